"""Run registered Spark queries next to their DuckDB oracle and compare
row count, column names and an order-insensitive hash of the values.

    python -m tests.oracle_compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_norm(k)}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return [cols[i] for i in order], len(rows), h, lines


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as entry
    queries, sql = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    names = names or list(sql)
    results = {}
    for n in names:
        t0 = time.time()
        try:
            df = queries[n](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
            t1 = time.time()
            res = con.execute(sql[n])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
            sc, sn, sh, sl = digest(scols, srows)
            dc, dn, dh, dl = digest(dcols, drows)
            ok = sc == dc and sn == dn and sh == dh
            results[n] = ok
            if verbose:
                print(f"{'OK ' if ok else 'BAD'} {n}: rows {sn}/{dn} cols {'=' if sc == dc else (sc, dc)} "
                      f"spark {t1 - t0:.1f}s")
                if not ok and sc == dc:
                    a, b = set(sl), set(dl)
                    for x in list(a - b)[:3]:
                        print("   spark only:", x[:300])
                    for x in list(b - a)[:3]:
                        print("   duck  only:", x[:300])
        except Exception as e:  # report and continue
            results[n] = False
            if verbose:
                print(f"ERR {n}: {type(e).__name__}: {str(e)[:800]}")
    return results


if __name__ == "__main__":
    from riskgrid.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    r = compare(spark, sf, sys.argv[2:] or None)
    print(f"{sum(r.values())}/{len(r)} match")
