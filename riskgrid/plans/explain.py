"""Physical-plan summary of registered queries.

    python -m riskgrid.plans.explain <sf_dir> [name ...]

For each query: shuffles, broadcasts, scans with their pushed filters and
read schema, and Python stages, taken from ``explain("formatted")``.
"""

from __future__ import annotations

import contextlib
import io
import re
import sys


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarize(text: str) -> dict:
    tree = text.split("\n\n")[0]
    return {
        "shuffles": len(re.findall(r"(?<![A-Za-z])Exchange\b", tree)),
        "broadcasts": len(re.findall(r"BroadcastExchange", tree)),
        "reused": len(re.findall(r"ReusedExchange", tree)),
        "scans": len(re.findall(r"Scan parquet", tree)),
        "python": len(re.findall(r"MapInPandas|MapInArrow|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython", tree)),
        "pushed": sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", text))),
        "read_schemas": sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", text))),
    }


def main() -> None:
    from riskgrid.plans.queries import QUERIES
    from riskgrid.session import local_session
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or sorted(QUERIES)
    spark = local_session()
    for n in names:
        s = summarize(plan_text(QUERIES[n](spark, sf_dir)))
        print(f"## {n}\nshuffles={s['shuffles']} broadcasts={s['broadcasts']} reused={s['reused']} "
              f"scans={s['scans']} python={s['python']}")
        for p in s["pushed"]:
            print(f"  pushed: {p}")
        for r in s["read_schemas"]:
            print(f"  read:   {r}")


if __name__ == "__main__":
    main()
