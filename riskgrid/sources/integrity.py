"""Integrity checks the DDL would enforce and parquet does not.

* ``check_unique``: keys that occur more than once.
* ``check_foreign_keys``: non-NULL references without a parent row
  (one ``left_anti`` merge join per reference, violations counted per value).
* ``check_rows``: NOT NULL, declared length and value-domain rules, counted
  in one aggregation pass per table and unpivoted to one row per rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schemas as S

NOT_NULL = {
    "users": ("user_id", "user_name", "full_name", "role", "is_active"),
    "hazards": ("hazard_id", "title", "reported_by_user_id", "status", "severity", "type", "created_at"),
    "hazard_logs": ("hazard_log_id", "hazard_id", "action_type", "performed_by_user_id", "created_at"),
    "hazard_attachments": ("attachment_id", "hazard_id", "file_name", "uploaded_at"),
}
DOMAINS = {
    ("users", "role"): S.ROLES,
    ("hazards", "status"): S.STATUSES,
    ("hazards", "severity"): S.SEVERITIES,
    ("hazards", "type"): S.TYPES,
    ("hazard_logs", "action_type"): S.ACTIONS,
}


def rules(table: str) -> list[tuple[str, str, object]]:
    """(rule name, column, parameter) of one table, in a fixed order."""
    out = [(f"not_null:{c}", c, None) for c in NOT_NULL[table]]
    out += [(f"max_len:{c}", c, n) for (t, c), n in S.MAX_LEN.items() if t == table]
    out += [(f"domain:{c}", c, vals) for (t, c), vals in DOMAINS.items() if t == table]
    return out


def check_rows(tables: dict[str, DataFrame]) -> DataFrame:
    parts = []
    for name in NOT_NULL:
        df = tables[name]
        aggs = []
        for rule, col, p in rules(name):
            c = F.col(col)
            if rule.startswith("not_null"):
                cond = c.isNull()
            elif rule.startswith("max_len"):
                cond = F.length(c) > F.lit(p)
            else:
                cond = c.isNotNull() & ~c.isin(*p)
            aggs.append(F.count_if(cond).alias(rule))
        wide = df.agg(*aggs)
        parts.append(wide.unpivot([], [r for r, _, _ in rules(name)], "rule", "violations")
                     .select(F.lit(name).alias("table_name"), "rule", "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_unique(tables: dict[str, DataFrame]) -> DataFrame:
    parts = []
    for name, keys in S.UNIQUE_KEYS:
        df = tables[name]
        # Names are unique without case, as in the reference's collation.
        by = [F.lower(F.col(k)).alias(k) if df.schema[k].dataType.simpleString() == "string" else F.col(k) for k in keys]
        g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        parts.append(g.select(F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
                              F.concat_ws(",", *[F.col(k).cast("string") for k in keys]).alias("key_value"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    parts = []
    for child, col, parent, pcol in S.FOREIGN_KEYS:
        c = tables[child].where(F.col(col).isNotNull()).select(F.col(col).alias("_k"))
        # A parent's keys are a table of their own size: merged, never collected on the driver (a file's
        # size says little about the rows of one column of it).
        p = tables[parent].select(F.col(pcol).alias("_k")).hint("merge")
        # Counted first: the join sees one row per key, however often it is used.
        bad = c.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).join(p, "_k", "left_anti")
        parts.append(bad.select(F.lit(child).alias("child_table"), F.lit(col).alias("fk_column"),
                                F.lit(parent).alias("parent_table"), F.col("_k").cast("string").alias("key_value"),
                                "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
