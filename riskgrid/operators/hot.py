"""Keys whose rows are more than one task should fold.

A key is hot when it has more than ``WORK_ROWS`` rows: a bound on one task's
work that does not depend on the size of the table. Counting is one partial-
aggregated pass; the keys stay a DataFrame and flag rows by a join, so there
may be any number of them. Hot keys take the split (parallel) path of a fold,
the rest the plain one, and both paths give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORK_ROWS = 100_000


def hot_keys(df: DataFrame, keys: list[str], work_rows: int = WORK_ROWS) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > F.lit(work_rows)).select(*keys)


def flag_hot(df: DataFrame, hot: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with a boolean column that is never NULL; NULL keys match NULL keys."""
    side = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(True).alias("_is_hot"))
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
        cond = c if cond is None else cond & c
    return (df.join(side, cond, "left").withColumn(name, F.coalesce("_is_hot", F.lit(False)))
            .drop("_is_hot", *[f"_hot_{k}" for k in keys]))
