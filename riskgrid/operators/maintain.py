"""Grants (V3) and dashboards of all users (A6) kept current after changes.

Both are sums over hazards, so a change needs only the rows it touches: what
the old rows gave is taken back and what the new rows give is added. The old
table of results is read once and merged; hazards that did not change are
not read, but for those whose due date the clock has passed since
(``passed_due``, a range filter that reaches a stored register's scan).

The results equal ``visible_grants`` and ``dashboard_all_*`` over the hazards
after the change, as long as the users are the same.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import commands as W
from . import dashboard as A
from . import listing as L
from . import scope as V

COUNTED = ("hazard_id", "reported_by_user_id", "assigned_to_user_id", "status", "severity", "type", "due_date")


def changes(commands: DataFrame, users: DataFrame, hazards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old, new) rows of the hazards that a command batch touches; a created
    hazard has no old row. The fold is checkpointed once, as in ``apply``."""
    from .apply_split import fold_auto
    folded = fold_auto(commands, users, hazards).checkpoint(eager=True)
    new = folded.where(F.col("row_type") == "state").select(*COUNTED)
    made = W.created_rows(W.validate_creates(commands, users, hazards), None)
    old = hazards.select(*COUNTED).join(new.select("hazard_id"), "hazard_id", "left_semi")
    return old, new.unionByName(made.select(*COUNTED))


def passed_due(hazards: DataFrame, old: DataFrame, then: dt.datetime, now: dt.datetime) -> DataFrame:
    """Untouched hazards that are overdue at one of the two times only."""
    low, high = (F.lit(t).cast("timestamp_ntz") for t in sorted((then, now)))
    due = hazards.select(*COUNTED).where((F.col("due_date") >= low) & (F.col("due_date") < high) & L.overdue_predicate(max(then, now)))
    return due.join(old.select("hazard_id"), "hazard_id", "left_anti")


def grants(current: DataFrame, users: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """V3 after the change: a related grant goes or comes only where the old and the new row differ in it."""
    def related(rows: DataFrame, sign: int) -> DataFrame:
        return V.visible_grants(users, rows).where(F.col("grant") == V.GRANT_RELATED).withColumn("sign", F.lit(sign))

    moved = (related(old, -1).unionByName(related(new, 1)).groupBy("user_id", "role", "hazard_id", "grant")
             .agg(F.sum("sign").alias("sign")))
    gone = moved.where("sign < 0").select("user_id", "hazard_id")
    return (current.join(gone, ["user_id", "hazard_id"], "left_anti").select("user_id", "role", "hazard_id", "grant")
            .unionByName(moved.where("sign > 0").drop("sign")))


def kpi(current: DataFrame, users: DataFrame, old: DataFrame, new: DataFrame, then: dt.datetime, now: dt.datetime,
        passed: DataFrame | None = None) -> DataFrame:
    """A6's counts, right at ``then``, made right at ``now`` after the change.

    ``passed`` (see ``passed_due``) may be left out where the times are equal."""
    gone, come = (old, new) if passed is None else (old.unionByName(passed), new.unionByName(passed))
    back = A.dashboard_all_kpi(users, gone, then).select("user_id", "role", *[(-F.col(c)).alias(c) for c in A.KPI_COLUMNS])
    parts = current.unionByName(back).unionByName(A.dashboard_all_kpi(users, come, now))
    return parts.groupBy("user_id", "role").agg(*[F.sum(c).alias(c) for c in A.KPI_COLUMNS])


def breakdown(current: DataFrame, users: DataFrame, old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """A6's buckets of one column after the change; empty buckets are absent."""
    back = A.dashboard_all_breakdown(users, old, column).withColumn("count", -F.col("count"))
    parts = current.unionByName(back).unionByName(A.dashboard_all_breakdown(users, new, column))
    return parts.groupBy("user_id", "key").agg(F.sum("count").alias("count")).where("count > 0")
