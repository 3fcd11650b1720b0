"""Dashboard aggregates.

Single-viewer dashboards are one pass over the scoped rows with grouping
sets. The all-users form never builds (user, hazard) pairs: per-user counts
come from the related edges (at most two per hazard) with a map-side partial
aggregate, and the rows every officer or manager shares ("all hazards", "the
unassigned Open pool") are aggregated once and attached as one scalar
subquery value.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import schemas as S
from . import listing as L
from . import scope as V

KPI_COLUMNS = ("total", "open_count", "in_progress_count", "resolved_count", "overdue_count")


def _kpi_aggs(now: dt.datetime, cond: Column | None = None) -> list[Column]:
    def cnt(c: Column | None) -> Column:
        full = c if cond is None else (cond if c is None else (cond & c))
        return F.count(F.lit(1)) if full is None else F.count_if(full)
    return [
        cnt(None).alias("total"),
        cnt(F.col("status") == F.lit(S.STATUS_OPEN)).alias("open_count"),
        cnt(F.col("status") == F.lit(S.STATUS_IN_PROGRESS)).alias("in_progress_count"),
        cnt(F.col("status") == F.lit(S.STATUS_RESOLVED)).alias("resolved_count"),
        cnt(L.overdue_predicate(now)).alias("overdue_count"),
    ]


# A1 -------------------------------------------------------------------------
def kpi(scoped: DataFrame, now: dt.datetime) -> DataFrame:
    """One row; an empty scope gives zeros (global aggregate, counts)."""
    return scoped.agg(*_kpi_aggs(now))


# A2 / A3 / O4 ---------------------------------------------------------------
def breakdown(scoped: DataFrame, column: str) -> DataFrame:
    return (scoped.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("key")))


# A4 -------------------------------------------------------------------------
def breakdown_percent(counts: DataFrame, query_key: str | None = None) -> DataFrame:
    """Percent of the largest bucket, rounded half to even. The max is taken
    over the already aggregated buckets as one scalar subquery."""
    mx = counts.agg(F.greatest(F.lit(1), F.coalesce(F.max("count"), F.lit(1)))).scalar()
    out = counts.withColumn("percent", F.bround(F.col("count") / mx * F.lit(100.0), 0).cast("int"))
    if query_key is not None:
        out = out.withColumn("link", T.drill_link(query_key, F.col("key")))
    return out.orderBy(F.col("count").desc(), F.col("key"))


# A5 -------------------------------------------------------------------------
def dashboard(scoped: DataFrame, now: dt.datetime) -> DataFrame:
    """KPI row and both breakdowns in one aggregation (grouping sets).

    One marker row is added so the KPI grouping set yields a row even for an
    empty scope (zeros); only real rows are counted, and the marker's own
    (empty) buckets are dropped."""
    cols = ("status", "severity", "type", "due_date")
    real = scoped.select(*cols, F.lit(True).alias("_real"))
    marker = scoped.sparkSession.createDataFrame(
        [(None, None, None, None, False)],
        "status string, severity string, type string, due_date timestamp_ntz, _real boolean")
    g = real.unionByName(marker).groupingSets(
        [[], [F.col("severity")], [F.col("type")]], F.col("severity"), F.col("type")).agg(
        *_kpi_aggs(now, F.col("_real")), F.grouping_id().alias("_gid"))
    section = (F.when(F.col("_gid") == 3, F.lit("kpi"))
               .when(F.col("_gid") == 1, F.lit("severity"))
               .otherwise(F.lit("type")))
    key = (F.when(F.col("_gid") == 1, F.col("severity"))
           .when(F.col("_gid") == 2, F.col("type")))
    return (g.select(section.alias("section"), key.alias("key"), *KPI_COLUMNS)
            .where((F.col("section") == "kpi") | (F.col("total") > 0)))


# A6 -------------------------------------------------------------------------
def _role_pick(role: Column, officer: Column, manager_rel: Column, manager_pool: Column,
               worker_rel: Column) -> Column:
    return (F.when(role == S.ROLE_SAFETY_OFFICER, officer)
            .when(role == S.ROLE_SITE_MANAGER, F.coalesce(manager_rel, F.lit(0)) + manager_pool)
            .when(role == S.ROLE_FIELD_WORKER, F.coalesce(worker_rel, F.lit(0)))
            .otherwise(F.lit(0))).cast("bigint")


def dashboard_all_kpi(users: DataFrame, hazards: DataFrame, now: dt.datetime) -> DataFrame:
    """KPI row of every active user, equal to ``kpi(scope(u))`` for each u."""
    edges = V.related_edges(hazards, "status", "due_date")
    not_pool = ~F.col("in_pool")
    rel = edges.groupBy("user_id").agg(
        *[c.alias(f"all_{n}") for c, n in zip(_kpi_aggs(now), KPI_COLUMNS)],
        *[c.alias(f"np_{n}") for c, n in zip(_kpi_aggs(now, not_pool), KPI_COLUMNS)])
    shared = hazards.agg(
        F.struct(*_kpi_aggs(now)).alias("g"),
        F.struct(*_kpi_aggs(now, V.in_pool())).alias("p"),
    ).select(F.struct("g", "p")).scalar()
    au = V.active_users(users)
    j = au.join(rel, "user_id", "left")
    return j.select(
        "user_id", "role",
        *[_role_pick(F.col("role"), shared["g"][n], F.col(f"np_{n}"), shared["p"][n], F.col(f"all_{n}")).alias(n)
          for n in KPI_COLUMNS])


def dashboard_all_breakdown(users: DataFrame, hazards: DataFrame, column: str) -> DataFrame:
    """(user_id, key, count) of every active user for one breakdown column;
    buckets with no rows are absent, as in the single-viewer breakdown."""
    edges = V.related_edges(hazards, column)
    au = V.active_users(users)
    rel = (edges.groupBy("user_id", F.col(column).alias("key"))
           .agg(F.count(F.lit(1)).alias("all_cnt"), F.count_if(~F.col("in_pool")).alias("np_cnt"))
           .join(au, "user_id", "inner")
           .select("user_id", "key",
                   F.when(F.col("role") == S.ROLE_FIELD_WORKER, F.col("all_cnt"))
                   .when(F.col("role") == S.ROLE_SITE_MANAGER, F.col("np_cnt"))
                   .otherwise(F.lit(0)).cast("bigint").alias("count")))
    # Shared buckets: one row per role and key value, joined on the role; the
    # planner broadcasts them when they are small, and splits the users otherwise.
    per_key = hazards.groupBy(F.col(column).alias("key")).agg(
        F.count(F.lit(1)).alias("g"), F.count_if(V.in_pool()).alias("p"))
    by_role = per_key.select("key", F.explode(F.array(
        F.struct(F.lit(S.ROLE_SAFETY_OFFICER).alias("r"), F.col("g").alias("count")),
        F.struct(F.lit(S.ROLE_SITE_MANAGER).alias("r"), F.col("p").alias("count")))).alias("e")).select("key", "e.r", "e.count")
    shared = au.join(by_role, F.col("role") == F.col("r")).select("user_id", "key", "count")
    return (rel.unionByName(shared).groupBy("user_id", "key").agg(F.sum("count").cast("bigint").alias("count"))
            .where(F.col("count") > 0))


# A7 -------------------------------------------------------------------------
def drilldown_consistency(hazards: DataFrame, users: DataFrame, viewer_id: int, role: str,
                          now: dt.datetime) -> DataFrame:
    """Every dashboard bucket next to the size of the list its link opens.

    Buckets come from the scoped rows; the list side is the list query (scope,
    reporter join) grouped the same way, so each side is one aggregation
    with grouping sets (status, severity, type and the overdue flag)."""
    scoped = V.scope(hazards, viewer_id, role).withColumn(
        "_overdue", F.when(L.overdue_predicate(now), F.lit("1")))
    listed = L.with_names(V.scope(hazards, viewer_id, role), users).withColumn(
        "_overdue", F.when(L.overdue_predicate(now), F.lit("1")))
    dims = ("status", "severity", "type", "_overdue")

    def counts(df: DataFrame, name: str) -> DataFrame:
        # A marker row keeps the overdue bucket present (count 0) for scopes
        # without overdue hazards; only real rows are counted.
        marker = df.sparkSession.createDataFrame(
            [(None, None, None, "1", False)],
            "status string, severity string, type string, _overdue string, _real boolean")
        rows = df.select(*dims, F.lit(True).alias("_real")).unionByName(marker)
        g = rows.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
            F.count_if(F.col("_real")).alias(name), F.grouping_id().alias("_gid"))
        dim = F.when(F.col("_gid") == 7, F.lit("status")).when(F.col("_gid") == 11, F.lit("severity")) \
            .when(F.col("_gid") == 13, F.lit("type")).otherwise(F.lit("overdue"))
        key = F.coalesce(*[F.col(d) for d in dims])
        return g.select(dim.alias("dimension"), key.alias("key"), name).where(F.col("key").isNotNull())

    b, lc = counts(scoped, "bucket_count"), counts(listed, "list_count")
    out = b.join(lc, ["dimension", "key"], "left").select(
        "dimension", "key", "bucket_count", F.coalesce("list_count", F.lit(0)).alias("list_count"))
    return out.withColumn("consistent", F.col("bucket_count") == F.col("list_count"))
