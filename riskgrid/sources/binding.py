"""Register tables derived from the driver's parquet tables.

The driver ships TPC-H-like tables; the register (users, hazards, logs,
attachments, change commands, login events) is a column mapping over them.
``derive`` builds each table as a lazy DataFrame (pruning and filters reach
the source scans); nothing is written by a query. ``materialize`` stores the
register on request, sorted on lookup keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S

# Fixed constants of the test binding (viewers and the clock of every query).
NOW = dt.datetime(1998, 7, 1, 12, 0, 0)
VIEWER_OFFICER = 10
VIEWER_MANAGER = 11
VIEWER_WORKER = 14
LOCKOUT_MAX_FAILURES = 3
LOCKOUT_WINDOW = dt.timedelta(days=7)
LOCKOUT_BLOCK = dt.timedelta(days=2)
ATTACHMENT_UPLOADED_AT = dt.datetime(2024, 1, 1, 0, 0, 0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(key: Column, pairs, default=None) -> Column:
    expr = None
    for k, v in pairs:
        expr = (F.when(key == F.lit(k), v) if expr is None else expr.when(key == F.lit(k), v))
    return expr.otherwise(default) if default is not None else expr


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    role = (F.when(k % 100 == 99, F.lit("Auditor"))
            .when(k % 10 == 0, F.lit(S.ROLE_SAFETY_OFFICER))
            .when((k % 10).isin(1, 2, 3), F.lit(S.ROLE_SITE_MANAGER))
            .otherwise(F.lit(S.ROLE_FIELD_WORKER)))
    return c.select(
        k.cast("long").alias("user_id"),
        F.concat(F.lit("user"), k.cast("string")).alias("user_name"),
        F.col("c_name").alias("full_name"),
        role.alias("role"),
        (~(k % 20).isin(7, 13)).alias("is_active"),
    )


def hazards(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """All hazards, or those whose hazard_id is in ``asked``: chosen before texts are joined."""
    o = read(spark, sf_dir, "orders")
    if asked is not None:
        ids = asked.select(F.col("hazard_id").alias("_asked")).distinct().hint("merge")
        o = o.join(ids, F.col("o_orderkey").cast("long") == F.col("_asked"), "left_semi")
    # An order's document: its key modulo the number of documents, where there is one with
    # that id (else, no description). One text per id (the greatest, should an id repeat), so a
    # query that reads no description needs no join: the planner leaves it out.
    docs = read(spark, sf_dir, "documents")
    # Where there is a join, it is a merge join: texts are no broadcast side at scale, and rows that
    # grow by a whole text each are better spread than kept in the few partitions of the narrow table.
    d = docs.groupBy("doc_id").agg(F.max("text").alias("doc_text")).hint("merge")
    n_docs = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    k = F.col("o_orderkey")
    j = o.withColumn("_doc", k % n_docs).join(d, F.col("_doc") == F.col("doc_id"), "left")
    title = F.concat(
        F.when(k % 25 == 0, F.lit("Demo: ")).otherwise(F.lit("")),
        _case(k % 4, [(0, F.lit("Loose rail")), (1, F.lit("Wet floor, level 2")),
                      (2, F.lit('Sign "EXIT" missing'))], F.lit("Blocked aisle")),
        F.lit(" #"), k.cast("string"))
    lead = _case(k % 7, [(0, F.lit("Smoke seen. ")), (1, F.lit("Electrical panel open. ")),
                         (2, F.lit("Gas smell. ")), (3, F.lit("Forklift leaking. ")),
                         (4, F.lit("ריח עשן. ")), (5, F.lit(""))], F.lit("Tripping risk. "))
    description = F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(lead, F.col("doc_text")))
    assignee = (F.when(k % 4 == 0, F.lit(None).cast("bigint"))
                .when(k % 4 == 1, F.col("o_custkey"))
                .otherwise(10 * (k % 15) + 1)).cast("long")
    status = _case(F.col("o_orderstatus"), [("O", F.lit(S.STATUS_OPEN)),
                                            ("P", F.lit(S.STATUS_IN_PROGRESS))],
                   F.lit(S.STATUS_RESOLVED))
    severity = _case(F.col("o_orderpriority"), [("1-URGENT", F.lit("Critical")), ("2-HIGH", F.lit("High")),
                                                ("3-MEDIUM", F.lit("Medium"))], F.lit("Low"))
    htype = F.when(k % 97 == 0, F.lit("Legacy")).otherwise(
        _case(k % 6, [(0, F.lit("Fire")), (1, F.lit("Electrical")), (2, F.lit("Chemical")),
                      (3, F.lit("Equipment")), (4, F.lit("Physical"))], F.lit("General")))
    due = F.when(k % 5 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(
        F.col("o_orderdate") + F.make_dt_interval(days=(k % 90).cast("int")))
    return j.select(
        k.cast("long").alias("hazard_id"),
        title.alias("title"),
        description.alias("description"),
        F.col("o_custkey").cast("long").alias("reported_by_user_id"),
        assignee.alias("assigned_to_user_id"),
        status.alias("status"),
        severity.alias("severity"),
        htype.alias("type"),
        F.col("o_orderdate").alias("created_at"),
        due.alias("due_date"),
    )


def _event_kind(names) -> Column:
    et = F.col("event_type")
    return _case(et, list(zip(("signup", "error", "purchase", "click"), [F.lit(n) for n in names[:4]])),
                 F.lit(names[4]))


def hazard_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    et = F.col("event_type")
    details = (F.when(et == "view", F.col("props"))
               .when(et == "click", F.lit("Open -> InProgress"))
               .otherwise(F.lit("")))
    return e.select(
        F.col("event_id").cast("long").alias("hazard_log_id"),
        ((F.col("event_id") * 7) % 300).cast("long").alias("hazard_id"),
        _event_kind(S.ACTIONS).alias("action_type"),
        details.alias("details"),
        F.col("user_id").cast("long").alias("performed_by_user_id"),
        F.col("ts").alias("created_at"),
    )


def hazard_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    pid = F.col("page_id")
    return p.select(
        pid.cast("long").alias("attachment_id"),
        ((pid * 13) % 300).cast("long").alias("hazard_id"),
        F.col("url").alias("file_name"),
        F.lit("text/html").alias("content_type"),
        F.length("html").cast("int").alias("file_size_bytes"),
        F.lit(None).cast("string").alias("storage_path"),
        F.when(pid % 3 == 0, F.lit(None).cast("long")).otherwise((pid % 15).cast("long"))
        .alias("uploaded_by_user_id"),
        F.lit(ATTACHMENT_UPLOADED_AT).cast("timestamp_ntz").alias("uploaded_at"),
    )


def hazard_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    eid = F.col("event_id")
    uid = F.col("user_id").cast("long")
    return e.select(
        eid.alias("command_id"),
        F.col("ts").alias("command_ts"),
        _event_kind(("create", "update", "assign", "change_status", "comment")).alias("kind"),
        F.when(eid % 50 == 0, F.lit(-1).cast("long")).otherwise(((eid * 7) % 300).cast("long")).alias("hazard_id"),
        F.when(eid % 41 == 0, F.lit(99)).otherwise(uid).alias("performed_by_user_id"),
        _case(eid % 5, [(0, F.lit("Open")), (1, F.lit("InProgress")), (2, F.lit(" Resolved ")),
                        (3, F.lit("Closed"))], F.lit(None).cast("string")).alias("new_status"),
        _case(eid % 4, [(0, F.lit(None).cast("long")), (1, uid), (2, F.lit(1).cast("long"))], F.lit(5).cast("long"))
        .alias("assign_to_user_id"),
        _case(eid % 3, [(0, F.lit(None).cast("string")), (1, F.lit(""))], F.col("props"))
        .alias("details"),
        _case(eid % 6, [(0, F.lit(13).cast("long")), (1, F.lit(4).cast("long"))], uid).alias("reported_by_user_id"),
        F.when(eid % 17 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Reported item "), eid.cast("string"))).alias("title"),
        F.col("props").alias("description"),
        _case(eid % 4, [(0, F.lit(None).cast("string")), (1, F.lit("Low")), (2, F.lit("High"))],
              F.lit("Critical")).alias("severity"),
        _case(eid % 3, [(0, F.lit(None).cast("string")), (1, F.lit("Fire"))], F.lit("Physical"))
        .alias("type"),
        F.when(eid % 2 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("ts")).alias("due_date"),
    )


def login_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("login_id"),
        F.col("ts"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 4).cast("string")).alias("ip"),
        F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("user_name"),
        (F.col("event_type") != "error").alias("success"),
    )


@dataclass
class Register:
    """The register tables of one dataset, as lazy DataFrames."""

    users: DataFrame
    hazards: DataFrame
    hazard_logs: DataFrame
    hazard_attachments: DataFrame
    hazard_commands: DataFrame
    login_events: DataFrame
    choose: Callable[[DataFrame], DataFrame] | None = None

    def hazards_of(self, asked: DataFrame) -> DataFrame:
        """The hazards for a job on ``asked`` (hazard_id): where they are derived, no others' texts are
        joined; stored ones are left to the job's own join."""
        return self.hazards if self.choose is None else self.choose(asked)


def derive(spark: SparkSession, sf_dir: str) -> Register:
    """The register computed from the driver's tables (lazy)."""
    return Register(
        users=users(spark, sf_dir),
        hazards=hazards(spark, sf_dir),
        hazard_logs=hazard_logs(spark, sf_dir),
        hazard_attachments=hazard_attachments(spark, sf_dir),
        hazard_commands=hazard_commands(spark, sf_dir),
        login_events=login_events(spark, sf_dir),
        choose=lambda asked: hazards(spark, sf_dir, asked),
    )


# Sort keys of the stored register: parquet min/max statistics on these
# columns let id lookups and time ranges skip row groups.
STORE_ORDER = {
    "users": ("user_id",),
    "hazards": ("hazard_id",),
    "hazard_logs": ("hazard_id", "created_at", "hazard_log_id"),
    "hazard_attachments": ("hazard_id", "attachment_id"),
    "hazard_commands": ("command_ts", "command_id"),
    "login_events": ("ts", "login_id"),
}
TABLE_NAMES = tuple(STORE_ORDER)
ROOT_CONF = "riskgrid.register.root"


def store(reg: Register, root: str) -> int:
    """Write the register as one committed version, each table range-
    partitioned and sorted on its lookup key."""
    from . import sinks
    tables = {}
    for name in TABLE_NAMES:
        df = getattr(reg, name)
        keys = STORE_ORDER[name]
        tables[name] = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return sinks.write_version(tables, root)


def materialize(spark: SparkSession, sf_dir: str, root: str) -> int:
    """Derive the register of one dataset and store it under ``root``.

    An explicit step of the caller, who sets ``riskgrid.register.root`` to
    serve queries from the stored tables and stores again when sources change."""
    return store(derive(spark, sf_dir), root)


def load(spark: SparkSession, sf_dir: str) -> Register:
    """The register of one dataset: derived lazily from the driver's tables, or
    read from the tables that ``materialize`` stored, where the session names
    their folder in ``riskgrid.register.root``."""
    root = spark.conf.get(ROOT_CONF, None)
    if not root:
        return derive(spark, sf_dir)
    from . import sinks
    version = sinks.current_version(spark, root)
    return Register(*(sinks.read_table(spark, root, n, version) for n in TABLE_NAMES))


def canonical(df: DataFrame) -> DataFrame:
    """Stored states in canonical spelling (texts compare without case, and
    without trailing spaces); values outside the domains stay as they are."""
    from ..functions import text as T
    for name, fn in (("status", T.canonical_status), ("severity", T.canonical_severity), ("type", T.canonical_type),
                     ("role", T.canonical_role)):
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(fn(F.rtrim(F.col(name))), F.col(name)))
    return df


def from_parquet(spark: SparkSession, root: str) -> Register:
    """Register stored as parquet tables under ``root`` with declared schemas;
    status, severity, type and role are brought to their canonical spelling."""
    def rd(name):
        return canonical(spark.read.schema(S.TABLES[name]).parquet(f"{root.rstrip('/')}/{name}"))
    return Register(*(rd(n) for n in ("users", "hazards", "hazard_logs", "hazard_attachments",
                                      "hazard_commands", "login_events")))
