"""Hazard list, filters, lookups and scoped reads.

Only active filters become predicates, so Catalyst sees plain comparisons
that reach the parquet scan; blank inputs add nothing (no catch-all
``(p IS NULL OR col = p)`` terms).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import schemas as S
from . import scope as V

LIST_COLUMNS = ("hazard_id", "title", "description", "reported_by_user_id", "assigned_to_user_id",
                "status", "severity", "type", "created_at", "due_date",
                "reported_by_name", "assigned_to_name")
LOG_COLUMNS = ("hazard_log_id", "hazard_id", "action_type", "details", "performed_by_user_id",
               "performed_by_name", "created_at")


def _blank(v) -> bool:
    return v is None or (isinstance(v, str) and v == "")


@dataclass(frozen=True)
class HazardFilter:
    """Optional list filters; None or '' disables one."""

    search_text: str | None = None
    status: str | None = None
    severity: str | None = None
    type: str | None = None
    assigned_to_user_id: int | None = None
    overdue_only: bool = False
    from_date: dt.datetime | None = None
    to_date: dt.datetime | None = None

    @staticmethod
    def from_form(search_text=None, status=None, severity=None, type=None,
                  assigned_to_user_id=None, overdue_only=False, role=None) -> "HazardFilter":
        """what the list page sends. Search is trimmed, white space only is
        no search; the assignee filter is offered to officers only."""
        st = None if search_text is None or search_text.strip() == "" else search_text.strip()
        officer = V.canonical_role_value(role) == S.ROLE_SAFETY_OFFICER if role is not None else True
        return HazardFilter(
            search_text=st,
            status=None if _blank(status) else status,
            severity=None if _blank(severity) else severity,
            type=None if _blank(type) else type,
            assigned_to_user_id=assigned_to_user_id if officer else None,
            overdue_only=bool(overdue_only),
        )


# F1 -------------------------------------------------------------------------
def like_pattern(search_text: str) -> str:
    """'%text%' with live % and _ wildcards; backslash is Spark's LIKE escape
    character and is doubled so it matches itself."""
    return "%" + search_text.replace("\\", "\\\\") + "%"


def tsql_like_regex(pattern: str) -> str:
    """A T-SQL LIKE pattern as a Java regex (full match): % and _ are
    wildcards and [...] / [^...] are character classes, inside which % and _
    are literal. Used when the search text holds '['."""
    import re
    out, i, n = ["(?s)^"], 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        elif ch == "[" and "]" in pattern[i + 1:]:
            j = pattern.index("]", i + 1)
            body = pattern[i + 1:j]
            neg = body.startswith("^")
            body = body[1:] if neg else body
            parts = []
            for k, c in enumerate(body):
                if c == "-" and 0 < k < len(body) - 1:
                    parts.append("-")
                else:
                    parts.append(re.escape(c))
            out.append("[" + ("^" if neg else "") + "".join(parts) + "]")
            i = j
        else:
            out.append(re.escape(ch))
        i += 1
    out.append("$")
    return "".join(out)


def search_predicate(search_text: str) -> Column:
    if "[" in search_text:
        rx = tsql_like_regex("%" + search_text.lower() + "%")
        return (F.coalesce(F.lower(F.col("title")).rlike(rx), F.lit(False))
                | F.coalesce(F.lower(F.col("description")).rlike(rx), F.lit(False)))
    pat = like_pattern(search_text).lower()
    return (F.coalesce(F.lower(F.col("title")).like(pat), F.lit(False))
            | F.coalesce(F.lower(F.col("description")).like(pat), F.lit(False)))


def filter_search(df: DataFrame, search_text: str | None) -> DataFrame:
    return df if _blank(search_text) else df.where(search_predicate(search_text))


# F2-F5 ----------------------------------------------------------------------
def same_text(column: str, value: str, domain: tuple[str, ...]) -> Column:
    """Equality without case and trailing spaces. Stored states are canonical, so
    a value of the domain is a plain comparison that reaches the scan."""
    plain = value.rstrip(" ").lower()
    for v in domain:
        if v.lower() == plain:
            return F.col(column) == F.lit(v)
    return F.lower(F.rtrim(F.col(column))) == F.lit(plain)


def filter_status(df: DataFrame, status: str | None) -> DataFrame:
    return df if _blank(status) else df.where(same_text("status", status, S.STATUSES))


def filter_severity(df: DataFrame, severity: str | None) -> DataFrame:
    return df if _blank(severity) else df.where(same_text("severity", severity, S.SEVERITIES))


def filter_type(df: DataFrame, htype: str | None) -> DataFrame:
    return df if _blank(htype) else df.where(same_text("type", htype, S.TYPES))


def filter_assignee(df: DataFrame, user_id: int | None) -> DataFrame:
    return df if user_id is None else df.where(F.col("assigned_to_user_id") == F.lit(user_id))


# F6 / F7 --------------------------------------------------------------------
def overdue_predicate(now: dt.datetime) -> Column:
    return (F.col("due_date").isNotNull() & (F.col("due_date") < F.lit(now).cast("timestamp_ntz"))
            & (F.col("status") != F.lit(S.STATUS_RESOLVED)))


def filter_overdue(df: DataFrame, now: dt.datetime, overdue_only: bool = True) -> DataFrame:
    return df.where(overdue_predicate(now)) if overdue_only else df


def filter_created_range(df: DataFrame, from_date: dt.datetime | None, to_date: dt.datetime | None) -> DataFrame:
    if from_date is not None:
        df = df.where(F.col("created_at") >= F.lit(from_date).cast("timestamp_ntz"))
    if to_date is not None:
        df = df.where(F.col("created_at") <= F.lit(to_date).cast("timestamp_ntz"))
    return df


# F11 ------------------------------------------------------------------------
def filter_title_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Titles that begin with ``prefix``, without case."""
    return df.where(F.lower("title").startswith(F.lit(prefix.lower())))


def apply_filter(df: DataFrame, f: HazardFilter, now: dt.datetime) -> DataFrame:
    df = filter_search(df, f.search_text)
    df = filter_status(df, f.status)
    df = filter_severity(df, f.severity)
    df = filter_type(df, f.type)
    df = filter_assignee(df, f.assigned_to_user_id)
    df = filter_overdue(df, now, f.overdue_only)
    return filter_created_range(df, f.from_date, f.to_date)


# J1-J3 ----------------------------------------------------------------------
def _names(users: DataFrame, id_col: str, name_col: str) -> DataFrame:
    return users.select(F.col("user_id").alias(id_col), F.col("full_name").alias(name_col))


def join_reporter(hazards: DataFrame, users: DataFrame) -> DataFrame:
    """Inner join: hazards with an unknown reporter drop out, as in the list."""
    return hazards.join(_names(users, "reported_by_user_id", "reported_by_name"), "reported_by_user_id", "inner")


def join_assignee(hazards: DataFrame, users: DataFrame) -> DataFrame:
    return hazards.join(_names(users, "assigned_to_user_id", "assigned_to_name"), "assigned_to_user_id", "left")


def join_log_performer(logs: DataFrame, users: DataFrame) -> DataFrame:
    return logs.join(_names(users, "performed_by_user_id", "performed_by_name"), "performed_by_user_id", "inner")


def with_names(hazards: DataFrame, users: DataFrame) -> DataFrame:
    return join_assignee(join_reporter(hazards, users), users).select(*LIST_COLUMNS)


# F8 + O1 --------------------------------------------------------------------
def hazard_list(hazards: DataFrame, users: DataFrame, viewer_id: int, role: str | None,
                f: HazardFilter, now: dt.datetime, ordered: bool = True) -> DataFrame:
    """Main list: scope, active filters, reporter and assignee names, newest
    first (ties broken by id, newest first)."""
    df = apply_filter(V.scope(hazards, viewer_id, role), f, now)
    out = with_names(df, users)
    return out.orderBy(F.col("created_at").desc(), F.col("hazard_id").desc()) if ordered else out


def for_viewers(df: DataFrame, viewers) -> DataFrame:
    """Rows of ``df`` (hazard columns) once per viewer whose scope holds them,
    with ``viewer_id``; one pass over ``df`` for any number of viewers."""
    flags = F.array(*[F.struct(F.lit(uid).alias("viewer_id"), V.scope_predicate(uid, role).alias("ok"))
                      for uid, role in viewers])
    out = df.select("*", F.explode(flags).alias("_v")).where(F.col("_v.ok"))
    return out.select(F.col("_v.viewer_id").alias("viewer_id"), *df.columns)


# F10 + O3 -------------------------------------------------------------------
def users_by_role(users: DataFrame, role: str | None) -> DataFrame:
    if _blank(role):
        return users.where(F.lit(False)).select("user_id", "user_name", "full_name", "role")
    return (users.where(F.col("is_active") & same_text("role", role, S.ROLES))
            .select("user_id", "user_name", "full_name", "role")
            .orderBy("full_name", "user_id"))


# J4-J6 ----------------------------------------------------------------------
def performer_role(df: DataFrame, users: DataFrame, id_col: str = "performed_by_user_id",
                   out_col: str = "performer_role") -> DataFrame:
    """Trimmed role of an active user, NULL when unknown or inactive
    (NULL means Unauthorized in the write checks)."""
    au = users.where(F.col("is_active")).select(
        F.col("user_id").alias("_pr_id"), T.canonical_role(F.trim(F.col("role"))).alias(out_col))
    return df.join(au, df[id_col] == au["_pr_id"], "left").drop("_pr_id")


def active_managers(users: DataFrame) -> DataFrame:
    return users.where(F.col("is_active") & (T.canonical_role(F.trim(F.col("role"))) == F.lit(S.ROLE_SITE_MANAGER))).select("user_id")


def semi_eligible_assignee(df: DataFrame, users: DataFrame, col: str = "assign_to_user_id") -> DataFrame:
    """Rows whose target is an active site manager."""
    m = active_managers(users).withColumnRenamed("user_id", "_ea_id")
    return df.join(m, df[col] == m["_ea_id"], "left_semi")


def semi_active_reporter(df: DataFrame, users: DataFrame, col: str = "reported_by_user_id") -> DataFrame:
    a = users.where(F.col("is_active")).select(F.col("user_id").alias("_ar_id"))
    return df.join(a, df[col] == a["_ar_id"], "left_semi")


# J8 / J9 --------------------------------------------------------------------
def requested_hazards(requests: DataFrame, hazards: DataFrame, users: DataFrame) -> DataFrame:
    """The hazards that any of ``requests`` asks for, with names, each once however many requests there
    are: texts are joined and shuffled per hazard, not per request."""
    asked = requests.select(F.col("hazard_id").alias("_rq_hazard")).distinct().hint("merge")
    return with_names(hazards.join(asked, F.col("hazard_id") == F.col("_rq_hazard"), "left_semi"), users)


def _judged(requests: DataFrame) -> tuple[DataFrame, Column]:
    """The requests' narrow rows, and whether the one joined to a hazard may read it."""
    rq = requests.select("request_id", F.col("hazard_id").alias("_rq_hazard"), F.col("user_id").alias("viewer_id"),
                         F.col("role").alias("_rq_role"))
    return rq, V.access_expr(F.col("_rq_role"), F.col("viewer_id"), F.col("reported_by_user_id"),
                             F.col("assigned_to_user_id"), F.col("status"))


def answers(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """(request_id, viewer_id, ``rows``' columns): each request beside the row of the hazard it asks for, if
    it may read it. ``rows`` hold a hazard's id, state and whatever the answer needs; a wide row meets
    its requests in the join that ends the query, and is not shuffled behind it."""
    rq, acc = _judged(requests)
    j = rq.join(rows, F.col("_rq_hazard") == F.col("hazard_id"), "inner").where(acc)
    return j.select("request_id", "viewer_id", *rows.columns)


def answered(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of ``rows`` (as in ``answers``) that at least one request may read, as they are."""
    rq, acc = _judged(requests)
    return rows.join(rq, (F.col("_rq_hazard") == F.col("hazard_id")) & acc, "left_semi")


def hazard_detail(requests: DataFrame, hazards: DataFrame, users: DataFrame) -> DataFrame:
    """Batch of scoped by-id reads: requests (request_id, hazard_id, user_id,
    role). A denied request returns no row, the same as a missing hazard.
    The hazards are joined once: access is judged on the joined row."""
    return answers(requests, requested_hazards(requests, hazards, users))


def scoped_logs(logs: DataFrame, hazards: DataFrame, users: DataFrame, viewers) -> DataFrame:
    """J9 for a set of viewers [(user_id, role)]: every log of every hazard the
    viewer may read. Logs are joined to their hazard and to the performer's
    name once; one pass then emits a row per viewer that may read the log
    (an array of one access flag per viewer, exploded and filtered)."""
    h = V.hazard_state(hazards)
    lh = join_log_performer(logs, users)
    lh = lh.join(h, lh["hazard_id"] == h["h_hazard_id"], "left")
    flags = F.array(*[
        F.struct(F.lit(uid).alias("viewer_id"),
                 V.access_expr(F.lit(role), F.lit(uid), F.col("h_reporter"), F.col("h_assignee"),
                               F.col("h_status")).alias("ok"))
        for uid, role in viewers])
    out = lh.select(*LOG_COLUMNS, F.explode(flags).alias("_v")).where(F.col("_v.ok"))
    return out.select(F.col("_v.viewer_id").alias("viewer_id"), *LOG_COLUMNS)


def hazard_history(logs: DataFrame, hazards: DataFrame, users: DataFrame, hazard_id: int,
                   viewer_id: int, role: str | None) -> DataFrame:
    """One request: logs of one hazard if accessible, newest first; denied
    gives zero rows with the same schema."""
    one = logs.where(F.col("hazard_id") == F.lit(hazard_id))
    return (scoped_logs(one, hazards, users, [(viewer_id, role)]).drop("viewer_id")
            .orderBy(F.col("created_at").desc(), F.col("hazard_log_id").desc()))


# J10 ------------------------------------------------------------------------
def user_by_name(requests: DataFrame, users: DataFrame, name_col: str = "user_name") -> DataFrame:
    """Lookup of users by name for a table of requests; the key is trimmed and
    compared ignoring case, blank keys find nothing. Secrets are never read."""
    key = F.lower(F.trim(F.col(name_col)))
    req = requests.withColumn("_key", key).where(F.col("_key") != F.lit(""))
    u = users.select(F.lower(F.col("user_name")).alias("_key"), F.col("user_id"),
                     F.col("user_name").alias("found_user_name"), "full_name", "role", "is_active")
    return req.join(u, "_key", "inner").drop("_key")
