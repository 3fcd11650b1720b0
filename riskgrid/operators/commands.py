"""Validated change commands (W1-W5, P9) and register maintenance.

A table of commands is judged against one snapshot of users and hazards:
each command gets the first failing check's result (OK, Unauthorized,
BadRequest, NotFound, Forbidden). The checks keep SQL's three-valued logic:
a NULL condition does not fail a check, exactly as ``IF NOT (...) RAISERROR``
does not raise. Users and hazards are joined once per role they play
(performer, target, reporter); the planner broadcasts users when its size
estimate allows and AQE splits hot keys otherwise.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import schemas as S
from ..sources import seed as SEED
from . import ids as I
from . import scope as V

OK, UNAUTH, BAD, NOTFOUND, FORBID = (S.RESULT_OK, S.RESULT_UNAUTHORIZED, S.RESULT_BAD_REQUEST,
                                     S.RESULT_NOT_FOUND, S.RESULT_FORBIDDEN)
KIND_CREATE, KIND_UPDATE, KIND_ASSIGN, KIND_STATUS, KIND_COMMENT = (
    "create", "update", "assign", "change_status", "comment")
WRITE_ROLES = (S.ROLE_SAFETY_OFFICER, S.ROLE_SITE_MANAGER, S.ROLE_FIELD_WORKER)


def user_facts(users: DataFrame) -> DataFrame:
    """One row per user: trimmed role if active (NULL otherwise), active flag
    and whether the user is an active site manager."""
    role = T.canonical_role(F.trim(F.col("role")))
    return users.select(
        "user_id",
        F.when(F.col("is_active"), role).alias("active_role"),
        F.col("is_active").alias("active"),
        (F.col("is_active") & (role == F.lit(S.ROLE_SITE_MANAGER))).alias("active_manager"),
    )


def with_context(commands: DataFrame, users: DataFrame, hazards: DataFrame) -> DataFrame:
    """Commands plus performer role (J6), hazard state, target and reporter facts."""
    uf = user_facts(users)
    perf = uf.select(F.col("user_id").alias("_p_id"), F.col("active_role").alias("role"))
    target = uf.select(F.col("user_id").alias("_t_id"), F.col("active_manager").alias("target_is_manager"))
    rep = uf.select(F.col("user_id").alias("_r_id"), F.col("active").alias("reporter_active"))
    h = V.hazard_state(hazards)
    c = commands
    j = (c.join(perf, c["performed_by_user_id"] == perf["_p_id"], "left")
         .join(h, c["hazard_id"] == h["h_hazard_id"], "left")
         .join(target, c["assign_to_user_id"] == target["_t_id"], "left")
         .join(rep, c["reported_by_user_id"] == rep["_r_id"], "left"))
    return j.drop("_p_id", "_t_id", "_r_id", "h_hazard_id")


def _chain(*steps: tuple[Column, str]) -> Column:
    expr = None
    for cond, res in steps:
        expr = F.when(cond, F.lit(res)) if expr is None else expr.when(cond, F.lit(res))
    return expr.otherwise(F.lit(OK))


def _cols():
    return (F.col("role"), F.col("performed_by_user_id"), F.col("h_reporter"), F.col("h_assignee"),
            F.col("h_status"))


# W1 -------------------------------------------------------------------------
def create_result() -> Column:
    role, p, _, _, _ = _cols()
    return _chain(
        (role.isNull(), UNAUTH),
        (~F.coalesce(F.col("reporter_active"), F.lit(False)), BAD),
        ((role == F.lit(S.ROLE_FIELD_WORKER)) & (F.col("reported_by_user_id") != p), FORBID),
        (~role.isin(*WRITE_ROLES), FORBID),
    )


# W2 -------------------------------------------------------------------------
def update_result() -> Column:
    role, p, r, a, s = _cols()
    return _chain(
        (role.isNull(), UNAUTH),
        (r.isNull(), NOTFOUND),
        (~role.isin(*WRITE_ROLES), FORBID),
        ((role == F.lit(S.ROLE_SITE_MANAGER)) & ~((a == p) | (a.isNull() & (s == F.lit(S.STATUS_OPEN)))), FORBID),
        ((role == F.lit(S.ROLE_FIELD_WORKER)) & ~((r == p) & a.isNull() & (s == F.lit(S.STATUS_OPEN))), FORBID),
    )


# W3 -------------------------------------------------------------------------
def assign_result() -> Column:
    role, p, _, a, s = _cols()
    t = F.col("assign_to_user_id")
    manager = role == F.lit(S.ROLE_SITE_MANAGER)
    return _chain(
        (role.isNull(), UNAUTH),
        (s.isNull(), NOTFOUND),
        (~role.isin(S.ROLE_SAFETY_OFFICER, S.ROLE_SITE_MANAGER), FORBID),
        ((role == F.lit(S.ROLE_SAFETY_OFFICER)) & t.isNotNull()
         & ~F.coalesce(F.col("target_is_manager"), F.lit(False)), FORBID),
        (manager & (t != p), FORBID),
        (manager & ~((s == F.lit(S.STATUS_OPEN)) & a.isNull()), FORBID),
    )


# W5 (checks after the performer's role) --------------------------------------
def _comment_steps() -> list[tuple[Column, str]]:
    role, p, r, a, s = _cols()
    return [
        (r.isNull(), NOTFOUND),
        ((role == F.lit(S.ROLE_FIELD_WORKER)) & ~((r == p) | (a == p)), FORBID),
        ((role == F.lit(S.ROLE_SITE_MANAGER))
         & ~((a == p) | (r == p) | ((s == F.lit(S.STATUS_OPEN)) & a.isNull())), FORBID),
        (~role.isin(*WRITE_ROLES), FORBID),
    ]


def comment_result() -> Column:
    role = F.col("role")
    return _chain((role.isNull(), UNAUTH), (T.is_blank(F.col("details")), BAD), *_comment_steps())


# W4 -------------------------------------------------------------------------
def new_status_value() -> Column:
    """Trimmed requested status in canonical spelling (unknown stays as is)."""
    return T.canonical_status(F.trim(F.col("new_status")))


def status_is_blank() -> Column:
    return T.is_blank(F.col("new_status"))


def change_status_result() -> Column:
    role, p, _, a, s = _cols()
    ns = new_status_value()
    blank = status_is_blank()
    comment_flow = _chain(*_comment_steps())
    status_flow = _chain(
        (~ns.isin(*S.STATUSES), BAD),
        (s.isNull(), NOTFOUND),
        ((role != F.lit(S.ROLE_SAFETY_OFFICER)) & (role != F.lit(S.ROLE_SITE_MANAGER)), FORBID),
        ((role != F.lit(S.ROLE_SAFETY_OFFICER)) & (a != p), FORBID),
        ((role != F.lit(S.ROLE_SAFETY_OFFICER))
         & ~(((s == F.lit(S.STATUS_OPEN)) & (ns == F.lit(S.STATUS_IN_PROGRESS)))
             | ((s == F.lit(S.STATUS_IN_PROGRESS)) & (ns == F.lit(S.STATUS_RESOLVED)))), FORBID),
    )
    return (F.when(role.isNull(), F.lit(UNAUTH))
            .when(blank & T.is_blank(F.col("details")), F.lit(BAD))
            .when(blank, comment_flow)
            .otherwise(status_flow))


def result_expr() -> Column:
    k = F.col("kind")
    return (F.when(k == KIND_CREATE, create_result())
            .when(k == KIND_UPDATE, update_result())
            .when(k == KIND_ASSIGN, assign_result())
            .when(k == KIND_STATUS, change_status_result())
            .when(k == KIND_COMMENT, comment_result())
            .otherwise(F.lit(BAD)))


def effect_expr() -> Column:
    """What an OK command writes: the log action it adds."""
    k = F.col("kind")
    return (F.when(k == KIND_CREATE, F.lit(S.ACTION_CREATED))
            .when(k == KIND_UPDATE, F.lit(S.ACTION_UPDATED))
            .when(k == KIND_ASSIGN, F.lit(S.ACTION_ASSIGNED))
            .when((k == KIND_STATUS) & ~status_is_blank(), F.lit(S.ACTION_STATUS_CHANGED))
            .otherwise(F.lit(S.ACTION_COMMENT)))


def validate(commands: DataFrame, users: DataFrame, hazards: DataFrame, keep_context: bool = False) -> DataFrame:
    """W1-W5 against one snapshot: every command with ``result`` and ``action``."""
    ctx = with_context(commands, users, hazards)
    out = ctx.withColumn("result", result_expr()).withColumn("action", effect_expr())
    if keep_context:
        return out
    return out.select(*commands.columns, "result", "action")


def max_id(df: DataFrame, col: str) -> Column:
    """Current maximum id as a scalar subquery (0 for an empty table)."""
    return df.agg(F.coalesce(F.max(col), F.lit(0)).cast("long")).scalar()


def validate_creates(commands: DataFrame, users: DataFrame, hazards: DataFrame) -> DataFrame:
    """W1 with ids: OK creates get max(hazard_id) + 1, + 2, ... in command order."""
    # The validated creates feed the sequencer's sampling, numbering and
    # counting passes: they are checkpointed once to the shared folder so
    # the validation joins run once.
    v = validate(commands.where(F.col("kind") == KIND_CREATE), users, hazards).checkpoint(eager=True)
    ok = I.assign_sequence(v.where(F.col("result") == OK), ["command_id"], max_id(hazards, "hazard_id"),
                           "new_hazard_id")
    rest = v.where(F.col("result") != OK).withColumn("new_hazard_id", F.lit(None).cast("long"))
    return ok.unionByName(rest)


def created_rows(creates: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """Hazard rows written by OK creates (output of ``validate_creates``).
    Missing title/description become '', severity Low, type General."""
    ok = creates.where(F.col("result") == OK)
    created_at = F.col("command_ts") if now is None else F.lit(now).cast("timestamp_ntz")
    return ok.select(
        F.col("new_hazard_id").alias("hazard_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.col("reported_by_user_id"),
        F.lit(None).cast("long").alias("assigned_to_user_id"),
        F.lit(S.STATUS_OPEN).alias("status"),
        F.coalesce("severity", F.lit("Low")).alias("severity"),
        F.coalesce("type", F.lit("General")).alias("type"),
        created_at.alias("created_at"),
        F.col("due_date"),
    )


# P9 -------------------------------------------------------------------------
def effective_edit(update_commands: DataFrame, users: DataFrame, hazards: DataFrame) -> DataFrame:
    """Policy says the edit form is open (P2) and the write is accepted."""
    from ..functions import policy as P
    v = validate(update_commands, users, hazards, keep_context=True)
    uf = users.select(F.col("user_id").alias("_u"), F.col("role").alias("viewer_role"))
    v = v.join(uf, v["performed_by_user_id"] == uf["_u"], "left")
    can_edit = P.can_edit_details("viewer_role", "performed_by_user_id", "h_reporter", "h_assignee", "h_status",
                                  F.col("h_reporter").isNotNull())
    return v.select("command_id", can_edit.alias("policy_can_edit"),
                    (F.col("result") == OK).alias("write_accepted"),
                    (can_edit & (F.col("result") == OK)).alias("effective_edit"))


# W7 -------------------------------------------------------------------------
def upsert_users(target: DataFrame, source: DataFrame) -> DataFrame:
    """Users matched by user_name (ignoring case) are updated and keep their
    id; the others are inserted with ids after the current maximum, in
    ``source`` order (column ``seq``)."""
    key = F.lower(F.col("user_name"))
    src = source.select(key.alias("_k"), F.col("user_name").alias("s_user_name"), F.col("full_name").alias("s_full"),
                        F.col("role").alias("s_role"), F.col("is_active").alias("s_active"), "seq")
    t = target.withColumn("_k", key)
    matched = t.join(src, "_k", "left")
    updated = matched.select(
        "user_id", "user_name",
        F.coalesce("s_full", "full_name").alias("full_name"),
        F.coalesce("s_role", "role").alias("role"),
        F.coalesce("s_active", "is_active").alias("is_active"))
    new = src.join(t.select("_k"), "_k", "left_anti")
    inserted = I.assign_sequence(new, ["seq"], max_id(target, "user_id"), "user_id").select(
        "user_id", F.col("s_user_name").alias("user_name"), F.col("s_full").alias("full_name"),
        F.col("s_role").alias("role"), F.col("s_active").alias("is_active"))
    return updated.unionByName(inserted)


# W8 -------------------------------------------------------------------------
def demo_ids(hazards: DataFrame, prefix: str = SEED.TITLE_PREFIX) -> DataFrame:
    return hazards.where(F.lower("title").startswith(F.lit(prefix.lower()))).select("hazard_id")


def purge(df: DataFrame, ids: DataFrame) -> DataFrame:
    """DELETE ... JOIN: drop rows whose hazard_id is in ``ids``."""
    return df.join(ids, "hazard_id", "left_anti")


# W9 -------------------------------------------------------------------------
def reload_demo(hazards: DataFrame, logs: DataFrame, users: DataFrame, demo_rows: DataFrame,
                now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Purge the demo set, insert ``demo_rows`` with fresh ids, then add the
    seed logs by INSERT ... SELECT over the inserted rows.

    ``demo_rows``: seq, title, description, severity, type, status, due_date,
    reporter_name, assignee_name (user names, resolved here)."""
    ids = demo_ids(hazards)
    names = users.select(F.lower("user_name").alias("_n"), "user_id")
    by_name = lambda col, out: names.select(F.col("_n").alias(col), F.col("user_id").alias(out))
    rows = (demo_rows.withColumn("reporter_name", F.lower("reporter_name"))
            .withColumn("assignee_name", F.lower("assignee_name"))
            .join(by_name("reporter_name", "reported_by_user_id"), "reporter_name", "left")
            .join(by_name("assignee_name", "assigned_to_user_id"), "assignee_name", "left"))
    inserted = I.assign_sequence(rows, ["seq"], max_id(hazards, "hazard_id"), "hazard_id")
    new_hazards = inserted.select(
        "hazard_id", "title", "description", "reported_by_user_id", "assigned_to_user_id", "status",
        "severity", "type", F.lit(now).cast("timestamp_ntz").alias("created_at"), "due_date")
    out_hazards = purge(hazards, ids).unionByName(new_hazards)

    safety = names.where(F.col("_n") == "safety").select(F.max("user_id")).scalar()
    manager = names.where(F.col("_n") == "manager").select(F.max("user_id")).scalar()
    t = F.col("title")
    seeds = inserted.select(
        "hazard_id",
        F.explode(F.array(
            F.struct(F.lit(1).alias("step"), F.lit(S.ACTION_CREATED).alias("action_type"),
                     F.lit(SEED.LOG_CREATED).alias("details"), safety.alias("performed_by_user_id")),
            F.when(t.startswith(SEED.TITLE_ASSIGNED), F.struct(
                F.lit(2).alias("step"), F.lit(S.ACTION_ASSIGNED).alias("action_type"),
                F.lit(SEED.LOG_ASSIGNED).alias("details"), safety.alias("performed_by_user_id"))),
            F.when(t.startswith(SEED.TITLE_MOVED), F.struct(
                F.lit(3).alias("step"), F.lit(S.ACTION_STATUS_CHANGED).alias("action_type"),
                F.lit(SEED.LOG_MOVED).alias("details"), manager.alias("performed_by_user_id"))),
        )).alias("e")).where(F.col("e").isNotNull()).select("hazard_id", "e.*")
    new_logs = I.assign_sequence(seeds, ["step", "hazard_id"], max_id(logs, "hazard_log_id"), "hazard_log_id").select(
        "hazard_log_id", "hazard_id", "action_type", "details", F.col("performed_by_user_id").cast("long"),
        F.lit(now).cast("timestamp_ntz").alias("created_at"))
    out_logs = purge(logs, ids).unionByName(new_logs)
    return out_hazards, out_logs
