"""Ordered application of change commands (W6), shared with the stream.

Commands interact only within one hazard (roles do not change inside a
batch), so the fold runs per hazard_id: the hazard's snapshot row and its
commands are hash-partitioned on hazard_id and sorted (hazard, snapshot
first, then command time and id; NULLs first, and full ties by content) by Spark; ``mapInArrow`` then streams each
partition's Arrow batches through a small Python state machine, hazard after
hazard, row by row; no hazard's history is buffered.
Creates bypass the fold: they are judged against the snapshot (W1) and get
ids after the current maximum. A command that names an id created in the
same batch is NotFound.
"""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import schemas as S
from . import commands as W
from . import ids as I

OK, UNAUTH, BAD, NOTFOUND, FORBID = W.OK, W.UNAUTH, W.BAD, W.NOTFOUND, W.FORBID
ROW_STATE, ROW_COMMAND = 0, 1
STATE_FIELDS = ("title", "description", "reported_by_user_id", "assigned_to_user_id", "status", "severity", "type",
                "created_at", "due_date")
# Order of a hazard's commands; NULLs come first. ``tie``, a hash of the whole command, settles equal times and ids.
ORDER = ["command_ts", "command_id", "tie"]
COMMAND_FIELDS = ("kind", "performed_by_user_id", "new_status", "assign_to_user_id", "details", "title", "description",
                  "severity", "type", "due_date")

FOLD_SCHEMA = (
    "hazard_id long, row_type string, command_id long, command_ts timestamp_ntz, kind string, "
    "performed_by_user_id long, result string, action string, log_details string, "
    "title string, description string, reported_by_user_id long, assigned_to_user_id long, status string, "
    "severity string, type string, created_at timestamp_ntz, due_date timestamp_ntz"
)
FOLD_COLUMNS = [c.strip().split(" ")[0] for c in FOLD_SCHEMA.split(",")]


# -- SQL three-valued logic on Python values (None = NULL) ------------------
def _eq(a, b):
    return None if a is None or b is None else a == b


def _ne(a, b):
    return None if a is None or b is None else a != b


def _not(x):
    return None if x is None else not x


def _and(*xs):
    if any(x is False for x in xs):
        return False
    return None if any(x is None for x in xs) else True


def _or(*xs):
    if any(x is True for x in xs):
        return True
    return None if any(x is None for x in xs) else False


def _blank(s) -> bool:
    return s is None or str(s).strip(" ") == ""


def _canonical_status(s):
    t = (s or "").strip(" ")
    for v in S.STATUSES:
        if t.lower() == v.lower():
            return v
    return t


def _none(v):
    if v is None:
        return None
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    return v


# -- one command against the current state -----------------------------------
def _comment_tail(role, p, r, a, s) -> str:
    if r is None:
        return NOTFOUND
    if role == S.ROLE_FIELD_WORKER and _not(_or(_eq(r, p), _eq(a, p))) is True:
        return FORBID
    if role == S.ROLE_SITE_MANAGER and _not(_or(_eq(a, p), _eq(r, p), _and(_eq(s, S.STATUS_OPEN), a is None))) is True:
        return FORBID
    if role not in W.WRITE_ROLES:
        return FORBID
    return OK


def judge(cmd: dict, state: dict | None) -> str:
    """Result of one non-create command given the hazard state (None when the
    hazard does not exist). Mirrors W2-W5 check by check."""
    role, p = cmd["role"], cmd["performed_by_user_id"]
    r = state["reported_by_user_id"] if state else None
    a = state["assigned_to_user_id"] if state else None
    s = state["status"] if state else None
    kind = cmd["kind"]
    if role is None:
        return UNAUTH
    if kind == W.KIND_UPDATE:
        if r is None:
            return NOTFOUND
        if role not in W.WRITE_ROLES:
            return FORBID
        if role == S.ROLE_SITE_MANAGER and _not(_or(_eq(a, p), _and(a is None, _eq(s, S.STATUS_OPEN)))) is True:
            return FORBID
        if role == S.ROLE_FIELD_WORKER and _not(_and(_eq(r, p), a is None, _eq(s, S.STATUS_OPEN))) is True:
            return FORBID
        return OK
    if kind == W.KIND_ASSIGN:
        t = cmd["assign_to_user_id"]
        if s is None:
            return NOTFOUND
        if role not in (S.ROLE_SAFETY_OFFICER, S.ROLE_SITE_MANAGER):
            return FORBID
        if role == S.ROLE_SAFETY_OFFICER:
            if t is not None and not cmd["target_is_manager"]:
                return FORBID
        else:
            if _ne(t, p) is True:
                return FORBID
            if _not(_and(_eq(s, S.STATUS_OPEN), a is None)) is True:
                return FORBID
        return OK
    if kind == W.KIND_STATUS:
        if _blank(cmd["new_status"]):
            if _blank(cmd["details"]):
                return BAD
            return _comment_tail(role, p, r, a, s)
        ns = _canonical_status(cmd["new_status"])
        if ns not in S.STATUSES:
            return BAD
        if s is None:
            return NOTFOUND
        if role != S.ROLE_SAFETY_OFFICER:
            if role != S.ROLE_SITE_MANAGER:
                return FORBID
            if _ne(a, p) is True:
                return FORBID
            if _not(_or(_and(_eq(s, S.STATUS_OPEN), ns == S.STATUS_IN_PROGRESS),
                        _and(_eq(s, S.STATUS_IN_PROGRESS), ns == S.STATUS_RESOLVED))) is True:
                return FORBID
        return OK
    if kind == W.KIND_COMMENT:
        if _blank(cmd["details"]):
            return BAD
        return _comment_tail(role, p, r, a, s)
    return BAD


def status_log_text(old, new, details) -> str:
    tail = "" if details is None or str(details).rstrip(" ") == "" else " | " + str(details)
    return ((old or "") + " -> " + (new or "") + tail)


def apply_one(cmd: dict, state: dict | None) -> tuple[str, str | None, str | None, dict | None]:
    """(result, log action, log details, new state) for one command."""
    res = judge(cmd, state)
    if res != OK:
        return res, None, None, state
    kind = cmd["kind"]
    st = dict(state) if state else None
    if kind == W.KIND_UPDATE:
        st.update(title=cmd["title"] or "", description=cmd["description"] or "",
                  severity=cmd["severity"] or "Low", type=cmd["type"] or "General",
                  due_date=cmd["due_date"])
        return res, S.ACTION_UPDATED, "", st
    if kind == W.KIND_ASSIGN:
        st["assigned_to_user_id"] = cmd["assign_to_user_id"]
        return res, S.ACTION_ASSIGNED, "", st
    if kind == W.KIND_STATUS and not _blank(cmd["new_status"]):
        text = status_log_text(st["status"], cmd["new_status"].strip(" "), cmd["details"])
        st["status"] = _canonical_status(cmd["new_status"])  # later rules compare the canonical spelling
        return res, S.ACTION_STATUS_CHANGED, text, st
    return res, S.ACTION_COMMENT, cmd["details"], state


def order_key(ts, ident) -> tuple:
    """Place of a command in its hazard's order: NULL before all values, as Spark sorts."""
    return (ts is not None, ts, ident is not None, ident)


def result_row(row: dict, res: str, action: str | None, details: str | None) -> dict:
    return {"hazard_id": row["hazard_id"], "row_type": "result", "command_id": row["command_id"],
            "command_ts": row["command_ts"], "kind": row["kind"],
            "performed_by_user_id": row["performed_by_user_id"], "result": res, "action": action,
            "log_details": details}


def fold_rows(rows: Iterator[dict]) -> Iterator[dict]:
    """Fold one hazard's rows (state row first, then commands in order);
    yields one output per command and one final state row if it changed."""
    state, changed, hazard_id, last = None, False, None, None
    for row in rows:
        hazard_id = row["hazard_id"]
        if row["row_type"] == ROW_STATE:
            state = {k: row[k] for k in STATE_FIELDS}
            continue
        key = order_key(row["command_ts"], row["command_id"])
        if last is not None and key < last:
            raise ValueError(f"commands of hazard {hazard_id} arrived out of order")
        last = key
        res, action, details, new_state = apply_one(row, state)
        changed = changed or (new_state is not state)
        state = new_state
        yield result_row(row, res, action, details)
    if changed and state is not None:
        yield {"hazard_id": hazard_id, "row_type": "state", **state}


_ARROW = {}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow form of a DDL schema (once per worker)."""
    if ddl not in _ARROW:
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
        _ARROW[ddl] = pa.schema([(n, kinds[t]) for n, t in (c.strip().split(" ") for c in ddl.split(","))])
    return _ARROW[ddl]


def frame(rows: list[dict], ddl: str) -> pa.RecordBatch:
    """Output rows as Arrow; a missing field is NULL."""
    return pa.RecordBatch.from_pylist(rows, schema=arrow_schema(ddl))


def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches as dicts with None for NULL. Whole numbers stay
    whole numbers (a pandas column with NULLs would turn ids into floats)."""
    for b in batches:
        yield from b.to_pylist()


def _fold_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a partition sorted by (hazard_id, row_type, command_ts,
    command_id): rows are grouped by hazard on the fly and folded."""
    def rows():
        return records(batches)

    out = []
    for _, group in itertools.groupby(rows(), key=lambda r: r["hazard_id"]):
        for o in fold_rows(group):  # the group is consumed lazily, row by row
            out.append(o)
            if len(out) >= 10_000:
                yield frame(out, FOLD_SCHEMA)
                out = []
    if out:
        yield frame(out, FOLD_SCHEMA)


def command_rows(commands: DataFrame, users: DataFrame) -> DataFrame:
    """Commands other than creates, with what the rules ask of their performer and target."""
    uf = W.user_facts(users)
    perf = uf.select(F.col("user_id").alias("_p"), F.col("active_role").alias("role"))
    tgt = uf.select(F.col("user_id").alias("_t"), F.col("active_manager").alias("target_is_manager"))
    c = commands.where(F.col("kind") != W.KIND_CREATE)
    c = (c.join(perf, c["performed_by_user_id"] == perf["_p"], "left")
         .join(tgt, c["assign_to_user_id"] == tgt["_t"], "left").drop("_p", "_t"))
    return c.select(
        "hazard_id", F.lit(ROW_COMMAND).alias("row_type"), "command_id", "command_ts",
        F.xxhash64(*COMMAND_FIELDS).alias("tie"), *COMMAND_FIELDS, "role",
        F.coalesce("target_is_manager", F.lit(False)).alias("target_is_manager"))


def fold(commands: DataFrame, users: DataFrame, hazards: DataFrame) -> DataFrame:
    """Per-command results and final hazard states of the ordered fold."""
    c = command_rows(commands, users)
    touched = c.select("hazard_id").distinct()
    states = hazards.join(touched, "hazard_id", "left_semi").select(
        "hazard_id", F.lit(ROW_STATE).alias("row_type"), *STATE_FIELDS)
    rows = c.unionByName(states, allowMissingColumns=True)
    ordered = rows.repartition("hazard_id").sortWithinPartitions("hazard_id", "row_type", *ORDER)
    return ordered.mapInArrow(_fold_partition, FOLD_SCHEMA)


def results(folded: DataFrame) -> DataFrame:
    return folded.where(F.col("row_type") == "result").select(
        "command_id", "hazard_id", "kind", "performed_by_user_id", "result", "action")


def apply(commands: DataFrame, users: DataFrame, hazards: DataFrame, logs: DataFrame,
          now: dt.datetime | None = None, split: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new hazards, new logs, results) after applying the command table.

    With ``split`` hot hazards are folded chunk by chunk side by side (``apply_split``);
    the other hazards take the one-pass fold. The fold output feeds three results, so it is checkpointed once to the
    shared checkpoint folder instead of being recomputed (the validated
    creates are checkpointed inside ``validate_creates``)."""
    if split:
        from .apply_split import fold_auto
        folded = fold_auto(commands, users, hazards).checkpoint(eager=True)
    else:
        folded = fold(commands, users, hazards).checkpoint(eager=True)
    creates = W.validate_creates(commands, users, hazards)
    res = results(folded).unionByName(
        creates.select("command_id", "hazard_id", "kind", "performed_by_user_id", "result",
                       F.when(F.col("result") == OK, F.lit(S.ACTION_CREATED)).alias("action")))
    states = folded.where(F.col("row_type") == "state").select(*[c for c in hazards.columns])
    new_rows = W.created_rows(creates, now)
    new_hazards = hazards.join(states.select("hazard_id"), "hazard_id", "left_anti").unionByName(states) \
        .unionByName(new_rows)
    fold_logs = folded.where((F.col("row_type") == "result") & (F.col("result") == OK)).select(
        "command_ts", "command_id", "hazard_id", F.col("action").alias("action_type"),
        F.col("log_details").alias("details"), "performed_by_user_id")
    create_logs = creates.where(F.col("result") == OK).select(
        "command_ts", "command_id", F.col("new_hazard_id").alias("hazard_id"),
        F.lit(S.ACTION_CREATED).alias("action_type"), F.lit("").alias("details"), "performed_by_user_id")
    added = I.assign_sequence(fold_logs.unionByName(create_logs), ["command_ts", "command_id"],
                              W.max_id(logs, "hazard_log_id"), "hazard_log_id")
    new_logs = logs.unionByName(added.select(
        "hazard_log_id", "hazard_id", "action_type", "details", "performed_by_user_id",
        F.col("command_ts").alias("created_at")))
    return new_hazards, new_logs, res
