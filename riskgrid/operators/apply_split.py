"""W6 for hot hazards: chunks of commands as functions of the state before them.

Commands of one hazard interact only through (assignee, status); the rules compare
the assignee with NULL and with the performer, and the status with three known ones. So what a
chunk of commands does to (assignee, status) is a small table: one line per known
performer who could act as assignee (plus NULL and anybody else) and per status class.

1. A hot hazard's commands are put in order over many tasks and cut into chunks of
   at most ``CHUNK_ROWS`` rows. Each chunk is written down as its table.
2. The tables are composed in a tree (``compose.entry_states``), which gives the
   state before each chunk.
3. Each chunk is folded from that state by the same rules as the plain fold.
4. The last state of a hazard comes from its last chunk with a change, and
   its other fields from the last chunk with an accepted update: two
   partial-aggregated maxima.

No step depends on the number of a hazard's commands in one task, and no rows are joined
by command id, so NULL and repeated ids, and NULL times, give the plain fold's rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import schemas as S
from . import apply as AP
from . import commands as W
from . import compose as C

CHUNK_ROWS = 20_000

NOBODY, SOMEONE, OTHER = 0, 1, 2       # assignee classes: NULL, a listed user, anybody else
_SENT_A = -(2 ** 63)                   # an assignee equal to no performer
_SENT_S = "\u0000other"                # a status equal to no known status
_STATUSES = (*S.STATUSES, None, _SENT_S)
_STATE = "state struct<a: bigint, s: string>"
_LINE = "in_a_kind int, in_a long, in_s string, out_a_kind int, out_a long, out_s string"
FN = "array<struct<" + ", ".join(c.replace(" ", ": ", 1) for c in _LINE.split(", ")) + ">>"


# -- a chunk's table: {(class, user, status): (class, user, status)}; OTHER and _SENT_S stay what they are ---
def _class(table: dict, a_kind: int, a, s) -> tuple:
    """The line of a table that a state falls under."""
    known = s if s in _STATUSES else _SENT_S
    return (a_kind, a, known) if a_kind == NOBODY or (a_kind, a, known) in table else (OTHER, None, known)


def _through(table: dict, a_kind: int, a, s) -> tuple:
    out_kind, out_a, out_s = table[_class(table, a_kind, a, s)]
    if out_kind == OTHER:
        out_kind, out_a = a_kind, a
    return out_kind, out_a, (s if out_s == _SENT_S else out_s)


def identity(users=()) -> dict:
    lines = [(NOBODY, None), (OTHER, None), *[(SOMEONE, u) for u in users]]
    return {(k, a, s): (k, a, s) for k, a in lines for s in _STATUSES}


def _listed(table: dict) -> set:
    return {a for k, a, _ in table if k == SOMEONE}


def compose_tables(f: dict, g: dict) -> dict:
    """First f, then g; lines that say what OTHER's say are left out."""
    out = {}
    for k, a, s in identity(_listed(f) | _listed(g)):
        out[k, a, s] = _through(g, *_through(f, k, a, s))
    for u in _listed(out):
        lines = {s: out[SOMEONE, u, s] for s in _STATUSES}
        if all(v == ((SOMEONE, u, out[OTHER, None, s][2]) if out[OTHER, None, s][0] == OTHER else out[OTHER, None, s]) for s, v in lines.items()):
            for s in _STATUSES:
                del out[SOMEONE, u, s]
    return out


def to_lines(table: dict) -> list[dict]:
    names = [c.split(" ")[0] for c in _LINE.split(", ")]
    return [dict(zip(names, (*k, *v))) for k, v in table.items()]


def from_lines(lines: list[dict]) -> dict:
    return {(x["in_a_kind"], x["in_a"], x["in_s"]): (x["out_a_kind"], x["out_a"], x["out_s"]) for x in lines}


@functools.lru_cache(maxsize=100_000)
def _effect(kind, role, new_status, target, target_is_manager, me: str, s):
    """What a command does to a state whose assignee is nobody, the performer or someone else:
    (whether it assigns, the new status). The performer is user 0 here."""
    p, sentinel = 0, _SENT_A
    cmd = {"kind": kind, "role": role, "performed_by_user_id": p, "new_status": new_status, "details": "x", "command_id": 0,
           "assign_to_user_id": {"nobody": None, "me": p, "else": 1}[target], "target_is_manager": target_is_manager,
           "title": None, "description": None, "severity": None, "type": None, "due_date": None}
    a = {"nobody": None, "me": p, "else": sentinel}[me]
    state = {"title": "", "description": "", "reported_by_user_id": 2, "assigned_to_user_id": a, "status": s,
             "severity": "", "type": "", "created_at": None, "due_date": None}
    _, action, _, new = AP.apply_one(cmd, state)
    return action == S.ACTION_ASSIGNED, new["status"]


class Chunk:
    """The table of a run of commands, built command by command.

    Lines that have reached the same state move together, so an officer's command that
    changes every line costs as many steps as there are different states."""

    def __init__(self):
        self.other = {s: (OTHER, None, s) for s in _STATUSES}
        self.groups = {(NOBODY, None, s): [(NOBODY, None, s)] for s in _STATUSES}
        self.users: set = set()

    def add(self, cmd: dict) -> None:
        kind, role, p = cmd["kind"], cmd["role"], cmd["performed_by_user_id"]
        if kind not in (W.KIND_ASSIGN, W.KIND_STATUS) or role not in (S.ROLE_SAFETY_OFFICER, S.ROLE_SITE_MANAGER):
            return
        if kind == W.KIND_STATUS and AP._blank(cmd["new_status"]):
            return
        t = cmd["assign_to_user_id"]
        target = "nobody" if t is None else "me" if t == p else "else"
        signature = (kind, role, cmd["new_status"], target, bool(cmd["target_is_manager"]))

        def move(state: tuple) -> tuple:
            a_kind, a, s = state
            me = "nobody" if a_kind == NOBODY else "me" if a_kind == SOMEONE and a == p else "else"
            assigned, status = _effect(*signature, me, s)
            if assigned:
                a_kind, a = (NOBODY, None) if t is None else (SOMEONE, t)
            return a_kind, a, status

        if role == S.ROLE_SITE_MANAGER:
            if p not in self.users:  # so far p fared as anybody else
                self.users.add(p)
                for s in _STATUSES:
                    k, a, now = self.other[s]
                    self.groups.setdefault((SOMEONE, p, now) if k == OTHER else (k, a, now), []).append((SOMEONE, p, s))
            touched = [(k, a, s) for k, a in ((NOBODY, None), (SOMEONE, p)) for s in _STATUSES]
            touched = [(x, self.groups.pop(x)) for x in touched if x in self.groups]
        else:
            touched, self.groups = list(self.groups.items()), {}
        for state, lines in touched:
            self.groups.setdefault(move(state), []).extend(lines)
        self.other = {s: move(state) for s, state in self.other.items()}

    def table(self) -> dict:
        out = {(OTHER, None, s): v for s, v in self.other.items()}
        for state, lines in self.groups.items():
            out.update((x, state) for x in lines)
        return out


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hazard_id, chunk, fn) of each run of rows with one hazard and chunk."""
    schema = pa.schema([("hazard_id", pa.int64()), ("chunk", pa.int64()), ("fn", pa.list_(pa.struct(
        [("in_a_kind", pa.int32()), ("in_a", pa.int64()), ("in_s", pa.string()),
         ("out_a_kind", pa.int32()), ("out_a", pa.int64()), ("out_s", pa.string())])))])

    def rows():
        for (hazard, chunk), group in itertools.groupby(AP.records(batches), key=lambda r: (r["hazard_id"], r["chunk"])):
            state = Chunk()
            for cmd in group:
                state.add(cmd)
            yield hazard, chunk, to_lines(compose_tables(identity(), state.table()))
    yield from C._batches(rows(), schema)


def _compose_lines(f: list[dict], g: list[dict]) -> list[dict]:
    return to_lines(compose_tables(from_lines(f), from_lines(g)))


def _advance(lines: list[dict], state: dict) -> dict:
    a, s = state["a"], state["s"]
    _, a, s = _through(from_lines(lines), NOBODY if a is None else SOMEONE, a, s)
    return {"a": a, "s": s}


CHUNK_OUT = AP.FOLD_SCHEMA + ", chunk long, updated boolean"


def _fold_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of each chunk from the state before it; one state row per chunk with a change."""
    out = []
    for (hazard, chunk), group in itertools.groupby(AP.records(batches), key=lambda r: (r["hazard_id"], r["chunk"])):
        state, changed, updated = None, False, False
        for row in group:
            if row["row_type"] == AP.ROW_STATE:
                state = {k: row.get(k) for k in AP.STATE_FIELDS}
                continue
            res, action, details, new = AP.apply_one(row, state)
            changed, updated = changed or new is not state, updated or action == S.ACTION_UPDATED
            state = new
            out.append(AP.result_row(row, res, action, details))
            if len(out) >= 10_000:
                yield AP.frame(out, CHUNK_OUT)
                out = []
        if changed:
            out.append({"hazard_id": hazard, "row_type": "state", **state, "chunk": chunk, "updated": updated})
    if out:
        yield AP.frame(out, CHUNK_OUT)


def fold_split(commands: DataFrame, users: DataFrame, hazards: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Same output as ``apply.fold`` (FOLD_SCHEMA), with chunks folded side by side."""
    rows = AP.command_rows(commands, users)
    size = chunk_rows or CHUNK_ROWS
    ordered = C.placed(rows, ["hazard_id", *AP.ORDER], size, commands.count())
    named = ordered.select("hazard_id").distinct()
    snapshot = hazards.join(named, "hazard_id", "left_semi")
    tables = ordered.mapInArrow(_tables, f"hazard_id long, chunk long, fn {FN}").checkpoint(eager=True)
    initial = snapshot.select("hazard_id", F.struct(F.col("assigned_to_user_id").alias("a"), F.col("status").alias("s")).alias("state"))
    entries = C.entry_states(tables, initial, "hazard_id", _compose_lines, _advance)
    # Only assignee, status and reporter decide; the other fields of a changed hazard are set below.
    reporters = snapshot.select("hazard_id", "reported_by_user_id")
    states = entries.join(reporters, "hazard_id").select(
        "hazard_id", "chunk", F.lit(AP.ROW_STATE).alias("row_type"), "reported_by_user_id",
        F.col("state.a").alias("assigned_to_user_id"), F.col("state.s").alias("status"))
    both = ordered.unionByName(states, allowMissingColumns=True)
    folded = (both.repartition("hazard_id", "chunk").sortWithinPartitions("hazard_id", "chunk", "row_type", *AP.ORDER)
              .mapInArrow(_fold_chunks, CHUNK_OUT)).checkpoint(eager=True)

    fields = ("title", "description", "severity", "type", "due_date")
    last = folded.where(F.col("row_type") == "state").groupBy(F.col("hazard_id").alias("_h")).agg(
        F.max_by(F.struct(F.col("assigned_to_user_id").alias("a"), F.col("status").alias("s")), "chunk").alias("_now"),
        F.max_by(F.when(F.col("updated"), F.struct(*fields)), F.when(F.col("updated"), F.col("chunk"))).alias("_update"))
    kept = {c: F.col(c) for c in hazards.columns}
    kept |= {c: F.when(F.col("_update").isNotNull(), F.col(f"_update.{c}")).otherwise(F.col(c)) for c in fields}
    kept |= {"assigned_to_user_id": F.col("_now.a"), "status": F.col("_now.s")}
    finals = snapshot.join(last, F.col("hazard_id") == F.col("_h")).select(
        F.lit("state").alias("row_type"), *[v.alias(k) for k, v in kept.items()])
    return (folded.where(F.col("row_type") == "result").select(*AP.FOLD_COLUMNS)
            .unionByName(finals, allowMissingColumns=True).select(*AP.FOLD_COLUMNS))


def fold_auto(commands: DataFrame, users: DataFrame, hazards: DataFrame, work_rows: int | None = None,
              chunk_rows: int | None = None) -> DataFrame:
    """The command fold, split for hazards with more than ``work_rows`` commands
    (more than one task should fold); all others take the one-pass fold. Both
    give the same rows. Commands that name no hazard (NULL) stay in the plain fold: each is judged alone."""
    from . import hot as H
    c = commands.where(F.col("kind") != W.KIND_CREATE)
    hot = H.hot_keys(c, ["hazard_id"], H.WORK_ROWS if work_rows is None else work_rows).checkpoint(eager=True)
    if hot.isEmpty():
        return AP.fold(c, users, hazards)
    flagged = H.flag_hot(c, hot, ["hazard_id"], "_hot")
    is_hot = F.col("_hot") & F.col("hazard_id").isNotNull()
    return AP.fold(flagged.where(~is_hot).drop("_hot"), users, hazards).unionByName(
        fold_split(flagged.where(is_hot).drop("_hot"), users, hazards, chunk_rows))
