"""Login lockout over event tables (L1), shared with the stream form (L2).

Per key (by default ``ip|lower(user)``): a failure opens a window; a failure
more than ``window`` after the window start opens a new one; every failure
counts; at ``max_failures`` the key is blocked until ``t + block``. While
blocked, attempts are refused and not counted. A success clears count and
block. The count survives the end of a block, so the next failure inside the
same window blocks again. A blank key is never tracked.

A fixed or session window cannot express this (the window opens at a
failure and a success resets it), so the fold is a small state machine. Spark
hash-partitions the events by key and sorts each partition by (key, ts,
login_id); ``mapInPandas`` then folds each partition in one streaming pass,
key after key, with O(1) state.

A key with more rows than one task should fold is cut in two steps. It is segmented
where the state is provably fresh (``idle_segments``). A segment that is still too long
(a dense burst) is cut into chunks of ``CHUNK_ROWS`` rows: a chunk's times and
successes, nine bytes an attempt, are enough to find the state behind it from the state before
it, jumping over refused attempts and over runs of successes (``advance``); that narrow chain
gives each chunk its first state, and the chunks are folded side by side.

An attempt without a time has no place in the order: it is judged alone, like one of a
blank key, and changes nothing.
"""

from __future__ import annotations

import datetime as dt
import itertools
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
DEFAULT_MAX_FAILURES = 5
DEFAULT_WINDOW = dt.timedelta(minutes=10)
DEFAULT_BLOCK = dt.timedelta(minutes=5)
OUTCOME_ALLOWED, OUTCOME_FAILED, OUTCOME_REFUSED = "allowed", "failed", "refused"
# ---------------------------------------------------------------------------

CHUNK_ROWS = 50_000
_NO_TIME = -(2 ** 63)
_EPOCH = dt.datetime(1970, 1, 1)
_US = dt.timedelta(microseconds=1)

OUT_SCHEMA = ("key string, login_id long, ts timestamp_ntz, success boolean, outcome string, "
              "failure_count int, retry_after_minutes int")
OUT_COLUMNS = [c.strip().split(" ")[0] for c in OUT_SCHEMA.split(",")]


@dataclass
class KeyState:
    window_start: dt.datetime | None = None
    count: int = 0
    blocked_until: dt.datetime | None = None


def step(state: KeyState, ts, success: bool, blank_key: bool, max_failures: int,
         window: dt.timedelta, block: dt.timedelta) -> tuple[str, int, int | None]:
    """Advance one key by one attempt; returns (outcome, failure count,
    retry-after minutes)."""
    if blank_key or ts is None:
        return (OUTCOME_ALLOWED if success else OUTCOME_FAILED), 0, None
    if state.blocked_until is not None and state.blocked_until > ts:
        minutes = (state.blocked_until - ts).total_seconds() / 60.0
        return OUTCOME_REFUSED, state.count, max(1, int(math.ceil(minutes)))
    if success:
        state.window_start, state.count, state.blocked_until = None, 0, None
        return OUTCOME_ALLOWED, 0, None
    if state.window_start is None or ts - state.window_start > window:
        state.window_start, state.count = ts, 0
    state.count += 1
    if state.count >= max_failures:
        state.blocked_until = ts + block
    return OUTCOME_FAILED, state.count, None


def fold_key(key: str, rows: Iterator[tuple], state: KeyState, max_failures: int, window: dt.timedelta,
             block: dt.timedelta) -> Iterator[tuple]:
    """rows: (login_id, ts, success) in (ts, login_id) order."""
    blank = key is None or key.strip() == ""
    last = None
    for login_id, ts, success in rows:
        k = order_key(ts, login_id)
        if last is not None and k < last:
            raise ValueError(f"login events of key {key!r} arrived out of order")
        last = k
        outcome, count, retry = step(state, ts, bool(success), blank, max_failures, window, block)
        yield (key, login_id, ts, bool(success), outcome, count, retry)


def order_key(ts, login_id) -> tuple:
    """Place of an attempt in its key's order: NULL before all values, as Spark sorts."""
    return (ts is not None, ts, login_id is not None, login_id)


def advance(times: list[int], fails: list[int], state: tuple, max_failures: int, window: int, block: int) -> tuple:
    """The state (window start, count, blocked until; microseconds) behind a run of attempts.

    ``times`` ascend; ``fails`` are the places of the failures among them. Refused attempts
    are passed by one search in the times, successes of a fresh state by one in the failures."""
    start, count, until = state
    i, n = 0, len(times)
    while i < n and times[i] == _NO_TIME:
        i += 1
    f = bisect_left(fails, i)
    while i < n:
        if until is not None and times[i] < until:
            i = bisect_left(times, until, i)
            f = bisect_left(fails, i, f)
            continue
        if f >= len(fails) or fails[f] != i:  # a success
            start, count, until = None, 0, None
            i = fails[f] if f < len(fails) else n
            continue
        t = times[i]
        if start is None or t - start > window:
            start, count = t, 0
        count += 1
        if count >= max_failures:
            until = t + block
        i += 1
        f += 1
    return start, count, until


def login_key(ip: Column | str = "ip", user_name: Column | str = "user_name") -> Column:
    """``ip|lower(user)`` with 'unknown' for a missing ip or blank user."""
    return T.login_key(ip, user_name)


def user_key(user_name: Column | str = "user_name") -> Column:
    """Key by user name only (ignoring case); blank names stay blank."""
    u = F.col(user_name) if isinstance(user_name, str) else user_name
    return F.lower(F.trim(u))


def idle_segments(rows: DataFrame, gap: dt.timedelta, block: dt.timedelta | None = None) -> DataFrame:
    """Add ``seg``: an id of the key's current segment (its first attempt).

    A new segment starts where the fold's state is provably fresh:
    * the attempt follows the key's previous attempt by more than ``gap``
      (window + block), or
    * the previous attempt was a success that cannot have been refused: no
      failure within ``block`` before it (a block lasts ``block`` from the
      failure that set it), so it cleared count and block.
    Segments therefore fold independently, and a hot key's history spreads
    over many tasks. Computed per (key, time bucket of width ``gap``) plus
    small per-bucket summaries, so no step holds all of one key's rows in one
    task."""
    g_us = max(1, int(gap / dt.timedelta(microseconds=1)))
    r = rows.withColumn("_b", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(g_us)))
    wb = Window.partitionBy("key", "_b").orderBy("ts", "login_id")
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    wk = Window.partitionBy("key").orderBy("_b")
    r = (r.withColumn("_prev", F.lag("ts").over(wb))
         .withColumn("_fail_ts", F.when(~F.col("success"), F.col("ts")))
         .withColumn("_prev_fail_b", F.max("_fail_ts").over(before)))
    s1 = (r.groupBy("key", "_b").agg(F.max("ts").alias("_last"), F.max("_fail_ts").alias("_bfail"))
          .withColumn("_prev_bucket_last", F.lag("_last").over(wk))
          .withColumn("_carry_fail", F.max("_bfail").over(wk.rowsBetween(Window.unboundedPreceding, -1))))
    r = _join_kb(r, s1.select("key", "_b", "_prev_bucket_last", "_carry_fail"))
    prev_fail = F.greatest(F.col("_prev_fail_b"), F.col("_carry_fail"))
    if block is None:
        r = r.withColumn("_safe", F.lit(False))
    else:
        r = r.withColumn("_safe", F.col("success") & (prev_fail.isNull() | (F.col("ts") >= prev_fail + F.lit(block))))
    r = r.withColumn("_prev_safe_b", F.lag("_safe").over(wb))
    s2 = (r.groupBy("key", "_b").agg(F.max_by("_safe", F.struct("ts", "login_id")).alias("_last_safe"))
          .withColumn("_prev_bucket_safe", F.lag("_last_safe").over(wk)))
    r = _join_kb(r, s2.select("key", "_b", "_prev_bucket_safe"))
    pred = F.coalesce(F.col("_prev"), F.col("_prev_bucket_last"))
    prev_safe = F.when(F.col("_prev").isNotNull(), F.col("_prev_safe_b")).otherwise(F.col("_prev_bucket_safe"))
    start = pred.isNull() | (F.col("ts") > pred + F.lit(gap)) | F.coalesce(prev_safe, F.lit(False))
    # Segment id: (ts, login_id) of its first attempt; increases along the key.
    r = r.withColumn("_start", F.when(start, F.struct("ts", "login_id")))
    r = r.withColumn("_seg_b", F.max("_start").over(wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    carry = (r.groupBy("key", "_b").agg(F.max("_start").alias("_bmax"))
             .withColumn("_carry", F.max("_bmax").over(wk.rowsBetween(Window.unboundedPreceding, -1))))
    r = _join_kb(r, carry.select("key", "_b", "_carry"))
    seg = F.coalesce(F.col("_seg_b"), F.col("_carry"))
    return r.withColumn("seg", F.concat(seg["ts"].cast("string"), F.lit("#"), seg["login_id"].cast("string"))).select(
        *rows.columns, "seg")


def _join_kb(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on (key, bucket) treating NULL keys as equal (a NULL user is one key)."""
    rr = right.withColumnRenamed("key", "_rk").withColumnRenamed("_b", "_rb")
    j = left.join(rr, left["key"].eqNullSafe(rr["_rk"]) & (left["_b"] == rr["_rb"]), "left")
    return j.drop("_rk", "_rb")


def lockout(events: DataFrame, key: Column | None = None, max_failures: int = DEFAULT_MAX_FAILURES,
            window: dt.timedelta = DEFAULT_WINDOW, block: dt.timedelta = DEFAULT_BLOCK,
            split_idle_gaps: bool = True, work_rows: int | None = None, chunk_rows: int | None = None) -> DataFrame:
    """L1: one output row per attempt with its outcome."""
    if max_failures <= 0:
        raise ValueError("max_failures must be positive")
    k = login_key() if key is None else key
    rows = events.select(k.alias("key"), "login_id", "ts", "success")
    rules = (max_failures, window, block)
    whole = rows.withColumn("seg", F.lit(None).cast("string"))
    if not split_idle_gaps:
        return _fold_segments(whole, *rules)
    # Only hot keys are segmented; the others fold whole (segment NULL).
    from . import hot as H
    most = H.WORK_ROWS if work_rows is None else work_rows
    hot = H.hot_keys(rows, ["key"], most).checkpoint(eager=True)
    if hot.isEmpty():
        return _fold_segments(whole, *rules)
    flagged = H.flag_hot(whole, hot, ["key"], "_hot")
    cut = idle_segments(flagged.where("_hot").drop("_hot", "seg"), window + block, block).checkpoint(eager=True)
    long = H.hot_keys(cut, ["key", "seg"], most).checkpoint(eager=True)
    marked = H.flag_hot(cut, long, ["key", "seg"], "_long")
    out = _fold_segments(flagged.where("not _hot").drop("_hot").unionByName(marked.where("not _long").drop("_long")), *rules)
    if long.isEmpty():
        return out
    return out.unionByName(_fold_chunks(marked.where("_long").drop("_long"), *rules, chunk_rows or CHUNK_ROWS))


def _fold_chunks(rows: DataFrame, max_failures: int, window: dt.timedelta, block: dt.timedelta, chunk_rows: int) -> DataFrame:
    """Long segments: the state before each chunk by a chain over times and successes, then all chunks at once."""
    from . import compose as C
    window_us, block_us = window // _US, block // _US
    ordered = C.placed(rows, ["key", "seg", "ts", "login_id"], chunk_rows, rows.count())
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(_NO_TIME))
    narrow = ordered.select("key", "seg", "chunk", at.alias("at"), "success")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one chunk as one row; a chunk that goes on in the next batch is joined there."""
        held: list = []

        def row():
            times, fails = (np.concatenate([h[c] for h in held]) for c in (1, 2))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((*held[0][0], times.tobytes(), fails.tobytes()),
                                                  (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                names=["key", "seg", "chunk", "times", "fails"])

        for b in batches:
            names = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            times = b.column(3).to_numpy()
            failed = ~b.column(4).fill_null(False).to_numpy(zero_copy_only=False)
            lo = 0
            for name, run in itertools.groupby(names):
                hi = lo + sum(1 for _ in run)
                if held and held[0][0] != name:
                    yield row()
                    held = []
                held.append((name, times[lo:hi], failed[lo:hi]))
                lo = hi
        if held:
            yield row()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, (None, 0, None)
        for b in batches:
            for r in b.to_pylist():
                if (r["key"], r["seg"]) != current:
                    current, state = (r["key"], r["seg"]), (None, 0, None)
                yield pa.RecordBatch.from_pylist([{"key": r["key"], "seg": r["seg"], "chunk": r["chunk"], "start": state[0],
                                                   "count": state[1], "until": state[2]}], schema=entry)
                times = np.frombuffer(r["times"], np.int64).tolist()
                fails = np.flatnonzero(np.frombuffer(r["fails"], bool)).tolist()
                state = advance(times, fails, state, max_failures, window_us, block_us)

    entry = pa.schema([("key", pa.string()), ("seg", pa.string()), ("chunk", pa.int64()), ("start", pa.int64()),
                       ("count", pa.int64()), ("until", pa.int64())])
    packed = narrow.mapInArrow(pack, "key string, seg string, chunk long, times binary, fails binary")
    entries = (packed.repartition("key", "seg").sortWithinPartitions("key", "seg", "chunk")
               .mapInArrow(chain, "key string, seg string, chunk long, start long, count long, until long"))
    both = ordered.withColumn("role", F.lit(1)).unionByName(entries.withColumn("role", F.lit(0)), allowMissingColumns=True)
    placed = both.repartition("key", "seg", "chunk").sortWithinPartitions("key", "seg", "chunk", "role", "ts", "login_id")
    return _fold(placed, max_failures, window, block)


def _fold_segments(rows: DataFrame, max_failures: int, window: dt.timedelta, block: dt.timedelta) -> DataFrame:
    """Each (key, segment) lands in one shuffle partition, sorted by time; one Python
    pass per partition folds segment after segment with O(1) state."""
    ordered = rows.repartition("key", "seg").sortWithinPartitions("key", "seg", "ts", "login_id")
    none = {c: F.lit(None).cast("long") for c in ("chunk", "start", "count", "until")}
    return _fold(ordered.withColumns(none | {"role": F.lit(1)}), max_failures, window, block)


def _time(us: int | None) -> dt.datetime | None:
    return None if us is None else _EPOCH + us * _US


def _fold(ordered: DataFrame, max_failures: int, window: dt.timedelta, block: dt.timedelta) -> DataFrame:
    """Outcomes of sorted rows; a row of role 0 gives the state before its chunk."""

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur, state, blank, last = object(), None, False, None
        out_types = [pa.string(), pa.int64(), pa.timestamp("us"), pa.bool_(), pa.string(), pa.int32(), pa.int32()]
        for b in batches:
            buf = []
            for key, seg, chunk, lid, ts, ok, role, start, count, until in zip(*(c.to_pylist() for c in b.columns)):
                if (key, seg, chunk) != cur:
                    cur, state, last = (key, seg, chunk), KeyState(), None
                    blank = key is None or key.strip() == ""
                if role == 0:
                    state = KeyState(_time(start), count, _time(until))
                    continue
                k = order_key(ts, lid)
                if last is not None and k < last:
                    raise ValueError(f"login events of key {key!r} arrived out of order")
                last = k
                outcome, n, retry = step(state, ts, bool(ok), blank, max_failures, window, block)
                buf.append((key, lid, ts, bool(ok), outcome, n, retry))
            if buf:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*buf), out_types)], names=OUT_COLUMNS)

    columns = ("key", "seg", "chunk", "login_id", "ts", "success", "role", "start", "count", "until")
    return ordered.select(*columns).mapInArrow(per_partition, OUT_SCHEMA)


def out_frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=OUT_COLUMNS)
    df["ts"] = pd.to_datetime(df["ts"])
    return df
