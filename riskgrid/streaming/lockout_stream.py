"""Login lockout on a stream of login events (L2).

``applyInPandasWithState`` with an event-time timeout. Rows of a
key are buffered in state and folded in (ts, login_id) order only once the
watermark has passed them (ts < watermark), so the outcome of every attempt
equals the batch operator's, whatever order rows arrive in within the
allowed lateness. Rows behind the watermark come out as ``late`` and change
nothing. A call into Python costs milliseconds whatever it folds, so keys share ``groups`` states by their hash;
inside one, every key has its own fold. The state is typed: per key the fold's three fields, its last time and its
number of waiting rows, and the waiting rows as three arrays,
which hold at most the rows of one allowed lateness. A key leaves the state once it has been idle for longer than window + block (such a gap
resets every rule of the fold).

The fold itself is ``operators.lockout.step``, shared with the batch form.
"""

from __future__ import annotations

import datetime as dt
import itertools
import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import lockout as LK
from ..session import checkpoint_dir
from ..sources.sinks import delete_on_exit

LATE = "late"  # outcome of an attempt that arrived behind the watermark
STATE_SCHEMA = ("keys array<string>, window_starts_us array<bigint>, counts array<int>, blocked_until_us array<bigint>, "
                "last_ts_us array<bigint>, n_waiting array<int>, "
                "ids array<bigint>, times array<bigint>, successes array<boolean>")
EPOCH = dt.datetime(1970, 1, 1)
_NO_TIME = np.iinfo(np.int64).min
FILES_PER_TRIGGER = 8  # at least; a replay takes a slice's files at once
GROUPS = 4096  # states of a stream; fixed for the life of its checkpoint
GROUP_ROWS = 2048  # rows of a replayed table that share a state, on average


def _us(ts: dt.datetime | None) -> int | None:
    return None if ts is None else (ts - EPOCH) // dt.timedelta(microseconds=1)


def _ts(us: int | None):
    return None if us is None else EPOCH + dt.timedelta(microseconds=int(us))


@dataclass
class Tracked:
    """A key in the state: its fold, the last time folded, and its waiting rows (login_id, time, success)."""
    fold: LK.KeyState = field(default_factory=LK.KeyState)
    last_us: int | None = None
    waiting: list = field(default_factory=list)


def _unpack(keys, starts, counts, blocked, lasts, n_waiting, *rows) -> dict:
    rows = zip(*rows)
    return {k: Tracked(LK.KeyState(_ts(ws), c, _ts(bu)), last, list(itertools.islice(rows, n)))
            for k, ws, c, bu, last, n in zip(keys, starts, counts, blocked, lasts, n_waiting)}


def _pack(tracked: dict) -> tuple:
    rows = [r for t in tracked.values() for r in t.waiting]
    per_key = [(k, _us(t.fold.window_start), t.fold.count, _us(t.fold.blocked_until), t.last_us, len(t.waiting))
               for k, t in tracked.items()]
    return (*map(list, zip(*per_key)), *([list(c) for c in zip(*rows)] or [[], [], []]))


def make_state_fn(max_failures: int, window: dt.timedelta, block: dt.timedelta):
    idle_us = int((window + block) / dt.timedelta(microseconds=1))

    def fn(_group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wm_us = state.getCurrentWatermarkMs() * 1000
        tracked = _unpack(*state.get) if state.exists else {}
        out = []
        for b in batches:
            times = b["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
            for k, lid, t, ok in zip(b["key"].tolist(), b["login_id"].tolist(), times, b["success"].tolist()):
                k = None if pd.isna(k) else k
                if t == _NO_TIME or t < wm_us:  # its place in the order has passed, or it has none: reported, not counted
                    out.append((k, int(lid), None if t == _NO_TIME else _ts(t), bool(ok), LATE, None, None))
                    continue
                if k not in tracked:
                    tracked[k] = Tracked()
                tracked[k].waiting.append((int(lid), t, bool(ok)))
        for k, at in list(tracked.items()):
            at.waiting.sort(key=lambda r: (r[1], r[0]))
            n = bisect_left(at.waiting, wm_us, key=lambda r: r[1])
            ready, at.waiting = at.waiting[:n], at.waiting[n:]
            out += LK.fold_key(k, ((lid, _ts(t), ok) for lid, t, ok in ready), at.fold, max_failures, window, block)
            if ready:
                at.last_us = ready[-1][1]
            if not at.waiting and (at.last_us is None or wm_us > at.last_us + idle_us):
                del tracked[k]
        if not tracked:
            state.remove()
        else:
            state.update(_pack(tracked))
            nxt = min(at.waiting[0][1] if at.waiting else at.last_us + idle_us for at in tracked.values())
            state.setTimeoutTimestamp(max(nxt // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            df = LK.out_frame(out)
            df["ts"] = pd.to_datetime(df["ts"])
            yield df

    return fn


def lockout_stream(events: DataFrame, key: Column, lateness: str, max_failures: int = LK.DEFAULT_MAX_FAILURES,
                   window: dt.timedelta = LK.DEFAULT_WINDOW, block: dt.timedelta = LK.DEFAULT_BLOCK,
                   groups: int = GROUPS) -> DataFrame:
    """Streaming DataFrame of outcomes; ``events`` is a streaming source of
    login events (ts as TIMESTAMP_NTZ, read in UTC); ``groups`` is the number of
    states that the keys share."""
    rows = (events.select(key.alias("key"), "login_id", F.col("ts").cast("timestamp").alias("ts"), "success")
            .withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).withWatermark("ts", lateness))
    out_schema = LK.OUT_SCHEMA.replace("ts timestamp_ntz", "ts timestamp")
    return rows.groupBy("group").applyInPandasWithState(
        make_state_fn(max_failures, window, block), out_schema, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)


def run_over_files(spark: SparkSession, events: DataFrame, key_fn, slices: int,
                   max_failures: int, window: dt.timedelta, block: dt.timedelta) -> DataFrame:
    """Replay a batch table of login events as a file stream and return the
    streamed outcomes (sentinels removed).

    The table is written as ``slices`` time-ordered files (one write per time
    range, so file order is time order), followed by one sentinel event per
    key and a final tick that moves the watermark past all real rows. The
    stream runs with ``availableNow`` into a parquet sink under the shared
    checkpoint folder. A trigger passes over every state, so it takes about a slice's
    files: more rows make larger triggers, not more of them."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/lockout-stream-{uuid.uuid4().hex}"
    delete_on_exit(spark, root)  # the result is read lazily, so the folder stays until the application ends
    src, sink, ckpt = f"{root}/source", f"{root}/sink", f"{root}/checkpoint"
    cols = ["login_id", "ts", "ip", "user_name", "success"]
    ev = events.select(*cols)
    span = ev.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count("*").alias("n")).first()
    lo, hi = span["lo"], span["hi"]
    step = (hi - lo) / slices if hi > lo else dt.timedelta(seconds=1)
    # Files of one slice may arrive in any order: the allowed lateness covers
    # a slice, so no real row is ever behind the watermark.
    lateness = dt.timedelta(seconds=int(step.total_seconds()) + 1)
    for i in range(slices):
        a = lo + step * i
        cond = (F.col("ts") >= F.lit(a)) if i else F.lit(True)
        if i < slices - 1:
            cond = cond & (F.col("ts") < F.lit(lo + step * (i + 1)))
        ev.where(cond).write.mode("append").parquet(src)
    far = hi + lateness * 4
    sentinels = (ev.withColumn("_k", key_fn()).groupBy("_k")
                 .agg(F.first("ip").alias("ip"), F.first("user_name").alias("user_name"))
                 .select(F.lit(-1).cast("long").alias("login_id"), F.lit(far).cast("timestamp_ntz").alias("ts"),
                         "ip", "user_name", F.lit(True).alias("success")))
    sentinels.write.mode("append").parquet(src)
    per_trigger = max(FILES_PER_TRIGGER, math.ceil(len(spark.read.schema(ev.schema).parquet(src).inputFiles()) / slices))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", per_trigger).parquet(src)
    out = lockout_stream(stream, key_fn(), f"{int(lateness.total_seconds())} seconds", max_failures, window, block,
                         max(1, math.ceil(span["n"] / GROUP_ROWS)))

    def run() -> None:
        q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    # The tick arrives in a later run, so it is a micro-batch of its own: the
    # watermark from everything before it passes every real row.
    spark.createDataFrame([(-2, hi + lateness * 8, "tick", "tick", True)], ev.schema) \
        .write.mode("append").parquet(src)
    run()
    res = spark.read.schema(out.schema).parquet(sink)
    return res.where(F.col("login_id") >= 0).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
