"""Ordered application of change commands on a stream.

Same buffering as the lockout stream: per hazard_id, rows wait in state until
the watermark passes them and are then folded in (command_ts, command_id)
order with ``operators.apply.apply_one`` (shared with the batch fold W6).
The hazard's snapshot arrives as the first row of its key (row_type 0, time
before every command). Users are a static side joined to the stream, by merging:
they grow with the register, and a broadcast would collect them on the driver in each trigger.
Creates need the current maximum id: a second query over the same source
judges them per micro-batch with W1 in ``foreachBatch`` and numbers them
after the last id of the epoch before, which that epoch committed with its rows.

The state is typed: of the hazard only what the rules compare (reporter, assignee,
status), and the waiting commands as one array per field, at most those of one
allowed lateness. A key without a hazard and without waiting commands has no state.
"""

from __future__ import annotations

import datetime as dt
import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import apply as AP
from ..operators import commands as W
from ..session import checkpoint_dir
from ..sources.sinks import delete_on_exit, path_exists

EPOCH = dt.datetime(1970, 1, 1)
FILES_PER_TRIGGER = 8  # at least; a replay takes a slice's files at once
S_CREATED = "Created"
LATE = "Late"  # result of a command that arrived behind the watermark
OUT_SCHEMA = ("command_id long, hazard_id long, kind string, performed_by_user_id long, result string, "
              "action string")
OUT_COLUMNS = [c.strip().split(" ")[0] for c in OUT_SCHEMA.split(",")]
SOURCE_COLUMNS = ("row_type", "hazard_id", "command_id", "command_ts", "kind", "performed_by_user_id",
                  "new_status", "assign_to_user_id", "details", "title", "description", "severity", "type",
                  "due_date", "reported_by_user_id", "assigned_to_user_id", "status", "created_at")
# What the rules and the results need of a command, and the order of equal ids.
_WAITING = {"command_id": "bigint", "command_us": "bigint", "tie": "bigint", "kind": "string", "performed_by_user_id": "bigint",
            "role": "string", "new_status": "string", "assign_to_user_id": "bigint", "target_is_manager": "boolean",
            "details": "string"}
_AT = list(_WAITING).index("command_us")
# Whole numbers travel as text: a pandas column with NULLs would turn them into floats.
_IDS = ("command_id", "tie", "performed_by_user_id", "assign_to_user_id", "reported_by_user_id", "assigned_to_user_id")
_HAZARD = ("reported_by_user_id", "assigned_to_user_id", "status")
STATE_SCHEMA = ("present boolean, reported_by_user_id long, assigned_to_user_id long, status string, "
                + ", ".join(f"{k} array<{t}>" for k, t in _WAITING.items()))


def _us(ts) -> int | None:
    if ts is None:
        return None
    return int((pd.Timestamp(ts).to_pydatetime().replace(tzinfo=None) - EPOCH) / dt.timedelta(microseconds=1))


def _ts(us):
    return None if us is None else EPOCH + dt.timedelta(microseconds=int(us))


def _order(cmd: tuple) -> tuple:
    command_id, command_us, tie, *_ = cmd
    return AP.order_key(command_us, command_id) + (tie,)


def _state_fn(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    hazard_id = None if key[0] is None or pd.isna(key[0]) else int(key[0])
    wm_us = state.getCurrentWatermarkMs() * 1000
    hz, buf = None, []
    if state.exists:
        present, *rest = state.get
        if present:
            hz = {k: None for k in AP.STATE_FIELDS} | {k: AP._none(v) for k, v in zip(_HAZARD, rest)}
        buf = list(zip(*rest[len(_HAZARD):]))
    late = []
    for b in batches:
        for rec in b.to_dict("records"):
            rec = {k: AP._none(v) for k, v in rec.items()}
            rec.update({k: int(rec[k]) for k in _IDS if rec[k] is not None})
            if rec["row_type"] == AP.ROW_STATE:
                hz = {k: rec.get(k) for k in AP.STATE_FIELDS}
                continue
            rec["command_us"] = _us(rec["command_ts"])
            # Its place in the order has passed, or it has none (no time): reported, not applied.
            if rec["command_us"] is None or rec["command_us"] < wm_us:
                late.append((rec["command_id"], hazard_id, rec["kind"], rec["performed_by_user_id"], LATE, None))
                continue
            buf.append(tuple(rec[k] for k in _WAITING))  # a key may wait with a slice's commands: no dict for each
    buf.sort(key=_order)
    n = bisect_left(buf, wm_us, key=lambda r: r[_AT])
    ready, buf = buf[:n], buf[n:]
    out = late
    for cmd in (dict(zip(_WAITING, r)) for r in ready):
        res, action, _details, hz = AP.apply_one({**_UNUSED, **cmd}, hz)
        out.append((cmd["command_id"], hazard_id, cmd["kind"], cmd["performed_by_user_id"], res, action))
    if hz is None and not buf:
        if state.exists:
            state.remove()
    else:
        waiting = [list(c) for c in zip(*buf)] or [[] for _ in _WAITING]
        state.update((hz is not None, *[hz[k] if hz else None for k in _HAZARD], *waiting))
        if buf:
            state.setTimeoutTimestamp(max(buf[0][_AT] // 1000, state.getCurrentWatermarkMs() + 1))
    if out:
        df = pd.DataFrame(out, columns=OUT_COLUMNS)
        for c in ("command_id", "hazard_id", "performed_by_user_id"):
            df[c] = df[c].astype("Int64")
        yield df


# Fields that an update writes and no rule reads.
_UNUSED = {"title": None, "description": None, "severity": None, "type": None, "due_date": None}


def apply_stream(source: DataFrame, users: DataFrame, lateness: str) -> DataFrame:
    """Streaming results of non-create commands; ``source`` streams snapshot
    rows and command rows (``SOURCE_COLUMNS``). Only what the fold reads is shuffled."""
    uf = W.user_facts(users.hint("merge"))
    perf = uf.select(F.col("user_id").alias("_p"), F.col("active_role").alias("role"))
    tgt = uf.select(F.col("user_id").alias("_t"), F.col("active_manager").alias("target_is_manager"))
    s = (source.where((F.col("row_type") == F.lit(AP.ROW_STATE)) | (F.col("kind") != F.lit(W.KIND_CREATE)))
         .withColumn("event_ts", F.col("command_ts").cast("timestamp")).withColumn("tie", F.xxhash64(*AP.COMMAND_FIELDS))
         .select("row_type", "hazard_id", "command_ts", "event_ts", "tie", *_HAZARD, *[c for c in _WAITING if c in SOURCE_COLUMNS]))
    s = (s.join(perf, s["performed_by_user_id"] == perf["_p"], "left")
         .join(tgt, s["assign_to_user_id"] == tgt["_t"], "left").drop("_p", "_t")
         .withColumn("target_is_manager", F.coalesce("target_is_manager", F.lit(False)))
         .withColumns({c: F.col(c).cast("string") for c in _IDS})
         .withWatermark("event_ts", lateness))
    return s.groupBy("hazard_id").applyInPandasWithState(
        _state_fn, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


CREATE_SCHEMA = ("command_id long, hazard_id long, kind string, performed_by_user_id long, result string, "
                 "action string, new_hazard_id long, epoch long")


def create_batch_writer(users: DataFrame, hazards: DataFrame, sink: str):
    """foreachBatch handler: W1 on the batch's creates against the snapshot;
    OK creates get ids after the last id of the epoch before (at first, the snapshot's
    largest). Each epoch overwrites only its own partition and its own mark, so a
    retried micro-batch writes the same rows once, with the same ids."""
    from ..operators import ids as I

    def last_id(spark: SparkSession, epoch_id: int) -> int:
        """The last id before this epoch: the mark of the epoch before, or the snapshot's largest."""
        mark = f"{sink}_marks/epoch-{epoch_id - 1}"
        if path_exists(spark, mark):
            return spark.read.schema("last_id long").parquet(mark).first()[0]
        if epoch_id > 0:
            raise RuntimeError(f"no mark of epoch {epoch_id - 1} at {sink}_marks")
        return hazards.agg(F.coalesce(F.max("hazard_id"), F.lit(0)).cast("long")).first()[0]

    def handle(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        creates = batch.where((F.col("row_type") == F.lit(AP.ROW_COMMAND)) & (F.col("kind") == W.KIND_CREATE))
        v = W.validate(creates.drop("row_type", "assigned_to_user_id", "status", "created_at"), users.hint("merge"), hazards)
        start = last_id(spark, epoch_id)
        ok = I.assign_sequence(v.where(F.col("result") == W.OK), ["command_id"], F.lit(start), "new_hazard_id")
        rest = v.where(F.col("result") != W.OK).withColumn("new_hazard_id", F.lit(None).cast("long"))
        out = ok.unionByName(rest).select(
            "command_id", "hazard_id", "kind", "performed_by_user_id", "result",
            F.when(F.col("result") == W.OK, F.lit(S_CREATED)).alias("action"), "new_hazard_id",
            F.lit(epoch_id).cast("long").alias("epoch"))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(sink))
        # The mark follows the rows of this epoch only: no scan of the sink or the snapshot.
        own, most = f"{sink}/epoch={epoch_id}", None
        if path_exists(spark, own):
            most = spark.read.schema(CREATE_SCHEMA).parquet(own).agg(F.max("new_hazard_id")).first()[0]
        (spark.createDataFrame([(start if most is None else most,)], "last_id long").coalesce(1)
         .write.mode("overwrite").parquet(f"{sink}_marks/epoch-{epoch_id}"))

    return handle


def source_rows(commands: DataFrame, hazards: DataFrame, snapshot_ts: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(snapshot rows, command rows incl. creates) in the stream's source layout."""
    c = commands.where(F.col("kind") != W.KIND_CREATE)
    touched = c.select("hazard_id").distinct()
    snap = hazards.join(touched, "hazard_id", "left_semi").select(
        F.lit(AP.ROW_STATE).alias("row_type"), "hazard_id", F.lit(None).cast("long").alias("command_id"),
        F.lit(snapshot_ts).cast("timestamp_ntz").alias("command_ts"), F.lit(None).cast("string").alias("kind"),
        F.lit(None).cast("long").alias("performed_by_user_id"), F.lit(None).cast("string").alias("new_status"),
        F.lit(None).cast("long").alias("assign_to_user_id"), F.lit(None).cast("string").alias("details"),
        "title", "description", "severity", "type", "due_date", "reported_by_user_id", "assigned_to_user_id",
        "status", "created_at")
    cmd = commands.select(
        F.lit(AP.ROW_COMMAND).alias("row_type"), "hazard_id", "command_id", "command_ts", "kind",
        "performed_by_user_id", "new_status", "assign_to_user_id", "details", "title", "description",
        "severity", "type", "due_date",
        F.when(F.col("kind") == W.KIND_CREATE, F.col("reported_by_user_id")).cast("long").alias("reported_by_user_id"),
        F.lit(None).cast("long").alias("assigned_to_user_id"), F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"))
    return snap, cmd


def run_over_files(spark: SparkSession, commands: DataFrame, users: DataFrame, hazards: DataFrame,
                   slices: int) -> DataFrame:
    """Replay the command table as a file stream (snapshot first, then
    time-ordered slices, then one sentinel per hazard and a tick) and return
    the streamed results without the sentinels. Each trigger joins the users and passes over
    every state, so it takes about a slice's files: more rows make larger triggers, not more of them."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/commands-stream-{uuid.uuid4().hex}"
    delete_on_exit(spark, root)  # the result is read lazily, so the folder stays until the application ends
    src, sink, ckpt = f"{root}/source", f"{root}/sink", f"{root}/checkpoint"
    bounds = commands.agg(F.min("command_ts").alias("lo"), F.max("command_ts").alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    step = (hi - lo) / slices if hi > lo else dt.timedelta(seconds=1)
    lateness = dt.timedelta(seconds=int(step.total_seconds()) + 1)
    snap, cmd = source_rows(commands, hazards, lo - lateness)
    snap.write.mode("append").parquet(src)
    for i in range(slices):
        cond = (F.col("command_ts") >= F.lit(lo + step * i)) if i else F.lit(True)
        if i < slices - 1:
            cond = cond & (F.col("command_ts") < F.lit(lo + step * (i + 1)))
        cmd.where(cond).write.mode("append").parquet(src)
    far = hi + lateness * 4
    fixed = {"row_type": F.lit(AP.ROW_COMMAND), "command_id": F.lit(-1).cast("long"),
             "command_ts": F.lit(far).cast("timestamp_ntz"), "kind": F.lit("comment")}
    sentinel = cmd.select("hazard_id").distinct().select(
        *[F.col(f.name) if f.name == "hazard_id" else fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
          for f in cmd.schema.fields])
    sentinel.write.mode("append").parquet(src)
    tick = sentinel.limit(1).withColumn("hazard_id", F.lit(-(2 ** 63)).cast("long")) \
        .withColumn("command_ts", F.lit(hi + lateness * 8).cast("timestamp_ntz"))

    written = spark.read.parquet(src)
    per_trigger = max(FILES_PER_TRIGGER, math.ceil(len(written.inputFiles()) / slices))
    stream = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", per_trigger).parquet(src)
    out = apply_stream(stream, users, f"{int(lateness.total_seconds())} seconds")

    def run() -> None:
        q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    # The tick arrives in a later run, so it is a micro-batch of its own: the
    # watermark from everything before it passes every real command.
    tick.write.mode("append").parquet(src)
    run()
    create_sink = f"{root}/creates"
    cq = (stream.writeStream.foreachBatch(create_batch_writer(users, hazards, create_sink))
          .option("checkpointLocation", f"{root}/checkpoint-creates").trigger(availableNow=True).start())
    cq.awaitTermination()
    folded = spark.read.schema(out.schema).parquet(sink).where(F.col("command_id") >= 0)
    created = spark.createDataFrame([], OUT_SCHEMA)
    if path_exists(spark, create_sink):
        created = spark.read.schema(CREATE_SCHEMA).parquet(create_sink).select(*OUT_COLUMNS)
    return folded.unionByName(created)

