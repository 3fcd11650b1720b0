"""Stream-specific behaviour of the lockout stream: out-of-order rows within
the allowed lateness are folded in time order; rows behind the watermark are
reported as late and change nothing."""

import datetime as dt
import glob
import os
import random
import tempfile
from urllib.parse import urlparse

from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from riskgrid.operators import apply as AP
from riskgrid.operators import commands as W
from riskgrid.operators import lockout as LK
from riskgrid.plans.explain import plan_text
from riskgrid.session import checkpoint_dir
from riskgrid.sources import schemas as S
from riskgrid.streaming import commands_stream as CS
from riskgrid.streaming import lockout_stream as LS

T0 = dt.datetime(2026, 1, 1, 8, 0, 0)


def test_lateness_and_late_rows(spark):
    root = tempfile.mkdtemp(prefix="riskgrid-stream-")
    src = root + "/src"

    def put(rows):
        spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), "ip", "u", ok) for i, m, ok in rows],
                              S.LOGIN_EVENTS).coalesce(1).write.mode("append").parquet(src)

    put([(1, 0, False), (3, 2, False)])        # batch 1
    put([(2, 1, False), (4, 3, False)])        # out of order, within lateness
    put([(5, 200, False)])                     # moves the watermark to minute 140
    put([(6, 100, False)])                     # behind the watermark: late
    put([(7, 400, False)])                     # folds everything before minute 340
    put([(8, 1000, False)])                    # tick
    stream = spark.readStream.schema(S.LOGIN_EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
    out = LS.lockout_stream(stream, LK.login_key(), "60 minutes", max_failures=3,
                            window=dt.timedelta(minutes=10), block=dt.timedelta(minutes=5))
    q = (out.writeStream.format("parquet").option("path", root + "/sink")
         .option("checkpointLocation", root + "/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.login_id: (r.outcome, r.failure_count) for r in spark.read.parquet(root + "/sink").collect()}
    assert got[6] == (LS.LATE, None) and len(got) >= 7
    assert got[1] == ("failed", 1) and got[2] == ("failed", 2) and got[3] == ("failed", 3)
    assert got[4][0] == "refused"               # blocked at minute 2 until minute 7
    assert got[5] == ("failed", 1)


def _events(spark, n, keys):
    rng = random.Random(11)
    rows = [(i, T0 + dt.timedelta(minutes=rng.randrange(3000)), "ip", rng.choice(keys), rng.random() < 0.4) for i in range(n)]
    return spark.createDataFrame(rows, S.LOGIN_EVENTS)


LIMITS = dict(max_failures=3, window=dt.timedelta(minutes=90), block=dt.timedelta(minutes=30))


def _same(stream, events):
    cols = ["key", "login_id", "ts", "success", "outcome", "failure_count", "retry_after_minutes"]
    a, b = stream.select(cols), LK.lockout(events, LK.user_key(), **LIMITS).select(cols)
    assert a.count() == events.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_keys_share_states(spark):
    """Forty keys, a blank and a missing one among them, fold in five states as each would alone."""
    ev = _events(spark, 1200, [None, "  "] + [f"u{i}" for i in range(38)])
    root = tempfile.mkdtemp(prefix="riskgrid-stream-")
    for i in range(6):  # six triggers, each with rows of all times: the lateness covers them
        ev.where(F.col("login_id") % 6 == i).coalesce(1).write.mode("append").parquet(root + "/src")
    spark.createDataFrame([(-1, T0 + dt.timedelta(days=9), "ip", "u0", True)], S.LOGIN_EVENTS).coalesce(1) \
        .write.mode("append").parquet(root + "/src")
    stream = spark.readStream.schema(S.LOGIN_EVENTS).option("maxFilesPerTrigger", 1).parquet(root + "/src")
    out = LS.lockout_stream(stream, LK.user_key(), "3000 minutes", **LIMITS, groups=5)
    q = (out.writeStream.format("parquet").option("path", root + "/sink")
         .option("checkpointLocation", root + "/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(states) == 5
    got = spark.read.parquet(root + "/sink").where("login_id >= 0")
    _same(got.withColumn("ts", F.col("ts").cast("timestamp_ntz")), ev)


def test_replay_triggers_do_not_grow_with_files(spark):
    """Twelve files a slice: a trigger takes a slice's files, so four and the last ones suffice."""
    ev = _events(spark, 2000, [f"u{i}" for i in range(60)])
    known = set(_replays(spark))
    _same(LS.run_over_files(spark, ev.repartition(12), LK.user_key, 4, **LIMITS), ev)
    root, = set(_replays(spark)) - known
    triggers = [c for c in os.listdir(f"{root}/checkpoint/commits") if c.isdigit()]
    assert len(triggers) <= 4 + 1 + 2  # data, what the watermark then frees, and the tick's two


def _replays(spark, of="lockout"):
    return glob.glob(urlparse(checkpoint_dir(spark)).path + f"/{of}-stream-*")


def _register(spark, n):
    """Users, hazards and n commands of all kinds, some on no hazard, some by nobody, one without a time."""
    rng = random.Random(7)
    users = spark.createDataFrame([(i, f"u{i}", f"U{i}", S.ROLES[i % len(S.ROLES)], i % 7 != 0) for i in range(1, 30)], S.USERS)
    hazards = spark.createDataFrame([(i, f"h{i}", "x", 1 + i % 29, None if i % 3 else 1 + i % 11, "Open", "Low", "Fire", T0, None)
                                     for i in range(1, 13)], S.HAZARDS)
    rows = [(i, None if i == 5 else T0 + dt.timedelta(minutes=rng.randrange(3000)), "comment" if i == 5 else rng.choice(["create", *KINDS]),
             rng.choice([-1, *range(1, 13)]), rng.choice([None, *range(1, 32)]), rng.choice([None, "InProgress", "Resolved", "?"]),
             rng.choice([None, *range(1, 30)]), rng.choice([None, "", "d"]), rng.randrange(1, 30), f"t{i}", "x", "Low", "Fire", None) for i in range(n)]
    return users, hazards, spark.createDataFrame(rows, (
        "command_id long, command_ts timestamp_ntz, kind string, hazard_id long, performed_by_user_id long, new_status string, "
        "assign_to_user_id long, details string, reported_by_user_id long, title string, description string, severity string, "
        "type string, due_date timestamp_ntz"))


KINDS = (W.KIND_UPDATE, W.KIND_ASSIGN, W.KIND_STATUS, W.KIND_COMMENT)


def test_command_replay_merges_users_in_few_triggers(spark, monkeypatch):
    """Users are on no broadcast side, neither of the fold nor of the creates; twelve files a slice make no
    more triggers than one; the results are the batch fold's."""
    users, hazards, cmds = _register(spark, 900)
    plans, runs, known = [], [], set(_replays(spark, "commands"))
    validate, start = W.validate, DataStreamWriter.start

    def seen(*args):
        out = validate(*args)
        plans.append(plan_text(out))
        return out

    monkeypatch.setattr(W, "validate", seen)
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: runs.append(start(self, *a, **k)) or runs[-1])
    got = CS.run_over_files(spark, cmds.repartition(12), users, hazards, 4)
    monkeypatch.undo()
    root, = set(_replays(spark, "commands")) - known
    triggers = {of: len([c for c in os.listdir(f"{root}/{of}/commits") if c.isdigit()]) for of in ("checkpoint", "checkpoint-creates")}
    assert max(triggers.values()) <= 4 + 1 + 2 and len(plans) == triggers["checkpoint-creates"]
    plans += [q._jsq.explainInternal(False) for q in runs[:2]]
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
    want = AP.apply(cmds, users, hazards, spark.createDataFrame([], S.HAZARD_LOGS))[2]
    # The command without a time is late on the stream and comes first in the batch fold.
    got, want = (df.where("command_id != 5").select(CS.OUT_COLUMNS) for df in (got, want))
    assert got.count() == 899 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
