"""Lockout fold (L1) scenarios with the default limits, and batch = stream."""

import datetime as dt

from riskgrid.operators import lockout as LK
from riskgrid.sources import schemas as S

T0 = dt.datetime(2026, 1, 1, 8, 0, 0)


def _run(spark, events, **kw):
    rows = [(i, T0 + dt.timedelta(minutes=m), ip, user, ok) for i, (m, ip, user, ok) in enumerate(events)]
    df = spark.createDataFrame(rows, S.LOGIN_EVENTS)
    return [(r.outcome, r.failure_count, r.retry_after_minutes)
            for r in LK.lockout(df, **kw).orderBy("login_id").collect()]


def test_block_refuse_reblock_and_reset(spark):
    ev = [(m, "ip", "Bob", False) for m in (0, 1, 2, 3, 4)]
    ev += [(5, "ip", "bob", True), (9.5, "ip", "BOB", False), (10, "ip", "bob", True), (15, "ip", "bob", True),
           (16, "ip", "bob", False)]
    got = _run(spark, ev)
    assert got[:5] == [("failed", n, None) for n in (1, 2, 3, 4, 5)]
    assert got[5] == ("refused", 5, 4)           # blocked until minute 9
    assert got[6] == ("failed", 6, None)         # block over, same window: blocked again
    assert got[7] == ("refused", 6, 5)           # until 14.5
    assert got[8] == ("allowed", 0, None)        # success resets
    assert got[9] == ("failed", 1, None)


def test_window_edge_is_inclusive(spark):
    got = _run(spark, [(0, "ip", "a", False), (10, "ip", "a", False), (20.01, "ip", "a", False)])
    assert [g[1] for g in got] == [1, 2, 1]


def test_blank_user_key_is_not_tracked(spark):
    from pyspark.sql import functions as F
    got = _run(spark, [(m, "ip", "  ", False) for m in range(7)], key=LK.user_key())
    assert all(g == ("failed", 0, None) for g in got)
    got2 = _run(spark, [(m, "ip", "  ", False) for m in range(7)], key=F.lit(""))
    assert all(g[0] == "failed" for g in got2)


def test_keys_are_independent(spark):
    ev = [(m, "ip1", "a", False) for m in range(5)] + [(5, "ip2", "a", True), (6, "ip1", "a", True)]
    got = _run(spark, ev)
    assert got[5] == ("allowed", 0, None) and got[6][0] == "refused"


def test_idle_gaps_split_a_hot_key_without_changing_results(spark):
    from pyspark.sql import functions as F
    # one hot key: bursts of failures separated by long idle gaps, plus a sparse key
    ev = []
    for burst in range(6):
        base = burst * 60
        ev += [(base + m, "ip", "hot", m % 4 == 3) for m in range(0, 9)]
    ev += [(m * 7, "ip", "cold", False) for m in range(5)]
    rows = [(i, T0 + dt.timedelta(minutes=m), ip, user, ok) for i, (m, ip, user, ok) in enumerate(ev)]
    df = spark.createDataFrame(rows, S.LOGIN_EVENTS)
    cols = ["key", "login_id", "outcome", "failure_count", "retry_after_minutes"]
    a = LK.lockout(df, split_idle_gaps=True).select(cols)
    b = LK.lockout(df, split_idle_gaps=False).select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    segs = LK.idle_segments(df.select(LK.login_key().alias("key"), "login_id", "ts", "success"),
                            LK.DEFAULT_WINDOW + LK.DEFAULT_BLOCK)
    per_key = {r.key: r.n for r in segs.groupBy("key").agg(F.countDistinct("seg").alias("n")).collect()}
    assert per_key == {"ip|hot": 6, "ip|cold": 1}


def test_hot_key_routing_keeps_results(spark):
    ev = [(m * 30, "ip", "hot", m % 5 == 4) for m in range(40)] + [(m, "ip", "cold", False) for m in range(3)]
    rows = [(i, T0 + dt.timedelta(minutes=m), ip, user, ok) for i, (m, ip, user, ok) in enumerate(ev)]
    df = spark.createDataFrame(rows, S.LOGIN_EVENTS)
    cols = ["key", "login_id", "outcome", "failure_count", "retry_after_minutes"]
    a = LK.lockout(df, work_rows=1).select(cols)
    b = LK.lockout(df, split_idle_gaps=False).select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_safe_successes_split_dense_mixed_traffic(spark):
    from pyspark.sql import functions as F
    # dense traffic on one key: failures and successes a minute apart, no idle gap
    ev = [(m, "ip", "hot", (m % 10) >= 3) for m in range(120)]
    rows = [(i, T0 + dt.timedelta(minutes=m), ip, user, ok) for i, (m, ip, user, ok) in enumerate(ev)]
    df = spark.createDataFrame(rows, S.LOGIN_EVENTS)
    cols = ["key", "login_id", "outcome", "failure_count", "retry_after_minutes"]
    for mf, w, b in ((3, dt.timedelta(minutes=10), dt.timedelta(minutes=2)), (2, dt.timedelta(minutes=30),
                                                                               dt.timedelta(minutes=5))):
        a = LK.lockout(df, max_failures=mf, window=w, block=b, work_rows=1).select(cols)
        c = LK.lockout(df, max_failures=mf, window=w, block=b, split_idle_gaps=False).select(cols)
        assert a.exceptAll(c).count() == 0 and c.exceptAll(a).count() == 0
    keyed = df.select(LK.login_key().alias("key"), "login_id", "ts", "success")
    n_gap = LK.idle_segments(keyed, dt.timedelta(minutes=12)).select("seg").distinct().count()
    n_safe = LK.idle_segments(keyed, dt.timedelta(minutes=12), dt.timedelta(minutes=2)).select("seg").distinct().count()
    assert n_gap == 1 and n_safe > 10
    assert keyed.count() == LK.idle_segments(keyed, dt.timedelta(minutes=12), dt.timedelta(minutes=2)).count()


def _both(df, **kw):
    cols = ["key", "login_id", "ts", "outcome", "failure_count", "retry_after_minutes"]
    a = LK.lockout(df, split_idle_gaps=False, **kw).select(cols)
    b = LK.lockout(df, work_rows=3, chunk_rows=7, **kw).select(cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    return a


def test_chunks_of_a_dense_burst_keep_results(spark):
    """Failures without a reset, dense mixtures, equal times, and attempts without a time."""
    import random
    rng = random.Random(7)
    ev = [(i, T0 + dt.timedelta(seconds=i // 2), "ip", "burst", False) for i in range(900)]
    ev += [(1000 + i, T0 + dt.timedelta(seconds=20 * i), "ip", "mixed", rng.random() < 0.4) for i in range(400)]
    ev += [(2000 + i, rng.choice([None, T0 + dt.timedelta(seconds=rng.randrange(900))]), "ip", "odd", rng.random() < 0.3) for i in range(200)]
    ev += [(3000 + i, T0 + dt.timedelta(seconds=i), "ip", "good", True) for i in range(60)]
    from pyspark.sql.types import StructField, StructType
    df = spark.createDataFrame(ev, StructType([StructField(f.name, f.dataType) for f in S.LOGIN_EVENTS])).repartition(4)
    got = _both(df)
    assert got.where("outcome = 'refused'").count() > 300 and got.count() == len(ev)
    assert got.where("ts is null and (failure_count <> 0 or outcome = 'refused')").count() == 0
    _both(df, max_failures=2, window=dt.timedelta(minutes=3), block=dt.timedelta(seconds=70))


def test_advance_is_the_fold():
    import random
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(0, 60)
        times = sorted(rng.randrange(400) for _ in range(n))
        ok = [rng.random() < rng.choice([0.05, 0.5, 0.9]) for _ in range(n)]
        most, window, block = rng.randint(1, 4), rng.randint(1, 80), rng.randint(1, 60)
        first = rng.choice([(None, 0, None), (-rng.randrange(90), rng.randint(1, 5), rng.choice([None, rng.randrange(60)]))])
        us = dt.timedelta(microseconds=1)
        state = LK.KeyState(LK._time(first[0]), first[1], LK._time(first[2]))
        for t, k in zip(times, ok):
            LK.step(state, LK._time(t), k, False, most, window * us, block * us)
        start, count, until = LK.advance(times, [i for i, k in enumerate(ok) if not k], first, most, window, block)
        blocked = until if until is not None and (not times or until > times[-1]) else None
        now = None if state.blocked_until is None else (state.blocked_until - LK._EPOCH) // us
        assert (LK._time(start), count) == (state.window_start, state.count)
        assert blocked == (now if now is not None and (not times or now > times[-1]) else None)
