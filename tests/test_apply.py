"""The Spark fold equals a plain-Python fold; first commands equal the
snapshot validation; stream forms equal batch forms (small data)."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from riskgrid.operators import apply as AP
from riskgrid.operators import commands as W
from riskgrid.sources import schemas as S

from .test_commands import CMDS, HAZARDS, T0, USERS


def _frames(spark):
    users = spark.createDataFrame(USERS, S.USERS)
    hazards = spark.createDataFrame(HAZARDS, S.HAZARDS)
    rows = [(cid, T0 + dt.timedelta(minutes=cid), kind, hid, p, ns, at, det, rep, "t", "d", None, None, None)
            for cid, kind, hid, p, ns, at, det, rep, _ in CMDS]
    return users, hazards, spark.createDataFrame(rows, S.HAZARD_COMMANDS)


def _plain_fold():
    roles = {u[0]: (u[3] if u[4] else None) for u in USERS}
    managers = {u[0] for u in USERS if u[4] and u[3] == "SiteManager"}
    states = {h[0]: dict(zip(("title", "description", "reported_by_user_id", "assigned_to_user_id", "status",
                              "severity", "type", "created_at", "due_date"), h[1:])) for h in HAZARDS}
    out = {}
    for cid, kind, hid, p, ns, at, det, rep, _ in sorted(CMDS, key=lambda c: c[0]):
        if kind == "create":
            continue
        cmd = dict(command_id=cid, kind=kind, performed_by_user_id=p, role=roles.get(p), new_status=ns,
                   assign_to_user_id=at, target_is_manager=at in managers, details=det, title="t",
                   description="d", severity=None, type=None, due_date=None)
        res, _, _, st = AP.apply_one(cmd, states.get(hid))
        if hid in states:
            states[hid] = st
        out[cid] = res
    return out, states


def test_fold_equals_plain_python(spark):
    users, hazards, cmds = _frames(spark)
    folded = AP.fold(cmds, users, hazards)
    got = {r.command_id: r.result for r in AP.results(folded).collect()}
    want, states = _plain_fold()
    assert got == want
    st = {r.hazard_id: (r.status, r.assigned_to_user_id) for r in folded.where("row_type = 'state'").collect()}
    for hid, (status, asg) in st.items():
        assert (states[hid]["status"], states[hid]["assigned_to_user_id"]) == (status, asg)


def test_fold_sees_earlier_effects(spark):
    users, hazards, cmds = _frames(spark)
    got = {r.command_id: r.result for r in AP.results(AP.fold(cmds, users, hazards)).collect()}
    snap = {r.command_id: r.result for r in W.validate(cmds, users, hazards).collect()}
    # command 4 (assign NULL) runs after 3 moved hazard 1 to InProgress: now Forbidden
    assert snap[4] == "OK" and got[4] == "Forbidden"


def test_apply_outputs(spark):
    users, hazards, cmds = _frames(spark)
    logs = spark.createDataFrame([(1, 1, "Created", "", 1, T0)], S.HAZARD_LOGS)
    new_h, new_l, res = AP.apply(cmds, users, hazards, logs)
    assert new_h.count() == len(HAZARDS) + 1
    ok = res.where(F.col("result") == "OK").count()
    assert new_l.count() == 1 + ok
    ids = [r.hazard_log_id for r in new_l.orderBy("hazard_log_id").collect()]
    assert ids == list(range(1, 2 + ok))


def test_split_fold_equals_plain_fold(spark):
    from riskgrid.operators import apply_split as AS
    users, hazards, cmds = _frames(spark)
    cols = AP.FOLD_COLUMNS
    a = AP.fold(cmds, users, hazards).select(cols)
    for chunk in (1, 3, 10_000):
        b = AS.fold_split(cmds, users, hazards, chunk).select(cols)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _random_commands(n, hazards=2, seed=1):
    """Commands of a few hot hazards by officers, managers, workers and strangers: equal times, NULL and
    repeated ids, whole rows repeated."""
    import random
    rng = random.Random(seed)
    users = [(i, f"u{i}", f"U {i}", ["SafetyOfficer", "SiteManager", "SiteManager", "SiteManager", "FieldWorker", "Auditor"][i % 6],
              i % 11 != 10) for i in range(1, 25)]
    known = [(h, f"h{h}", "d", rng.randint(1, 24), rng.choice([None, 2, 3]), rng.choice(["Open", "InProgress", "odd"]), "Low", "Fire", T0, None)
             for h in range(1, hazards + 1)]
    rows = []
    for i in range(n):
        kind = rng.choice(["assign", "assign", "change_status", "change_status", "comment", "update"])
        row = (rng.choice([i, i, i, None, i // 7]), rng.choice([None, *[T0 + dt.timedelta(minutes=i // 3)] * 9]), kind,
               rng.choice([*range(1, hazards + 1), hazards + 9]), rng.choice([None, *range(1, 27)]),
               rng.choice([None, "Open", "inprogress", "InProgress ", "Resolved", "bogus", ""]), rng.choice([None, *range(1, 26)]),
               rng.choice([None, "", "why"]), None, f"t{i % 5}", None, None, None, None)
        rows += [row] * rng.choice([1, 1, 1, 2])
    return users, known, rows


def test_split_equals_plain_with_nulls_ties_and_repeats(spark):
    from riskgrid.operators import apply_split as AS
    for n, chunk, seed in ((400, 7, 1), (900, 60, 2), (60, 1, 3)):
        u, h, c = _random_commands(n, seed=seed)
        users, hazards = spark.createDataFrame(u, S.USERS), spark.createDataFrame(h, S.HAZARDS)
        loose = StructType([StructField(f.name, f.dataType) for f in S.HAZARD_COMMANDS])
        cmds = spark.createDataFrame(c, loose).repartition(5)
        a = AP.fold(cmds, users, hazards).select(AP.FOLD_COLUMNS)
        b = AS.fold_auto(cmds, users, hazards, work_rows=0, chunk_rows=chunk).select(AP.FOLD_COLUMNS)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        assert a.where("row_type = 'result'").count() == len(c) and a.where("row_type = 'result' and result = 'OK'").count() > n // 20


def test_chunk_tables_say_what_the_fold_does():
    """A chunk's table equals folding its commands, from every assignee and status; so do composed tables."""
    import random
    from riskgrid.operators import apply_split as AS
    rng = random.Random(5)
    roles = {i: ["SafetyOfficer", "SiteManager", "SiteManager", "FieldWorker", None][i % 5] for i in range(9)}
    def commands(n):
        out = []
        for _ in range(n):
            p, t = rng.randrange(9), rng.choice([None, *range(9)])
            out.append(dict(kind=rng.choice(["assign", "change_status", "comment", "update"]), performed_by_user_id=p, role=roles[p],
                            new_status=rng.choice([None, "Open", "Inprogress", "Resolved", "x"]), assign_to_user_id=t, command_id=1,
                            target_is_manager=t is not None and roles[t] == "SiteManager", details="d", title="", description="",
                            severity="", type="", due_date=None))
        return out
    for _ in range(60):
        parts = [commands(rng.choice([0, 1, 2, 5, 12])) for _ in range(rng.randint(1, 4))]
        table = AS.identity()
        for part in parts:
            c = AS.Chunk()
            for cmd in part:
                c.add(cmd)
            table = AS.compose_tables(table, AS.from_lines(AS.to_lines(c.table())))
        for a in (None, *range(9), 77):
            for s in ("Open", "InProgress", "Resolved", None, "odd"):
                state = {k: None for k in AP.STATE_FIELDS} | {"assigned_to_user_id": a, "status": s, "reported_by_user_id": 3}
                for cmd in (x for part in parts for x in part):
                    state = AP.apply_one(cmd, state)[3]
                assert AS._advance(AS.to_lines(table), {"a": a, "s": s}) == {"a": state["assigned_to_user_id"], "s": state["status"]}


def test_auto_fold_routes_hot_hazards(spark):
    from riskgrid.operators import apply_split as AS
    from riskgrid.operators import hot as H
    users, hazards, cmds = _frames(spark)
    loose = cmds.limit(1).withColumn("hazard_id", F.lit(None).cast("long")).withColumn("kind", F.lit("comment")) \
        .withColumn("command_id", F.lit(2 ** 53 + 1))
    cmds = cmds.unionByName(loose)
    c = cmds.where("kind != 'create'")
    hot = H.hot_keys(c, ["hazard_id"], 3)
    assert 1 in {r.hazard_id for r in hot.collect()}
    flagged = H.flag_hot(c, hot, ["hazard_id"], "_hot")
    assert flagged.count() == c.count() and flagged.where("_hot is null").count() == 0
    cols = AP.FOLD_COLUMNS
    a = AP.fold(cmds, users, hazards).select(cols)
    for work in (0, 1, 3, 10 ** 9):
        b = AS.fold_auto(cmds, users, hazards, work_rows=work, chunk_rows=3).select(cols)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert {r.command_id for r in a.where("hazard_id is null").collect()} == {2 ** 53 + 1}


def test_ids_over_2_53_stay_whole(spark):
    from riskgrid.operators import apply_split as AS
    users, hazards, cmds = _frames(spark)
    big = cmds.withColumn("command_id", F.col("command_id") + F.lit(2 ** 53 + 1))
    want = {r.command_id + 2 ** 53 + 1: r.result for r in AP.results(AP.fold(cmds, users, hazards)).collect()}
    for fold in (AP.fold, lambda *x: AS.fold_split(*x, 3)):
        assert {r.command_id: r.result for r in AP.results(fold(big, users, hazards)).collect()} == want


def test_status_is_stored_in_canonical_spelling():
    state = {"title": "", "description": "", "reported_by_user_id": 3, "assigned_to_user_id": 2, "status": "Open",
             "severity": "", "type": "", "created_at": None, "due_date": None}
    cmd = dict(command_id=1, kind="change_status", performed_by_user_id=2, role="SiteManager", new_status=" inprogress",
               assign_to_user_id=None, target_is_manager=False, details=None, title=None, description=None,
               severity=None, type=None, due_date=None)
    res, _, text, st = AP.apply_one(cmd, state)
    assert (res, text, st["status"]) == ("OK", "Open -> inprogress", "InProgress")
    assert AP.apply_one({**cmd, "new_status": "RESOLVED "}, st)[0] == "OK"


def test_stream_create_writer_numbers_across_epochs(spark):
    import tempfile
    from riskgrid.streaming import commands_stream as CS
    users, hazards, cmds = _frames(spark)
    _, src = CS.source_rows(cmds, hazards, T0)
    sink = tempfile.mkdtemp(prefix="riskgrid-creates-") + "/out"
    handle = CS.create_batch_writer(users, hazards, sink)
    handle(src.where("command_id <= 12"), 0)
    handle(src.where("command_id > 12"), 1)
    handle(src.where("command_id > 12"), 1)          # a retried epoch writes its rows once
    got = {r.command_id: r.new_hazard_id for r in spark.read.parquet(sink).collect()}
    want = {r.command_id: r.new_hazard_id for r in W.validate_creates(cmds, users, hazards).collect()}
    assert got == want
