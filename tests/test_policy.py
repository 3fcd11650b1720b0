"""Policy rules (P1-P8) on the reference's unit-test rows and a truth table
against the SQL accessibility (V2) and the viewer scope (V1)."""

import itertools

import pytest
from pyspark.sql import functions as F

from riskgrid.functions import policy as P
from riskgrid.operators import scope as V

SCHEMA = "uid int, role string, reporter int, assignee int, status string"


def _view(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("exists", F.lit(True))
    return [r[0] for r in df.select(P.can_view("role", "uid", "reporter", "assignee", "status", "exists")).collect()]


def test_officer_sees_any(spark):
    assert _view(spark, [(999, "SafetyOfficer", 10, None, "Open")]) == [True]


def test_worker_reporter_assignee_other(spark):
    rows = [(5, "FieldWorker", 5, None, "Open"), (5, "FieldWorker", 1, 5, "InProgress"),
            (5, "FieldWorker", 1, 2, "Open")]
    assert _view(spark, rows) == [True, True, False]


def test_manager_unassigned_open_vs_in_progress(spark):
    rows = [(7, "SiteManager", 1, None, "Open"), (7, "SiteManager", 1, None, "InProgress")]
    assert _view(spark, rows) == [True, False]


def test_comment_roles(spark):
    df = spark.createDataFrame([("FieldWorker",), ("SiteManager",), ("SafetyOfficer",), ("Unknown",)], "role string")
    assert [r[0] for r in df.select(P.can_add_comment("role")).collect()] == [True, True, True, False]


def test_missing_hazard_denied_by_policy(spark):
    df = spark.createDataFrame([(1, "SafetyOfficer", None, None, None)], SCHEMA).withColumn("exists", F.lit(False))
    r = df.select(P.can_view("role", "uid", "reporter", "assignee", "status", "exists"),
                  F.array_join(P.allowed_next_statuses("role", "uid", "assignee", "status", "exists"), ",")).first()
    assert r[0] is False and r[1] == ""


def test_manager_status_policy_is_two_valued(spark):
    # unassigned Open hazard: the proc allows InProgress (NULL <> id), the policy does not
    df = spark.createDataFrame([(7, "SiteManager", 1, None, "Open")], SCHEMA).withColumn("exists", F.lit(True))
    r = df.select(P.can_change_status("role", "uid", "reporter", "assignee", "status", "exists", "InProgress")).first()
    assert r[0] is False


def test_next_statuses(spark):
    rows = [(1, "SafetyOfficer", 2, None, "Resolved"), (7, "SiteManager", 1, 7, "Open"),
            (7, "SiteManager", 1, 7, "InProgress"), (7, "SiteManager", 1, 7, "Resolved"),
            (7, "SiteManager", 1, 8, "Open"), (5, "FieldWorker", 5, 5, "Open")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("exists", F.lit(True))
    got = [r[0] for r in df.select(F.array_join(
        P.allowed_next_statuses("role", "uid", "assignee", "status", "exists"), ",")).collect()]
    assert got == ["Open,InProgress,Resolved", "InProgress", "Resolved", "", "", ""]


@pytest.fixture(scope="module")
def truth(spark):
    roles = ["SafetyOfficer", "SiteManager", "FieldWorker", "Auditor"]
    rel = {"reporter": (1, 9), "assignee": (9, 1), "none": (9, 8), "both": (1, 1)}
    rows, hid = [], 0
    for role, (rk, (rep, asg)), assigned, status in itertools.product(
            roles, rel.items(), (True, False), ("Open", "InProgress", "Resolved")):
        hid += 1
        rows.append((hid, role, rep, asg if assigned else (None if asg != 1 else None), status))
    return spark.createDataFrame(rows, "hazard_id int, role string, reporter int, assignee int, status string")


def test_scope_equals_access_equals_policy(spark, truth):
    uid = 1
    t = truth.withColumn("uid", F.lit(uid))
    pol = t.select("hazard_id", P.can_view("role", "uid", "reporter", "assignee", "status", F.lit(True)).alias("p"))
    acc = t.select("hazard_id", V.access_expr(F.col("role"), F.col("uid"), F.col("reporter"), F.col("assignee"),
                                              F.col("status")).alias("a"))
    hz = truth.select("hazard_id", F.col("reporter").alias("reported_by_user_id"),
                      F.col("assignee").alias("assigned_to_user_id"), "status", "role")
    scoped = set()
    for role in ("SafetyOfficer", "SiteManager", "FieldWorker", "Auditor"):
        part = V.scope(hz.where(F.col("role") == role), uid, role)
        scoped |= {r[0] for r in part.select("hazard_id").collect()}
    p = {r[0]: r[1] for r in pol.collect()}
    a = {r[0]: r[1] for r in acc.collect()}
    assert p == a
    assert {h for h, v in p.items() if v} == scoped


def test_access_flags_special_cases(spark):
    hazards = spark.createDataFrame([(1, 5, None, "Open")],
                                    "hazard_id int, reported_by_user_id int, assigned_to_user_id int, status string")
    req = spark.createDataFrame(
        [(1, 99, 3, "SafetyOfficer"), (2, 99, 3, "SiteManager"), (3, 1, 3, " SiteManager "), (4, 1, 3, None),
         (5, 1, 3, "sitemanager")],
        "request_id int, hazard_id int, user_id int, role string")
    got = {r.request_id: r.accessible for r in V.access_flags(req, hazards).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_visible_grants_expand_to_scope_per_user(spark):
    import datetime as dt

    from riskgrid.sources import schemas as S
    users = spark.createDataFrame(
        [(1, "o", "O", "SafetyOfficer", True), (2, "m", "M", "SiteManager", True), (3, "w", "W", "FieldWorker", True),
         (4, "m2", "M2", " sitemanager ", True), (5, "x", "X", "FieldWorker", False), (6, "a", "A", "Auditor", True)],
        S.USERS)
    t0 = dt.datetime(2026, 1, 1)
    rows, hid = [], 0
    for rep, asg, st in itertools.product((2, 3, 4, 9), (None, 2, 3, 4), ("Open", "InProgress", "Resolved")):
        hid += 1
        rows.append((hid, "t", None, rep, asg, st, "Low", "Fire", t0, None))
    hazards = spark.createDataFrame(rows, S.HAZARDS)
    grants = V.visible_grants(users, hazards).collect()
    all_ids = {r[0] for r in rows}
    pool = {r[0] for r in rows if r[4] is None and r[5] == "Open"}
    expanded = {}
    for g in grants:
        s = expanded.setdefault(g.user_id, set())
        s |= all_ids if g.grant == "all" else pool if g.grant == "pool" else {g.hazard_id}
    for uid, role in ((1, "SafetyOfficer"), (2, "SiteManager"), (3, "FieldWorker"), (4, " sitemanager "),
                      (6, "Auditor")):
        want = {r.hazard_id for r in V.scope(hazards, uid, role).select("hazard_id").collect()}
        assert expanded.get(uid, set()) == want, uid
    assert 5 not in expanded  # inactive users get no grants
    related = [(g.user_id, g.hazard_id) for g in grants if g.grant == "related"]
    assert len(related) == len(set(related))  # no duplicate pairs
