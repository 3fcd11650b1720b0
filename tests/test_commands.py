"""Validated commands (W1-W5) on small rows covering every check and the
three-valued-logic cases of SURVEY §1.5.1."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskgrid.operators import commands as W
from riskgrid.operators import ids as I
from riskgrid.sources import schemas as S

USERS = [(1, "safety", "Safety Officer", "SafetyOfficer", True), (2, "manager", "Site Manager", "SiteManager", True),
         (3, "worker", "Field Worker", "FieldWorker", True), (4, "old", "Old Worker", "FieldWorker", False),
         (5, "aud", "Auditor", "Auditor", True)]
T0 = dt.datetime(2026, 1, 1)
HAZARDS = [(1, "a", None, 3, None, "Open", "Low", "Fire", T0, None),
           (2, "b", None, 3, None, "InProgress", "Low", "Fire", T0, None),
           (3, "c", None, 1, None, "Open", "Low", "Fire", T0, None),
           (4, "d", None, 1, 2, "Open", "Low", "Fire", T0, None)]
# (id, kind, hazard, performer, new_status, assign_to, details, reporter)
CMDS = [
    (1, "comment", 3, 3, None, None, "seen it", 3, "OK"),            # worker on another's unassigned hazard
    (2, "update", 2, 2, None, None, None, 3, "OK"),                  # manager, unassigned InProgress
    (3, "change_status", 1, 2, "InProgress", None, None, 3, "OK"),   # manager, unassigned Open (NULL <> id)
    (4, "assign", 1, 2, None, None, None, 3, "OK"),                  # manager assigns NULL
    (5, "update", 1, 4, None, None, None, 3, "Unauthorized"),        # inactive performer
    (6, "change_status", 1, 3, None, None, "", 3, "BadRequest"),     # blank status and details
    (7, "change_status", 1, 1, "Closed", None, None, 3, "BadRequest"),
    (8, "assign", 1, 1, None, 3, None, 3, "Forbidden"),              # target not a manager
    (9, "assign", 1, 1, None, 2, None, 3, "OK"),
    (10, "update", 999, 1, None, None, None, 3, "NotFound"),
    (11, "create", None, 3, None, None, None, 2, "Forbidden"),        # worker reporting for another
    (12, "create", None, 1, None, None, None, 4, "BadRequest"),       # inactive reporter
    (13, "create", None, 3, None, None, None, 3, "OK"),
    (14, "change_status", 1, 3, "  ", None, "note", 3, "OK"),        # blank status -> comment by reporter
    (15, "change_status", 4, 2, " resolved ", None, None, 3, "Forbidden"),  # Open -> Resolved skips a step
    (16, "change_status", 4, 2, "InProgress", None, None, 3, "OK"),
    (17, "update", 3, 5, None, None, None, 3, "Forbidden"),          # unknown role
    (18, "comment", 4, 3, None, None, "x", 3, "Forbidden"),          # worker not related, hazard assigned
    (19, "comment", 1, 3, None, None, "   ", 3, "BadRequest"),
    (20, "assign", 3, 2, None, 2, None, 3, "OK"),                    # manager self-assigns unassigned Open
    (21, "assign", 4, 2, None, 2, None, 3, "Forbidden"),             # already assigned
]


@pytest.fixture(scope="module")
def frames(spark):
    users = spark.createDataFrame(USERS, S.USERS)
    hazards = spark.createDataFrame(HAZARDS, S.HAZARDS)
    rows = [(cid, T0 + dt.timedelta(minutes=cid), kind, hid, p, ns, at, det, rep, "t", "d", None, None, None)
            for cid, kind, hid, p, ns, at, det, rep, _ in CMDS]
    cmds = spark.createDataFrame(rows, S.HAZARD_COMMANDS)
    return users, hazards, cmds


def test_results(frames):
    users, hazards, cmds = frames
    got = {r.command_id: r.result for r in W.validate(cmds, users, hazards).collect()}
    assert got == {c[0]: c[-1] for c in CMDS}


def test_status_blank_becomes_comment(frames):
    users, hazards, cmds = frames
    v = {r.command_id: r.action for r in W.validate(cmds, users, hazards).collect()}
    assert v[14] == S.ACTION_COMMENT and v[16] == S.ACTION_STATUS_CHANGED


def test_create_ids_follow_max(frames):
    users, hazards, cmds = frames
    c = {r.command_id: r.new_hazard_id for r in W.validate_creates(cmds, users, hazards).collect()}
    assert c == {11: None, 12: None, 13: 5}


def test_assign_sequence_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = I.assign_sequence(df, ["k"], F.lit(100), "new_id", num_partitions=7)
    got = sorted((r.k, r.new_id) for r in out.collect())
    assert got == [(k, 101 + k) for k in range(1000)]


def test_upsert_and_reload(spark):
    from riskgrid.sources import seed
    users = spark.createDataFrame(USERS, S.USERS)
    up = {r.user_name: r for r in W.upsert_users(users, seed.seed_users(spark)).collect()}
    assert up["safety"].user_id == 1 and up["manager"].user_id == 2 and up["worker"].user_id == 3
    target = spark.createDataFrame([(7, "Safety", "x", "FieldWorker", False)], S.USERS)
    up2 = {r.user_name: r for r in W.upsert_users(target, seed.seed_users(spark)).collect()}
    assert up2["Safety"].user_id == 7 and up2["Safety"].role == "SafetyOfficer" and up2["Safety"].is_active
    assert up2["manager"].user_id == 8 and up2["worker"].user_id == 9
