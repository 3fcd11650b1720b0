"""V3 and A6 kept current after W6 equal their recomputation (small data)."""

import datetime as dt

import pytest

from riskgrid.operators import apply as AP
from riskgrid.operators import dashboard as A
from riskgrid.operators import maintain as M
from riskgrid.operators import scope as V
from riskgrid.sources import schemas as S

from .test_commands import CMDS, HAZARDS, T0, USERS

NOW = T0 + dt.timedelta(days=100)
MORE = [(10, "e", None, 3, 2, "InProgress", "High", "Slip", T0, NOW - dt.timedelta(days=5)),    # becomes overdue in between
        (11, "f", None, 2, None, "Resolved", "High", "Slip", T0, NOW - dt.timedelta(days=5)),   # resolved: never overdue
        (12, "g", None, 1, 2, "Open", "High", "Slip", T0, NOW - dt.timedelta(days=50)),         # overdue at both times
        (13, "h", None, 3, 3, "Open", "Low", "Fire", T0, NOW)]


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    users = spark.createDataFrame(USERS, S.USERS)
    hazards = spark.createDataFrame(HAZARDS + MORE, S.HAZARDS)
    cmds = [(cid, T0 + dt.timedelta(minutes=cid), kind, hid, p, ns, at, det, rep, "t", "d", "High", "Slip",
             NOW - dt.timedelta(days=cid), None) for cid, kind, hid, p, ns, at, det, rep, _ in CMDS]
    commands = spark.createDataFrame([c[:len(S.HAZARD_COMMANDS)] for c in cmds], S.HAZARD_COMMANDS)
    logs = spark.createDataFrame([(1, 1, "Created", "", 1, T0)], S.HAZARD_LOGS)
    after = AP.apply(commands, users, hazards, logs)[0]
    return users, hazards, after, *M.changes(commands, users, hazards)


def test_only_touched_hazards_are_read(tables):
    _, hazards, after, old, new = tables
    assert {r.hazard_id for r in old.collect()} == {1, 2, 3, 4}
    assert {r.hazard_id for r in new.collect()} == {1, 2, 3, 4, 14}  # one is created
    assert after.count() == hazards.count() + 1


def test_grants(tables):
    users, hazards, after, old, new = tables
    before = V.visible_grants(users, hazards)
    kept = rows(M.grants(before, users, old, new))
    assert kept == rows(V.visible_grants(users, after)) != rows(before)
    assert rows(M.grants(before, users, old.limit(0), new.limit(0))) == rows(before)


@pytest.mark.parametrize("days", [0, 10, 200])
@pytest.mark.parametrize("back", [False, True])
def test_kpi(tables, days, back):
    users, hazards, after, old, new = tables
    then, now = NOW - dt.timedelta(days=days), NOW
    if back:
        then, now = now, then
    got = M.kpi(A.dashboard_all_kpi(users, hazards, then), users, old, new, then, now, M.passed_due(hazards, old, then, now))
    assert rows(got) == rows(A.dashboard_all_kpi(users, after, now))


@pytest.mark.parametrize("column", ["severity", "type", "status"])
def test_breakdown(tables, column):
    users, hazards, after, old, new = tables
    got = M.breakdown(A.dashboard_all_breakdown(users, hazards, column), users, old, new, column)
    assert rows(got) == rows(A.dashboard_all_breakdown(users, after, column))


def test_clock_alone_reads_what_passed(tables):
    users, hazards, _, old, _ = tables
    none = old.limit(0)
    passed = M.passed_due(hazards, none, NOW - dt.timedelta(days=10), NOW)
    assert [r.hazard_id for r in passed.select("hazard_id").collect()] == [10]
