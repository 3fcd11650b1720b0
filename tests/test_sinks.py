"""Versioned table sink (S8): a purge + reload becomes visible as one commit."""

import datetime as dt
import tempfile

import pytest

from riskgrid.operators import commands as W
from riskgrid.sources import schemas as S
from riskgrid.sources import seed
from riskgrid.sources import sinks


def test_purge_reload_commits_once(spark):
    root = tempfile.mkdtemp(prefix="riskgrid-sink-")
    t0 = dt.datetime(2026, 1, 1)
    users = spark.createDataFrame([(1, "safety", "S", "SafetyOfficer", True), (2, "manager", "M", "SiteManager", True),
                                   (3, "worker", "W", "FieldWorker", True)], S.USERS)
    hazards = spark.createDataFrame([(1, "Demo: old", None, 3, None, "Open", "Low", "Fire", t0, None),
                                     (2, "Keep", None, 3, None, "Open", "Low", "Fire", t0, None)], S.HAZARDS)
    logs = spark.createDataFrame([(1, 1, "Created", "", 1, t0), (2, 2, "Created", "", 1, t0)], S.HAZARD_LOGS)
    assert sinks.write_version({"users": users, "hazards": hazards, "hazard_logs": logs}, root) == 0
    h2, l2 = W.reload_demo(hazards, logs, users, seed.seed_hazards(spark), t0)
    assert sinks.write_version({"hazards": h2, "hazard_logs": l2}, root) == 1
    cur = sinks.read_table(spark, root, "hazards")
    assert sorted(r.hazard_id for r in cur.collect()) == [2, 3, 4, 5, 6]
    assert sinks.read_table(spark, root, "users").count() == 3          # carried over
    assert sinks.read_table(spark, root, "hazard_logs").count() == 1 + 6
    assert sinks.read_table(spark, root, "hazards", version=0).count() == 2


def _one(spark, n):
    return spark.createDataFrame([(n, "u%d" % n, "U", "FieldWorker", True)], S.USERS)


def test_unreadable_commit_is_an_error_and_destroys_nothing(spark):
    import os
    root = tempfile.mkdtemp(prefix="riskgrid-sink-")
    sinks.write_version({"users": _one(spark, 1)}, root)
    path = f"{root}/_commits/0000000000.json"
    good = open(path).read()
    crc = f"{root}/_commits/.0000000000.json.crc"
    if os.path.exists(crc):
        os.remove(crc)
    open(path, "w").write("{broken")
    with pytest.raises(ValueError):
        sinks.write_version({"users": _one(spark, 2)}, root)
    open(path, "w").write(good)
    assert [r.user_id for r in sinks.read_table(spark, root, "users").collect()] == [1]


def test_of_two_writers_one_commits(spark):
    root = tempfile.mkdtemp(prefix="riskgrid-sink-")
    assert sinks.write_version({"users": _one(spark, 1)}, root) == 0
    assert sinks.write_version({"users": _one(spark, 2)}, root, expected=0) == 1
    with pytest.raises(sinks.VersionConflict):
        sinks.write_version({"users": _one(spark, 3)}, root, expected=0)
    assert [r.user_id for r in sinks.read_table(spark, root, "users").collect()] == [2]


def test_old_versions_and_lost_writes_are_removed(spark):
    import os
    root = tempfile.mkdtemp(prefix="riskgrid-sink-")
    assert sinks.remove_old(spark, root) == []
    hazards = spark.createDataFrame([], S.HAZARDS)
    sinks.write_version({"users": _one(spark, 0), "hazards": hazards}, root)
    for n in (1, 2, 3):
        sinks.write_version({"users": _one(spark, n)}, root)
    with pytest.raises(sinks.VersionConflict):
        sinks.write_version({"users": _one(spark, 9)}, root, expected=2)
    assert sinks.remove_old(spark, root, keep=2) == []  # all is young: a writer may still be at work
    removed = sinks.remove_old(spark, root, keep=2, older_than=dt.timedelta(0))
    assert len(removed) == 3  # users of versions 0 and 1, and of the lost write
    assert [r.user_id for r in sinks.read_table(spark, root, "users").collect()] == [3]
    assert [r.user_id for r in sinks.read_table(spark, root, "users", version=2).collect()] == [2]
    assert sinks.read_table(spark, root, "hazards").count() == 0  # written by version 0, still named
    assert len([f for f in os.listdir(f"{root}/data") if os.listdir(f"{root}/data/{f}")]) == 3
    assert sinks.remove_old(spark, root, keep=2, older_than=dt.timedelta(0)) == []
    with pytest.raises(Exception):
        sinks.read_table(spark, root, "users", version=0).count()
    assert sinks.write_version({"users": _one(spark, 4)}, root) == 4  # numbers go on
    with pytest.raises(ValueError):
        sinks.remove_old(spark, root, keep=0)


def test_register_is_stored_only_on_request(spark):
    import os
    from riskgrid.sources import binding as B
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test data not present")
    root = tempfile.mkdtemp(prefix="riskgrid-register-")
    assert B.materialize(spark, sf, root) == 0
    spark.conf.set(B.ROOT_CONF, root)
    try:
        stored = B.load(spark, sf).hazards
    finally:
        spark.conf.unset(B.ROOT_CONF)
    lazy = B.load(spark, sf).hazards
    assert stored.exceptAll(lazy).count() == 0 and lazy.exceptAll(stored).count() == 0
    assert lazy.where("length(description) > 300").count() > 0  # whole texts
