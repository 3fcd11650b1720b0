"""Integrity checks on tables with planted violations (S5-S7), and case rules."""

import datetime as dt

from riskgrid.operators import listing as L
from riskgrid.sources import binding as B
from riskgrid.sources import integrity as DQ
from riskgrid.sources import schemas as S

T0 = dt.datetime(2026, 1, 1)


def _tables(spark):
    users = [(1, "Ann", "Ann A", "SafetyOfficer", True), (2, "ann", "Ann B", "SiteManager", True), (2, "bob", "Bob", "sitemanager ", True)]
    hazards = [(1, "t", None, 1, None, "Open", "Low", "Fire", T0, None), (1, "t", None, 9, 8, "resolved", "LOW", "fire", T0, None)]
    logs = [(1, 1, "Created", "", 1, T0), (2, 7, "Created", "", 7, T0), (3, 7, "Comment", "x", 1, T0)]
    return {"users": spark.createDataFrame(users, S.USERS), "hazards": spark.createDataFrame(hazards, S.HAZARDS),
            "hazard_logs": spark.createDataFrame(logs, S.HAZARD_LOGS),
            "hazard_attachments": spark.createDataFrame([], S.HAZARD_ATTACHMENTS)}


def test_unique_keys_find_planted_repeats(spark):
    got = {(r.table_name, r.key_columns, r.key_value, r.n) for r in DQ.check_unique(_tables(spark)).collect()}
    assert got == {("users", "user_id", "2", 2), ("users", "user_name", "ann", 2), ("hazards", "hazard_id", "1", 2)}


def test_foreign_keys_find_planted_orphans(spark):
    got = {(r.child_table, r.fk_column, r.key_value, r.n) for r in DQ.check_foreign_keys(_tables(spark)).collect()}
    assert got == {("hazards", "reported_by_user_id", "9", 1), ("hazards", "assigned_to_user_id", "8", 1),
                   ("hazard_logs", "hazard_id", "7", 2), ("hazard_logs", "performed_by_user_id", "7", 1)}


def test_stored_states_and_filters_ignore_case(spark):
    t = _tables(spark)
    hazards, users = B.canonical(t["hazards"]), B.canonical(t["users"])
    assert {(r.status, r.severity, r.type) for r in hazards.collect()} == {("Open", "Low", "Fire"), ("Resolved", "Low", "Fire")}
    assert L.filter_status(hazards, "RESOLVED ").count() == 1 and L.filter_severity(hazards, "low").count() == 2
    assert L.filter_type(hazards, "FIRE").count() == 2 and L.filter_type(hazards, "legacy").count() == 0
    assert {r.user_name for r in L.users_by_role(users, "SITEMANAGER").collect()} == {"ann", "bob"}
    assert {r.user_id for r in L.active_managers(t["users"]).collect()} == {2}


def test_planted_rows_equal_the_sql(spark):
    import duckdb

    from riskgrid.plans import oracles as O
    tables = _tables(spark)
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    for name, check in (("dq_unique", DQ.check_unique), ("dq_foreign_keys", DQ.check_foreign_keys), ("dq_row_rules", DQ.check_rows)):
        got = check(tables)
        sql = O.SQL[name][len(O.BINDING):]
        sql = "WITH one AS (SELECT 1)" + sql if sql.lstrip().startswith(",") else sql
        want = con.sql(sql).to_df()[got.columns].values.tolist()
        assert sorted(map(tuple, want), key=repr) == sorted(map(tuple, got.collect()), key=repr)
        assert any(r[-1] for r in want)
