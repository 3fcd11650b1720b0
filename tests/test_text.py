"""Scalar expressions (T1-T16) and the SURVEY §1.5 edge rows."""

import datetime as dt

from pyspark.sql import functions as F

from riskgrid.functions import text as T
from riskgrid.operators import dashboard as A
from riskgrid.operators import listing as L

NOW = dt.datetime(2026, 3, 10, 12, 0, 0)


def _one(spark, col, values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_classify_keywords(spark):
    texts = ["There is a FIRE", "עשן במסדרון", "exposed electric cable", "קצר בלוח", "acid spill", "gasket worn",
             "אדים", "forklift blocked", "ציוד", "מלגזה", "fire and acid", None, "", "   ", "nothing here"]
    types = _one(spark, T.classify_type("x"), texts)
    sev = _one(spark, T.classify_severity("x"), texts)
    # "מלגזה" (forklift) contains "גז" (gas): substring matching makes it Chemical.
    assert types == ["Fire", "Fire", "Electrical", "Electrical", "Chemical", "Chemical", "Chemical", "Equipment",
                     "Equipment", "Chemical", "Fire", "General", "General", "General", "General"]
    assert sev == ["High", "High", "High", "High", "Critical", "Critical", "Critical", "High", "High", "Critical",
                   "High", "Medium", "Medium", "Medium", "Medium"]


def test_percent_half_to_even(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 8)], "key string, count long")
    got = {r.key: r.percent for r in A.breakdown_percent(counts).collect()}
    assert got == {"a": 12, "b": 100}
    empty = spark.createDataFrame([], "key string, count long")
    assert A.breakdown_percent(empty).count() == 0


def test_search_wildcards_case_and_null(spark):
    df = spark.createDataFrame([(1, "Spill 50% done", None), (2, "abc", "x"), (3, "Nothing", None),
                                (4, "q", "A_C upper")], "hazard_id int, title string, description string")
    ids = lambda s: sorted(r[0] for r in L.filter_search(df, s).select("hazard_id").collect())
    assert ids("50%") == [1]
    assert ids("a_c") == [2, 4]
    assert ids("NOTHING") == [3]
    assert ids("") == [1, 2, 3, 4]


def test_overdue_forms(spark):
    rows = [(dt.datetime(2026, 3, 10, 18, 0), "Open"), (dt.datetime(2026, 3, 10, 6, 0), "Open"),
            (dt.datetime(2026, 3, 9, 6, 0), "InProgress"), (dt.datetime(2026, 3, 1), "Resolved"), (None, "Open")]
    df = spark.createDataFrame(rows, "due timestamp_ntz, status string")
    got = [(r[0], r[1]) for r in df.select(T.overdue_ts("due", "status", NOW), T.overdue_day("due", "status", NOW))
           .collect()]
    assert got == [(False, False), (True, False), (True, True), (False, False), (False, False)]


def test_csv_field(spark):
    got = _one(spark, T.csv_field("x"), ['a,b', 'say "hi"', "cr\rx", "lf\nx", None, "plain", ""])
    assert got == ['"a,b"', '"say ""hi"""', '"cr\rx"', '"lf\nx"', "", "plain", ""]


def test_report_line_cut(spark):
    got = _one(spark, T.cut_line("x", T.REPORT_LINE_MAX), ["a" * 120, "b" * 121, None])
    assert got[0] == "a" * 120
    assert got[1] == "b" * 119 + "…" and len(got[1]) == 120
    assert got[2] == ""


def test_status_log_text(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",), ("x" * 2000,), ("note",)], "d string")
    got = [r[0] for r in df.select(T.status_log_text(F.lit("Open"), F.lit("InProgress"), "d")).collect()]
    assert got[:3] == ["Open -> InProgress"] * 3
    assert got[3] == "Open -> InProgress | " + "x" * 2000
    cut = df.select(T.status_log_text(F.lit("Open"), F.lit("InProgress"), "d", T.LOG_DETAILS_MAX).alias("c")).collect()
    assert max(len(r.c) for r in cut) == T.LOG_DETAILS_MAX
    assert got[4] == "Open -> InProgress | note"


def test_trim_canonical_and_fallback(spark):
    assert _one(spark, T.trim_or_empty("x"), [None, "  a  ", "\tb"]) == ["", "a", "\tb"]
    assert _one(spark, T.canonical_status("x"), [" resolved ", "INPROGRESS", "Closed", None]) == \
        ["Resolved", "InProgress", "Closed", None]
    assert _one(spark, T.type_or_general("x"), ["Fire", "Legacy", "fire"]) == ["Fire", "General", "General"]


def test_comment_and_form_validity(spark):
    assert _one(spark, T.comment_valid("x"), ["ab", " abc ", "\t a \n", None]) == [False, True, False, False]
    df = spark.createDataFrame([("t", "d", ""), ("", "d", None), ("t", "d", "2026-01-05"), ("t", "d", "soon"),
                                ("t" * 201, "d", None)], "t string, d string, due string")
    got = [r[0] for r in df.select(T.form_valid("t", "d", "due")).collect()]
    assert got == [True, False, True, False, False]


def test_due_parse(spark):
    got = _one(spark, T.parse_due("x"), ["2026-01-05", "2026-01-05 13:45", "  ", "junk", None])
    assert got == [dt.datetime(2026, 1, 5), dt.datetime(2026, 1, 5, 13, 45), None, None, None]


def test_login_key_and_links(spark):
    df = spark.createDataFrame([("1.2.3.4", "Bob"), (None, "  "), ("5.6.7.8", None)], "ip string, u string")
    assert [r[0] for r in df.select(T.login_key("ip", "u")).collect()] == \
        ["1.2.3.4|bob", "unknown|unknown", "5.6.7.8|unknown"]
    assert _one(spark, T.drill_link("type", F.col("x")), ["In Progress"]) == \
        ["~/Hazards/HazardList.aspx?type=In+Progress"]


def test_empty_scope_kpi_is_zero(spark):
    empty = spark.createDataFrame([], "status string, due_date timestamp_ntz")
    r = A.kpi(empty, NOW).first()
    assert tuple(r) == (0, 0, 0, 0, 0)


def test_search_bracket_classes(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "xbc", None), (3, "a%c", "Z"), (4, "dbc", None),
                                (5, "line1\nac", None)], "hazard_id int, title string, description string")
    ids = lambda s: sorted(r[0] for r in L.filter_search(df, s).select("hazard_id").collect())
    assert ids("[ab]c") == [1, 2, 4, 5]
    assert ids("[a-c]bc") == [1]
    assert ids("[^a]bc") == [2, 4]
    assert ids("a[%]c") == [3]


def test_dashboard_single_pass_handles_empty_scope(spark):
    empty = spark.createDataFrame([], "status string, severity string, type string, due_date timestamp_ntz")
    rows = [tuple(r) for r in A.dashboard(empty, NOW).collect()]
    assert rows == [("kpi", None, 0, 0, 0, 0, 0)]
    one = spark.createDataFrame([("Open", "High", "Fire", None)], empty.schema)
    got = sorted(tuple(r) for r in A.dashboard(one, NOW).collect())
    assert got == [("kpi", None, 1, 1, 0, 0, 0), ("severity", "High", 1, 1, 0, 0, 0), ("type", "Fire", 1, 1, 0, 0, 0)]


def test_drilldown_keeps_zero_overdue_bucket(spark):
    from riskgrid.sources import schemas as S
    t0 = dt.datetime(2026, 1, 1)
    hazards = spark.createDataFrame([(1, "t", None, 3, None, "Open", "Low", "Fire", t0, None)], S.HAZARDS)
    users = spark.createDataFrame([(3, "w", "W", "FieldWorker", True)], S.USERS)
    got = {(r.dimension, r.key): (r.bucket_count, r.list_count, r.consistent)
           for r in A.drilldown_consistency(hazards, users, 3, "FieldWorker", NOW).collect()}
    assert got == {("status", "Open"): (1, 1, True), ("severity", "Low"): (1, 1, True),
                   ("type", "Fire"): (1, 1, True), ("overdue", "1"): (0, 0, True)}


def test_list_form_normalisation():
    f = L.HazardFilter.from_form(search_text="  ", status="", severity="High", type=None,
                                 assigned_to_user_id=7, overdue_only=1, role="FieldWorker")
    assert f == L.HazardFilter(search_text=None, status=None, severity="High", type=None,
                               assigned_to_user_id=None, overdue_only=True)
    g = L.HazardFilter.from_form(search_text=" rail ", assigned_to_user_id=7, role=" safetyofficer ")
    assert g.search_text == "rail" and g.assigned_to_user_id == 7
