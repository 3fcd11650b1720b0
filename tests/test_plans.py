"""Plan-shape guards for the scale properties the design relies on."""

import os

import pytest

from riskgrid.plans.explain import plan_text, summarize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The register stored on request: predicates reach its scans."""
    from riskgrid.sources import binding as B
    root = str(tmp_path_factory.mktemp("register"))
    B.materialize(spark, SF, root)
    spark.conf.set(B.ROOT_CONF, root)
    yield root
    spark.conf.unset(B.ROOT_CONF)


def _plan(spark, name):
    from riskgrid.plans.queries import QUERIES
    return summarize(plan_text(QUERIES[name](spark, SF)))


def test_list_scope_and_filters_reach_the_scan(spark, stored):
    s = _plan(spark, "hazard_list")
    pushed = " ".join(s["pushed"])
    assert "EqualTo(assigned_to_user_id,11)" in pushed and "LessThan(due_date" in pushed
    assert s["python"] == 0


def test_filters_prune_columns(spark, stored):
    s = _plan(spark, "dashboard")
    assert all("description" not in r and "title" not in r for r in s["read_schemas"])


def test_all_users_dashboard_builds_no_pairs(spark, stored):
    s = _plan(spark, "dashboard_all_kpi")
    assert s["python"] == 0 and s["shuffles"] <= 2


def test_history_scans_each_table_once(spark, stored):
    s = _plan(spark, "hazard_history")
    assert s["scans"] == 3


def test_folds_are_one_python_stage(spark, stored):
    assert _plan(spark, "lockout_batch")["python"] == 1


def test_visible_pairs_stays_linear(spark, stored):
    from riskgrid.plans.queries import QUERIES, reg
    r = reg(spark, SF)
    n = QUERIES["visible_pairs"](spark, SF).count()
    assert n <= 2 * r.hazards.count() + r.users.count()


def test_texts_are_joined_only_where_they_are_read(spark):
    """Derived from the source tables: no join with documents, and no scan of them, without a description."""
    from riskgrid.plans.queries import QUERIES
    for name in ("dashboard", "hazard_history", "kpi_manager"):
        text = plan_text(QUERIES[name](spark, SF))
        assert "documents.parquet" not in text, name


def test_foreign_key_checks_collect_no_parent_on_the_driver(spark):
    """The parents' keys are merged however small their files are estimated (small files were broadcast before)."""
    from riskgrid.plans.queries import QUERIES
    text = plan_text(QUERIES["dq_foreign_keys"](spark, SF))
    assert "Broadcast" not in text and text.count("SortMergeJoin") >= 6


def test_policy_rows_collect_no_table_on_the_driver(spark):
    """Users and hazard states are merged with the requests (both were broadcast before), in every query on them."""
    from riskgrid.plans.queries import QUERIES
    for name in ("policy_can_comment", "policy_can_view", "row_actions", "access_flags"):
        text = plan_text(QUERIES[name](spark, SF))
        assert "Broadcast" not in text and text.count("SortMergeJoin") >= 2, name
    for name in ("scalar_status_log", "cmd_comment", "hazard_history"):
        s = plan_text(QUERIES[name](spark, SF)).split("\n\n")[0]
        assert "SortMergeJoin LeftOuter" in s, name
