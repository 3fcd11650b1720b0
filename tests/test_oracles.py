"""Every registered query against its DuckDB oracle, the stream
forms against the batch forms, and the driver contract."""

import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_all_oracles_match(spark):
    from .oracle_compare import compare
    import __spark_entry__ as e
    names = [n for n in e.oracle_sql() if not n.startswith("op")]
    res = compare(spark, SF, names, verbose=False)
    bad = sorted(k for k, ok in res.items() if not ok)
    assert not bad, bad


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0 and "hazard_id" in df.columns
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert all(k.startswith("op") or k == "pipeline" for k in set(q) - set(o))


@pytest.mark.parametrize("parts", [2, 4, 200])
def test_created_ids_are_dense_and_ordered(spark, parts):
    """At sf0.01, with any number of partitions; each Created log names its own hazard."""
    import __spark_entry__ as e
    from riskgrid.operators import apply as AP
    from riskgrid.plans.queries import reg
    sf = "/root/testdata/sf0.01"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = e.queries()["cmd_create"](spark, sf).where("result = 'OK'").orderBy("command_id").collect()
        ids = [r.new_hazard_id for r in rows]
        assert ids == list(range(ids[0], ids[0] + len(ids))) and len(ids) == 1290
        r = reg(spark, sf)
        hazards, logs, _ = AP.apply(r.hazard_commands, r.users, r.hazards, r.hazard_logs)
        made = hazards.where(F.col("hazard_id") >= ids[0]).select("hazard_id", "created_at")
        told = logs.where((F.col("hazard_id") >= ids[0]) & (F.col("action_type") == "Created")).select("hazard_id", "created_at")
        assert made.count() == len(ids) and made.exceptAll(told).count() == 0 and told.exceptAll(made).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lockout_stream_equals_batch(spark):
    import __spark_entry__ as e
    q = e.queries()
    cols = ["key", "login_id", "ts", "success", "outcome", "failure_count", "retry_after_minutes"]
    s, b = q["lockout_stream"](spark, SF).select(cols), q["lockout_batch"](spark, SF).select(cols)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_command_stream_equals_batch(spark):
    import __spark_entry__ as e
    q = e.queries()
    cols = ["command_id", "hazard_id", "kind", "performed_by_user_id", "result", "action"]
    s = q["apply_commands_stream"](spark, SF).select(cols)
    b = q["apply_commands"](spark, SF).select(cols)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0
