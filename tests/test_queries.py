"""Every query of the engine against its SQL, and the plans that they run by."""

import pytest

from tidemark.plans import catalogue
from tidemark.sources import adapters


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, sf_dir, oracle, rows_of, name):
    columns, rows = rows_of(catalogue.QUERIES[name](spark, sf_dir))
    expected_columns, expected = oracle(catalogue.ORACLES[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["name", "labels_key", "ts", "value"]
    assert df.count() > 0


def test_registry_without_the_subpackage():
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_no_python_in_plans(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "ArrowEval" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_few_columns(spark, sf_dir):
    plan = catalogue.count_series(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "value:double" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["range_scan_exact", "range_downsampled", "instant_value"])
def test_ranges_reach_the_scan(spark, sf_dir, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThanOrEqual(ts," in plan


def test_epoch_seconds_ignore_the_session_zone(spark, sf_dir):
    here = adapters.events(spark, sf_dir).agg({"ts": "min"}).head()[0]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert adapters.events(spark, sf_dir).agg({"ts": "min"}).head()[0] == here
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name, scans", [("aggregate_all", 1), ("downsample_mean", 1)])
def test_one_pass_over_the_table(spark, sf_dir, name, scans):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == scans
