"""Hand-derived cases for every operator: order, ties, late data, gaps and bad parameters."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.errors import BadRequest
from tidemark.functions.labels import labels_column, labels_key
from tidemark.operators import ordered
from tidemark.operators.aggregate import aggregate, downsample
from tidemark.operators.chunks import with_chunk, zone_map
from tidemark.operators.instant import instant
from tidemark.operators.rate import rate
from tidemark.operators.select import range_scan, sample_counts, select_series, series, series_count
from tidemark.schema import SAMPLES


def make(spark, text, name="m", labels=None, seq=0):
    """Samples as "ts:value ..." in order of arrival."""
    pairs = [tuple(map(float, p.split(":"))) for p in text.split()]
    rows = [(name, labels or {}, t, v, seq + i) for i, (t, v) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "name string, labels map<string,string>, ts double, value double, seq long")
    return df.withColumn("labels_key", labels_key(F.col("labels"))).select(*SAMPLES.names)


def points(df):
    return {r["ts"]: r["value"] for r in df.collect()}


@pytest.fixture(params=["one block", "blocks of two"])
def blocks(request, monkeypatch):
    if request.param != "one block":
        monkeypatch.setattr(ordered, "BLOCK_SAMPLES", 2)
        monkeypatch.setattr(ordered, "BLOCK_SECONDS", 12.0)


def test_rate_counts_a_reset_from_zero(spark, blocks):
    for order in ("time", "arrival"):
        assert points(rate(make(spark, "0:5 10:15 20:3 30:9"), order)) == pytest.approx({10: 1.0, 20: 0.3, 30: 0.6})


def test_rate_with_ties_and_late_samples(spark, blocks):
    samples = make(spark, "10:1 20:2 20:3 15:4 30:6")
    assert points(rate(samples, "arrival")) == pytest.approx({20: 0.1, 30: 2 / 15})
    assert points(rate(samples, "time")) == pytest.approx({15: 0.6, 20: 0.4, 30: 0.3})


def test_rate_of_one_sample_is_empty(spark):
    assert rate(make(spark, "10:1")).count() == 0


def test_rate_keeps_series_apart(spark):
    both = make(spark, "0:0 10:10", labels={"a": "1"}).union(make(spark, "0:0 10:20", labels={"a": "2"}, seq=2))
    assert sorted(r["value"] for r in rate(both).collect()) == [1.0, 2.0]


def test_downsample_leaves_gaps_out(spark):
    assert points(downsample(make(spark, "12:1 14:3 25:5 41:7"), 10, "mean")) == {10: 2, 20: 5, 40: 7}


def test_downsample_of_late_samples(spark, blocks):
    samples = make(spark, "12:1 25:2 13:9 26:4")
    assert points(downsample(samples, 10, "sum", "arrival")) == {10: 1, 20: 15}
    assert points(downsample(samples, 10, "sum", "time")) == {10: 10, 20: 6}
    assert points(downsample(samples, 10, "last", "arrival")) == {10: 1, 20: 4}
    assert points(downsample(samples, 10, "last", "time")) == {10: 9, 20: 4}


@pytest.mark.parametrize("agg, value", [("mean", 4), ("sum", 12), ("min", 1), ("max", 7), ("count", 3.0), ("last", 7), ("MEAN", 4)])
def test_all_aggregates(spark, agg, value):
    samples = make(spark, "10:4 11:1 19:7")
    assert points(downsample(samples, 10, agg)) == {10: value}
    assert aggregate(samples, agg).head()[0] == value
    assert math.isnan(aggregate(samples.where("false"), agg).head()[0])


def test_negative_times_and_odd_steps(spark):
    assert points(downsample(make(spark, "-7.5:1"), 2)) == {-8: 1}
    samples = make(spark, "12:1 14:3")
    assert downsample(samples, 0).count() == downsample(samples, -1).count() == 0
    assert points(downsample(make(spark, "1700000000:5"), 0.125)) == {1_700_000_000: 5}
    assert downsample(make(spark, "1700000000:5"), 1e-8).count() == 1
    for step in (math.nan, math.inf):
        with pytest.raises(BadRequest):
            downsample(samples, step)
    with pytest.raises(BadRequest, match="mean.*last"):
        downsample(samples, 10, "p95")
    with pytest.raises(BadRequest):
        downsample(samples, 10, "mean", "sideways")


def test_nan_values_are_largest(spark):
    for text in ("1:1 2:nan", "1:nan 2:1"):
        samples = make(spark, text)
        assert aggregate(samples, "min").head()[0] == 1
        assert math.isnan(aggregate(samples, "max").head()[0])


def test_range_is_closed_and_needs_no_order(spark):
    assert points(range_scan(make(spark, "1:1 2:2 3:3"), "m", {}, 1, 3)) == {1: 1, 2: 2, 3: 3}
    assert points(range_scan(make(spark, "1:1 2:2 3:3"), "m", {}, 2, 2)) == {2: 2}
    assert points(range_scan(make(spark, "10:1 30:2 20:3 40:4"), "m", {}, 15, 25)) == {20: 3}
    with pytest.raises(BadRequest):
        range_scan(make(spark, "1:1"), "m", {}, math.nan, 3)


def test_a_bucket_may_start_before_the_range(spark):
    assert points(downsample(range_scan(make(spark, "7:1 8:2"), "m", {}, 7, 9), 5, "sum")) == {5: 3}


@pytest.mark.parametrize("at, value", [(399, 1), (400, 2), (700, 2), (701, None), (99, None)])
def test_instant_takes_the_first_of_the_latest(spark, at, value):
    found = instant(make(spark, "100:1 400:2 400:3"), at).collect()
    assert [r["value"] for r in found] == ([] if value is None else [value])


def test_instant_lookback_is_closed(spark):
    samples = make(spark, "100:1")
    assert instant(samples, 400).count() == 1
    assert instant(samples, 400.5).count() == 0
    assert instant(samples, 400.5, lookback=301).count() == 1


@pytest.fixture
def four(spark):
    out = make(spark, "1:1", labels={"host": "web-1", "dc": "a"})
    for i, labels in enumerate(({"host": "web-2"}, {"host": "db-1"}, {}), 1):
        out = out.union(make(spark, "9:1", labels=labels, seq=i))
    return out


def test_exact_labels(four):
    assert range_scan(four, "m", {"host": "web-1"}, 0, 10).count() == 0
    assert range_scan(four, "m", {"dc": "a", "host": "web-1"}, 0, 10).count() == 1


@pytest.mark.parametrize("matchers, seqs", [({"host": "web-*"}, [0, 1]), ({"dc": "*"}, [0, 1, 2, 3]), ({"dc": ""}, [1, 2, 3]), ({"host": "?*"}, [0, 1, 2]), ({"host": "[!w]*"}, [2]), ({}, [0, 1, 2, 3]), ({"host": "web-*", "dc": "a"}, [0])])
def test_glob_labels(four, matchers, seqs):
    assert sorted(r["first_seq"] for r in select_series(four, "m", matchers, 0, 10).collect()) == seqs


def test_glob_keeps_series_without_samples(four):
    found = select_series(four, "m", {}, 0, 5).collect()
    assert len(found) == 4 and sum(r["ts"] is None for r in found) == 3
    assert select_series(four, "other", {}, 0, 5).count() == 0


def test_label_order_does_not_matter(spark):
    a, b = make(spark, "1:1", labels={"a": "1", "b": "2"}), make(spark, "2:1", labels={"b": "2", "a": "1"}, seq=1)
    both = a.union(b)
    assert series_count(both).head()[0] == 1
    assert series(both).head()["first_seq"] == 0
    assert sample_counts(both).head()["samples"] == 2
    assert both.where(labels_key(labels_column({"b": "2", "a": "1"})) == F.col("labels_key")).count() == 2


def test_chunks_roll_over(spark, blocks):
    samples = make(spark, " ".join(f"{i}:{i}" for i in range(121)))
    assert sorted(r["samples"] for r in zone_map(samples).collect()) == [1, 120]
    assert with_chunk(samples, 50).where("chunk = floor(seq / 50)").count() == 121


def test_empty_input(spark):
    none = make(spark, "1:1").where("false")
    for df in (downsample(none, 10), downsample(none, 10, "last", "arrival"), rate(none), instant(none, 5), series(none), zone_map(none)):
        assert df.count() == 0
    assert series_count(none).head()[0] == 0


def test_a_step_too_small_for_the_times_is_an_error(spark):
    samples = make(spark, "1.7e9:1 1.8e9:2")
    assert downsample(samples, 1e-9).count() == 2
    for order in ("time", "arrival"):
        with pytest.raises(Exception, match="too small"):
            downsample(samples, 1e-11, "mean", order).collect()


def test_several_aggregates_in_one_pass(spark):
    samples = make(spark, "10:4 11:1 19:7 25:2")
    found = {r["ts"]: (r["mean"], r["last"], r["count"]) for r in downsample(samples, 10, ["mean", "LAST", "count"]).collect()}
    assert found == {10: (4, 7, 3), 20: (2, 2, 1)}
    assert tuple(aggregate(samples, ["min", "max"]).head()) == (1, 7)
    assert all(math.isnan(x) for x in aggregate(samples.where("false"), ["count", "sum"]).head())
    assert downsample(samples, 0, ["sum"]).columns == ["name", "labels_key", "ts", "sum"]
