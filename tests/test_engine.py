"""The store and the engine over it."""

import pytest

from tidemark.errors import BadRequest, NoData
from tidemark.plans.engine import MetricEngine
from tidemark.sources.ingest import SampleStore


@pytest.fixture
def engine(spark, tmp_path):
    return MetricEngine(spark, f"file://{tmp_path}/store")


def test_empty_store(engine):
    assert engine.health() == {"status": "ok", "series": 0}
    assert engine.series().count() == 0
    assert engine.range("cpu", 0, 10).count() == 0
    with pytest.raises(NoData):
        engine.instant("cpu")


def test_round_trip(engine):
    assert engine.ingest_batch([{"name": "cpu", "labels": {"host": "a"}, "timestamp": t, "value": t} for t in (30, 10, 20)]) == 3
    assert engine.ingest("mem", 5, {"host": "b"}, 15) == 1
    assert [(r["name"], r["labels"]) for r in engine.series().collect()] == [("cpu", {"host": "a"}), ("mem", {"host": "b"})]
    assert engine.health()["series"] == 2
    found = engine.range("cpu", 0, 100, '{"host": "a"}').orderBy("seq").collect()
    assert [(r["ts"], r["seq"]) for r in found] == [(30, 0), (10, 1), (20, 2)]
    assert [(r["ts"], r["value"]) for r in engine.range("cpu", 0, 100, {"host": "a"}, step=50, agg="SUM").collect()] == [(0, 60)]
    assert engine.instant("cpu", {"host": "a"}, 25)["value"] == 20
    assert engine.instant("cpu", {"host": "a"}, 25)["timestamp"] == 25
    assert {r["ts"]: r["value"] for r in engine.rate("cpu", 0, 100, {"host": "a"}).collect()} == {20: 1, 30: 1}
    assert engine.select("cpu", {"host": "?"}, 0, 15).where("ts IS NOT NULL").count() == 1


def test_scan_is_pruned(engine, spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    engine.ingest_batch([{"name": n, "labels": {"h": "1"}, "timestamp": 1, "value": 1} for n in ("cpu", "001")])
    plan = engine.range("001", 0, 5, {"h": "1"})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(name" in plan and "(name#" in plan
    assert "GreaterThanOrEqual(ts,0.0)" in plan and "EqualTo(labels_key" in plan
    assert engine.range("001", 0, 5, {"h": "1"}).count() == 1


def test_names(engine):
    for name in ("", "   ", "\t", " ", "\x1c"):
        with pytest.raises(BadRequest):
            engine.ingest(name, 1)
    engine.ingest(" cpu ", 1, timestamp=5)
    assert [r["name"] for r in engine.series().collect()] == [" cpu "]


def test_a_batch_is_written_whole_or_not_at_all(engine):
    with pytest.raises(BadRequest):
        engine.ingest_batch([{"name": "cpu", "value": 1}, {"name": "", "value": 1}])
    assert engine.ingest_batch([]) == 0
    assert engine.health()["series"] == 0


def test_default_time_is_one_for_the_batch(spark, tmp_path):
    store = SampleStore(spark, f"file://{tmp_path}/s")
    assert store.ingest_batch([{"name": "a", "value": 1}, {"name": "a", "value": 2, "timestamp": 7}, {"name": "a", "value": 3}], now=100.0) == 3
    assert [r["ts"] for r in store.read().orderBy("seq").collect()] == [100, 7, 100]


@pytest.mark.parametrize("point", [{"name": "a"}, {"name": "a", "value": None}, {"name": 5, "value": 1}, {"name": "a", "value": 1, "labels": {"x": 1}}, {"name": "a", "value": 1, "labels": None}, {"name": "a", "value": 1, "timestamp": float("nan")}, {"name": "a", "value": 1, "timestamp": float("inf")}, {"name": "a", "value": "x"}])
def test_bad_points(engine, point):
    with pytest.raises(BadRequest):
        engine.ingest_batch([point])


def test_points_of_a_frame_need_an_arrival(engine, spark):
    df = spark.createDataFrame([("a", {"x": "1"}, 5.0, 1.0, 1), ("a", None, None, 2.0, 0)], "name string, labels map<string,string>, timestamp double, value double, n int")
    with pytest.raises(BadRequest):
        engine.ingest_batch(df)
    assert engine.ingest_batch(df, arrival="n") == 2
    assert [r["labels"] for r in engine.series().collect()] == [{}, {"x": "1"}]


def test_numbers_as_strings_and_booleans(engine):
    engine.ingest_batch([{"name": "a", "value": "2.5", "timestamp": "4"}, {"name": "a", "value": True, "timestamp": 5}])
    assert [(r["ts"], r["value"]) for r in engine.range("a", 0, 9).orderBy("ts").collect()] == [(4, 2.5), (5, 1)]


@pytest.mark.parametrize("labels", ["oops", "[1]", {"a": 1}, '{"a": 1}'])
def test_bad_labels(engine, labels):
    with pytest.raises(BadRequest):
        engine.range("cpu", 0, 1, labels)


def test_bad_ranges(engine):
    with pytest.raises(BadRequest):
        engine.range("cpu", 5, 5)
    with pytest.raises(BadRequest):
        engine.range("cpu", float("nan"), 5)
    with pytest.raises(BadRequest):
        engine.range("cpu", 0, 5, step=1, agg="p95")


def test_reading_only(spark):
    with pytest.raises(BadRequest):
        MetricEngine(spark).ingest("a", 1)


def test_single_points_arrive_one_after_the_other(engine):
    for v in (0, 1, 2):
        engine.ingest("cpu", v, {}, 100)
    assert sorted((r["value"], r["seq"]) for r in engine.range("cpu", 0, 200).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert engine.range("cpu", 0, 200, step=50, agg="last").head()["value"] == 2
    assert engine.instant("cpu", {}, 100)["value"] == 0


def test_instant_over_a_store(engine):
    engine.ingest("cpu", 1, {}, 100)
    engine.ingest_batch([{"name": "cpu", "value": v, "timestamp": 400} for v in (2, 3)])
    assert [engine.instant("cpu", {}, t)["value"] for t in (399, 400, 700)] == [1, 2, 2]
    for t in (99, 701):
        with pytest.raises(NoData):
            engine.instant("cpu", {}, t)


def test_writers_never_share_numbers(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    one, two = SampleStore(spark, path), SampleStore(spark, path)
    number, first = one._claim(5)  # a writer that is still at work, or has died
    assert (number, first) == (0, 0)
    assert two.ingest_batch([{"name": "a", "value": 1, "timestamp": 1}]) == 1
    assert [r["seq"] for r in one.read().collect()] == [5]
    assert not one._put("log/1.claim", "0 9\n") and one.next_seq() == 6
    assert two._claim(1) == (2, 6)


def test_readers_see_whole_batches(spark, tmp_path, monkeypatch):
    store = SampleStore(spark, f"file://{tmp_path}/s")
    store.ingest("a", 1, {}, 1)
    monkeypatch.setattr(SampleStore, "_put", lambda self, name, text, put=SampleStore._put: put(self, name, text) if name.endswith("claim") else False)
    store.ingest("b", 1, {}, 1)
    assert store.read().count() == 1 and store.series().count() == 1


def test_catalogue_reads_no_sample(engine):
    engine.ingest_batch([{"name": "cpu", "labels": {"h": str(i % 3)}, "timestamp": i, "value": i} for i in range(9)])
    engine.ingest("cpu", 1, {"h": "0"}, 20)
    assert all("/series/batch=" in f and "/data/" not in f for f in engine.catalogue.inputFiles())
    found = {r["labels_key"]: (r["first_seq"], r["samples"], r["min_ts"], r["max_ts"]) for r in engine.catalogue.collect()}
    assert found['[{"key":"h","value":"0"}]'] == (0, 4, 0, 20) and len(found) == 3
    plan = engine.select("cpu", {"h": "*"}, 5, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2  # the catalogue, and the samples of the range


def test_arrival_numbers_are_checked(engine, spark):
    for n in (-1, None):
        df = spark.createDataFrame([("a", None, 1.0, 1.0, n)], "name string, labels map<string,string>, timestamp double, value double, n int")
        with pytest.raises(BadRequest):
            engine.ingest_batch(df, arrival="n")
