"""The engine's queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import NoData
from tidemark.functions.labels import labels_from_json, labels_key
from tidemark.operators.aggregate import aggregate, downsample
from tidemark.operators.chunks import with_chunk, zone_map
from tidemark.operators.instant import LOOKBACK, instant
from tidemark.operators.rate import rate
from tidemark.operators.select import range_scan, sample_counts, select_series, series, series_count
from tidemark.plans.engine import MetricEngine
from tidemark.schema import SERIES
from tidemark.sources import adapters
from tidemark.sources.folders import new_folder
from tidemark.sources.ingest import normalise, valid

DAY, START = 86_400.0, 1_704_067_200.0  # the first event's day
AGGREGATES = ["mean", "sum", "min", "max", "count", "last"]
EVENTS = """e AS (
  SELECT event_type AS name, '[{"key":"user_id","value":"' || user_id || '"}]' AS labels_key, user_id,
         epoch_us(ts) / 1e6 AS ts, value, event_id AS seq FROM events
)"""
ORDERS = """o AS (
  SELECT 'order_total' AS name, '[{"key":"status","value":"' || o_orderstatus || '"}]' AS labels_key,
         epoch_us(o_orderdate) / 1e6 AS ts, o_totalprice AS value, o_orderkey AS seq FROM orders
)"""
LINES = """l AS (
  SELECT 'line_qty' AS name, '[{"key":"linestatus","value":"' || l_linestatus || '"},{"key":"returnflag","value":"' || l_returnflag || '"}]' AS labels_key,
         epoch_us(l_shipdate) / 1e6 AS ts, l_quantity AS value FROM lineitem
)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


def _bucketed(source: str, table: str, step: float, value: str) -> str:
    return f"WITH {source} SELECT name, labels_key, floor(ts / {step}) * {step} AS ts, {value} AS value FROM {table} GROUP BY ALL"


def _daily(agg: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(downsample(adapters.events(spark, sf_dir), DAY, agg))

    return query


def range_scan_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = START, START + 20 * DAY
    return range_scan(adapters.events(spark, sf_dir, start, end), "click", {"user_id": "8"}, start, end).select("name", "labels_key", "ts", "value", "seq")


def range_downsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = START + 3600.5, START + 25 * DAY
    found = range_scan(adapters.events(spark, sf_dir, start, end), "view", {"user_id": "7"}, start, end)
    return _rounded(downsample(found, 6 * 3600.0, "mean"))


def aggregate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six aggregates of all events, in one pass, and the aggregate of nothing."""
    samples = adapters.events(spark, sf_dir)
    row = aggregate(samples, AGGREGATES)
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("agg"), F.round(a, 6).alias("value")) for a in AGGREGATES)))
    empty = aggregate(samples.where(F.lit(False)), "count").select(F.lit("empty").alias("agg"), F.isnan("value").cast("double").alias("value"))
    return row.select(each.alias("x")).select("x.agg", "x.value").unionByName(empty)


def downsample_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(downsample(adapters.lineitem(spark, sf_dir), 30 * DAY, "sum"))


def downsample_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return downsample(adapters.orders(spark, sf_dir), 30 * DAY, ["last", "count"], "arrival")


def rate_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rate(adapters.events(spark, sf_dir)))


def rate_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rate(adapters.orders(spark, sf_dir), "arrival"))


def instant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = START + 10 * DAY
    return instant(adapters.events(spark, sf_dir, at - LOOKBACK, at), at)


def select_glob_keep_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = select_series(adapters.events(spark, sf_dir), "click", {"user_id": "[!2-9]*"}, START, START + 2 * DAY)
    return found.groupBy(*SERIES).agg(F.count("ts").alias("samples"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("total"))


def select_glob_missing_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_series(adapters.events(spark, sf_dir), "error", {"host": "", "user_id": "?"}, START, START + 5 * DAY).select("name", "labels_key", "ts", "value")


def list_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(adapters.events(spark, sf_dir)).select("name", "labels_key", "first_seq")


def count_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_count(adapters.events(spark, sf_dir))


def samples_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_counts(adapters.events(spark, sf_dir))


def chunk_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_chunk(adapters.orders(spark, sf_dir)).select("name", "labels_key", "seq", "chunk")


def chunk_zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_map(adapters.orders(spark, sf_dir))


def ingest_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: every seventh with a blank name, which is left out, every fifth without a time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.when(F.col("event_id") % 7 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" "), "event_type"))
    ts = F.when(F.col("event_id") % 5 != 0, adapters.epoch_seconds(F.col("ts")))
    points = e.select(name.alias("name"), F.create_map(F.lit("user_id"), F.col("user_id").cast("string")).alias("labels"), ts.alias("timestamp"), "value", "event_id")
    return normalise(points.where(valid()), START, F.col("event_id")).select("name", "labels_key", "ts", "value", "seq")


def labels_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", labels_key(labels_from_json(F.col("props"))).alias("labels_key"))


_STORES: dict[tuple[str, str], MetricEngine] = {}


def event_engine(spark: SparkSession, sf_dir: str) -> MetricEngine:
    """An engine over a new store that holds all events, in two batches: those of even users, then those of odd ones."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORES:
        e = spark.read.parquet(f"{sf_dir}/events.parquet")
        labels = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"))
        points = e.select(F.col("event_type").alias("name"), labels.alias("labels"), adapters.epoch_seconds(F.col("ts")).alias("timestamp"), "value", "event_id", (F.col("user_id") % 2).alias("odd"))
        engine = MetricEngine(spark, new_folder(spark, "store"))
        for odd in (0, 1):
            engine.ingest_batch(points.where(F.col("odd") == odd).drop("odd"), arrival="event_id")
        _STORES[key] = engine
    return _STORES[key]


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_engine(spark, sf_dir).samples.select("name", "labels_key", "ts", "value", "seq")


def store_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_engine(spark, sf_dir).catalogue.select("name", "labels_key", "first_seq", "samples", "min_ts", "max_ts")


def store_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([tuple(event_engine(spark, sf_dir).health().values())], "status string, series long")


def store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_engine(spark, sf_dir).range("view", START, START + 25 * DAY, '{"user_id": "7"}')


def store_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    try:
        found = [event_engine(spark, sf_dir).instant("click", {"user_id": "8"}, START + 20 * DAY, 20 * DAY)]
    except NoData:
        found = []
    return spark.createDataFrame([(x["name"], x["timestamp"], x["value"]) for x in found], "name string, ts double, value double")


def store_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_engine(spark, sf_dir).select("click", {"user_id": "[!2-9]*"}, START, START + 2 * DAY)
    return found.groupBy(*SERIES).agg(F.count("ts").alias("samples"), F.min("first_seq").alias("first_seq"))


def single_ingests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five regions as points of one time, each ingested by itself: LAST takes the last to arrive, an instant the first."""
    engine = MetricEngine(spark, new_folder(spark, "store"))
    for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect():
        engine.ingest("region", r["r_regionkey"], {}, 100.0)
    last = engine.range("region", 0, 200, {}, 50.0, "last").head()["value"]
    seqs = [r["seq"] for r in engine.range("region", 0, 200).collect()]
    found = [("last", last), ("instant", engine.instant("region", {}, 100.0)["value"]), ("distinct_seq", float(len(set(seqs)))), ("largest_seq", float(max(seqs)))]
    return spark.createDataFrame(found, "what string, value double")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "range_scan_exact": range_scan_exact,
    "range_downsampled": range_downsampled,
    "aggregate_all": aggregate_all,
    **{f"downsample_{a}": _daily(a) for a in ("mean", "sum", "min", "max", "count", "last")},
    "downsample_hot": downsample_hot,
    "downsample_arrival": downsample_arrival,
    "rate_time": rate_time,
    "rate_arrival": rate_arrival,
    "instant_value": instant_value,
    "select_glob_keep_empty": select_glob_keep_empty,
    "select_glob_missing_label": select_glob_missing_label,
    "list_series": list_series,
    "series_count": count_series,
    "samples_per_series": samples_per_series,
    "chunk_ordinal": chunk_ordinal,
    "chunk_zone_map": chunk_zone_map,
    "ingest_normalise": ingest_normalise,
    "labels_from_json": labels_of_json,
    "store_round_trip": store_round_trip,
    "store_series": store_series,
    "store_health": store_health,
    "store_range": store_range,
    "store_instant": store_instant,
    "store_glob": store_glob,
    "single_ingests": single_ingests,
}
_VALUE = {"mean": "round(avg(value), 6)", "sum": "round(sum(value), 6)", "min": "round(min(value), 6)", "max": "round(max(value), 6)", "count": "count(*)::DOUBLE", "last": "round(arg_max(value, {'a': ts, 'b': seq}), 6)"}
_CHUNKS = f"WITH {ORDERS}, c AS (SELECT *, (row_number() OVER (PARTITION BY name, labels_key ORDER BY seq) - 1) // 120 AS chunk FROM o)"
_RATE = """, p AS (SELECT *, lag(ts) OVER w AS t0, lag(value) OVER w AS v0 FROM {t} WINDOW w AS (PARTITION BY name, labels_key ORDER BY {by}))
SELECT name, labels_key, ts, round(CASE WHEN value < v0 THEN value ELSE value - v0 END / (ts - t0), 6) AS value FROM p WHERE ts > t0"""
#: Events as they lie in the store: the second batch's arrival numbers follow the first one's.
_STORE = f"WITH {EVENTS}, s AS (SELECT name, labels_key, user_id, ts, value, CASE WHEN user_id % 2 = 0 THEN seq ELSE seq + 1 + (SELECT max(seq) FROM e WHERE user_id % 2 = 0) END AS seq FROM e)"
ORACLES: dict[str, str] = {
    "range_scan_exact": f"WITH {EVENTS} SELECT name, labels_key, ts, value, seq FROM e WHERE name = 'click' AND user_id = 8 AND ts BETWEEN {START} AND {START + 20 * DAY}",
    "range_downsampled": f"WITH {EVENTS} SELECT name, labels_key, floor(ts / 21600.0) * 21600.0 AS ts, round(avg(value), 6) AS value FROM e WHERE name = 'view' AND user_id = 7 AND ts BETWEEN {START + 3600.5} AND {START + 25 * DAY} GROUP BY ALL",
    "aggregate_all": f"WITH {EVENTS} SELECT 'empty' AS agg, 1.0::DOUBLE AS value " + " ".join(f"UNION ALL SELECT '{a}', {v} FROM e" for a, v in _VALUE.items()),
    **{f"downsample_{a}": _bucketed(EVENTS, "e", DAY, v) for a, v in _VALUE.items()},
    "downsample_hot": _bucketed(LINES, "l", 30 * DAY, _VALUE["sum"]),
    "downsample_arrival": f"""WITH {ORDERS}, b AS (
      SELECT *, max(floor(ts / {30 * DAY})) OVER (PARTITION BY name, labels_key ORDER BY seq ROWS UNBOUNDED PRECEDING) * {30 * DAY} AS b FROM o
    ) SELECT name, labels_key, b AS ts, arg_max(value, seq) AS last, count(*)::DOUBLE AS count FROM b GROUP BY ALL""",
    "rate_time": f"WITH {EVENTS}" + _RATE.format(t="e", by="ts, seq"),
    "rate_arrival": f"WITH {ORDERS}" + _RATE.format(t="o", by="seq"),
    "instant_value": f"WITH {EVENTS} SELECT name, labels_key, max(ts) AS ts, arg_max(value, {{'a': ts, 'b': -seq}}) AS value FROM e WHERE ts BETWEEN {START + 10 * DAY - 300} AND {START + 10 * DAY} GROUP BY ALL",
    "select_glob_keep_empty": f"""WITH {EVENTS}, s AS (SELECT DISTINCT name, labels_key FROM e WHERE name = 'click' AND user_id::VARCHAR GLOB '[!2-9]*')
      SELECT s.name, s.labels_key, count(e.ts) AS samples, round(coalesce(sum(e.value), 0), 6) AS total
      FROM s LEFT JOIN e ON e.name = s.name AND e.labels_key = s.labels_key AND e.ts BETWEEN {START} AND {START + 2 * DAY} GROUP BY ALL""",
    "select_glob_missing_label": f"""WITH {EVENTS}, s AS (SELECT DISTINCT name, labels_key FROM e WHERE name = 'error' AND user_id::VARCHAR GLOB '?')
      SELECT s.name, s.labels_key, e.ts, e.value
      FROM s LEFT JOIN e ON e.name = s.name AND e.labels_key = s.labels_key AND e.ts BETWEEN {START} AND {START + 5 * DAY}""",
    "list_series": f"WITH {EVENTS} SELECT name, labels_key, min(seq) AS first_seq FROM e GROUP BY ALL",
    "series_count": f"WITH {EVENTS} SELECT count(*) AS series FROM (SELECT DISTINCT name, labels_key FROM e)",
    "samples_per_series": f"WITH {EVENTS} SELECT name, labels_key, count(*) AS samples FROM e GROUP BY ALL",
    "chunk_ordinal": _CHUNKS + " SELECT name, labels_key, seq, chunk FROM c",
    "chunk_zone_map": _CHUNKS + " SELECT name, labels_key, chunk, count(*) AS samples, min(ts) AS min_ts, max(ts) AS max_ts FROM c GROUP BY ALL",
    "ingest_normalise": f"WITH {EVENTS} SELECT ' ' || name AS name, labels_key, CASE WHEN seq % 5 = 0 THEN {START} ELSE ts END AS ts, value, seq FROM e WHERE seq % 7 <> 0",
    "labels_from_json": """SELECT event_id, '[{"key":"k","value":"' || (props->>'$.k') || '"}]' AS labels_key FROM events""",
    "store_round_trip": _STORE + " SELECT name, labels_key, ts, value, seq FROM s",
    "store_series": _STORE + " SELECT name, labels_key, min(seq) AS first_seq, count(*) AS samples, min(ts) AS min_ts, max(ts) AS max_ts FROM s GROUP BY ALL",
    "store_health": _STORE + " SELECT 'ok' AS status, count(*) AS series FROM (SELECT DISTINCT name, labels_key FROM s)",
    "store_range": _STORE + f" SELECT ts, value, seq FROM s WHERE name = 'view' AND user_id = 7 AND ts BETWEEN {START} AND {START + 25 * DAY}",
    "store_instant": _STORE + f" SELECT name, {START + 20 * DAY}::DOUBLE AS ts, arg_max(value, {{'a': ts, 'b': -seq}}) AS value FROM s WHERE name = 'click' AND user_id = 8 AND ts BETWEEN {START} AND {START + 20 * DAY} GROUP BY name",
    "store_glob": _STORE + f""" SELECT name, labels_key, count(*) FILTER (WHERE ts BETWEEN {START} AND {START + 2 * DAY}) AS samples, min(seq) AS first_seq
      FROM s WHERE name = 'click' AND user_id::VARCHAR GLOB '[!2-9]*' GROUP BY ALL""",
    "single_ingests": """SELECT 'last' AS what, max(r_regionkey)::DOUBLE AS value FROM region UNION ALL SELECT 'instant', min(r_regionkey)::DOUBLE FROM region
      UNION ALL SELECT 'distinct_seq', count(*)::DOUBLE FROM region UNION ALL SELECT 'largest_seq', count(*)::DOUBLE - 1 FROM region""",
}
