"""The given tables as samples."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.labels import labels_key


def epoch_seconds(ts: Column) -> Column:
    """Unix seconds of a timestamp without a zone, in UTC whatever the session's zone."""
    seconds = F.unix_date(F.to_date(ts)).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return (seconds * 1_000_000 + micros) / F.lit(1e6)


def _bound(seconds: float) -> Column:
    """A timestamp without a zone, from Unix seconds in UTC."""
    at = datetime(1970, 1, 1) + timedelta(seconds=seconds)
    return F.lit(at.isoformat(sep=" ", timespec="microseconds")).cast("timestamp_ntz")


def _samples(rows: DataFrame, name: Column, labels: Column, ts: str, value: str, seq: str, start: float | None, end: float | None) -> DataFrame:
    """start and end (Unix seconds) bound the raw column, a millisecond wide of them, so that the scan can use its
    statistics; the derived seconds can't be pushed down, and the exact range is taken from them."""
    if start is not None:
        rows = rows.where(F.col(ts) >= _bound(start - 1e-3))
    if end is not None:
        rows = rows.where(F.col(ts) <= _bound(end + 1e-3))
    cols = [name.alias("name"), labels.alias("labels"), epoch_seconds(F.col(ts)).alias("ts"), F.col(value).cast("double").alias("value"), F.col(seq).cast("long").alias("seq")]
    return rows.select(*cols).withColumn("labels_key", labels_key(F.col("labels"))).select("name", "labels", "labels_key", "ts", "value", "seq")


def events(spark: SparkSession, sf_dir: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """A series per event type and user, in order of time."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _samples(rows, F.col("event_type"), F.create_map(F.lit("user_id"), F.col("user_id").cast("string")), "ts", "value", "event_id", start, end)


def orders(spark: SparkSession, sf_dir: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """A series per order status; by order key, dates go back and forth."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _samples(rows, F.lit("order_total"), F.create_map(F.lit("status"), F.col("o_orderstatus")), "o_orderdate", "o_totalprice", "o_orderkey", start, end)


def lineitem(spark: SparkSession, sf_dir: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """A series per return flag and line status. Its order of arrival is unknown: not for LAST or order "arrival"."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    labels = F.create_map(F.lit("returnflag"), F.col("l_returnflag"), F.lit("linestatus"), F.col("l_linestatus"))
    return _samples(rows, F.lit("line_qty"), labels, "l_shipdate", "l_quantity", "l_orderkey", start, end)
