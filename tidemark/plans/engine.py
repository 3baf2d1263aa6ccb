"""The engine: what a client of a metric store calls, each call a Spark query."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import BadRequest, NoData
from tidemark.functions.aggregates import Aggregation
from tidemark.operators import aggregate, rate, select
from tidemark.operators.instant import LOOKBACK, instant
from tidemark.sources.ingest import SampleStore


def parse_labels(labels: str | dict | None) -> dict[str, str]:
    """Labels as a dict of strings, from one or from a JSON object."""
    if isinstance(labels, str):
        try:
            labels = json.loads(labels)
        except json.JSONDecodeError:
            raise BadRequest(f"labels can't be read as JSON: {labels!r}") from None
    if labels is not None and not isinstance(labels, dict):
        raise BadRequest(f"labels are pairs of a name and a string, not {labels!r}")
    for k, v in (labels or {}).items():
        if not isinstance(k, str) or not isinstance(v, str):
            raise BadRequest(f"a label and its value are strings, not {k!r} and {v!r}")
    return labels or {}


class MetricEngine:
    def __init__(self, spark: SparkSession, store: SampleStore | str | None = None, samples: DataFrame | None = None):
        """Over a store (or its path), or over samples at hand, which can only be read."""
        self.spark, self._samples = spark, samples
        self.store = SampleStore(spark, store) if isinstance(store, str) else store

    @property
    def samples(self) -> DataFrame:
        return self._samples if self.store is None else self.store.read()

    def _writable(self) -> SampleStore:
        if self.store is None:
            raise BadRequest("this engine has no store to write to")
        return self.store

    def health(self) -> dict:
        return {"status": "ok", "series": self.catalogue.count()}

    @property
    def catalogue(self) -> DataFrame:
        """A row per series; of a store, from its own catalogue, without a look at any sample."""
        return select.series(self._samples) if self.store is None else self.store.series()

    def series(self) -> DataFrame:
        """name, labels, in the order first written."""
        return self.catalogue.orderBy("first_seq").select("name", "labels")

    def ingest(self, name: str, value: float, labels: str | dict | None = None, timestamp: float | None = None) -> int:
        return self._writable().ingest(name, value, parse_labels(labels), timestamp)

    def ingest_batch(self, points, arrival: str | None = None) -> int:
        return self._writable().ingest_batch(points, arrival)

    def range(self, name: str, start: float, end: float, labels: str | dict | None = None, step: float | None = None, agg: str = "mean", order: str = "time") -> DataFrame:
        """ts, value of one series: its samples (with seq), or their aggregates by buckets of step."""
        labels, agg = parse_labels(labels), Aggregation.of(agg)
        if not start < end:
            raise BadRequest(f"the range from {start} to {end} holds no time")
        found = select.range_scan(self.samples, name, labels, start, end)
        if step is None:
            return found.select("ts", "value", "seq")
        return aggregate.downsample(found, step, agg, order).select("ts", "value")

    def rate(self, name: str, start: float, end: float, labels: str | dict | None = None, order: str = "time") -> DataFrame:
        return rate.rate(select.range_scan(self.samples, name, parse_labels(labels), start, end), order).select("ts", "value")

    def select(self, name: str, matchers: str | dict | None, start: float, end: float) -> DataFrame:
        """All series of this name whose labels match the patterns, with their samples in the range."""
        return select.select_series(self.samples, name, parse_labels(matchers), start, end, self.catalogue)

    def instant(self, name: str, labels: str | dict | None = None, at: float | None = None, lookback: float = LOOKBACK) -> dict:
        """The value at a time (now, if none is given); raises NoData where there is none."""
        labels, at = parse_labels(labels), time.time() if at is None else at
        row = instant(select.range_scan(self.samples, name, labels, at - lookback, at), at, lookback).select(F.col("value")).head()
        if row is None:
            raise NoData(f"{name!r} has no sample from {at - lookback} to {at}")
        return {"name": name, "labels": labels, "timestamp": at, "value": row["value"]}
