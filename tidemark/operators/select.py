"""Scans: ranges of one series, of all series that match, and the catalogue of series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import BadRequest
from tidemark.functions.labels import has_labels, matches
from tidemark.schema import SERIES


def check_finite(**values: float) -> None:
    for name, value in values.items():
        if not math.isfinite(value):
            raise BadRequest(f"{name} must be finite, not {value}")


def in_range(start: float, end: float) -> Column:
    """The closed interval."""
    if math.isnan(start) or math.isnan(end):
        raise BadRequest("start and end must be numbers")
    return F.col("ts").between(float(start), float(end))


def range_scan(samples: DataFrame, name: str, labels: dict[str, str], start: float, end: float) -> DataFrame:
    """The samples of exactly this series."""
    return samples.where((F.col("name") == name) & has_labels(labels) & in_range(start, end))


def series(samples: DataFrame) -> DataFrame:
    """name, labels, labels_key, first_seq of every series; ordered by first_seq, they stand as first written."""
    return samples.groupBy(*SERIES).agg(F.first("labels").alias("labels"), F.min("seq").alias("first_seq"))


def series_count(samples: DataFrame) -> DataFrame:
    return samples.select(*SERIES).distinct().agg(F.count("*").alias("series"))


def sample_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*SERIES).agg(F.count("*").alias("samples"))


def select_series(samples: DataFrame, name: str, matchers: dict[str, str], start: float, end: float, catalogue: DataFrame | None = None) -> DataFrame:
    """The samples of every series whose labels match the patterns; a series without samples in the range gives one row
    with null ts, value and seq. With a catalogue (a row per series), samples outside the range are never read."""
    like = (F.col("name") == name) & matches(matchers)
    chosen = series(samples.where(like)) if catalogue is None else catalogue.where(like).select("name", "labels", "labels_key", "first_seq")
    inside = samples.where(like & in_range(start, end)).select(*SERIES, "ts", "value", "seq")
    return chosen.join(inside, SERIES, "left").select("name", "labels", "labels_key", "first_seq", "ts", "value", "seq")
