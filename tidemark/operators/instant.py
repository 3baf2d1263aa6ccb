"""The value of series at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.select import check_finite, in_range
from tidemark.schema import SERIES

LOOKBACK = 300.0


def instant(samples: DataFrame, at: float, lookback: float = LOOKBACK) -> DataFrame:
    """name, labels_key, ts (of the sample), value: each series' latest sample in [at - lookback, at]; of samples of the
    same time the first to arrive. A series without one gives no row."""
    check_finite(at=at, lookback=lookback)
    first_of_latest = F.struct("ts", (-F.col("seq")).alias("s"))
    found = samples.where(in_range(at - lookback, at)).groupBy(*SERIES)
    return found.agg(F.max("ts").alias("ts"), F.max_by("value", first_of_latest).alias("value"))
