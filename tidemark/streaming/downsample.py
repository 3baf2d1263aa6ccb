"""Downsampling of a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import BadRequest
from tidemark.functions.aggregates import Aggregation, aggregate_column
from tidemark.schema import SERIES


def downsample_stream(samples: DataFrame, step: float, agg: str | Aggregation = Aggregation.MEAN, watermark: str = "10 minutes") -> DataFrame:
    """As downsample() by time, of a streaming frame of samples: a bucket is emitted once the watermark has passed it.

    step is in whole microseconds, above 0. Samples later than the watermark are left out."""
    micros = round(step * 1e6)
    if micros < 1:
        raise BadRequest(f"step must be a microsecond or more, not {step}")
    timed = samples.withColumn("_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).withWatermark("_time", watermark)
    grouped = timed.groupBy(*SERIES, F.window("_time", f"{micros} microseconds")).agg(aggregate_column(agg, "time"))
    return grouped.select(*SERIES, (F.unix_micros("window.start") / F.lit(1e6)).alias("ts"), "value")
