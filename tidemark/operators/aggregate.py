"""Aggregation over time: of a whole range, or of buckets of a fixed step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.aggregates import Aggregation, aggregate_columns, check_order
from tidemark.operators.ordered import carried, earlier_blocks, with_block, within_block
from tidemark.operators.select import check_finite
from tidemark.schema import SERIES


def aggregate(samples: DataFrame, agg: str | Aggregation | list[str | Aggregation], order: str = "time") -> DataFrame:
    """One row: value, or a column for each of a list of aggregates; NaN where there is no sample."""
    columns = aggregate_columns(agg, order)
    row = samples.agg(*columns, F.count(F.lit(1)).alias("_n"))
    return row.select(*(F.when(F.col("_n") == 0, F.lit(float("nan"))).otherwise(F.col(c)).alias(c) for c in row.columns[:-1]))


def bucket_number(step: float) -> Column:
    """floor(ts / step), or an error where a long can't hold it and buckets would run together."""
    quotient = F.col("ts") / F.lit(float(step))
    wrong = F.raise_error(F.concat(F.lit(f"a step of {step} is too small for the time "), F.col("ts").cast("string")))
    return F.when(F.abs(quotient) < F.lit(2.0**63), F.floor(quotient)).otherwise(wrong.cast("long"))


def downsample(samples: DataFrame, step: float, agg: str | Aggregation | list[str | Aggregation] = Aggregation.MEAN, order: str = "time") -> DataFrame:
    """name, labels_key, ts, value: a row per series and bucket that has samples; ts is the bucket's start, a multiple of
    step. For a list of aggregates a column of its own name each, in one pass, instead of value.

    With order "arrival" a late sample counts for the latest bucket reached so far. A step of 0 or less gives no rows; one
    so small that ts / step exceeds 2**63 raises an error when the query runs."""
    columns = aggregate_columns(agg, order)
    check_order(order)
    check_finite(step=step)
    points = samples.select(*SERIES, "ts", "value", "seq")
    if step <= 0:
        return points.groupBy(*SERIES, "ts").agg(*columns).limit(0)
    bucket = bucket_number(step)
    if order == "time":
        points = points.withColumn("_bucket", bucket)
    else:
        points = with_block(points.withColumn("_own", bucket), order)
        before = carried(points, F.max("_own"), F.max("_a").over(earlier_blocks()))
        reached = F.max("_own").over(within_block(order).rowsBetween(Window.unboundedPreceding, 0))
        points = points.withColumn("_reached", reached).join(before, [*SERIES, "_block"]).withColumn("_bucket", F.greatest("_reached", "_carried"))
    grouped = points.groupBy(*SERIES, "_bucket").agg(*columns)
    return grouped.select(*SERIES, (F.col("_bucket") * F.lit(float(step))).alias("ts"), *grouped.columns[3:])
