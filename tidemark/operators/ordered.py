"""Windows over the order of a series without one task per series: the order is cut into blocks.

A block is a stretch of arrival numbers or of time. Windows run within (series, block); what a block needs of those before
it is one row per block, so a series of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.aggregates import check_order
from tidemark.schema import SERIES

BLOCK_SAMPLES, BLOCK_SECONDS = 1_000_000, 86_400.0 * 7


def with_block(samples: DataFrame, order: str) -> DataFrame:
    block = F.floor(F.col("seq") / BLOCK_SAMPLES) if check_order(order) == "arrival" else F.floor(F.col("ts") / BLOCK_SECONDS)
    return samples.withColumn("_block", block)


def within_block(order: str) -> WindowSpec:
    return Window.partitionBy(*SERIES, "_block").orderBy(*(["seq"] if order == "arrival" else ["ts", "seq"]))


def carried(samples: DataFrame, aggregate: Column, over: Column) -> DataFrame:
    """Per series and block: over, a window function of the blocks' aggregates (in the column _a) in order."""
    return samples.groupBy(*SERIES, "_block").agg(aggregate.alias("_a")).select(*SERIES, "_block", over.alias("_carried"))


def blocks() -> WindowSpec:
    """The blocks of a series, in order."""
    return Window.partitionBy(*SERIES).orderBy("_block")


def earlier_blocks() -> WindowSpec:
    """All blocks of a series before the current one."""
    return blocks().rowsBetween(Window.unboundedPreceding, -1)
