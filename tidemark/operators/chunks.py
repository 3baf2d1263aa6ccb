"""Samples by chunks of their arrival, and the time range of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import carried, earlier_blocks, with_block, within_block
from tidemark.schema import SERIES

CHUNK_SIZE = 120


def with_chunk(samples: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """samples with chunk: the number, from 0, of the chunk of its series that each sample falls into by arrival."""
    rows = with_block(samples, "arrival")
    before = carried(rows, F.count("*"), F.sum("_a").over(earlier_blocks()))
    place = F.row_number().over(within_block("arrival")) + F.coalesce("_carried", F.lit(0)) - 1
    return rows.join(before, [*SERIES, "_block"]).withColumn("chunk", F.floor(place / F.lit(size))).drop("_block", "_carried")


def zone_map(samples: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """name, labels_key, chunk, samples, min_ts, max_ts."""
    return with_chunk(samples, size).groupBy(*SERIES, "chunk").agg(F.count("*").alias("samples"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
