"""The per-second rate of a counter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import blocks, with_block, within_block
from tidemark.schema import SERIES


def rate(samples: DataFrame, order: str = "time") -> DataFrame:
    """name, labels_key, ts, value: for each sample the change since its predecessor in its series, by seconds.

    After a decrease the counter is taken to have started anew at 0. Pairs that don't advance in time give no row, but
    their later sample still is the next one's predecessor. A range must be taken before, not after."""
    own = within_block(order)
    rows = with_block(samples.select(*SERIES, "ts", "value", "seq"), order).withColumn("_a", F.struct("ts", "value"))
    rows = rows.select("*", F.lag("_a").over(own).alias("_previous"), F.lead("seq").over(own).isNull().alias("_last"))
    ends = rows.where("_last")  # a block's last sample is the predecessor of the next block's first
    before = ends.select(*SERIES, "_block", F.lag("_a").over(blocks()).alias("_carried"))
    rows = rows.join(before, [*SERIES, "_block"]).withColumn("_previous", F.coalesce("_previous", "_carried"))
    dt, dv = F.col("ts") - F.col("_previous.ts"), F.col("value") - F.col("_previous.value")
    change = F.when(dv < 0, F.col("value")).otherwise(dv)
    return rows.where(dt > 0).select(*SERIES, "ts", F.when(dt > 0, change / dt).alias("value"))
