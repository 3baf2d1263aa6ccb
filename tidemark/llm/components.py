"""Connected components of links, by alternating large and small stars over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of u is tied to the least of u and its neighbours; small: u and its smaller ones are.
    A hub's rows are reduced to their least by partial aggregation; the join back is one that Spark can split."""
    both = _both_ways(edges)
    both = both if large else both.where("u > v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
    out = tied.where("u > w").select("u", "v") if large else tied.select("u", "v").union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def components(links: DataFrame) -> DataFrame:
    """links: u, v. A row per node that has a link: node, component (the least node that it reaches).

    Each round is written to the shared folder; it ends when a round changes nothing, after about log2 of the longest
    path. No links give no rows; links of a node to itself are passed over."""
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        step = written(_stars(edges, large=True), "edges")
        dropped(edges)
        edges = written(_stars(step, large=False), "edges")
        dropped(step)
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
