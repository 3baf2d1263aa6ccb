"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's score for a query is a sum over LISTS lists, each of the partial scores of a block of dimensions. Rows and
queries are packed into blocks of bounded size; a tile is a block of queries with a block of rows, which holds all lists of
its rows, so what the third phase resolves never travels. Tiles are rows of a join, dealt to tasks by the block of queries
and a salt of the block of rows: one job a phase, whatever the number of queries.

  1. Every tile takes the k best entries of each of its local lists, resolves the totals of just these, and keeps the k
     best of a query. The k-th best over all tiles is a safe cutoff tau: at least k vectors reach it.
  2. The cutoffs join the blocks of queries. A vector that reaches tau has a partial score of tau / LISTS or more in some
     list, whatever the signs; a tile collects the entries of its lists at or above that uniform threshold.
  3. The totals of the entries collected are resolved exactly; of those that reach tau a task keeps the k best of each
     query, ties to the smaller id, and the best of all tasks are ranked.

Defined cases: vectors that are null or empty, or hold null or non-finite components, take no part, neither as queries nor as
candidates; so do rows with a null id. Rows that repeat an id are candidates on their own (and as queries, give one
result, from the first of the vectors in order). A vector whose length differs from the query's does not match it. Fewer
than k candidates give fewer rows. Extra columns are ignored; an empty table gives an empty result. Components are
floored after scaling; scores are exact up to 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, table, written

SCALE, K, LISTS, QUERY_BLOCK, ROW_BLOCK, QUERY_STEP = 64, 20, 2, 4096, 8192, 128
FOUND = "query_block long, query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id and its vector floor(scale * x) as doubles, without the rows that take no part."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fine = F.forall(F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)
        .select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("double")).alias("x"))
    )


def packed(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of up to size vectors of one length d: block (a number), d, ids and x as bytes, and whether x is of doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(d: int, ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
            nonlocal number
            number += 1
            wide = bool(np.abs(x).max(initial=0) > 32767)
            return pd.DataFrame({"block": [number], "d": [d], "ids": [ids.tobytes()], "x": [x.astype(np.float64 if wide else np.int16).tobytes()], "wide": [wide]})

        for pdf in batches:
            length = pdf["x"].map(len).to_numpy()
            for d in np.unique(length).tolist():
                own = pdf[length == d]
                held = [*waiting.pop(d, []), (own["vec_id"].to_numpy(np.int64), np.stack(own["x"].to_numpy()))]
                ids, x = (np.concatenate(parts) for parts in zip(*held, strict=True))
                for at in range(0, len(ids) - size + 1, size):
                    yield block(d, ids[at : at + size], x[at : at + size])
                done = len(ids) // size * size
                if done < len(ids):
                    waiting[d] = [(ids[done:], x[done:])]
        for d, held in waiting.items():
            yield block(d, *held[0])

    return vectors.mapInPandas(run, "block long, d int, ids binary, x binary, wide boolean")


def unpacked(ids: bytes, x: bytes, wide: bool, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(x, dtype=np.float64 if wide else np.int16).reshape(-1, d)


class Tile:
    """The local lists of a block of rows for a block of queries."""

    def __init__(self, row: tuple):
        self.number = row.query_block
        self.names, q = unpacked(row.query_ids, row.query_x, row.query_wide, row.d)
        self.ids, x = unpacked(row.ids, row.x, row.wide, row.d)
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * row.d
        kind = np.float32 if largest < 2**24 else np.float64  # sums of whole numbers, exact in either
        self.q, self.x = q.astype(kind), x.astype(kind)
        self.cuts = np.array_split(np.arange(row.d), min(LISTS, row.d))

    def steps(self) -> Iterator[tuple[slice, list[np.ndarray]]]:
        """QUERY_STEP queries at a time: the partial scores of each list."""
        for s in range(0, len(self.names), QUERY_STEP):
            own = slice(s, s + QUERY_STEP)
            yield own, [self.q[own, c[0] : c[-1] + 1] @ self.x[:, c[0] : c[-1] + 1].T for c in self.cuts]


def heads(tile: Tile, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phase 1: (query, vector, total) of the k best entries of each list."""
    n = len(tile.ids)
    head = min(k + 1, n)  # the query's own row may be among them
    for own, parts in tile.steps():
        names = tile.names[own]
        best = np.concatenate([np.argpartition(p, n - head, axis=1)[:, n - head :] for p in parts], axis=1)
        best.sort(axis=1)
        rows, cols = np.repeat(np.arange(len(names)), best.shape[1]), best.ravel()
        once = np.ones(len(cols), dtype=bool)
        once[1:] = (cols[1:] != cols[:-1]) | (rows[1:] != rows[:-1])
        once &= tile.ids[cols] != names[rows]
        rows, cols = rows[once], cols[once]
        yield names[rows], tile.ids[cols], sum(p[rows, cols].astype(np.float64) for p in parts)


def reached(tile: Tile, cutoff: dict[int, float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phases 2 and 3: of the entries at or above the uniform threshold the totals that reach the cutoff."""
    for own, parts in tile.steps():
        names = tile.names[own]
        cut = np.array([cutoff.get(int(i), -np.inf) for i in names])
        seen = parts[0] >= (cut / len(parts))[:, None]
        for p in parts[1:]:
            seen |= p >= (cut / len(parts))[:, None]
        rows, cols = np.nonzero(seen)
        score = sum(p[rows, cols].astype(np.float64) for p in parts)
        keep = (score >= cut[rows]) & (tile.ids[cols] != names[rows])
        yield names[rows[keep]], tile.ids[cols[keep]], score[keep]


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[keep], score[keep]


def _search(k: int, last: bool):
    """The k best that a task's tiles find for each query: in phase 1, or in phases 2 and 3."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def rows(number: int) -> pd.DataFrame:
            query, ids, score = held.pop(number)
            return pd.DataFrame({"query_block": number, "query_id": query, "vec_id": ids, "score": score.astype(np.int64)})

        for pdf in batches:
            for row in pdf.itertuples():
                tile = Tile(row)
                if tile.number not in held and len(held) >= 16:  # blocks of queries that a task holds
                    yield rows(next(iter(held)))
                found = reached(tile, dict(zip(row.cut_ids, row.cuts, strict=True)) if row.cut_ids is not None else {}) if last else heads(tile, k)
                for part in found:
                    kept = best(*part, k)
                    if tile.number in held:
                        kept = tuple(np.concatenate(x) for x in zip(held[tile.number], kept, strict=True))
                    held[tile.number] = kept
                if tile.number in held:
                    held[tile.number] = best(*held[tile.number], k)
        for number in list(held):
            yield rows(number)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows of vectors, ties to the smaller id."""
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    rows = written(packed(integer_vectors(vectors, id_col, vec_col, scale), ROW_BLOCK), "rows")
    single = written(integer_vectors(queries, id_col, vec_col, scale).groupBy("vec_id").agg(F.min("x").alias("x")), "queries")
    asked = written(packed(single.repartition(max(1, -(-single.count() // QUERY_BLOCK))), QUERY_BLOCK), "asked")
    dropped(single)
    salts = max(1, -(-2 * parallel // max(1, asked.count())))
    asked = asked.select(F.col("block").alias("query_block"), "d", F.col("ids").alias("query_ids"), F.col("x").alias("query_x"), F.col("wide").alias("query_wide"))
    dealt = rows.join(asked.select("query_block", "d"), "d").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))  # rows of asked: one per QUERY_BLOCK queries

    def tiles(blocks: DataFrame) -> DataFrame:
        copies = blocks.drop("d").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        return dealt.join(copies.hint("shuffle_hash"), ["query_block", "salt"])

    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = tiles(asked).mapInPandas(_search(k, False), FOUND)
    kth = first.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).groupBy("query_block", "query_id").agg(F.min("score").alias("tau"), F.count("*").alias("n"))
    cuts = kth.where(F.col("n") >= k).groupBy("query_block").agg(F.collect_list(F.struct("query_id", F.col("tau").cast("double").alias("tau"))).alias("cuts"))  # up to QUERY_BLOCK a row
    cuts = written(cuts.select("query_block", F.col("cuts.query_id").alias("cut_ids"), F.col("cuts.tau").alias("cuts")), "cuts")
    found = tiles(asked.join(cuts, "query_block", "left")).mapInPandas(_search(k, True), FOUND)
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
