"""Variable-capacity best-fit packing of token sequences into bins of several permitted lengths.

Documents are cut into pieces of at most the largest capacity. Pieces are dealt into shards of about SHARD_PIECES, by their
total number and a hash of id, text, copy and piece, so a shard is a random sample of the lengths and no document, source
or group of copies fills one. Each shard is packed in one task: pieces in decreasing length go to the open bin that they
fill best; where none has room, the bin size that costs least per token for the pieces at hand opens. A bin's cost is its
capacity plus BIN_COST tokens. At the end each bin is downsized to the smallest permitted length that holds its contents.

A full piece (as long as the largest capacity) fills a bin by itself. Bins never span shards; the waste this adds is at
most a few partly filled bins a shard. Equal rows are counted first and packed one by one, told apart by copy.

pack() gives a row per piece: doc_id, piece, n_tokens, bin_id (unique over all shards), capacity, position (first token's
offset in the bin), copy (from 0 among equal rows). sequences() takes documents as token ids and gives a row per bin: its
token ids, the position of each within its own piece, and the document of each piece with its offset.

Rows of empty or null texts are pieces of no tokens: bin_id, capacity and position are null, so that no document is lost;
they are in no sequence. Null ids are packed as others. Extra columns are ignored; an empty table gives an empty result.
Ties go to the lower doc_id, then piece; of bins equally full, to the one opened first.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, table, written

CAPACITIES, BIN_COST, SHARD_PIECES, MOST_TASKS = (512, 1024, 2048, 4096), 16, 20_000, 10_000


def cheapest(length: int, rest: np.ndarray, counts: np.ndarray, capacities: tuple[int, ...]) -> int:
    """The capacity that costs least per token placed, when a new bin takes length and then, greedily, the largest of the
    lengths still to come (rest, increasing, with counts)."""
    best, price = capacities[-1], float("inf")
    for cap in (c for c in capacities if c >= length):
        room, filled, taken = cap - length, length, {}
        while room > 0:
            i = int(np.searchsorted(rest, min(room, length), side="right")) - 1  # none longer is still to come
            while i >= 0 and counts[i] - taken.get(i, 0) <= 0:
                i -= 1
            if i < 0:
                break
            taken[i] = taken.get(i, 0) + 1
            room -= int(rest[i])
            filled += int(rest[i])
        cost = (cap + BIN_COST) / filled
        if cost < price - 1e-12:
            best, price = cap, cost
    return best


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """For lengths in decreasing order (each from 1 to the largest capacity): bin and offset of each, capacity of each bin."""
    capacities = tuple(sorted(capacities))
    kinds, counts = np.unique(np.array(lengths, dtype=np.int64), return_counts=True)
    slot = {int(x): i for i, x in enumerate(kinds)}
    room: dict[int, list[int]] = {}  # bins by their free room, first opened last
    rooms: list[int] = []  # the keys of room, increasing
    which, offset, size, used = [], [], [], []
    for x in lengths:
        counts[slot[x]] -= 1
        at = bisect.bisect_left(rooms, x)
        if at < len(rooms):
            free = rooms[at]
            b = room[free].pop()
            if not room[free]:
                del room[free], rooms[at]
        else:
            free = cheapest(x, kinds, counts, capacities)
            b = len(size)
            size.append(free)
            used.append(0)
        which.append(b)
        offset.append(used[b])
        used[b] += x
        free -= x
        if free:
            if free not in room:
                room[free] = []
                bisect.insort(rooms, free)
            bisect.insort(room[free], b, key=lambda v: -v)
    return which, offset, [capacities[bisect.bisect_left(capacities, u)] for u in used]


def pack(docs: DataFrame, n_tokens: Column, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id", shard_pieces: int = SHARD_PIECES, key: Column | None = None) -> DataFrame:
    """docs packed by n_tokens, a column of them. With a key (a long), rows of one id are equal only if their keys are."""
    largest = max(capacities)
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.lit(0).cast("long") if key is None else key).alias("key"), F.coalesce(n_tokens.cast("long"), F.lit(0)).alias("n"))
    groups = written(sized.groupBy("doc_id", "key", "n").agg(F.count("*").alias("copies")), "sizes")
    last_piece = f"greatest(0L, (n - 1) div {largest}L)"
    total = groups.agg(F.sum(F.expr(f"copies * (1 + {last_piece})"))).head()[0] or 0
    shards = int(max(1, -(-total // shard_pieces)))
    copies = groups.select("doc_id", "key", "n", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"))
    pieces = copies.select("*", F.explode(F.expr(f"sequence(0L, {last_piece})")).alias("piece")).select(
        "doc_id", "key", "copy", "piece", F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).cast("long").alias("n_tokens")
    )
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "key", "copy", "piece"), F.lit(shards)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece", "copy", "key"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        full = pdf["n_tokens"].to_numpy()
        placed = int((full > 0).sum())
        which, offset, caps = best_fit([int(x) for x in full[:placed]], capacities)
        pdf["bin_id"] = pd.array(which + [None] * (len(pdf) - placed), dtype="Int64") * shards + int(key[0])
        pdf["capacity"] = pd.array([caps[b] for b in which] + [None] * (len(pdf) - placed), dtype="Int64")
        pdf["position"] = pd.array(offset + [None] * (len(pdf) - placed), dtype="Int64")
        # ids as they came: as strings, since pandas makes floats of longs where there are nulls
        return pdf[["doc_id", "piece", "n_tokens", "bin_id", "capacity", "position", "copy", "key"]]

    schema = "doc_id string, piece long, n_tokens long, bin_id long, capacity long, position long, copy long, key long"
    # few bytes, but much work: a task per shard, which Spark would otherwise join into a few
    rows = pieces.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 20, " ")).repartition(min(shards, MOST_TASKS), "shard").groupBy("shard").applyInPandas(run, schema)
    rows = rows.withColumn("doc_id", F.trim("doc_id").cast("long"))
    return rows.drop("key") if key is None else rows


def sequences(tokens: DataFrame, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id", ids_col: str = "ids", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """tokens: a document's ids, an array of whole numbers, per row. A row per bin: bin_id, capacity, token_ids, position_ids
    (from 0 in each piece), and segments: doc_id, piece and start of each piece in the bin."""
    ids = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), ids.alias("ids"), F.xxhash64(ids).alias("key"))
    placed = pack(rows, F.size("ids"), capacities, "doc_id", shard_pieces, F.col("key")).where("bin_id IS NOT NULL")
    once = rows.dropDuplicates(["doc_id", "key"]).withColumnsRenamed({"doc_id": "whose", "key": "its_key"})
    parts = placed.join(once, F.col("doc_id").eqNullSafe(F.col("whose")) & (F.col("key") == F.col("its_key")))
    part = F.slice("ids", (F.col("piece") * max(capacities) + 1).cast("int"), F.col("n_tokens").cast("int"))
    parts = parts.select("bin_id", "capacity", F.struct("position", "doc_id", "piece", part.alias("ids")).alias("p"))
    bins = parts.groupBy("bin_id", "capacity").agg(F.array_sort(F.collect_list("p")).alias("p"))  # at most capacity tokens
    places = F.transform("p", lambda x: F.sequence(F.lit(0), F.size(x["ids"]) - 1))
    segments = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["position"].alias("start")))
    return bins.select("bin_id", "capacity", F.flatten("p.ids").alias("token_ids"), F.flatten(places).alias("position_ids"), segments.alias("segments"))


def word_count(text_col: str = "text"):
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_count())
