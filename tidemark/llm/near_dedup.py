"""Near-duplicate documents: banded MinHash candidates, verified by odd sketches, confirmed on the full shingle sets.

One pass over the texts gives each document the size and a 128-bit digest of its shingle set, the keys of BANDS bands of
MinHash values, and an odd sketch: its bottom-k MinHash sample folded into a bitmap of BITS bits, where each value of the
sample flips one bit. From the population count of the XOR of two sketches follows an estimate of the number of values by
which the samples differ, and so of the similarity (similarity_estimate). The count itself never exceeds that number. Up
to SAMPLE shingles the sample is the set itself, so a count above what the similarity allows rules a pair out for certain;
above, the estimate does, with six deviations of sampling and sketch to spare. Documents with the same set are one class;
only its representative (the least id) goes on. A link is confirmed on the two texts, shingle by shingle, not on hashes.

In a bucket of a band no list of all pairs is made. Every member is paired with one leader per bucket (the least of its
ids, XORed with one of ORDERS constants, so leaders differ between bands). Pairs whose sketches rule the similarity out
are passed over; the others are confirmed on the texts. What these links leave of a bucket in different components is
compared further, so no link between different sets is lost to the choice of leaders:
  * members of a bucket of up to FEW documents with each other, by their sketches, in the first band that they share;
  * members of larger buckets (say, documents that share a header and little else) by a prefix filter over all of them:
    sets of a similarity of percent share one of their rarest shingles, as many as the similarity lets differ and one
    more. How rare a shingle is comes from counts of all members' shingles in COUNTERS cells; any order is a right one,
    and this one keeps the headers out of the lists. Lists of up to SHORT members are paired; sizes and places in the
    order rule out more, then the sketches.
  * what stands in a longer list too is of a crowd of documents alike but for little more than the similarity allows; such
    members are compared with each other as those of small buckets are. Where they are no copies of each other, this is
    the one step whose work grows with the square of a crowd: compiled sketch comparisons, from which few pairs come.
A pair of similarity 0.8 shares a bucket with a probability of 1 - 5e-8.

Defined cases: A-Z are lower-cased; a set is of distinct runs of `shingle` words (fewer words: the whole sequence, as one);
a null, empty or blank text has an empty set and is linked with nothing; rows that repeat an id count as one document
with several texts (a link of one is a link of all); a row with a null id takes no part: its component_id is null and it
is kept. Extra columns are ignored; an empty table gives an empty result. Ties: the least id of a component stays.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import TO_LOWER, dropped, mix64, summed, table, unused, word_bounds, word_hashes, written
from tidemark.llm.components import components

BANDS, ROWS, SAMPLE, BITS, CHUNK, FEW, SHORT, COUNTERS = 32, 4, 1024, 1024, 1 << 19, 64, 16, 1 << 18
SAMPLES = BANDS * ROWS
HOT_SHARE = 1 / 1000
ORDERS = [int(x) for x in mix64(np.arange(101, 105, dtype=np.uint64)) >> np.uint64(2)]
_FLIP = (mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_MULTIPLY = (mix64(np.arange(1001, SAMPLES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingles' 64-bit hashes, increasing."""
    data = TO_LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    words = word_hashes(data, *word_bounds(data))
    if not len(words):
        return words
    n = min(shingle, len(words))
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return np.unique(total)


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """[set, sample], uint32; no set is empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((SAMPLES, len(sets)), dtype=np.uint32)
    for i in range(SAMPLES):
        np.minimum.reduceat((flat ^ _FLIP[i]) * _MULTIPLY[i], starts, out=out[i])
    return out.T


def band_keys(values: np.ndarray) -> np.ndarray:
    """[set, band]: 64-bit keys whose low bits are the band's number."""
    key = np.zeros((len(values), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + values[:, r::ROWS].astype(np.uint64) + np.uint64(r))
    return (key & ~np.uint64(BANDS - 1) | np.arange(BANDS, dtype=np.uint64)[None, :]).view(np.int64)


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """[set, BITS / 64]: bit by bit the parity of the least SAMPLE values of the set that fall there."""
    samples = [s[:SAMPLE] for s in sets]
    at = (mix64(np.concatenate(samples)) % np.uint64(BITS)).astype(np.int64)
    at += np.repeat(np.arange(len(sets)) * BITS, [len(s) for s in samples])
    flips = np.bincount(at, minlength=len(sets) * BITS)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64).reshape(len(sets), BITS // 64)


def differing_bits(a: Column, b: Column) -> Column:
    """The population count of the XOR, spelled out so that it is compiled."""
    return functools.reduce(operator.add, (F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(BITS // 64)))


def difference_estimate(bits: Column) -> Column:
    """How many values two samples differ by, from the bits by which their odd sketches do: each value flips one."""
    share = F.greatest(F.lit(1.0) - bits * F.lit(2.0 / BITS), F.lit(1.0 / BITS))
    return F.log(share) / F.lit(float(np.log(1 - 2 / BITS)))


def similarity_estimate(nu: Column, nv: Column, su: Column, sv: Column) -> Column:
    """Of two sets of up to SAMPLE shingles, from their sizes and sketches."""
    d = F.least(difference_estimate(differing_bits(su, sv)), nu + nv)
    return (nu + nv - d) / (nu + nv + d)


def may_link(nu: Column, nv: Column, su: Column, sv: Column, percent: int) -> Column:
    """Neither the sizes nor the sketches rule out that the pair is alike."""
    large, small = F.greatest(nu, nv), F.least(nu, nv)
    bits = differing_bits(su, sv)
    most = (nu + nv) * F.lit((100 - percent) / (100 + percent))  # by how many shingles the sets of a link may differ
    a, b = (F.least(F.lit(1.0), F.lit(float(SAMPLE)) / n) for n in (large, small))  # the shares that were sampled
    expected = a * most + (b - a) * small
    # the sketch's own deviation: sqrt(BITS / 4 * (1 - q^2)) bits, q = (1 - 2 / BITS)^d, each worth 1 / q values
    q = F.exp(expected * F.lit(float(np.log(1 - 2 / BITS))))
    spread = F.sqrt(expected + F.lit(BITS / 4) * (1 - q * q) / (q * q))
    sampled = difference_estimate(bits) <= expected + 6 * spread + 6
    return (100 * small >= percent * large) & F.when(large <= SAMPLE, bits <= most + 1e-6).otherwise(sampled)


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t or "") > CHUNK:
            yield slice(at, i)
            at, size = i, 0
        size += len(t or "")
    if at < len(texts):
        yield slice(at, len(texts))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """docs: doc_id, text. Per row doc_id, n, h1, h2 (of the set), keys and sketch (null for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for own in _chunks(texts):
                sets = [shingle_set(t, shingle) for t in texts[own]]
                some = [i for i, s in enumerate(sets) if len(s)]
                keys, sketch = [None] * len(sets), [None] * len(sets)
                if some:
                    values = min_hashes([sets[i] for i in some])
                    for i, k, s in zip(some, band_keys(values), odd_sketches([sets[i] for i in some]), strict=True):
                        keys[i], sketch[i] = k, s
                digest = [(s.sum(dtype=np.uint64), mix64(s ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)) for s in sets]
                h = np.array(digest, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[own], "n": [len(s) for s in sets], "h1": h[:, 0], "h2": h[:, 1], "keys": keys, "sketch": sketch})

    return docs.mapInPandas(run, "doc_id long, n long, h1 long, h2 long, keys array<long>, sketch array<long>")


@functools.lru_cache(maxsize=64)
def shingles(text: str, shingle: int) -> frozenset:
    """The set itself, of tuples of words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = min(shingle, len(words))
    return frozenset(zip(*(words[i : len(words) - n + 1 + i] for i in range(n)), strict=True)) if n else frozenset()


def alike(a: str, b: str, shingle: int, percent: int) -> bool:
    x, y = shingles(a, shingle), shingles(b, shingle)
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    shared = len(x & y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of pairs (u, v) those whose texts' shingle sets are alike, written."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [alike(x, y, shingle, percent) for x, y in zip(pdf["a"], pdf["b"], strict=True)]
            yield pdf.loc[np.array(keep, dtype=bool), ["u", "v"]]

    a, b = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b"))
    return written(pairs.join(a, "u").join(b, "v").mapInPandas(check, "u long, v long"), "links")


def prefix_pairs(members: DataFrame, texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """members: doc_id and c, of distinct documents. Pairs u < v of different c that a prefix filter does not rule out,
    from the short lists; and the members that stand in a long list, whose pairs with each other may be missing."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [shingle_set(t, shingle) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "c": pdf["c"], "s": [s.tobytes() for s in own]})

    def count(pdf: pd.DataFrame) -> np.ndarray:
        hashes = np.frombuffer(b"".join(pdf["s"]), dtype=np.uint64)
        return np.bincount((hashes % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS).astype(float)

    known = written(texts.join(members.hint("shuffle_hash"), "doc_id").mapInPandas(sets, "doc_id long, c long, s binary"), "sets")
    seen = summed(known.select("s"), count, COUNTERS).astype(np.float32)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, c, raw in zip(pdf["doc_id"], pdf["c"], pdf["s"], strict=True):
                s = np.frombuffer(raw, dtype=np.uint64)
                n = len(s)
                if n:
                    s = s[np.lexsort((s, seen[(s % np.uint64(COUNTERS)).astype(np.int64)]))[: n - -(-percent * n // 100) + 1]]
                    out.append(pd.DataFrame({"h": s.view(np.int64), "doc_id": doc, "c": c, "n": n, "at": np.arange(len(s))}))
            if out:
                yield pd.concat(out)

    rows = written(known.mapInPandas(prefixes, "h long, doc_id long, c long, n long, at long"), "prefixes")
    lists = written(rows.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "lists")
    short = rows.join(lists.where(F.col("m") <= SHORT).select("h"), "h")
    x, y = (short.select("h", F.col("doc_id").alias(d), F.col("c").alias(f"c{d}"), F.col("n").alias(f"n{d}"), F.col("at").alias(f"at{d}")) for d in "uv")
    sizes = (100 * F.col("nu") >= percent * F.col("nv")) & (100 * F.col("nv") >= percent * F.col("nu"))
    most = F.least("atu", "atv") + F.least(F.col("nu") - F.col("atu"), F.col("nv") - F.col("atv"))  # shared shingles
    enough = (100 + percent) * most >= percent * (F.col("nu") + F.col("nv"))
    pairs = x.join(y, (x["h"] == y["h"]) & (F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & sizes & enough)
    out = written(pairs.select("u", "v").distinct(), "pairs")
    dense = written(rows.join(lists.where(F.col("m") > SHORT).select("h"), "h", "left_semi").select("doc_id").distinct(), "dense")
    dropped(known, rows, lists)
    return out, dense


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(signatures(texts, shingle), "signatures")
    named = rows.where("doc_id IS NOT NULL AND n > 0")
    classes = written(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("n").alias("n")), "classes")
    reps = written(named.join(classes.select("h1", "h2", F.col("rep").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"]).select("doc_id", "n", "keys", "sketch"), "reps")
    order = F.element_at(F.array(*[F.lit(x) for x in ORDERS]), (F.col("bucket").bitwiseAND(len(ORDERS) - 1) + 1).cast("int"))
    buckets = reps.select(F.explode("keys").alias("bucket"), "doc_id")
    leaders = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.col("doc_id").bitwiseXOR(order)).alias("m"))
    leaders = leaders.where("n > 1").select("bucket", F.col("m").bitwiseXOR(order).alias("leader"))
    shared = written(buckets.join(leaders, "bucket"), "buckets")  # only buckets of two or more
    a, b = (reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "uv")
    likely = may_link(F.col("nu"), F.col("nv"), F.col("su"), F.col("sv"), percent)
    ordered = shared.where("doc_id <> leader").select(F.least("doc_id", "leader").alias("u"), F.greatest("doc_id", "leader").alias("v")).distinct()
    links = confirm(ordered.join(a, "u").join(b, "v").where(likely).select("u", "v"), texts, shingle, percent)
    found = written(components(links), "components")
    # members of one bucket that are still apart
    at = shared.select("bucket", "doc_id").join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left")
    at = at.select("bucket", "doc_id", F.coalesce("c", "doc_id").alias("c"))
    apart = at.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).where("c0 < c1").select("bucket", "m")
    left = written(at.join(apart, "bucket"), "left")
    crowded = left.where(F.col("m") > FEW).select("doc_id", "c").distinct()
    near = left.where(F.col("m") <= FEW)
    some = bool(crowded.head(1))
    if some:
        listed, dense = prefix_pairs(crowded, texts, shingle, percent)
        near = near.unionByName(left.where(F.col("m") > FEW).join(dense, "doc_id", "left_semi"))
    halves = F.transform("keys", lambda k: F.shiftright(k, 32).cast("int"))
    at = written(near.drop("m").join(reps.select("doc_id", "n", "sketch", halves.alias("keys")), "doc_id"), "apart")
    x, y = (at.select("bucket", *(F.col(name).alias(short + c) for name, short in (("doc_id", ""), ("c", "c"), ("n", "n"), ("sketch", "s"), ("keys", "k")))) for c in "uv")
    first_shared = F.coalesce(*(F.when(F.col("ku")[i] == F.col("kv")[i], F.lit(i)) for i in range(BANDS)))
    cross = (x["bucket"] == y["bucket"]) & (F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & likely & (first_shared == x["bucket"].bitwiseAND(BANDS - 1))
    rest = x.join(y, cross).select("u", "v")
    if some:
        rest = rest.unionByName(listed.join(a, "u").join(b, "v").where(likely).select("u", "v"))
    rest = written(rest.distinct(), "rest")
    if rest.head(1):
        more = confirm(rest, texts, shingle, percent)
        found = written(components(links.union(more)), "components")
    known = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "rows", F.coalesce("component", "rep").alias("component_id"))
    known = written(known, "known")
    dropped(reps, shared, left, at, rest)
    small = rows.select("doc_id", "n", "h1", "h2")
    part = small.where("doc_id IS NOT NULL AND n > 0")
    hot = known.where(F.col("rows") > HOT_SHARE * part.count()).drop("rows")  # at most 1 / HOT_SHARE rows, by counting
    split = part.join(F.broadcast(hot), ["h1", "h2"], "left")
    rest = split.where("component_id IS NULL").drop("component_id").join(known.drop("rows"), ["h1", "h2"], "left")
    alone = small.where("doc_id IS NULL OR n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = split.where("component_id IS NOT NULL").unionByName(rest).select("doc_id", "n", "component_id").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_dedup keeps, all columns as they are."""
    (name,) = unused(docs, "gone")
    gone = near_dedup(docs, shingle, percent, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col(name), "left_anti")


def op6_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), shingle=2)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), f AS (SELECT x, count(*) AS c FROM e GROUP BY x
), r AS (
  SELECT doc_id, n, e.x, row_number() OVER (PARTITION BY doc_id ORDER BY c, e.x) AS k FROM e JOIN f USING (x)
), p AS (SELECT * FROM r WHERE k <= n - (80 * n + 99) // 100 + 1
), c AS (
  SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), l AS (
  SELECT u, v FROM c JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v
  WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))
), b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), t AS (
  SELECT doc_id AS node, doc_id AS reached FROM s
  UNION
  SELECT t.node, b.v FROM t JOIN b ON b.u = t.reached
), m AS (SELECT node, min(reached) AS component_id FROM t GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON m.node = s.doc_id
"""
