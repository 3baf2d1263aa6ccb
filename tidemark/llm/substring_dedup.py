"""Removal of word passages that occur more than once in the corpus, by compressed FM-indexes over shards.

A window is `window` consecutive words of one document; each word that a repeated window covers goes. Windows are routed
by content: the least hash of the word 8-grams in a window is the same wherever the window stands, so all occurrences of
a window meet in one shard. Consecutive windows of the same least hash make a segment.

  1. One pass over the texts counts the least hashes (one row per segment, summed before the shuffle). A hash that occurs
     once in the whole corpus has no repeated window.
  2. A second pass cuts out the segments of the others. Equal segments become one, with the number of their occurrences
     as its weight, again summed before the shuffle.
  3. Each shard builds an FM-index of its segments, and all of them are streamed against it: backward search over the
     wavelet matrix gives matching statistics, of which the intervals of `window` words or more that occur twice (by
     weight) are reported. A shard has about SHARD_WORDS words.
  4. The intervals go back to the documents, whose remaining words are joined.

A hash with more than HOT different segments (say, the end of a passage that a third of all documents quote, each followed
by text of its own) would fill one shard; its segments are split into windows, those whose own hash occurs once are passed
over as in the first step, and the others are dealt to shards by it, where the index decides as it does for segments.

Defined cases: words are [^\\x20\\x09-\\x0D]+, unchanged; a null text has none; texts of fewer words than a window lose
none; rows that repeat an id and text are occurrences of their own (so they lose all their windows); ids may be null; extra
columns are ignored; an empty table gives an empty result. Hashes only route: within a shard words are compared by their
bytes, and so are segments when they are counted. Windows may overlap within a document and count as occurrences there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, mix64, table, word_bounds, word_hashes, written
from tidemark.llm.fm_index import FmIndex

WINDOW, GRAM, SHARD_WORDS, HOT, CHUNK = 35, 8, 300_000, 5_000, 1 << 19


class Segments:
    """The segments of a chunk of texts, document by document: doc (index of the text), h (least hash), first and last
    (word numbers, within the document, at which its first and last window start), twice (whether the hash stands at
    several places in it); and the bytes of any segment, its words joined by single spaces."""

    def __init__(self, texts: list[str], window: int):
        docs = [b" ".join(t.encode("utf-8", "surrogatepass").split()) for t in texts]
        self.bytes = b" ".join(docs) + b" "
        data = np.frombuffer(self.bytes, dtype=np.uint8)
        self.starts, self.ends = word_bounds(data)
        words = word_hashes(data, self.starts, self.ends)
        of_word = np.searchsorted(np.cumsum([len(d) + 1 for d in docs]), self.starts, side="right")
        self.begin = np.searchsorted(of_word, np.arange(len(docs)))  # each document's first word
        gram, n = min(GRAM, window), len(words) - window + 1
        if n < 1:
            self.doc = self.first = self.last = np.zeros(0, dtype=np.int64)
            self.h, self.twice = self.doc, self.doc > 0
            return
        grams = words
        for i in range(1, gram):
            grams = mix64(grams[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[i:])
        span = window - gram + 1  # grams in a window
        least, width = grams, 1
        while 2 * width <= span:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < span:
            least = np.minimum(least[: len(grams) - span + 1], least[span - width : len(grams) - width + 1])
        whole = of_word[:n] == of_word[window - 1 :]  # windows that lie within one document
        new = np.r_[True, (least[1:] != least[:-1]) | (of_word[1:n] != of_word[: n - 1])]
        first = np.flatnonzero(whole & new)
        ends = np.flatnonzero(whole & np.r_[new[1:] | ~whole[1:], True])
        around = np.arange(span)
        left = first + grams[first[:, None] + around].argmin(axis=1)
        right = ends + span - 1 - grams[ends[:, None] + around[::-1]].argmin(axis=1)
        self.doc, self.h, self.twice = of_word[first], least[first].view(np.int64), left != right
        self.first, self.last = first - self.begin[self.doc], ends - self.begin[self.doc]
        self.window = window

    def text(self, i: int) -> bytes:
        at = self.begin[self.doc[i]]
        return self.bytes[self.starts[at + self.first[i]] : self.ends[at + self.last[i] + self.window - 1]]


def chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """pdf in pieces of about CHUNK characters of text."""
    piece = (np.cumsum([len(t) for t in pdf["text"]]) - 1) // CHUNK
    for _, own in pdf.groupby(piece, sort=False):
        yield own


def repeated_in_shard(texts: list[bytes], weights: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """For each segment the intervals of words that repeated windows cover. Symbols stand for words by their bytes."""
    symbol: dict[bytes, int] = {}
    parts = [np.array([symbol.setdefault(w, len(symbol) + 1) for w in t.split()], dtype=np.int64) for t in texts]
    return FmIndex(parts, weights).repeated(parts, window)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and (with keep_text) kept_text."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a row's name: rows of the same id and text share it, and are treated alike
    texts = texts.withColumns({"k": F.xxhash64("doc_id", "text"), "d": F.coalesce("doc_id", F.lit(0))})

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own in chunks(pdf):
                found = Segments(own["text"].tolist(), window)
                yield pd.DataFrame({"k": own["k"].to_numpy()[found.doc], "h": found.h, "c": found.twice + np.int32(1)})

    anchors = written(texts.select("k", "text").mapInPandas(least, "k long, h long, c int"), "anchors")
    shared = anchors.groupBy("h").agg(F.sum("c").alias("n")).where("n > 1").select("h")
    of_doc = anchors.select("k", "h").join(shared, "h", "left_semi").groupBy("k").agg(F.collect_set("h").alias("hs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = lambda h, doc: mix64(h.view(np.uint64) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for pdf in batches:
            for own in chunks(pdf):
                found = Segments(own["text"].tolist(), window)
                hs = own["hs"].tolist()
                wanted = tag(np.concatenate([np.asarray(h, dtype=np.int64) for h in hs]), np.repeat(np.arange(len(hs)), [len(h) for h in hs]))
                pick = np.flatnonzero(np.isin(tag(found.h, found.doc), wanted))
                yield pd.DataFrame({"k": own["k"].to_numpy()[found.doc[pick]], "d": own["d"].to_numpy()[found.doc[pick]], "start": found.first[pick].astype(np.int32), "h": found.h[pick], "seg": [found.text(i) for i in pick.tolist()]})

    found = texts.select("k", "d", "text").join(of_doc.hint("shuffle_hash"), "k").mapInPandas(cut, "k long, d long, start int, h long, seg binary")
    keyed = found.select("k", "d", "start", "h", "seg", F.xxhash64("seg").alias("s1"), F.xxhash64(F.lit(1), "seg").alias("s2"))
    keyed = written(keyed, "segments")
    dropped(anchors)
    distinct = written(keyed.groupBy("h", "seg").agg(F.count("*").alias("weight"), F.first("s1").alias("s1"), F.first("s2").alias("s2")), "distinct")
    hot = distinct.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h")
    few = distinct.join(hot, "h", "left_anti").select("h", "seg", "weight", "s1", "s2")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for seg, weight, s1, s2 in zip(pdf["seg"], pdf["weight"], pdf["s1"], pdf["s2"], strict=True):
                words, at = bytes(seg).split(), {}
                for i in range(len(words) - window + 1):
                    at.setdefault(b" ".join(words[i : i + window]), []).append(i)
                out += [(w, weight * len(x), s1, s2, x) for w, x in at.items()]
            yield pd.DataFrame(out, columns=["seg", "weight", "s1", "s2", "at"])

    split = distinct.join(hot, "h", "left_semi").mapInPandas(windows, "seg binary, weight long, s1 long, s2 long, at array<int>")
    split = split.select("weight", "s1", "s2", "at", F.xxhash64("seg").alias("w1"), F.xxhash64(F.lit(1), "seg").alias("w2"), "seg")
    split = written(split, "windows")
    again = split.groupBy("w1").agg(F.sum("weight").alias("n")).where("n > 1").select("w1")
    many = split.join(again, "w1", "left_semi").groupBy("seg").agg(F.sum("weight").alias("weight"), F.first("w1").alias("s1"), F.first("w2").alias("s2"))
    pieces = written(few.select("h", "seg", "weight", "s1", "s2").unionByName(many.select(F.col("s1").alias("h"), "seg", "weight", "s1", "s2")), "pieces")
    words = pieces.agg(F.sum(F.octet_length("seg"))).head()[0] or 0
    shards = max(1, -(-words // (6 * SHARD_WORDS)))  # about six bytes a word

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = repeated_in_shard([bytes(s) for s in pdf["seg"]], pdf["weight"].to_numpy(), window)
        rows = [(s1, s2, a, b) for s1, s2, own in zip(pdf["s1"], pdf["s2"], found, strict=True) for a, b in own]
        return pd.DataFrame(rows, columns=["s1", "s2", "a", "b"])

    sharded = pieces.select("seg", "weight", "s1", "s2", F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"))
    hits = written(sharded.groupBy("shard").applyInPandas(search, "s1 long, s2 long, a int, b int"), "hits")
    dropped(distinct, pieces)
    # a window's hit is one of the segments that it was split from
    of_windows = split.select("s1", "s2", "at", "w1", "w2").join(hits.select(F.col("s1").alias("w1"), F.col("s2").alias("w2")), ["w1", "w2"], "left_semi")
    of_windows = of_windows.select("s1", "s2", F.explode("at").alias("a")).withColumn("b", F.col("a") + window)
    spans = keyed.select("k", "d", "start", "s1", "s2").join(hits.unionByName(of_windows), ["s1", "s2"])
    spans = spans.groupBy("k", "d").agg(F.collect_set(F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))).alias("spans"))
    spans = spans.select("k", "d", F.col("spans.a").alias("a"), F.col("spans.b").alias("b"))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, a, b in zip(pdf["text"], pdf["a"], pdf["b"], strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                n = len(words)
                if a is not None:
                    gone = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(gone, a, 1)
                    np.add.at(gone, b, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if keep_text else None))
            got = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
            got.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield got if keep_text else got.drop(columns="kept_text")

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return texts.join(spans.hint("shuffle_hash"), ["k", "d"], "left").select("doc_id", "text", "a", "b").mapInPandas(rest, schema)


def op4_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), keep_text=False)


ORACLE = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), t AS (
  SELECT k, j, w[j] AS word, CASE WHEN j + 34 <= len(w) THEN sha256(array_to_string(w[j:j + 34], ' ')) END AS h
  FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS j FROM d)
), r AS (
  SELECT k, j, word, CASE WHEN h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 THEN 1 ELSE 0 END AS again FROM t
), c AS (
  SELECT k, j, word, max(again) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM r
), a AS (
  SELECT k, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY k
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (k)
"""
