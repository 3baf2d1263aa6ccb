"""Exact de-duplication against a persistent digest index, with DataFrame operations only.

The index is a table bucketed and sorted by digest. New rows are hashed, grouped by digest (partial aggregation, so a
digest with a third of all rows is summed before it is shuffled), and sort-merge anti-joined with the index; groups that
it lacks are appended, the others are given what it holds. Reading the index for a join on its digest needs no exchange on
its side. The order within its files keeps digests of a row group close together; a merge join still sorts a bucket, since
each batch appends a file to it.

exact_dedup() judges one batch against an index. exact_dedup_batches() adds several, and says of all their rows what the
index holds in the end; the query does so with two halves of the table, the one of larger ids first, as what is in the
index stays. An index made for one call is dropped at its end, once the result has been written.

Defined cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z only; of equal new
texts the row with the largest id stays (null ids lose; if all are null, keep_id is null and all are kept); rows that
repeat the keeper's id and text are the same document and are all marked kept; if the index already holds the digest,
its keep_id stays and every new row is dropped; extra columns of the input are ignored, so clashing names don't matter;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, dropped, new_path, quoted, table, unused, written
from tidemark.sources.folders import delete_folder

#: Groups with more than this share of the rows are joined by broadcast; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the SHA-256 (binary) of each normalised text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col).alias("digest"))


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """digest, keep_id, group_size; bucketed and sorted by digest, appended to batch by batch."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            self._write(spark.createDataFrame([], "digest binary, keep_id long, group_size long"), path or new_path(spark, "index"))

    def _write(self, rows: DataFrame, path: str | None = None) -> None:
        writer = rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append")
        (writer.option("path", path) if path else writer).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Takes the table out of the catalogue and deletes its files."""
        at = self.spark.sql(f"DESCRIBE EXTENDED {self.name}").where("col_name = 'Location'").head()["data_type"]
        self.spark.sql(f"DROP TABLE {self.name}")
        delete_folder(self.spark, at)

    def add(self, hashed: DataFrame) -> DataFrame:
        """Appends the digests that are new; returns one row per digest of hashed: digest, keep_id, group_size (of this
        batch, with what the index holds), rows (of this batch), seen (before)."""
        groups = written(hashed.groupBy("digest").agg(F.max("doc_id").alias("new_id"), F.count("*").alias("rows")), "groups")
        known = self.read().hint("merge")
        fresh = groups.join(known, "digest", "left_anti").select("digest", F.col("new_id").alias("keep_id"), F.col("rows").alias("group_size"), "rows", F.lit(False).alias("seen"))
        again = groups.join(known, "digest").select("digest", "keep_id", (F.col("rows") + F.col("group_size")).alias("group_size"), "rows", F.lit(True).alias("seen"))
        fresh, again = written(fresh, "fresh"), written(again, "again")  # before the append, which changes what known reads
        dropped(groups)
        self._write(fresh.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest"))
        return fresh.unionByName(again)


def _told(hashed: DataFrame, verdicts: DataFrame, n_rows: int) -> DataFrame:
    """hashed with what verdicts (a row per digest, rows of it among hashed) say."""
    hot = verdicts.where(F.col("rows") > HOT_SHARE * n_rows)  # at most 1 / HOT_SHARE rows, by counting
    split = hashed.join(F.broadcast(hot), "digest", "left")
    rest = split.where(F.col("rows").isNull()).select("doc_id", "digest").join(verdicts, "digest", "left")
    return split.where(F.col("rows").isNotNull()).unionByName(rest).select(
        "doc_id",
        "keep_id",
        "group_size",
        (~F.col("seen") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Adds the batch to the index."""
    own = index or DigestIndex(docs.sparkSession)
    hashed = written(digests(docs, id_col, text_col), "digests")
    out = _told(hashed, own.add(hashed), hashed.count())
    if index is None:
        out = written(out, "exact")
        own.drop()
        dropped(hashed)
    return out


def exact_dedup_batches(batches: list[DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same of all batches' rows together, where of equal texts one of the earliest batch stays: a new index takes
    them one after the other, and what it then holds of a digest is what its rows are told."""
    spark = batches[0].sparkSession
    index, hashed, seen = DigestIndex(spark), [], []
    for batch in batches:
        hashed.append(written(digests(batch, id_col, text_col), "digests"))
        seen.append(index.add(hashed[-1]).select("digest", "rows"))
    rows, counts = (functools.reduce(DataFrame.unionByName, x) for x in (hashed, seen))
    counts = counts.groupBy("digest").agg(F.sum("rows").alias("rows"))
    verdicts = written(index.read().select("digest", "keep_id").join(counts, "digest").select("digest", "keep_id", F.col("rows").alias("group_size"), "rows", F.lit(False).alias("seen")), "verdicts")
    out = written(_told(rows, verdicts, rows.count()), "exact")
    index.drop()
    dropped(*hashed, verdicts)
    return out


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, all columns as they are; of rows that repeat an id and text, one."""
    row_id, row_digest, kept_id, kept_digest, copies = unused(docs, "row_id", "row_digest", "kept_id", "kept_digest", "copies")
    kept = exact_dedup(docs, None, id_col, text_col).where("kept").select(F.col("doc_id").alias(kept_id), F.unhex("text_sha256").alias(kept_digest))
    kept = written(kept.groupBy(kept_id, kept_digest).agg(F.count("*").alias(copies)), "kept")
    rows = docs.select("*", F.col(id_col).cast("long").alias(row_id), _digest(text_col).alias(row_digest))
    key = F.col(row_id).eqNullSafe(F.col(kept_id)) & (F.col(row_digest) == F.col(kept_digest))
    own = [F.col(quoted(c)) for c in docs.columns]
    out = rows.join(kept.where(F.col(copies) == 1), key, "left_semi").select(*own)
    again = kept.where(F.col(copies) > 1)
    if again.head(1):
        out = out.union(rows.join(again, key, "left_semi").dropDuplicates([row_id, row_digest]).select(*own))
    return out


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).head()
    later = F.coalesce(F.col("doc_id") <= ((least or 0) + (most or 0)) // 2, F.lit(True))
    return exact_dedup_batches([docs.where(~later), docs.where(later)])


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
