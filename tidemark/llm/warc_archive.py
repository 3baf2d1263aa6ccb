"""WARC archives of dictionary-compressed records, written and read through Spark's own file sources.

An archive (.warc.zst) is one file of a partition. It starts with a skippable frame (magic 0x184D2A5D) that holds a
Zstandard dictionary, built from the file's own leading records; every record then is a Zstandard frame of its own,
compressed with that dictionary, so a record can be read without its neighbours. The text writer puts the frames into
files: it writes the bytes of each row as they are, commits whole files only (a retried task leaves no half archive), and
reaches any store that Spark can write. Its line separator is an empty skippable frame, which readers pass over.

Payloads that repeat are archived as revisits: of the rows whose payload equals and has at least MIN_REVISIT bytes, those
with the smallest page_id are responses, the others revisit it. Which page a row refers to is found on ids and digests
alone; the payloads themselves are shuffled once, by id and digest into the archives, so copies of one payload spread.
Pairs of an id and a payload that hold over HOT_SHARE of the rows are dealt out by their place instead.

Responses carry an HTTP head before the payload; the payload's digest and length leave it out. Pages have no time of
their own, so all records of a call carry its date (a parameter).

Defined cases: a null html is an empty payload; a null or empty url is archived as about:blank; rows that repeat a
page_id and its payload are all responses (or all revisit the same page); a null page_id loses against any other, and
where all are null they are responses; smaller payloads are all responses. Extra columns are ignored; an empty table
writes no record and gives an empty result. A file ends at a partition's end; FILE_BYTES bounds what a reader holds.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, new_path, table, written

DICT_MAGIC, SKIP_MAGIC, SUFFIX = 0x184D2A5D, 0x184D2A50, ".warc.zst"
#: An empty skippable frame; all of its bytes are ASCII.
SEPARATOR = struct.pack("<II", SKIP_MAGIC, 0).decode("ascii")
MIN_REVISIT, DICT_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES, LEVEL, SLICE = 0, 32 << 10, 400, 4 << 20, 3, 8 << 10
#: Bytes of payload per archive, as planned from the payloads' total.
FILE_BYTES = 32 << 20
#: Groups with more than this share of the rows are joined by broadcast; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record. A revisit has no block; its headers carry the payload's digest and length."""
    kind, digest = "response" if refers_to is None else "revisit", sha1_base32(payload)
    block = b""
    if kind == "response":
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        *(["Content-Type: application/http; msgtype=response"] if kind == "response" else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained from the records; where they are too few for that, their own bytes serve as the dictionary."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, records)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:DICT_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _frames(date: str):
    """The frames of one archive: the dictionary's, then one per record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample: list[bytes] = []
        squeeze = None

        def begin() -> list[bytes]:
            nonlocal squeeze
            d = dictionary(sample)
            squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=d)
            raw = d.as_bytes()
            return [struct.pack("<II", DICT_MAGIC, len(raw)) + raw, *map(squeeze.compress, sample)]

        for pdf in batches:
            out: list[bytes] = []
            for page_id, url, payload, refers_to in zip(pdf["page_id"], pdf["url"], pdf["payload"], pdf["refers_to"], strict=True):
                record = warc_record(None if pd.isna(page_id) else int(page_id), url, bytes(payload), None if pd.isna(refers_to) else int(refers_to), date)
                if squeeze:
                    out.append(squeeze.compress(record))
                    continue
                sample.append(record)
                if len(sample) >= SAMPLE_RECORDS or sum(map(len, sample)) >= SAMPLE_BYTES:
                    out += begin()
            if out:
                yield pd.DataFrame({"frame": out})
        if sample and not squeeze:
            yield pd.DataFrame({"frame": begin()})

    return run


def _references(thin: DataFrame, n_rows: int, min_revisit: int) -> DataFrame:
    """thin: page_id, key (of the payload), n (its bytes). A row per pair of page_id and key: refers_to (null for a
    response) and copies (rows of the pair)."""
    pairs = thin.groupBy("page_id", "key").agg(F.count("*").alias("copies"), F.min("n").alias("n"))
    first = thin.where(F.col("n") >= min_revisit).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    first = written(first.where("rows > 1"), "first")  # only they can be revisited
    split = pairs.join(F.broadcast(first.where(F.col("rows") > HOT_SHARE * n_rows)), "key", "left")
    rest = split.where("rows IS NULL").drop("first", "rows").join(first.where(F.col("rows") <= HOT_SHARE * n_rows), "key", "left")
    both = split.where("rows IS NOT NULL").unionByName(rest)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    out = written(both.select("page_id", "key", refers, "copies"), "references")
    dropped(first)
    return out


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT, date: str | None = None) -> None:
    """Archives every row of pages under path. date: of all records, as YYYY-MM-DDThh:mm:ssZ; by default, the call's."""
    spark, date = pages.sparkSession, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    thin = written(rows.select("page_id", "key", F.octet_length("payload").alias("n")), "payloads")
    total, n_rows = thin.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    found = _references(thin, n_rows, min_revisit)
    # ids go to the tasks as strings: pandas makes floats of longs where there are nulls
    pair = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"), "key")
    found = found.select(pair.alias("pair"), F.col("refers_to").cast("string").alias("refers_to"), "copies")
    often = found.where(F.col("copies") > HOT_SHARE * n_rows).select("pair", F.col("refers_to").alias("hot_refers"), F.lit(True).alias("hot"))
    seldom = found.where((F.col("copies") <= HOT_SHARE * n_rows) & F.col("refers_to").isNotNull()).select("pair", "refers_to")
    place = F.concat("pair", F.monotonically_increasing_id().cast("string").cast("binary"))
    rows = rows.withColumn("pair", pair).join(F.broadcast(often), "pair", "left").withColumn("pair", F.when(F.col("hot"), place).otherwise(F.col("pair")))
    files = int(max(1, -(-total // FILE_BYTES), 2 * spark.sparkContext.defaultParallelism if total > 8 * FILE_BYTES else 1))
    out = rows.repartition(files, "pair").join(seldom.repartition(files, "pair").hint("shuffle_hash"), "pair", "left")
    out = out.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.coalesce("hot_refers", "refers_to").alias("refers_to"))
    frames = out.mapInPandas(_frames(date), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", SEPARATOR).text(path)
    dropped(thin)
    _name_archives(spark, path)


def _name_archives(spark: SparkSession, path: str) -> None:
    """Gives the committed files of path the name of archives."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(at):
        old = status.getPath()
        if old.getName().endswith(".txt"):
            files.rename(old, spark._jvm.org.apache.hadoop.fs.Path(at, old.getName()[:-4] + SUFFIX))


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a WARC record: {version!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and the block of each record of an archive's bytes."""
    at, unpack, view = 0, None, memoryview(archive)
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if len(view) - at >= 8 else (0, 0)
        if magic == DICT_MAGIC and at == 0:
            raw = bytes(view[8 : 8 + size])
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
        elif magic & 0xFFFFFFF0 == SKIP_MAGIC:
            at += 8 + size
        else:
            one, out = unpack.decompressobj(), []
            while not one.eof:  # by slices, as what follows a frame is copied
                part = view[at : at + SLICE]
                if not len(part):
                    raise ValueError("an archive ends within a frame")
                out.append(one.decompress(part))
                at += len(part)
            at -= len(one.unused_data)
            yield parse_record(b"".join(out))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        number = lambda x: None if x is None else int(x)
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for f, block in records(content):
                    response = f["WARC-Type"] == "response"
                    block = block.partition(b"\r\n\r\n")[2]
                    digest = sha1_base32(block) if response else f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if digest != f["WARC-Payload-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"a payload differs from its digest: {f}")
                    rows.append((number(f.get("X-Page-ID")), f["WARC-Target-URI"], len(block) if response else int(f["X-Payload-Length"]), digest, f["WARC-Type"], number(f.get("X-Refers-To-Page-ID")), block if response else None))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=names, dtype=object).astype({"payload_bytes": "int64", "page_id": "Int64", "refers_to": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=names, dtype=object).astype({"payload_bytes": "int64", "page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path).select("content").mapInPandas(run, schema)


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).drop("payload", "url")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id,
         array_to_string(list_transform(range(1, 41), lambda i:
           substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(h, i, 1)) - 3, 4)), '') AS bits
  FROM p
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
           + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""
