"""Ids that a float doesn't hold, valid heads, hot pairs, and a reader that takes time in proportion."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc_archive
from tidemark.llm.common import new_path


def test_large_ids_stay_exact(spark):
    big = 2**53 + 1
    html = "<p>" + "x" * 300 + "</p>"
    rows = [(big, "u", html), (big + 2, "u", html), (2**62 + 3, "v", html), (None, "u", html), (-big, "w", "<b>")]
    path = new_path(spark, "test")
    warc_archive.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {(r["page_id"], r["refers_to"]) for r in warc_archive.read_warc(spark, path).collect()}
    assert got == {(big, None), (big + 2, big), (2**62 + 3, big), (None, big), (-big, None)}


def test_heads_are_valid(spark):
    rows = [(1, "http://a/b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u\r\nX: y", "é")]
    path = new_path(spark, "test")
    warc_archive.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path, date="2024-05-06T07:08:09Z")
    names = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    assert names and all(n.endswith(".warc.zst") for n in names)
    seen, ids = {}, {}
    for (content,) in spark.read.format("binaryFile").load(path).select("content").collect():
        for fields, block in warc_archive.records(bytes(content)):
            assert fields["WARC-Date"] == "2024-05-06T07:08:09Z" and fields["WARC-Target-URI"]
            assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"])
            assert len(block) == int(fields["Content-Length"])
            seen[int(fields["X-Page-ID"])], ids[int(fields["X-Page-ID"])] = (fields, block), fields["WARC-Record-ID"]
    fields, block = seen[1]
    assert fields["Content-Type"] == "application/http; msgtype=response"
    head, _, body = block.partition(b"\r\n\r\n")
    assert head.startswith(b"HTTP/1.1 200 OK\r\n") and body == b"<p>x</p>"
    assert seen[2][0]["WARC-Refers-To"] == ids[1] and seen[2][1] == b"" and "WARC-Profile" in seen[2][0]
    assert seen[3][1].endswith("é".encode()) and "X" not in seen[3][0]


def archive(n):
    import struct

    import zstandard

    d = zstandard.ZstdCompressionDict(b"WARC/1.1 response text/html" * 20, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze, raw = zstandard.ZstdCompressor(dict_data=d), d.as_bytes()
    frames = [squeeze.compress(warc_archive.warc_record(i, "u", b"page %d " % i * 60, None, "2024-01-01T00:00:00Z")) for i in range(n)]
    return struct.pack("<II", warc_archive.DICT_MAGIC, len(raw)) + raw + warc_archive.SEPARATOR.encode().join(frames)


def test_reading_takes_time_in_proportion():
    def seconds(data, n):
        began = time.perf_counter()
        assert sum(1 for _ in warc_archive.records(data)) == n
        return time.perf_counter() - began

    few, many = archive(5_000), archive(20_000)
    seconds(few, 5_000)
    assert min(seconds(many, 20_000) for _ in range(2)) < 4 * 2 * max(seconds(few, 5_000), 0.05)
    with pytest.raises(ValueError, match="within a frame"):
        list(warc_archive.records(few[:-5]))


def test_a_pair_and_a_payload_of_most_rows(spark):
    """Hot pairs of id and payload, and a hot payload, are dealt out; all rows are archived, with the right reference."""
    html = F.when(F.col("id") % 3 == 0, F.lit("<b>hot</b>")).when(F.col("id") % 3 == 1, F.lit("<i>one page</i>")).otherwise(F.concat(F.lit("own "), F.col("id").cast("string")))
    page = F.when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id") + 100)
    pages = spark.range(0, 6000, 1, 4).select(page.alias("page_id"), F.lit("u").alias("url"), html.alias("html"), F.lit("x").alias("key"), F.lit(1).alias("pair"))
    path = new_path(spark, "test")
    warc_archive.write_warc(pages, path)
    got = warc_archive.read_warc(spark, path).groupBy("record_type", "refers_to").count().collect()
    assert {(r[0], r[1], r[2]) for r in got} == {("response", None, 4001), ("revisit", 100, 1999)}
