"""Downsampling of a stream gives the closed buckets of the same batch."""

import pytest

from tidemark.errors import BadRequest
from tidemark.operators.aggregate import downsample
from tidemark.streaming.downsample import downsample_stream

from test_operators import make


def test_stream_matches_batch(spark, tmp_path):
    samples = make(spark, "0:1 30:2 61:3 119:4 200:5 100000:6")
    samples.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(samples.schema).parquet(f"{tmp_path}/in")
    query = downsample_stream(stream, 60, "last", "1 second").writeStream.format("memory").queryName("closed").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.table("closed").select("ts", "value").collect()))
    want = sorted(map(tuple, downsample(samples, 60, "last").where("ts < 90000").select("ts", "value").collect()))
    assert got == want and len(got) == 3
    with pytest.raises(BadRequest):
        downsample_stream(stream, 0)
