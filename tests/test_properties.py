"""What holds for any input: the glob translation, and downsampling by arrival against a walk with a cursor."""

import fnmatch
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions.labels import glob_regex, labels_column, labels_key, labels_literal
from tidemark.operators.aggregate import downsample

from test_operators import make

CHARS = "ab-]![*?\n.^\\ZéÄ9"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(CHARS, max_size=7), min_size=20, max_size=40), st.lists(st.text(CHARS, max_size=5), min_size=10, max_size=30))
def test_glob(spark, patterns, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", *[F.col("v").rlike(glob_regex(p)).alias(str(i)) for i, p in enumerate(patterns)]).collect()
    for row in got:
        for i, p in enumerate(patterns):
            assert row[str(i)] == fnmatch.fnmatchcase(row["v"], p), (p, row["v"])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.text("aZ\"\\\n\t\x01\x1f\x7f/é漢🙂", max_size=4), st.text("b\"\\\r\x0b\x1c ß", max_size=4), max_size=4), min_size=1, max_size=8))
def test_label_literals(spark, sets):
    row = spark.range(1).select(*[labels_key(labels_column(s)).alias(str(i)) for i, s in enumerate(sets)]).head()
    assert [row[str(i)] for i in range(len(sets))] == [labels_literal(s) for s in sets]


def walk(samples, step):
    out, start, bucket = [], math.floor(samples[0][0] / step) * step, []
    for ts, value in samples:
        while ts >= start + step:
            if bucket:
                out.append((start, sum(bucket)))
            bucket, start = [], start + step
        bucket.append(value)
    return dict([*out, (start, sum(bucket))])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(0, 9)), min_size=1, max_size=30), st.sampled_from([0.25, 1, 5, 60]))
def test_arrival_order(spark, samples, step):
    df = make(spark, " ".join(f"{t}:{v}" for t, v in samples))
    assert {r["ts"]: r["value"] for r in downsample(df, step, "sum", "arrival").collect()} == walk(samples, step)
    in_order = sorted(samples, key=lambda x: x[0])
    df = make(spark, " ".join(f"{t}:{v}" for t, v in in_order))
    by_time, by_arrival = (sorted(map(tuple, downsample(df, step, "last", o).select("ts", "value").collect())) for o in ("time", "arrival"))
    assert by_time == by_arrival
    assert sum(r["value"] for r in downsample(df, step, "count").collect()) == len(samples)
