"""The tables of the engine: labelled samples, series and points."""

from __future__ import annotations

from pyspark.sql import types as T

#: The columns that name a series; labels themselves can't be compared or joined.
SERIES = ["name", "labels_key"]

SAMPLES = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("labels_key", T.StringType(), False),
        T.StructField("ts", T.DoubleType(), False),  # Unix seconds
        T.StructField("value", T.DoubleType(), False),
        T.StructField("seq", T.LongType(), False),  # order of arrival
    ]
)
POINTS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timestamp", T.DoubleType()),  # null: the time of ingest
        T.StructField("value", T.DoubleType()),
    ]
)
#: What a store's catalogue holds of a series.
CATALOGUE = T.StructType(
    [
        *SAMPLES.fields[:3],
        T.StructField("first_seq", T.LongType(), False),
        T.StructField("samples", T.LongType(), False),
        T.StructField("min_ts", T.DoubleType(), False),
        T.StructField("max_ts", T.DoubleType(), False),
    ]
)
