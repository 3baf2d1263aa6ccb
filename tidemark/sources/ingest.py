"""Validated points, and the store of batches that they are appended to."""

from __future__ import annotations

import re
import time
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import BadRequest, Conflict
from tidemark.functions.labels import labels_key
from tidemark.schema import CATALOGUE, POINTS, SAMPLES, SERIES

#: A character that is neither white space nor one of the four separators U+001C-U+001F.
SOLID = r"(?U)[^\s\x1c-\x1f]"
CLAIM_TRIES, CLAIM_WAIT_S = 100, 0.1


def valid() -> Column:
    """A name that isn't blank (kept as it is), a value, no null label, and a finite time (or none)."""
    labels = F.coalesce(F.forall(F.map_values("labels"), lambda v: v.isNotNull()), F.lit(True))
    ts = F.col("timestamp")
    finite = ts.isNull() | ~(F.isnan(ts) | (F.abs(ts) == float("inf")))
    return F.coalesce(F.col("name").rlike(SOLID), F.lit(False)) & F.col("value").isNotNull() & labels & finite


def normalise(points: DataFrame, now: float, seq: Column) -> DataFrame:
    """Valid points as samples; those without a time get now, the same for all."""
    labels = F.coalesce("labels", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rows = points.select("name", labels.alias("labels"), F.coalesce("timestamp", F.lit(float(now))).alias("ts"), "value", seq.cast("long").alias("seq"))
    return rows.withColumn("labels_key", labels_key(F.col("labels"))).select(*SAMPLES.names)


def _point(point: dict) -> tuple:
    """A point of a list, its numbers read as they are, from strings or from booleans."""
    name, labels = point.get("name"), point.get("labels", {})
    if not isinstance(name, str) or not isinstance(labels, dict) or not all(isinstance(x, str) for kv in labels.items() for x in kv):
        raise BadRequest(f"a point needs a name and labels of strings: {point!r}")
    try:
        ts = point.get("timestamp")
        return name, labels, None if ts is None else float(ts), float(point["value"])
    except (KeyError, TypeError, ValueError):
        raise BadRequest(f"a point needs a value, and numbers for its value and time: {point!r}") from None


class SampleStore:
    """Batches of samples in Parquet, with a log of their arrival numbers and a catalogue of their series.

    data/batch=N/name=.../   the samples of batch N, sorted by series and time
    series/batch=N/          a row per series of the batch: first arrival number, number of samples, least and largest time
    log/N.claim              made first, if it doesn't exist: the arrival numbers that batch N takes
    log/N.done               made last: from then on readers see batch N, whole

    Two writers never take the same numbers, as only one of them can make a claim; the other one takes the next. A batch
    whose writer fails stays unseen, and its numbers unused. What the log decides costs a listing of it, whatever the
    number of samples; where the file system can't create a file exclusively, there may be one writer at a time only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _log(self, kind: str) -> list[int]:
        """The numbers of the batches that are claimed or done, increasing."""
        files = self._files()
        if not files.exists(self._path("log")):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._path("log"))]
        return sorted(int(n.split(".")[0]) for n in names if re.fullmatch(rf"\d+\.{kind}", n))

    def _put(self, name: str, text: str) -> bool:
        """Makes a file, unless there is one."""
        try:
            out = self._files().create(self._path(name), False)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                return False
            raise
        out.writeBytes(text)
        out.close()
        return True

    def _claimed(self, number: int) -> int:
        """The first arrival number after those of a claimed batch."""
        jvm = self.spark._jvm
        for _ in range(CLAIM_TRIES):
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(self._files().open(self._path(f"log/{number}.claim"))))
            line = reader.readLine()
            reader.close()
            if line:
                return int(line.split()[1])
            time.sleep(CLAIM_WAIT_S)  # another writer has made the file and is about to fill it
        raise Conflict(f"the claim of batch {number} in {self.path} is empty: its writer stopped")

    def next_seq(self) -> int:
        """The first arrival number that no batch has taken."""
        taken = self._log("claim")
        return self._claimed(taken[-1]) if taken else 0

    def _claim(self, n: int) -> tuple[int, int]:
        """The number of a new batch, and the first of n arrival numbers that are its own."""
        for _ in range(CLAIM_TRIES):
            taken = self._log("claim")
            number, first = (taken[-1] + 1, self._claimed(taken[-1])) if taken else (0, 0)
            if self._put(f"log/{number}.claim", f"{first} {first + n}\n"):
                return number, first
        raise Conflict(f"too many writers claim batches of {self.path}")

    def _batches(self, kind: str, schema: T.StructType) -> DataFrame:
        done = self._log("done")
        if not done:
            return self.spark.createDataFrame([], schema)
        at = f"{self.path}/{kind}"
        reader = self.spark.read.schema(schema.add("batch", T.LongType()) if "batch" not in schema.names else schema)
        return reader.option("basePath", at).parquet(*(f"{at}/batch={n}" for n in done)).drop("batch")

    def read(self) -> DataFrame:
        """The samples of all batches that are done at the time of the call."""
        return self._batches("data", T.StructType(list(SAMPLES.fields)))

    def series(self) -> DataFrame:
        """A row per series, from the catalogue: name, labels, labels_key, first_seq, samples, min_ts, max_ts."""
        rows = self._batches("series", T.StructType(list(CATALOGUE.fields))).groupBy(*SERIES)
        return rows.agg(F.first("labels").alias("labels"), F.min("first_seq").alias("first_seq"), F.sum("samples").alias("samples"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts")).select(*CATALOGUE.names)

    def _write(self, number: int, samples: DataFrame) -> None:
        """Files sorted by series and time, so that row groups can be passed over by their statistics."""
        at = f"{self.path}/data/batch={number}"
        spread = samples.repartitionByRange("name", "labels_key", "ts").sortWithinPartitions("name", "labels_key", "ts")
        spread.write.partitionBy("name").parquet(at)
        own = self.spark.read.schema(SAMPLES).parquet(at).groupBy(*SERIES)
        own = own.agg(F.first("labels").alias("labels"), F.min("seq").alias("first_seq"), F.count("*").alias("samples"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
        own.select(*CATALOGUE.names).write.parquet(f"{self.path}/series/batch={number}")
        self._put(f"log/{number}.done", "")

    def ingest_batch(self, points: DataFrame | Iterable[dict], arrival: str | None = None, now: float | None = None) -> int:
        """Appends all points, or raises BadRequest and appends none; returns how many.

        A list of points arrives in its order. A DataFrame has no order: arrival names a column of it that has, with
        distinct whole numbers from 0 on."""
        now = time.time() if now is None else now
        if not isinstance(points, DataFrame):
            rows = [(*_point(p), i) for i, p in enumerate(points)]
            points, arrival = self.spark.createDataFrame(rows, T.StructType([*POINTS.fields, T.StructField("_i", T.LongType())])), "_i"
        elif arrival is None:
            raise BadRequest("a DataFrame of points needs a column of their arrival")
        at = F.col(arrival)
        total, bad, least, most = points.agg(F.count("*"), F.count_if(~valid() | at.isNull()), F.min(at), F.max(at)).head()
        if bad:
            raise BadRequest(f"{bad} of {total} points have a blank name, no value, a null label, no arrival or a time that isn't finite")
        if total:
            if least < 0:
                raise BadRequest(f"arrival numbers start at 0, not at {least}")
            number, first = self._claim(int(most) + 1)
            self._write(number, normalise(points, now, F.lit(first) + at))
        return total

    def ingest(self, name: str, value: float, labels: dict[str, str] | None = None, timestamp: float | None = None) -> int:
        return self.ingest_batch([{"name": name, "labels": labels or {}, "timestamp": timestamp, "value": value}])
