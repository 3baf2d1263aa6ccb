"""What the operators of this subpackage share: tables written in the shared folder, names, and byte-level word tools."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.folders import delete_folder, new_folder

#: The separators of words: space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES, SUM_TASKS = 16 << 20, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the folder that all executors share (spark.checkpoint.dir)."""
    bound_batches(spark)
    return new_folder(spark, label)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidemark_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        delete_folder(df.sparkSession, df.tidemark_path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the bytes of an Arrow batch to BATCH_BYTES for the session (a lower setting stays): texts can be long, and a
    worker holds a batch several times."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(BATCH_BYTES + 1)).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; where all characters are single bytes, lower() does just that, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in UTF-8 bytes."""
    solid = np.empty(len(data) + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    np.logical_not(IS_SPACE[data], out=solid[1:-1].view(bool))
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Keeps the low bytes, 0 to 8 of them, of a 64-bit word.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: equal words get equal hashes wherever they stand. Eight bytes at a time go through a
    mixing step; words of over LONG_WORD bytes get a BLAKE2 digest."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    length = ends - starts
    out = mix64(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at, who = 0, np.flatnonzero(length <= LONG_WORD)
    while len(who):
        chunk = eight[starts[who] + at] & _LOW[np.minimum(length[who] - at, 8)]
        out[who] = mix64((out[who] + np.uint64(0xD6E8FEB86659FD93)) ^ chunk)
        at += 8
        who = who[length[who] > at]
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def summed(rows: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of part, an array of the given size: one array per task, added up by SUM_TASKS tasks, whose
    sums reach the driver."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += part(pdf)
        yield pd.DataFrame({"v": [total.tobytes()]})

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for pdf in batches:
            for v in pdf["v"]:
                total += np.frombuffer(v)
        yield pd.DataFrame({"v": [total.tobytes()]})

    sums = rows.mapInPandas(own, "v binary").repartition(SUM_TASKS).mapInPandas(both, "v binary").collect()
    return np.sum([np.frombuffer(r["v"]) for r in sums], axis=0)
