"""Helpers shared by the training-data operators: durable tables and word codes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only in a local run, as in tests, a temporary folder is made and set where none is named; on a cluster such a folder
    would be one machine's, so its lack is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    ``group`` bounds a row group's rows: those with long arrays need it, as Spark's reader decodes up to 4,096 rows of a row group at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    if group:
        out = out.option("parquet.block.row.count.limit", group)
    out.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that :func:`materialise` made."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send whole texts to Python in smaller batches than Spark's default of 10,000 rows; a session's own setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def trim() -> None:
    """Give freed memory back to the system: Python workers live on after their task, beside the next stage's."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over unsigned integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordCodes(dict):
    """Word (bytes) to 64-bit code, remembered; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 120_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(codes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct codes of the runs of ``width`` words; a shorter text is one run, none for no words."""
    n = len(codes)
    if not n:
        return codes
    k = min(width, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = (out * np.uint64(0xF1357AEA2E62A9C5)) + mix(codes[i : n - k + 1 + i] + np.uint64(i + 1))
    return np.unique(mix(out))
