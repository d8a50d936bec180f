"""Named tables under one folder, and what is kept in them: key-value pairs, vector indexes and communities, written, loaded and cleaned."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.vector_index import Index


class Store:
    """Tables by name in a folder that all executors reach. A name is a path of letters, digits, ``_``, ``-`` and ``/``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self, name: str) -> bool:
        """Whether a table of that name was written to its end."""
        fs, at = self._at(f"{name}/_SUCCESS")
        return fs.exists(at)

    def save(self, name: str, df: DataFrame, force: bool = False) -> bool:
        """Write a table; one that is there stays unless ``force``. Returns whether it was written."""
        if self.exists(name) and not force:
            return False
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return True

    def load(self, name: str) -> DataFrame | None:
        """The table, or None where there is none."""
        return self.spark.read.parquet(f"{self.path}/{name}") if self.exists(name) else None

    def clean(self, name: str) -> None:
        """Delete a table, or a folder of tables."""
        fs, at = self._at(name)
        fs.delete(at, True)


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    """key, value (JSON text) of JSON files that hold one object each; a file that doesn't has no rows. Of a key in several files the last file's value stays."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,string>").alias("m"))
    return whole.select("file", F.explode("m").alias("key", "value")).groupBy("key").agg(F.max_by("value", "file").alias("value"))


def write_kv(pairs: DataFrame, path: str) -> None:
    """A JSON row {"key", "value"} for each pair; values are kept as they are, so JSON text stays JSON text."""
    pairs.select("key", "value").write.mode("overwrite").json(path)


def read_kv_rows(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_kv` wrote."""
    return spark.read.schema("key string, value string").json(path)


def upsert_kv(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, value: pairs of ``new`` in place of those of ``old`` with their keys."""
    return old.select("key", "value").join(new.select("key"), "key", "left_anti").unionByName(new.select("key", "value"))


def save_index(index: Index, store: Store, name: str, force: bool = False) -> Index:
    """Write an index (vectors by cell, centroids, probes) unless it is there, and load it: vectors get their cells once."""
    if force or not store.exists(f"{name}/meta"):
        store.save(f"{name}/rows", index.rows.repartition("cell"), True)
        cells = store.spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(index.centroids)], "cell int, centroid array<double>")
        store.save(f"{name}/centroids", cells, True)
        # last, as it tells that the others are whole
        store.save(f"{name}/meta", store.spark.createDataFrame([(index.probes, index.id_col)], "probes int, id_col string"), True)
    return load_index(store, name)


def load_index(store: Store, name: str) -> Index | None:
    """The index, or None where there is none or not a whole one."""
    meta = store.load(f"{name}/meta")
    if meta is None:
        return None
    probes, id_col = meta.first()
    # at most vector_index.CELLS centroids
    cells = [r["centroid"] for r in store.load(f"{name}/centroids").orderBy("cell").collect()]
    rows = store.load(f"{name}/rows")
    return Index(np.array(cells, np.float64) if cells else np.zeros((0, 0)), rows, probes, id_col, rows.count())


def communities(store: Store, name: str, cluster, report, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Membership and reports by name: loaded, or made by ``cluster()`` and ``report(membership)``, written and then read.

    ``force`` makes reports again and keeps the membership.
    """
    if not store.exists(f"{name}/membership"):
        store.save(f"{name}/membership", cluster())
    membership = store.load(f"{name}/membership")
    if force or not store.exists(f"{name}/reports"):
        store.save(f"{name}/reports", report(membership), True)
    return membership, store.load(f"{name}/reports")
