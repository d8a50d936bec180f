"""A graph built in micro-batches with a ledger of done and failed chunks, so that a build killed half-way goes on where it stopped."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import providers as P
from graphloom.operators import merge as M

LEDGER = "batch string, chunk_id string, status string, attempt int"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the build; none of its files there yet is no rows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, status (done or failed), attempt: the last entry of every chunk met."""
    w = W.partitionBy("chunk_id").orderBy(F.desc("attempt"), (F.col("status") != "done").cast("int"))
    return _read(spark, f"{path}/ledger", LEDGER).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("chunk_id", "status", "attempt")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, content: what was extracted from each done chunk, once."""
    rows = _read(spark, f"{path}/answers", "batch string, chunk_id string, content string")
    done = ledger(spark, path).filter("status = 'done'").select("chunk_id")
    return rows.join(done, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("content").alias("content"))


def _extract(batch: DataFrame, path: str, name: str, attempt: int, provider: P.LLMProvider | None, prompt: Callable) -> None:
    """Answers first, then the ledger: a batch that dies between the two is done again, into the same folders."""
    asked = P.complete(batch.select("chunk_id", "content").dropDuplicates(["chunk_id"]), prompt(F.col("content")), "answer", provider, nulls=True)
    where = f"{path}/answers/batch={name}"
    # every row, also those without an answer: the ledger is derived from what was written, so the provider is asked once
    asked.select("chunk_id", F.col("answer").alias("content")).write.mode("overwrite").parquet(where)
    told = batch.sparkSession.read.schema("chunk_id string, content string").parquet(where)
    told.select("chunk_id", F.when(F.col("content").isNull(), "failed").otherwise("done").alias("status"), F.lit(attempt).alias("attempt")).write.mode("overwrite").parquet(f"{path}/ledger/batch={name}")


def build(chunks: DataFrame, path: str, provider: P.LLMProvider | None = None, prompt: Callable | None = None, retries: int = 1) -> None:
    """Extract records from a stream of chunks (chunk_id, content) into the build at ``path``, as far as the stream goes now.

    Each micro-batch asks the provider for its chunks that the ledger doesn't have as done; a prompt the provider fails on makes its chunk failed.
    At the end failed chunks are asked again ``retries`` times, from the content kept beside the ledger. The stream's own checkpoint is under ``path``, so a
    build begun again reads new files only; a batch repeated after a crash overwrites its own folders. Rows without chunk_id are left out.
    """
    prompt = prompt or (lambda c: F.concat_ws("\t", F.lit("records"), c))
    spark = chunks.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        known = ledger(spark, path).filter("status = 'done'").select("chunk_id")
        new = rows.filter("chunk_id is not null").select("chunk_id", "content").join(known, "chunk_id", "left_anti")
        where = f"{path}/chunks/batch=s{number}"
        new.write.mode("overwrite").parquet(where)
        _extract(spark.read.schema("chunk_id string, content string").parquet(where), path, f"s{number}", 1, provider, prompt)

    chunks.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/stream").trigger(availableNow=True).start().awaitTermination()
    for attempt in range(2, retries + 2):
        failed = ledger(spark, path).filter((F.col("status") == "failed") & (F.col("attempt") < attempt)).select("chunk_id")
        again = _read(spark, f"{path}/chunks", "batch string, chunk_id string, content string").join(failed, "chunk_id", "left_semi")
        if not again.isEmpty():
            _extract(again, path, f"r{attempt}-{uuid.uuid4().hex[:8]}", attempt, provider, prompt)


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges merged from all done chunks, whatever the batches they came in."""
    return M.extract_graph(answers(spark, path))
