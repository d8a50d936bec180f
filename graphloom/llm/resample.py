"""Importance resampling towards a target: hashed n-gram counts as sparse blocks, column sums as distributions, products as weights."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.shared import bound_batches, discard, materialise, trim

BUCKETS = 10_000
#: a document of fewer words is never drawn
LEAST_WORDS = 20
#: features and rows that one block of the matrix holds, and those of the document that fills it
BLOCK_FEATURES, BLOCK_ROWS = 1 << 15, 2000
#: blocks in a row group, which are read at once: under 30 MB in memory
BLOCK_GROUP = 64
#: words and n-grams whose buckets a task remembers
KNOWN = 300_000

#: lower case for A-Z; digits, letters and all bytes from 0x80 stay; the rest parts words
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_BLOCKS = "ids array<long>, words array<long>, starts array<long>, columns array<int>, counts array<int>"
_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("columns", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


class _Buckets(dict):
    """Feature (bytes) to bucket, remembered; emptied when full."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def features(words: list[bytes], orders: int) -> Iterator[bytes]:
    """All runs of 1 to ``orders`` words, joined by one space, repeats and all."""
    yield from words
    for n in range(2, orders + 1):
        yield from map(b" ".join, zip(*(words[k:] for k in range(n))))


def _row(words: list[bytes], orders: int, known: _Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Columns in order, and their counts, of one document; memory is the document's, whatever its length."""
    found = np.fromiter(map(known.__getitem__, features(words, orders)), np.int32)
    columns, counts = np.unique(found, return_counts=True)
    return columns, counts.astype(np.int32)


def count_matrix(docs: DataFrame, orders: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document-by-bucket matrix in compressed sparse rows: a row of the frame is a block of documents.

    ``ids`` and ``words`` have an entry a document; document k's entries of ``columns`` and ``counts`` are those from
    ``starts[k]`` on, up to ``starts[k + 1]``. A null text has no words, a null id stays null. Neither a block nor a task's memory grows with the table
    where the matrix is written in row groups of ``BLOCK_GROUP`` blocks.
    """
    bound_batches(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, sizes, rows, held = _Buckets(buckets), [], [], [], 0

        def block() -> pa.RecordBatch:
            starts = np.cumsum([0, *(len(c) for c, _ in rows)])
            flat = [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int32) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((ids, sizes, starts, *flat), _SCHEMA.types)], schema=_SCHEMA)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                ids.append(i)
                sizes.append(len(words))
                rows.append(_row(words, orders, known))
                held += len(rows[-1][0])
                if held >= BLOCK_FEATURES or len(ids) >= BLOCK_ROWS:
                    yield block()
                    ids, sizes, rows, held = [], [], [], 0
        if ids:
            yield block()
        known.clear()
        trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(blocks, _BLOCKS)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all documents: each task adds up its blocks, so ``buckets`` rows a task are moved."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                columns, counts = (batch.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
                total += np.bincount(columns, counts, buckets).astype(np.int64)  # exact: a block's sums are far under 2^53
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in matrix.select("columns", "counts").mapInArrow(sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of target share over source share, a bucket of one added to each count; rounded down."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """The product of the matrix with ``gain``, a number for each bucket: id, n_words, n_features, weight; one row a document."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words, starts, columns, counts = (batch.column(c).slice(k, 1).flatten() for c in range(5))
                starts, columns, counts = (x.to_numpy(zero_copy_only=False) for x in (starts, columns, counts))
                upto = [np.concatenate([[0], np.cumsum(x)]) for x in (counts.astype(np.int64), counts * gain[columns])]
                sums = [x[starts[1:]] - x[starts[:-1]] for x in upto]
                yield pa.RecordBatch.from_arrays([ids, words, *(pa.array(x, pa.int64()) for x in sums)], ["id", "n_words", "n_features", "weight"])

    return matrix.select("ids", "words", "starts", "columns", "counts").mapInArrow(product, "id long, n_words long, n_features long, weight long")


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place (from 1) in ``order`` as column ``name``: range partitions, and totals of one row each."""
    part, before = f"part{uuid.uuid4().hex}", f"before{uuid.uuid4().hex}"
    # written once, as a partition's number holds for one run of the shuffle only
    ranged = materialise(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranked")
    totals = ranged.groupBy(part).agg(F.count("*").alias(before))
    offsets = totals.select(part, F.coalesce(F.sum(before).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
    # a row for each shuffle partition, whatever the number of rows
    placed = ranged.join(F.broadcast(offsets), part)
    return placed.withColumn(name, F.col(before) + F.row_number().over(W.partitionBy(part).orderBy(*order))).drop(part, before)


def resample(
    docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = LEAST_WORDS, seed: int = 2024, id_col: str = "doc_id",
    text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
) -> DataFrame:
    """Draw ``percent`` of 100 of the documents without replacement, the likelier the more their n-grams are the target's.

    One row for each row of ``docs``: id, n_features, weight, score, rank; ``rank`` counts from 1 and is null for what isn't drawn. Words are lower-cased in A-Z
    only; features are runs of 1 to ``orders`` words, counted into ``buckets`` by crc32. The counts of all documents are
    written once as sparse blocks and read twice: their column sums and the target's give each bucket's gain, and the product with the gains gives the
    weights. The score adds Gumbel noise from a hash of seed and id, so that the highest scores are a weighted draw. Of the N documents with at least
    ``least_words`` words floor(percent * N / 100) are drawn; equal scores go by id, the smaller first, none last.

    Null and empty texts have no features, weight 0 and are never drawn unless ``least_words`` is 0. A null id hashes as the empty
    text; rows that repeat an id have the same noise and are drawn each for itself. An empty target has equal shares; no documents give no rows.
    Ids are whole numbers. Other columns, whatever their names, are left out. What comes to the driver is a number for each bucket.
    """
    blocks = materialise(count_matrix(docs, orders, buckets, id_col, text_col), "blocks", BLOCK_GROUP)
    gain = gains(column_sums(blocks, buckets), column_sums(count_matrix(target, orders, buckets, target_id, target_text), buckets))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296)))
    scored = materialise(weights(blocks, gain).withColumn("score", score), "scored")
    discard(blocks)
    eligible = scored.filter(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features")]
    ranked = numbered(eligible, order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))
