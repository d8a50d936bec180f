"""Approximate dense search: vectors in cells around centroids, exact cosines within the cells a query probes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE = 20_000  # vectors that the centroids are fitted on, at most
CELLS = 4096  # centroids, at most
ASKED = 200  # vectors of the sample by which the number of probes is chosen
SHARE = 100_000  # vectors that one task compares, at most
SHARE_BYTES = 64 * 1024 * 1024  # what these, or the queries they meet, may take
ROWS = 1024  # rows of a product
WAITING = 2_000_000  # pairs between two choices of the best


@dataclass
class Index:
    """Unit centroids, every vector as (id, e, cell), how many cells a query probes and how many vectors there are."""

    centroids: np.ndarray
    rows: DataFrame
    probes: int
    id_col: str
    size: int


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def centroids_of(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means; a cell without members keeps its centroid."""
    out = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = (x @ out.T).argmax(1)
        total = np.zeros_like(out)
        np.add.at(total, own, x)
        out = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, _unit(total), out)
    return out


def probes_for(x: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells that hold at least ``recall`` of the k nearest of vectors of the sample, by exact search there."""
    asked = x[:ASKED]
    own = (x @ centroids.T).argmax(1)
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(place[np.arange(len(asked))[:, None], own[near]].ravel())
    return int(needed[math.ceil(recall * len(needed)) - 1]) + 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _celled(centroids: np.ndarray):
    """Rows (key, vector) to those with the vector's nearest cell; a null vector has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(whole.column(1).is_valid())
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                own = (_matrix(batch.column(1), centroids.shape[1]) @ centroids.T).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32))], ["key", "e", "cell"])

    return run


def _probing(centroids: np.ndarray, probes: int):
    """Rows (key, vector) to those with the vector's ``probes`` nearest cells as bits; a null vector has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(whole.column(1).is_valid())
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                near = np.argsort(-(_matrix(batch.column(1), centroids.shape[1]) @ centroids.T), axis=1, kind="stable")[:, :probes]
                bits = np.zeros((len(batch), len(centroids)), bool)
                np.put_along_axis(bits, near, True, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())], ["key", "e", "cells"])

    return run


def _best(query: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query, by falling score, then by place."""
    order = np.lexsort((place, -score, query))
    query, place, score = query[order], place[order], score[order]
    ok = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[ok], place[ok], score[ok]


def _compared(cells: int, width: int, k: int, names: tuple[str, str]):
    """One task: its vectors (key, e, cell) and queries (key, e, cells) to each query's ``k`` best among the cells it probes."""

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        own = own.take(pa.compute.sort_indices(own, [("key", "ascending")], null_placement="at_start")).combine_chunks()
        asked = asked.combine_chunks()
        unit = lambda t: _unit(_matrix(t.column("e").combine_chunks(), width))
        x, q = unit(own), unit(asked)
        cell = own.column("cell").to_numpy()
        members = np.argsort(cell, kind="stable")
        starts = np.searchsorted(cell[members], np.arange(cells + 1))
        bits = np.frombuffer(b"".join(asked.column("cells").to_pylist()), np.uint8).reshape(len(q), -(-cells // 8))
        none = np.zeros(0, np.int64)
        held, waiting, n = (none, none, np.zeros(0)), [], 0
        least = np.full(len(q), -np.inf)  # what a query's k-th best has reached

        def settle():
            found = _best(*(np.concatenate(c) for c in zip(held, *waiting, strict=True)), k)
            full, count = np.unique(found[0], return_counts=True)
            ends = np.cumsum(count) - 1
            least[full[count == k]] = found[2][ends[count == k]]
            return found

        for c in range(cells):
            mine = members[starts[c] : starts[c + 1]]
            who = np.nonzero(bits[:, c >> 3] & (128 >> (c & 7)))[0] if len(mine) else none
            for m in range(0, len(who), ROWS):
                i = who[m : m + ROWS]
                for h in range(0, len(mine), 4 * ROWS):
                    j = mine[h : h + 4 * ROWS]
                    made = q[i] @ x[j].T
                    a, b = np.nonzero(made >= least[i][:, None] - 1e-6)
                    waiting.append((i[a], j[b], np.round(made[a, b], 6)))
                    n += len(a)
                    if n > WAITING:
                        held, waiting, n = settle(), [], 0
        query, place, score = settle() if waiting else held
        return pa.table({names[0]: asked.column("key").take(pa.array(query)), names[1]: own.column("key").take(pa.array(place)), "score": score})

    return run


def build(vectors: DataFrame, id_col: str = "vec_id", k: int = 10, recall: float = 0.95, sample: int = SAMPLE, cells: int | None = None) -> Index:
    """Index every vector (``id_col``, embedding); null vectors are never found.

    About the square root of the number of vectors is the number of cells, up to CELLS. Centroids are fitted on at most
    ``sample`` vectors, taken by a hash of the id, and on the same sample the number of probes is set so that ``recall`` of the
    k nearest lie in the cells probed. All else covers every row.
    """
    rows = vectors.select(F.col(id_col).alias("key"), F.col("embedding").cast("array<double>").alias("e")).filter("e is not null")
    n = rows.count()
    held = rows.orderBy(F.xxhash64("key"), "key").limit(sample).select("e").toArrow().column(0).to_pylist()
    if not held:
        return Index(np.zeros((0, 0)), rows.withColumn("cell", F.lit(0)), 1, id_col, 0)
    x = _unit(np.array(held, np.float64))
    middle = centroids_of(x, cells or max(1, min(CELLS, len(x), math.isqrt(n))))
    kind = dict(rows.dtypes)["key"]
    return Index(middle, rows.mapInArrow(_celled(middle), f"key {kind}, e array<double>, cell int"), probes_for(x, middle, k, recall), id_col, n)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """Cosine top-k of every query (query_id, q) among the cells it probes: query_id, id, score, rank.

    Vectors and queries are dealt to shares by hash of their ids, and a task compares one share of each as matrices, cell by cell, so a cell
    of many vectors, say of copies, is no task of its own. A query moves once a share of vectors, with the cells it probes as bits, and its
    ``k`` best leave a task. With as many probes as there are cells the result is exact.
    """
    kinds = [f"{name} {dict(df.dtypes)[column]}" for name, df, column in (("query_id", queries, "query_id"), (index.id_col, index.rows, "key"))]
    if not len(index.centroids):
        return queries.sparkSession.createDataFrame([], f"{kinds[0]}, {kinds[1]}, score double, rank int")
    cells, width = index.centroids.shape
    asked = queries.select(F.col("query_id").alias("key"), F.col("q").cast("array<double>").alias("e")).filter("e is not null")
    p, most = min(probes or index.probes, cells), max(1, min(SHARE, SHARE_BYTES // (8 * max(1, width))))
    shares, parts = max(min(8, -(-index.size // 512)), -(-index.size // most)), max(1, -(-asked.count() // most))
    asked = asked.mapInArrow(_probing(index.centroids, p), f"{kinds[0].replace('query_id', 'key', 1)}, e array<double>, cells binary")
    deal = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = index.rows.withColumn("share", deal(shares)).withColumn("part", every(parts)).groupBy("share", "part")
    met = own.cogroup(asked.withColumn("part", deal(parts)).withColumn("share", every(shares)).groupBy("share", "part"))
    scored = met.applyInArrow(_compared(cells, width, k, ("query_id", index.id_col)), f"{kinds[0]}, {kinds[1]}, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), index.id_col)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
