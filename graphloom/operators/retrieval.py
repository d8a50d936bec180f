"""Lexical and dense retrieval, rank fusion and score propagation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from graphloom.functions import text as T
from graphloom.functions import vectors as V
from graphloom.lineage import written

BROADCAST = 1_000_000  # terms of an index that go to every task; more meet its texts by a shuffle
BLOCK_BYTES = 32 << 20  # vectors of a block, as doubles
TILE = 1024  # vectors whose products are held at a time, times four


class Tfidf:
    """TF-IDF over (id, text): smooth idf ln((1 + n) / (1 + df)) + 1, unit rows, cosine. Terms: a-z and 0-9, two or more.

    Texts are dealt out by id once and split where they lie, so their terms aren't moved. ``terms`` (id, term, tf) and ``norms`` (id, norm) are
    lazy; ``idf`` (term, idf) is counted first and written, a row a term.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, stopwords: tuple[str, ...] = ()):
        self.id = id_col
        self.docs = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).repartition(id_col)
        term = self.docs.select(id_col, F.explode(T.tokens(F.col("text"))).alias("term")).filter(F.length("term") >= 2)
        if stopwords:
            term = term.filter(~F.col("term").isin(*stopwords))
        self.terms = term.groupBy(id_col, "term").agg(F.count("*").alias("tf"))
        n = docs.count()
        self.idf = written(self.terms.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")))
        self.weighted = self.terms.join(F.broadcast(self.idf) if self.idf.count() <= BROADCAST else self.idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
        self.norms = self.weighted.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    def query_weights(self, query: str) -> DataFrame:
        """(term, q): unit weights of the query's known terms, a handful of rows."""
        spark = self.docs.sparkSession
        q = spark.createDataFrame([(query,)], "q string").select(F.explode(T.tokens(F.col("q"))).alias("term")).filter(F.length("term") >= 2).groupBy("term").agg(F.count("*").alias("n"))
        w = self.idf.join(F.broadcast(q), "term").withColumn("q", F.col("n") * F.col("idf"))
        return w.select("term", "idf", (F.col("q") / F.sqrt(F.sum(F.col("q") * F.col("q")).over(W.partitionBy()))).alias("q"))

    def scores(self, query: str, candidates: DataFrame | None = None) -> DataFrame:
        """(id, score) of the documents that share a term with the query."""
        own = self.weighted.join(F.broadcast(self.query_weights(query).select("term", "q")), "term", "left")
        if candidates is not None:
            own = own.join(candidates, self.id, "left_semi")
        both = own.groupBy(self.id).agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return both.filter("dot is not null").select(self.id, (F.col("dot") / F.col("norm")).alias("score"))

    def top(self, query: str, k: int, candidates: DataFrame | None = None) -> DataFrame:
        return self.scores(query, candidates).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), self.id).limit(k)


def text_search(docs: DataFrame, id_col: str, text_col: str, query: str, top_k: int = 10, candidate_k: int | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Two-phase search: TF-IDF candidates, max(5 top_k, 20), then the hybrid score.

    hybrid = tfidf + 0.45 idf-weighted coverage of the query's tokens + min(0.30, 0.06 bi- and
    trigram hits) + 0.20 if the text holds the whole query. ``entities`` (id) narrows the candidates.
    """
    index = Tfidf(docs, id_col, text_col)
    few = index.top(query, candidate_k or max(5 * top_k, 20), entities).withColumnRenamed("score", "tfidf")
    spark = docs.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.lower(F.trim("q")).alias("lower"), F.array_distinct(T.tokens(F.col("q"))).alias("tok"), T.tokens(F.col("q")).alias("all"))
    grams = asked.select("lower", "tok", F.array_distinct(F.concat(T.ngrams(F.col("all"), 2), T.ngrams(F.col("all"), 3))).alias("grams"))
    mean = index.idf.agg(F.avg("idf").alias("mean"))
    weights = asked.select(F.explode("tok").alias("term")).join(index.idf, "term", "left").crossJoin(mean).agg(F.map_from_entries(F.collect_list(F.struct("term", F.coalesce("idf", "mean").alias("w")))).alias("weights"))
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(few), id_col).crossJoin(F.broadcast(grams)).crossJoin(F.broadcast(weights))
    lower = F.lower("text")
    own = T.tokens(F.col("text"))
    total = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda s, x: s + x)
    covered = F.aggregate(F.map_entries("weights"), F.lit(0.0), lambda s, e: s + F.when(F.array_contains(F.col("own"), e["key"]), e["value"]).otherwise(0.0))
    rows = rows.withColumn("own", own)
    hits = F.size(F.filter("grams", lambda g: F.contains(lower, g)))
    rows = rows.select(id_col, "tfidf", (covered / total).alias("coverage"), hits.cast("long").alias("phrase_hits"), F.contains(lower, F.col("lower")).alias("exact"))
    hybrid = F.col("tfidf") + 0.45 * F.col("coverage") + F.least(F.lit(0.30), 0.06 * F.col("phrase_hits")) + F.when(F.col("exact"), 0.20).otherwise(0.0)
    return rows.select(id_col, F.round(hybrid, 5).alias("hybrid"), F.round("tfidf", 5).alias("tfidf"), F.round("coverage", 5).alias("coverage"), "phrase_hits", "exact").orderBy(F.desc("hybrid"), F.desc("tfidf"), id_col).limit(top_k)


def rrf(ranked: DataFrame, key: str, base: int = 50) -> DataFrame:
    """Reciprocal rank fusion of rows (key, rank from 1, score): rrf = sum 1 / (base + rank), with the best score."""
    return ranked.groupBy(key).agg(F.round(F.sum(1 / (base + F.col("rank"))), 9).alias("rrf"), F.max("score").alias("score")).orderBy(F.desc("rrf"), F.desc("score"), key)


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """Exact cosine top-k of every query (query_id, q) against all vectors: query_id, id, score.

    Queries are a stated, small set and are broadcast as one array, so each vector is read once; only
    each partition's best k of a query meet.
    """
    n = queries.count()
    if n > 4096:
        raise ValueError("queries are broadcast; ask at most 4096 at once")
    # a vector's length is taken before it meets the queries, so a pair costs one product
    asked = F.broadcast(queries.select("query_id", "q", V.norm(F.col("q")).alias("_b")))
    pairs = vectors.select(id_col, F.col("embedding").alias("e"), V.norm(F.col("embedding")).alias("_a")).join(asked)
    n = F.col("_a") * F.col("_b")
    scored = pairs.select("query_id", id_col, F.round(F.when(n == 0, 0.0).otherwise(V.dot(F.col("e"), F.col("q")) / n), 6).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def by_blocks(vectors: DataFrame, meet: Callable, schema: str, id_col: str = "vec_id", flags: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of vectors by pairs of blocks: ``meet(ids, flags, tiles)`` yields a task's Arrow batches.

    ``ids`` are the task's ids in order; ``tiles`` gives (i, j, s), places among ``ids`` of two sets of vectors and their cosines, each pair of different vectors once (of a
    set with itself, s holds -inf on and below the diagonal). Blocks are as large as a task can hold, so a vector moves a few times only;
    the products are made tile by tile. Null vectors pair with nothing.
    """
    rows = vectors.filter("embedding is not null")
    size = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, min(8, -(-size[0] // 512)), -(-size[0] * (size[1] or 1) * 8 // BLOCK_BYTES))
    own = rows.select(F.col(id_col).alias("id"), F.col("embedding").alias("e"), *flags, F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("own"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "e", *flags)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        t = t.take(pa.compute.sort_indices(t.column("id")))
        first, last = key[0].as_py(), key[1].as_py()
        side = t.column("own").to_numpy()
        x = t.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(side), -1)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        a, b = np.nonzero(side == first)[0], np.nonzero(side == last)[0]

        def tiles():
            for m in range(0, len(a), TILE):
                i = a[m : m + TILE]
                for n in range(m if first == last else 0, len(b), 4 * TILE):
                    j = b[n : n + 4 * TILE]
                    made = x[i] @ x[j].T
                    if first == last:
                        made[i[:, None] >= j[None, :]] = -np.inf
                    yield i, j, made

        yield from meet(t.column("id"), [t.column(f).to_numpy() for f in flags], tiles())

    return spread.groupBy("p", "q").applyInArrow(run, schema)


def over(tile, threshold: float):
    """Places and rounded scores of a tile's pairs whose score reaches the threshold."""
    i, j, s = tile
    at, to = np.nonzero(s >= max(threshold - 1e-6, -3.0))
    score = np.round(s[at, to], 6)
    ok = score >= threshold
    at, to = i[at[ok]], j[to[ok]]
    return np.minimum(at, to), np.maximum(at, to), score[ok]


def similar_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", both: bool = False) -> DataFrame:
    """(a, b, score) of all pairs a < b, or with ``both`` in either order, with cosine at least the threshold; only these leave a task, tile by tile."""
    kind = dict(vectors.dtypes)[id_col]

    def meet(ids, _, tiles):
        for tile in tiles:
            a, b, score = over(tile, threshold)
            for a, b in ((a, b), (b, a))[: 2 if both else 1]:
                yield from pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "score": score}).to_batches(100_000)

    return by_blocks(vectors, meet, f"a {kind}, b {kind}, score double", id_col)


def nearest(vectors: DataFrame, threshold: float, k: int, id_col: str = "vec_id") -> DataFrame:
    """(id, other, score): of each vector's ``k`` nearest others (ties: the lesser id) those whose score reaches the threshold.

    A task keeps the ``k`` best of each of its vectors, so what leaves it grows with vectors and not with pairs.
    """
    kind = dict(vectors.dtypes)[id_col]

    def best(id, other, score):
        order = np.lexsort((other, -score, id))
        id, other, score = id[order], other[order], score[order]
        ok = np.arange(len(id)) - np.searchsorted(id, id) < k
        return id[ok], other[ok], score[ok]

    def meet(ids, _, tiles):
        none = np.zeros(0, np.int64)
        held, waiting, n = (none, none, np.zeros(0)), [], 0
        for tile in tiles:
            a, b, score = over(tile, threshold)
            waiting.append((np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([score, score])))
            n += len(score)
            if n > 2_000_000:
                held, waiting, n = best(*(np.concatenate(c) for c in zip(held, *waiting, strict=True))), [], 0
        id, other, score = best(*(np.concatenate(c) for c in zip(held, *waiting, strict=True)))
        yield from pa.table({"id": ids.take(pa.array(id)), "other": ids.take(pa.array(other)), "score": score}).to_batches(100_000)

    few = by_blocks(vectors, meet, f"id {kind}, other {kind}, score double", id_col)
    return few.withColumn("_at", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "other"))).filter(F.col("_at") <= k).drop("_at")


def node_vector(hits: DataFrame, how: str = "sum") -> DataFrame:
    """Scores of nodes over several queries, summed or at their best, scaled to sum 1: node, score."""
    best = hits.groupBy("node").agg((F.sum if how == "sum" else F.max)("score").alias("s"))
    return best.select("node", F.round(V.share(F.col("s")), 6).alias("score"))


def max_sim(query_tokens: DataFrame, doc_tokens: DataFrame) -> DataFrame:
    """Late interaction: per document the sum over query tokens of the best cosine among its tokens: doc_id, score."""
    pair = doc_tokens.join(F.broadcast(query_tokens)).select("doc_id", "q_tok", V.cosine(F.col("e"), F.col("q")).alias("s"))
    return pair.groupBy("doc_id", "q_tok").agg(F.max("s").alias("s")).groupBy("doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


def embed_distinct(rows: DataFrame, text_col: str, embed, known: DataFrame | None = None) -> DataFrame:
    """Embed each distinct text once, those in ``known`` (text, embedding) not at all, and give all rows their vector.

    ``embed`` maps a list of texts to vectors and runs in batches on the executors.
    """
    texts = rows.select(F.col(text_col).alias("text")).filter(F.col(text_col).isNotNull()).distinct()
    todo = texts.join(known, "text", "left_anti") if known is not None else texts

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"text": b["text"], "embedding": list(embed(b["text"].tolist()))})

    new = todo.mapInPandas(run, "text string, embedding array<float>")
    table = new.unionByName(known.select("text", F.col("embedding").cast("array<float>").alias("embedding"))) if known is not None else new
    return rows.join(table.withColumnRenamed("text", text_col), text_col, "left")


def embed_each(rows: DataFrame, text_col: str, embed) -> DataFrame:
    """Gives each row the vector of its text where it lies, for texts that seldom repeat: nothing is moved, and repeats within a batch are embedded once. Null texts get null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float32())
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).dictionary_encode()
            made = pa.array(list(embed(texts.dictionary.to_pylist())) if len(texts.dictionary) else [], kind)
            yield pa.RecordBatch.from_arrays([*b.columns, made.take(texts.indices)], [*b.schema.names, "embedding"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def propagate(scores: DataFrame, incidence: DataFrame, out: str) -> DataFrame:
    """One sparse product: (node, score) over (node, out, v) to (out, score)."""
    return scores.join(incidence, "node").groupBy(out).agg(F.sum(F.col("score") * F.col("v")).alias("score"))


def top_by(df: DataFrame, score: Column, key: str, k: int) -> DataFrame:
    return df.orderBy(score.desc(), key).limit(max(0, k))
