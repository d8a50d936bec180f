"""Relationship and chunk operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import vectors as V
from graphloom.operators import graph as G
from graphloom.operators import retrieval as R


def onehop(edges: DataFrame, seeds: DataFrame, budget: int | None = None) -> DataFrame:
    """Incident edges of the seeds by (rank, weight) falling, as many as fit the token budget.

    The running sum is over the edges of a question's few seeds.
    """
    own = G.incident(edges, seeds.select(F.col("entity_name").alias("node")))
    d = G.degree(edges).join(own.select(F.explode(F.array("src", "tgt")).alias("node")).distinct(), "node", "left_semi")
    e = own.join(d.select(F.col("node").alias("src"), F.col("degree").alias("_a")), "src").join(d.select(F.col("node").alias("tgt"), F.col("degree").alias("_b")), "tgt")
    e = e.withColumn("rank", F.col("_a") + F.col("_b")).drop("_a", "_b")
    if budget is not None:
        size = F.size(T.words(F.concat_ws(" ", "src", "relation", "tgt"))).cast("long")
        e = e.filter("true").withColumn("_ok", V.within_budget(size, [F.desc("rank"), F.desc("weight"), F.col("src"), F.col("tgt"), F.col("relation")], budget)).filter("_ok").drop("_ok")
    return e


def directed_onehop(edges: DataFrame, seeds: DataFrame, direction: str = "both", relations: list[str] | None = None) -> DataFrame:
    """Edges as they point, from (outgoing), to (incoming) or at (both, each once) the seeds, of the given relations."""
    e = edges.filter(F.col("relation").isin(*relations)) if relations else edges
    s = seeds.select("entity_name").distinct()
    out = e.join(s.withColumnRenamed("entity_name", "src"), "src", "left_semi").select(*e.columns)
    into = e.join(s.withColumnRenamed("entity_name", "tgt"), "tgt", "left_semi").select(*e.columns)
    if direction == "outgoing":
        return out
    return into if direction == "incoming" else out.unionByName(into).dropDuplicates()


def vdb(edge_vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """Dense top-k over edges (edge_id, embedding)."""
    hits = R.vector_top(edge_vectors, queries, k, "edge_id")
    return hits.filter(F.col("score") >= threshold) if threshold is not None else hits


def score_agg(scores: DataFrame, incidence: DataFrame, k: int) -> DataFrame:
    """Edges by the sum of their ends' scores: edge_id, score; the k best."""
    s = R.propagate(scores.select(F.col("entity_name").alias("node"), "score"), incidence, "edge_id").withColumn("score", F.round("score", 6))
    return R.top_by(s, F.col("score"), "edge_id", k)


def score_ends(edges: DataFrame, scores: DataFrame, how: str = "sum", k: int | None = None) -> DataFrame:
    """Edges scored by the sum, average or maximum of their ends' scores (a missing one is 0); edges with none go."""
    a = scores.select(F.col("entity_name").alias("src"), F.col("score").alias("_a"))
    b = scores.select(F.col("entity_name").alias("tgt"), F.col("score").alias("_b"))
    e = edges.join(a, "src", "left").join(b, "tgt", "left").fillna(0.0, ["_a", "_b"]).filter("_a <> 0 or _b <> 0")
    s = {"sum": F.col("_a") + F.col("_b"), "average": (F.col("_a") + F.col("_b")) / 2, "max": F.greatest("_a", "_b")}[how]
    out = e.withColumn("score", F.round(s, 6)).drop("_a", "_b")
    return out.orderBy(F.desc("score"), "src", "tgt", "relation").limit(k) if k is not None else out


def agent_relations(edges: DataFrame, head: str, previous: list[str], width: int, pick=None) -> DataFrame:
    """Relations at a head that weren't used before: relation, side (head or tail), n; ``pick`` may rate them, else the most frequent stay."""
    sides = edges.filter((F.col("src") == head) | (F.col("tgt") == head)).select("relation", F.when(F.col("src") == head, "head").otherwise("tail").alias("side"))
    left = sides.filter(~F.col("relation").isin(*previous)) if previous else sides
    counted = left.groupBy("relation", "side").agg(F.count("*").alias("n"))
    return (pick(counted) if pick else counted).orderBy(F.desc("n"), "relation", "side").limit(width)


def parse_scores(text):
    """Column of structs (relation, score) from '{relation (Score: x)}' marks in a model's answer."""
    found = F.regexp_extract_all(text, F.lit(r"\{[^{}]*\(Score: [0-9.]+\)\s*\}"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.trim(F.regexp_extract(m, r"\{([^{}]*?)\(Score", 1)).alias("relation"), F.regexp_extract(m, r"Score: ([0-9.]+)", 1).cast("double").alias("score")))


# chunks


def chunks_from_relations(edges: DataFrame, chunks: DataFrame, budget: int | None = None) -> DataFrame:
    """Chunks that the edges name in source_ids, in the order of first mention: chunk_id, position, tokens.

    Edges come with a ``position``; a chunk takes its first.
    """
    first = edges.select("position", F.posexplode("source_ids").alias("_p", "chunk_id")).groupBy("chunk_id").agg(F.min(F.struct("position", "_p")).alias("o"))
    c = first.join(chunks.select("chunk_id", "tokens"), "chunk_id").select("chunk_id", F.col("o.position").alias("position"), F.col("o._p").alias("place"), "tokens")
    if budget is not None:
        c = c.withColumn("_ok", V.within_budget(F.col("tokens"), [F.col("position"), F.col("place"), F.col("chunk_id")], budget)).filter("_ok").drop("_ok")
    return c


def capped_relation_chunks(edges: DataFrame, per_edge: int, total: int) -> DataFrame:
    """At most ``per_edge`` chunks of each edge (edge_id, position, source_ids) and ``total`` in all, in order: edge_id, chunk_id."""
    rows = edges.select("edge_id", "position", F.posexplode("source_ids").alias("_p", "chunk_id")).filter(F.col("_p") < per_edge)
    return rows.orderBy("position", "_p", "edge_id").limit(total).select("edge_id", "chunk_id")


def occurrence(mentions: DataFrame, edges: DataFrame, seeds: DataFrame, k: int | None = None) -> DataFrame:
    """Chunks of the seeds (entity_name, position): chunk_id, position of the first seed, relation_counts = one-hop
    neighbours of the chunk's seeds that cite it too. Ordered by position, then counts falling."""
    own = mentions.join(seeds, "entity_name").select("chunk_id", "entity_name", "position")
    near = G.neighbours(edges, seeds.select(F.col("entity_name").alias("node"))).select(F.col("seed").alias("entity_name"), F.col("node"))
    both = own.join(near, "entity_name").join(mentions.select("chunk_id", F.col("entity_name").alias("node")).distinct(), ["chunk_id", "node"]).groupBy("chunk_id").agg(F.countDistinct("node").alias("c"))
    first = own.groupBy("chunk_id").agg(F.min("position").alias("position"))
    out = first.join(both, "chunk_id", "left").select("chunk_id", "position", F.coalesce("c", F.lit(0)).alias("relation_counts"))
    return out.orderBy("position", F.desc("relation_counts"), "chunk_id").limit(k) if k is not None else out


def pair_occurrence(mentions: DataFrame, seeds: DataFrame, k: int | None = None) -> DataFrame:
    """Chunks by the number of pairs of seeds they mention together: chunk_id, pairs."""
    n = mentions.join(seeds.select("entity_name").distinct(), "entity_name").groupBy("chunk_id").agg(F.countDistinct("entity_name").alias("n"))
    out = n.filter("n > 1").select("chunk_id", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    return out.orderBy(F.desc("pairs"), "chunk_id").limit(k) if k is not None else out


def aggregate_chunks(scores: DataFrame, edges: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Entity scores over edges (src, tgt, source_ids), each there once, to their known chunks, scaled to 0..1 over all chunks reached: chunk_id, score; ties by the larger id.

    An edge meets its two ends' scores and has its own before its chunks are listed, so no rows of edge and end and none of edge and chunk are moved.
    """
    a, b = (scores.select(F.col("entity_name").alias(end), F.col("score").alias(s)) for end, s in (("src", "_a"), ("tgt", "_b")))
    r = edges.select("src", "tgt", "source_ids").join(a, "src", "left").join(b, "tgt", "left").filter("_a is not null or _b is not null")
    own = (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).alias("score")
    c = r.select(F.explode("source_ids").alias("chunk_id"), own).groupBy("chunk_id").agg(F.sum("score").alias("score"))
    c = c.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    ends = F.broadcast(c.agg(F.min("score").alias("lo"), F.max("score").alias("hi")))
    scaled = c.crossJoin(ends).select("chunk_id", F.round(F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("score"))
    return scaled.orderBy(F.desc("score"), F.desc("chunk_id")).limit(k)


def aggregate_by_edges(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Candidate chunks (chunk_id, edge_ids, text): the score of each edge named exactly, half of one whose name only
    occurs in the text; chunks without any share the total alike."""
    few = F.broadcast(scores.agg(F.collect_list(F.struct("edge_id", "score")).alias("s")))
    n = F.broadcast(candidates.agg(F.count("*").alias("n"), F.lit(1).alias("_")).drop("_"))
    rows = candidates.crossJoin(few).crossJoin(n)
    hit = F.aggregate("s", F.lit(0.0), lambda t, x: t + F.when(F.array_contains("edge_ids", x["edge_id"]), x["score"]).when(F.contains(F.col("text"), x["edge_id"]), 0.5 * x["score"]).otherwise(0.0))
    total = F.aggregate("s", F.lit(0.0), lambda t, x: t + x["score"])
    out = rows.select("chunk_id", F.round(F.when(hit > 0, hit).otherwise(total / F.col("n")), 6).alias("score"))
    return out.orderBy(F.desc("score"), "chunk_id").limit(k)


def texts_for_entities(mentions: DataFrame, chunks: DataFrame, names: DataFrame, cap: int) -> DataFrame:
    """Per entity up to ``cap`` of its chunks: entity_name, chunk_id, content."""
    w = W.partitionBy("entity_name").orderBy("chunk_id")
    own = mentions.join(names, "entity_name", "left_semi").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap)
    return own.join(chunks.select("chunk_id", "content"), "chunk_id").select("entity_name", "chunk_id", "content")
