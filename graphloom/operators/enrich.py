"""Edges and node attributes added to a built graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph as G
from graphloom.operators import retrieval as R


BLOCK = 1000  # values of one key that meet in a task at a time


def pairs_within(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Every pair of distinct values (a < b) that share a key: key, a, b; ``rows`` has distinct (key, value).

    The values of a key with over ``BLOCK`` of them are dealt into blocks by hash, and each pair of blocks meets apart from the others,
    so no task holds more than about two blocks of one key. Null keys and values pair with nothing.
    """
    r = rows.select(F.col(key).alias("key"), F.col(value).alias("value"))
    hot = r.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = r.join(hot, "key", "left").select("key", "value", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    own = own.withColumn("own", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("value"), "blocks").cast("int")))
    # the left side's block is never the later one, and a pair of blocks meets once
    meet = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = own.select("key", F.col("value").alias("x"), F.col("own").alias("low"), F.explode(F.filter(meet, lambda i: i >= F.col("own"))).alias("high"))
    right = own.select("key", F.col("value").alias("y"), F.explode(F.filter(meet, lambda i: i <= F.col("own"))).alias("low"), F.col("own").alias("high"))
    both = left.join(right, ["key", "low", "high"]).filter("x <> y and (low < high or x < y)")
    return both.select(F.col("key").alias(key), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def cooccurrence(mentions: DataFrame, edges: DataFrame | None = None, weight: float = 0.5) -> DataFrame:
    """Edges of entities that share a chunk: src, tgt, weight, relation, source_id (the least shared chunk); known edges are left out.

    A chunk's entities are few by construction (its size is bounded); the pairs of one that holds many are dealt to many tasks.
    """
    m = mentions.select("chunk_id", "entity_name").distinct()
    pair = pairs_within(m, "chunk_id", "entity_name")
    new = pair.groupBy(F.col("a").alias("src"), F.col("b").alias("tgt")).agg(F.min("chunk_id").alias("source_id"))
    if edges is not None:
        new = new.join(edges.select("src", "tgt"), ["src", "tgt"], "left_anti")
    return new.select("src", "tgt", F.lit(weight).alias("weight"), F.lit("chunk_cooccurrence").alias("relation"), "source_id")


def similarity_edges(vectors: DataFrame, threshold: float = 0.7, weight: float = 1.0, top_k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """Edges from each vector to those of its ``top_k`` nearest, itself counted, whose normalised score reaches the threshold.

    A vector's scores are divided by its best one, which is its own: 1, as cosines are. An edge found from both ends is one, its weights (weight x score) added up.
    """
    near = R.nearest(vectors, threshold, top_k - 1, id_col)
    return near.groupBy(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("tgt")).agg(F.round(F.sum(F.col("score") * weight), 6).alias("weight"), F.lit("similarity").alias("relation"))


def synonym_edges(vectors: DataFrame, edges: DataFrame | Column, threshold: float = 0.92, most: int = 3, id_col: str = "vec_id") -> DataFrame:
    """Pairs at least ``threshold`` alike, each among the ``most`` nearest of one of its ends, that have no edge yet in either direction.

    ``edges`` are rows (src, tgt), or where a rule tells them a condition on src < tgt, which needs no row for each known pair.
    """
    near = R.nearest(vectors, threshold, most, id_col).select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("tgt"), "score").distinct()
    if isinstance(edges, Column):
        return near.filter(~F.coalesce(edges, F.lit(False))).withColumn("relation", F.lit("synonym"))
    known = edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt"))
    return near.join(known, ["src", "tgt"], "left_anti").withColumn("relation", F.lit("synonym"))


def name_candidates(names: DataFrame, bucket: int = 500) -> DataFrame:
    """Pairs of names (a < b) that share a telling token: names of four characters or more that aren't numbers, tokens of three or more.

    A token in over ``bucket`` names tells nothing and opens no pairs: the operator's own blocking rule.
    """
    n = names.select("entity_name").distinct().filter((F.length("entity_name") >= 4) & ~T.is_number(F.col("entity_name")))
    t = n.select("entity_name", F.explode(F.array_distinct(T.tokens(F.col("entity_name")))).alias("token")).filter((F.length("token") >= 3) & ~F.col("token").isin(*T.STOPWORDS))
    ok = t.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n").between(2, bucket)).select("token")
    t = t.join(ok, "token", "left_semi")
    return t.alias("x").join(t.alias("y"), "token").filter("x.entity_name < y.entity_name").select(F.col("x.entity_name").alias("a"), F.col("y.entity_name").alias("b")).distinct()


def name_similarity(names: DataFrame, threshold: float = 0.65, bucket: int = 500) -> DataFrame:
    """Edges of candidate names whose matching-block ratio reaches the threshold: src, tgt, weight."""

    @F.pandas_udf("double")
    def ratio(a, b):
        import difflib

        import pandas as pd

        return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)])

    s = name_candidates(names, bucket).withColumn("weight", F.round(ratio("a", "b"), 6))
    return s.filter(F.col("weight") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("tgt"), "weight", F.lit("name_similarity").alias("relation"))


def with_centrality(nodes: DataFrame, edges: DataFrame, iterations: int = 10, most: int = 5000) -> DataFrame:
    """Nodes with pagerank, degree centrality and betweenness; 0 for those without edges.

    Betweenness needs a row for each pair of nodes; in a graph of over ``most`` nodes it is null, as too large to be worth it.
    """
    n = nodes.count()
    d = G.degree(edges).select(F.col("node").alias("entity_name"), (F.col("degree") / max(1, n - 1)).alias("d"))
    p = G.pagerank(edges, iterations).select(F.col("node").alias("entity_name"), "score")
    both = nodes.join(d, "entity_name", "left").join(p, "entity_name", "left")
    between = F.lit(None).cast("double")
    if n <= most:
        both, between = both.join(G.betweenness(edges).select(F.col("node").alias("entity_name"), "betweenness"), "entity_name", "left"), F.coalesce("betweenness", F.lit(0.0))
    return both.select(*nodes.columns, F.round(F.coalesce("score", F.lit(0.0)), 9).alias("pagerank"), F.round(F.coalesce("d", F.lit(0.0)), 9).alias("degree_centrality"), between.alias("betweenness"))
