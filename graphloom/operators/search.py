"""Searches composed of operators: questions with their expansions against nodes, and from chunks over candidates to their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import providers as P
from graphloom.functions.expansion import expand_query
from graphloom.operators import entities as E
from graphloom.operators import graph as G
from graphloom.operators import retrieval as R
from graphloom.operators import server as S

#: expansions of a question that are searched, at most
EXPANSIONS = 5


def search_questions(vectors: DataFrame, questions: DataFrame, k: int, provider: P.EmbeddingProvider | None = None, related: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """query_id, entity_name, score, rank: dense search for questions (query_id, question), with expansions for those that find fewer than ``k`` names.

    ``vectors``: entity_name, embedding, of the provider's kind. A question's expansions are its terms of :func:`expand_query` but itself, the first EXPANSIONS in order;
    their hits count 0.9 of their score.
    """
    terms = questions.select("query_id", F.explode(F.slice(F.filter(expand_query(F.col("question"), related), lambda t: t != F.lower("question")), 1, EXPANSIONS)).alias("text"))
    ask = P.embed(questions.select("query_id", F.col("question").alias("text")), "text", provider).select("query_id", F.col("embedding").alias("q"))
    more = P.embed(terms, "text", provider).select("query_id", F.col("embedding").alias("q"))
    return E.search_expanded(vectors, ask, more, k)


def augmented(question: Column, names: Column) -> Column:
    """The question with the names (an array) that it doesn't hold, in any case of letters, put after it; the names alone for an empty one."""
    asked = F.trim(F.coalesce(question, F.lit("")))
    own = F.filter(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: n != "")
    missing = F.filter(own, lambda n: ~F.contains(F.lower(asked), F.lower(n)))
    return F.when(asked == "", F.array_join(own, " ")).otherwise(F.trim(F.concat_ws(" ", asked, F.array_join(missing, " "))))


def search_then_expand(
    chunks: DataFrame, mentions: DataFrame, nodes: DataFrame, edges: DataFrame, question: str, names: list[str] | None = None, top_chunks: int = 6, per_chunk: int = 4, most: int = 5, neighbours: int = 20,
) -> dict[str, DataFrame]:
    """Chunks of a question, the entities in them that fit it best, and these entities' neighbours of highest degree: chunks, candidates, selected, neighbours.

    ``chunks``: chunk_id, content. ``mentions``: chunk_id, entity_name. ``nodes``: entity_name, entity_type, description. ``names`` that the question doesn't hold are put after it. Without a chunk or
    candidate the later frames are empty. What goes from step to step is a result list of stated length.
    """
    spark = chunks.sparkSession
    asked = spark.createDataFrame([(question, names or [])], "q string, n array<string>").select(augmented(F.col("q"), F.col("n"))).first()[0]
    found = R.text_search(chunks, "chunk_id", "content", asked, top_chunks)
    found = found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("hybrid"), F.desc("tfidf"), "chunk_id")))  # top_chunks rows
    candidates = S.score_candidates(found.select("chunk_id", "rank", F.col("hybrid").alias("score")), mentions, nodes, G.degree(edges), asked, per_chunk)
    pool = candidates.join(nodes.select("entity_name", "entity_type"), "entity_name").select("entity_name", "entity_type", F.col("candidate_score").alias("score"))
    selected = S.select_candidate(pool, None, [], 0.0, most)
    near = E.onehop_limited(edges.select("src", "tgt"), selected.select("entity_name"), neighbours)
    return {"chunks": found, "candidates": candidates, "selected": selected, "neighbours": near}


def expand_plans(vectors: DataFrame, questions: DataFrame, k: int, edges: DataFrame, provider: P.EmbeddingProvider | None = None) -> DataFrame:
    """query_id, seed, entity_name, rank: the neighbours of highest degree of what :func:`search_questions` finds."""
    hits = search_questions(vectors, questions, k, provider)
    near = E.onehop_limited(edges.select("src", "tgt"), hits.select("entity_name").distinct(), k)
    return hits.select("query_id", F.col("entity_name").alias("seed")).join(near, "seed").select("query_id", "seed", "entity_name", "rank")
