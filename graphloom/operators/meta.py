"""Operators around questions and answers; the provider decides, with a deterministic default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import providers as P
from graphloom.operators import graph as G
from graphloom.operators.prize_tree import prize_tree


def _prompt(task: str, question, context=None):
    return F.concat_ws("\t", F.lit(task), question, context if context is not None else F.lit(""))


def _lines(c):
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def extract_entities(questions: DataFrame, provider: P.LLMProvider | None = None) -> DataFrame:
    """(id, position, entity_name) named by each question."""
    said = P.complete(questions, _prompt("extract", F.col("question")), "_a", provider)
    return said.select("id", F.posexplode(F.array_distinct(_lines(F.col("_a")))).alias("position", "entity_name"))


def decompose(questions: DataFrame, most: int = 4, provider: P.LLMProvider | None = None) -> DataFrame:
    """(id, position, question): sub-questions, one a line of the answer."""
    said = P.complete(questions, _prompt("decompose", F.col("question")), "_a", provider)
    return said.select("id", F.posexplode(F.slice(_lines(F.col("_a")), 1, most)).alias("position", "question"))


def context(chunks: DataFrame, key: str = "id") -> DataFrame:
    """One text per question from its chunks (id, position, content), in order; a question's chunks are few."""
    rows = F.array_sort(F.collect_list(F.struct("position", "content")))
    return chunks.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["content"]), "\n").alias("context"))


def answer(questions: DataFrame, chunks: DataFrame, provider: P.LLMProvider | None = None) -> DataFrame:
    """(id, answer) from the question's chunks; without any the context is empty."""
    rows = questions.join(context(chunks), "id", "left")
    return P.complete(rows, _prompt("answer", F.col("question"), F.coalesce("context", F.lit(""))), "answer", provider).select("id", "answer")


def synthesize(questions: DataFrame, parts: DataFrame, provider: P.LLMProvider | None = None) -> DataFrame:
    """(id, answer) from the answers of sub-questions (id, position, content), as bullets."""
    return answer(questions, parts.withColumn("content", F.concat(F.lit("- "), "content")), provider)


def reason(questions: DataFrame, chunks: DataFrame, provider: P.LLMProvider | None = None) -> DataFrame:
    """(id, question): the question refined by what was found."""
    rows = questions.join(context(chunks), "id", "left")
    return P.complete(rows, _prompt("refine", F.col("question"), F.coalesce("context", F.lit(""))), "_q", provider).select("id", F.col("_q").alias("question"))


def rerank(questions: DataFrame, items: DataFrame, k: int, provider: P.LLMProvider | None = None) -> DataFrame:
    """Items (id, position, content) in the order the provider gives; score 1 - rank / k, places out of range ignored."""
    rows = F.array_sort(F.collect_list(F.struct("position", "content")))
    per = questions.join(items.groupBy("id").agg(rows.alias("_r")), "id")
    said = P.complete(per, _prompt("rerank", F.col("question"), F.array_join(F.transform("_r", lambda r: r["content"]), "\n")), "_a", provider)
    at = said.select("id", "_r", F.posexplode(F.array_distinct(F.regexp_extract_all("_a", F.lit("[0-9]+"), F.lit(0)))).alias("rank", "place"))
    hit = F.try_element_at("_r", F.col("place").cast("int") + 1)
    w = W.partitionBy("id").orderBy("rank")
    out = at.select("id", "rank", hit.alias("h")).filter("h is not null").withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)
    return out.select("id", F.col("h.position").alias("position"), "rank", F.round(1 - F.col("rank") / k, 6).alias("score"))


def prune_subgraph(edges: DataFrame) -> DataFrame:
    """Edges of the largest connected component (the least name wins a tie): the fallback of the prize-collecting tree."""
    top = G.largest_component(edges).select("node")
    return edges.join(top.withColumnRenamed("node", "src"), "src", "left_semi").select(*edges.columns)


def costs_and_prizes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prize of a node: its score or 1; cost of an edge: 1 / max(weight, 0.01)."""
    prize = F.coalesce("score", F.lit(1.0)) if "score" in nodes.columns else F.lit(1.0)
    return nodes.select("entity_name", prize.alias("prize")), edges.select("src", "tgt", F.round(1 / F.greatest("weight", F.lit(0.01)), 6).alias("cost"))


def pcst_optimize(nodes: DataFrame, edges: DataFrame, window: float = 0.0) -> DataFrame:
    """Edges (with ``cost``) of the tree whose node scores outweigh its edges' costs by most: prizes are scores, costs fall with weights.

    ``nodes`` (entity_name, score) and ``edges`` (src, tgt, weight, more) are a question's sets; with no worthwhile edge there are no rows.
    """
    prizes, costs = costs_and_prizes(nodes, edges)
    tree = prize_tree(prizes.withColumnRenamed("entity_name", "node"), costs, window).filter("parent is not null")
    kept = tree.select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("tgt"), "cost")
    least = W.partitionBy("src", "tgt").orderBy(F.desc("weight"), *[c for c in edges.columns if c not in ("src", "tgt", "weight")])
    one = G.canonical(edges).withColumn("_n", F.row_number().over(least)).filter("_n = 1").drop("_n")
    return one.join(kept, ["src", "tgt"])


def choose_paths(paths: DataFrame, chosen: list[int] | None, most: int = 5) -> DataFrame:
    """The paths (position, path) whose numbers were chosen, at most ``most``; none chosen keeps all."""
    return paths.filter(F.col("position").isin(*chosen)).orderBy("position").limit(most) if chosen else paths
