"""Steps in which a provider rates: relations at an entity, their far ends, and paths; each for many questions at once, with a fixed outcome where it says nothing usable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import providers as P
from graphloom.operators import relations as L

#: fixed values: the name of a chain's end, and how scores are marked in an answer about candidates
FINISH = "[FINISH]"
SCORE = r"\d+\.\d+"
#: candidates in one prompt; more are asked in several
PAGE = 100


def _prompt(task: str, *parts):
    return F.concat_ws("\t", F.lit(task), *parts)


def rate_relations(edges: DataFrame, topics: DataFrame, width: int = 3, provider: P.LLMProvider | None = None) -> DataFrame:
    """id, question, entity_name, relation, head, score: the relations at each topic's entity that the provider holds to matter.

    ``topics``: id, question, entity_name, and maybe previous (names of relations used before) and previous_head; previous relations are left out on the side that led here: tails
    after a head, heads after a tail. The prompt holds the distinct relations in order; an answer names some as '{relation (Score: x)}', with those not asked for left
    out. Without a provider, or where an answer has no such marks, the ``width`` most frequent relations stay, scored by their share. ``head``: the entity is
    the edges' source.
    """
    before = F.coalesce("previous", F.array().cast("array<string>")) if "previous" in topics.columns else F.array().cast("array<string>")
    after_head = F.coalesce("previous_head", F.lit(False)) if "previous_head" in topics.columns else F.lit(False)
    t = topics.select("id", "question", "entity_name", before.alias("before"), after_head.alias("after_head"))
    sides = edges.select("relation", F.explode(F.array(F.struct(F.col("src").alias("entity_name"), F.lit(True).alias("at_head")), F.struct(F.col("tgt").alias("entity_name"), F.lit(False).alias("at_head")))).alias("x")).select("relation", "x.*")
    met = t.join(sides, "entity_name").filter(~(F.array_contains("before", F.col("relation")) & (F.col("after_head") != F.col("at_head"))))
    rel = met.groupBy("id", "question", "entity_name", "relation").agg(F.max("at_head").alias("head"), F.count("*").alias("n"))
    all_n = F.sum("n").over(W.partitionBy("id", "entity_name"))
    place = F.row_number().over(W.partitionBy("id", "entity_name").orderBy(F.desc("n"), "relation"))
    fixed = rel.withColumns({"score": F.round(F.col("n") / all_n, 6), "place": place})
    if provider is None:
        return fixed.filter(F.col("place") <= width).select("id", "question", "entity_name", "relation", "head", "score")
    # distinct relations of one entity: a vocabulary, not its edges
    asked = rel.groupBy("id", "question", "entity_name").agg(F.array_join(F.array_sort(F.collect_set("relation")), "; ").alias("names"))
    said = P.complete(asked, _prompt("relations", F.col("question"), F.concat_ws("\n", "entity_name", "names", F.lit(str(width)))), "answer", provider, nulls=True)
    marks = said.select("id", "entity_name", F.explode_outer(L.parse_scores(F.col("answer"))).alias("m")).select("id", "entity_name", "m.relation", F.col("m.score").alias("rated"))
    usable = rel.select("id", "entity_name", "relation").join(marks, ["id", "entity_name", "relation"]).groupBy("id", "entity_name", "relation").agg(F.max("rated").alias("rated"))
    told = usable.select("id", "entity_name").distinct().withColumn("told", F.lit(True))
    both = fixed.join(usable, ["id", "entity_name", "relation"], "left").join(told, ["id", "entity_name"], "left")
    keep = F.when(F.coalesce("told", F.lit(False)), F.col("rated").isNotNull()).otherwise(F.col("place") <= width)
    return both.filter(keep).select("id", "question", "entity_name", "relation", "head", F.coalesce("rated", "score").alias("score"))


def rate_tails(edges: DataFrame, chosen: DataFrame, width: int = 3, provider: P.LLMProvider | None = None) -> DataFrame:
    """id, entity_name, score, relation, topic_entity, head: the far ends of the chosen relations, the ``width`` best of each question, none scored 0.

    ``chosen`` is what :func:`rate_relations` returns. One far end takes its relation's score; several are rated by the provider, in prompts of at most PAGE in order of
    name. Where an answer doesn't have as many decimals as there were candidates, and without a provider, each counts 1 / number of them. A
    relation without far ends leads to FINISH with score 0, so to nothing.
    """
    far = edges.select("relation", F.explode(F.array(F.struct(F.col("src").alias("topic_entity"), F.col("tgt").alias("far"), F.lit(True).alias("head")), F.struct(F.col("tgt").alias("topic_entity"), F.col("src").alias("far"), F.lit(False).alias("head")))).alias("x"))
    far = far.select("relation", "x.*").distinct()
    c = chosen.select("id", "question", F.col("entity_name").alias("topic_entity"), "relation", "head", F.col("score").alias("given")).join(far, ["topic_entity", "relation", "head"])
    key = ["id", "topic_entity", "relation", "head"]
    c = c.withColumns({"n": F.count("*").over(W.partitionBy(*key)), "at": F.row_number().over(W.partitionBy(*key).orderBy("far")) - 1})
    even = F.round(1 / F.col("n"), 6)
    if provider is None:
        rated = c.withColumn("score", F.when(F.col("n") == 1, F.col("given")).otherwise(even))
    else:
        pages = c.filter("n > 1").withColumn("page", (F.col("at") / PAGE).cast("int"))
        pages = pages.groupBy(*key, "question", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "far"))), lambda x: x["far"]).alias("far"))
        said = P.complete(pages, _prompt("tails", F.col("question"), F.concat_ws("\n", "relation", F.array_join("far", "; "))), "answer", provider, nulls=True)
        marks = F.regexp_extract_all("answer", F.lit(SCORE), F.lit(0))
        scores = said.select(*key, "far", F.when(F.size(marks) == F.size("far"), F.transform(marks, lambda x: x.cast("double"))).alias("scores"))
        scores = scores.select(*key, F.explode(F.arrays_zip("far", "scores")).alias("x")).select(*key, F.col("x.far").alias("far"), F.col("x.scores").alias("rated"))
        rated = c.join(scores, [*key, "far"], "left").withColumn("score", F.when(F.col("n") == 1, F.col("given")).otherwise(F.coalesce("rated", even)))
    best = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "far", "relation", "topic_entity", "head"))
    return rated.filter("score > 0").withColumn("_r", best).filter(F.col("_r") <= width).select("id", F.col("far").alias("entity_name"), "score", "relation", "topic_entity", "head")


def pick_paths(paths: DataFrame, questions: DataFrame, most: int = 5, provider: P.LLMProvider | None = None) -> DataFrame:
    """id, position, path: of each question's numbered paths (id, position, path) those the provider names by number, ``most`` at most; all where it names none.

    ``questions``: id, question. The prompt has a line for each path of the question, the first PAGE by position.
    """
    line = F.concat_ws(": ", F.col("position").cast("string"), F.array_join("path", " -> "))
    shown = paths.withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("position"))).filter(F.col("_r") <= PAGE)
    asked = shown.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    said = P.complete(asked.join(questions.select("id", "question"), "id"), _prompt("paths", F.col("question"), F.col("lines")), "answer", provider, nulls=True) if provider else None
    if said is None:
        return paths.select("id", "position", "path")
    named = said.select("id", F.explode(F.regexp_extract_all("answer", F.lit("[0-9]+"), F.lit(0))).alias("p")).select("id", F.col("p").cast("long").alias("position")).distinct()
    hit = paths.join(named, ["id", "position"], "left_semi").withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("position"))).filter(F.col("_r") <= most)
    rest = paths.join(hit.select("id").distinct(), "id", "left_anti")
    return hit.select("id", "position", "path").unionByName(rest.select("id", "position", "path"))
