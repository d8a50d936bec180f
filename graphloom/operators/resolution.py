"""Free-form names to nodes by a ranked cascade, with a token index for what isn't found as it is; and the chunks of such names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.lineage import written

#: fixed value: a name of this form is a chunk's id already
CHUNK_ID = r"(?i)^\s*chunk[_-][a-z0-9]+\s*$"
NONE = "array<string>"


def _compact(c: Column) -> Column:
    return F.trim(F.regexp_replace(T.clean(c), " +", " "))


def _node_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))


def token_index(nodes: DataFrame) -> DataFrame:
    """token, df, entity_name, tokens: a posting for each distinct token of each name, with the number of names that have it."""
    own = nodes.select("entity_name").filter("entity_name is not null").distinct().withColumn("tokens", _node_tokens(F.col("entity_name")))
    posted = own.withColumn("token", F.explode("tokens"))
    return posted.join(posted.groupBy("token").agg(F.count("*").alias("df")), "token").select("token", "df", "entity_name", "tokens")


def nearest_names(index: DataFrame, asked: DataFrame) -> DataFrame:
    """name, entity_name, shared, n: the node that shares most of the name's tokens; of equal ones that of fewest tokens, then characters, then the least name.

    ``asked``: name, tokens. A name's tokens are looked up from the rarest on. A node without any of the r rarest shares at most the rest, so once
    more than that has been found the name is settled: common tokens' postings are read for unsettled names only, and
    tokens of no node are never looked up.
    """
    df = index.groupBy("token").agg(F.first("df").alias("df"))
    each = asked.select("name", "tokens", F.explode("tokens").alias("token")).join(df, "token")
    known = each.groupBy("name").agg(F.first("tokens").alias("tokens"), F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("rare"))
    left, best = written(known), None
    done = []
    most = left.agg(F.max(F.size("rare"))).first()[0] or 0
    for r in range(1, most + 1):
        ask = left.withColumn("token", F.element_at("rare", r))
        hit = ask.join(index.select("token", "entity_name", F.col("tokens").alias("own")), "token")
        key = F.struct((-F.size(F.array_intersect("tokens", "own"))).alias("lost"), F.size("own").alias("m"), F.length("entity_name").alias("chars"), "entity_name")
        found = hit.groupBy("name").agg(F.min(key).alias("best"))
        merged = left.drop("best").join(found, "name", "left") if best is None else left.withColumnRenamed("best", "old").join(found, "name", "left").withColumn("best", F.least("old", "best")).drop("old")
        best = written(merged)
        settled = (-F.col("best.lost") > F.size("rare") - r) | (F.size("rare") == r)
        done.append(best.filter(settled))
        left = written(best.filter(~settled))
        if left.isEmpty():
            break
    if not done:
        return asked.selectExpr("name", "name AS entity_name", "0 AS shared", "0 AS n").limit(0)
    return reduce(DataFrame.unionByName, done).select("name", F.col("best.entity_name").alias("entity_name"), (-F.col("best.lost")).alias("shared"), F.size("tokens").alias("n"))


def resolve_ids(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """name, entity_name, how: the node that each name means.

    In this order: ``chunk`` (the name is a chunk's id, entity_name is null), ``exact``, ``clean`` (the name in lower case with other marks blanked),
    ``compact`` (with single spaces), ``subset`` (a node with all the name's tokens: fewest tokens, then characters, then the least name),
    ``partial`` (most tokens in common, then as before), ``none``. Names that begin with 'chunk ' once cleaned, and those without letters or digits, are found exactly or
    cleaned only. Null names are left out.
    """
    asked = names.select("name").filter("name is not null").distinct().withColumns({"clean": T.clean(F.col("name")), "compact": _compact(F.col("name"))})
    own = nodes.select("entity_name").distinct()
    forms = F.filter(F.array(F.struct(F.lit(1).alias("at"), F.col("name").alias("form")), F.struct(F.lit(2).alias("at"), F.col("clean").alias("form")), F.struct(F.lit(3).alias("at"), F.when(~F.startswith(F.concat("compact", F.lit(" ")), F.lit("chunk ")), F.col("compact")).alias("form"))), lambda x: x["form"].isNotNull())
    tried = asked.filter(~F.rlike("name", F.lit(CHUNK_ID))).select("name", "compact", F.explode(forms).alias("x")).select("name", "x.*")
    direct = written(tried.join(own.withColumnRenamed("entity_name", "form"), "form").groupBy("name").agg(F.min(F.struct("at", F.col("form").alias("entity_name"))).alias("b")).select("name", "b.*"))
    open_ = asked.filter(~F.rlike("name", F.lit(CHUNK_ID)) & (F.col("compact") != "") & ~F.startswith(F.concat("compact", F.lit(" ")), F.lit("chunk "))).join(direct, "name", "left_anti")
    near = nearest_names(written(token_index(nodes)), open_.select("name", F.array_distinct(F.split("compact", " ")).alias("tokens")))
    ways = direct.select("name", "entity_name", F.element_at(F.array(F.lit("exact"), F.lit("clean"), F.lit("compact")), F.col("at")).alias("how"))
    ways = ways.unionByName(near.select("name", "entity_name", F.when(F.col("shared") == F.col("n"), "subset").otherwise("partial").alias("how")))
    rest = F.when(F.rlike("name", F.lit(CHUNK_ID)), "chunk").otherwise("none")
    return asked.select("name").join(ways, "name", "left").select("name", "entity_name", F.coalesce("how", rest).alias("how"))


def chunks_of_names(nodes: DataFrame, edges: DataFrame, names: DataFrame, chunks: DataFrame, cap: int | None = None) -> DataFrame:
    """name, entity_name, chunk_id, content: the chunks that each name's node was found in, its neighbours that are chunks, and names that are chunk ids.

    ``nodes``: entity_name, entity_type, source_ids. Up to ``cap`` chunks a name, sources in their order before neighbours by name. Chunks not in ``chunks`` are left out after the
    cap, as are names that mean no node.
    """
    found = written(resolve_ids(nodes.select("entity_name"), names))
    direct = found.filter("how = 'chunk'").select("name", F.lit(None).cast("string").alias("entity_name"), F.trim("name").alias("chunk_id"), F.lit(0).alias("side"), F.lit(0).alias("at"))
    hit = found.filter("entity_name is not null").select("name", "entity_name")
    source = hit.join(nodes.select("entity_name", F.posexplode("source_ids").alias("at", "chunk_id")), "entity_name").select("name", "entity_name", "chunk_id", F.lit(0).alias("side"), "at")
    ends = edges.select(F.explode(F.array(F.struct("src", "tgt"), F.struct(F.col("tgt").alias("src"), F.col("src").alias("tgt")))).alias("e")).select(F.col("e.src").alias("entity_name"), F.col("e.tgt").alias("chunk_id")).distinct()
    beside = ends.join(nodes.filter("entity_type = 'chunk'").select(F.col("entity_name").alias("chunk_id")), "chunk_id", "left_semi")
    beside = hit.join(beside, "entity_name").select("name", "entity_name", "chunk_id", F.lit(1).alias("side"), F.lit(0).alias("at"))
    rows = direct.unionByName(source).unionByName(beside).groupBy("name", "entity_name", "chunk_id").agg(F.min(F.struct("side", "at")).alias("o"))
    if cap is not None:
        rows = rows.withColumn("_r", F.row_number().over(W.partitionBy("name").orderBy("o", "chunk_id"))).filter(F.col("_r") <= cap)
    return rows.join(chunks.select("chunk_id", "content"), "chunk_id").select("name", "entity_name", "chunk_id", "content")
