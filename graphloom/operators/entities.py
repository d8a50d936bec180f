"""Entity operators: nodes in, nodes out (entity_name with score or rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import graph as G
from graphloom.operators import retrieval as R


def with_rank(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds the degree as ``rank``, 0 for a node without edges."""
    d = G.degree(edges).select(F.col("node").alias("entity_name"), F.col("degree").alias("rank"))
    return entities.join(d, "entity_name", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def attach_clusters(entities: DataFrame, membership: DataFrame) -> DataFrame:
    """Adds ``clusters``, the sorted 'level:cluster' names of each entity; empty without any."""
    m = membership.groupBy(F.col("node").alias("entity_name")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "level", "cluster"))).alias("clusters"))
    return entities.join(m, "entity_name", "left").withColumn("clusters", F.coalesce("clusters", F.array().cast("array<string>")))


def vdb(vectors: DataFrame, queries: DataFrame, k: int, edges: DataFrame | None = None, membership: DataFrame | None = None) -> DataFrame:
    """Dense top-k: query_id, entity_name, score, rank of the hit; with degree and clusters where given."""
    hits = R.vector_top(vectors, queries, k, "entity_name").withColumnRenamed("rank", "hit")
    if edges is not None:
        hits = with_rank(hits, edges)
    return attach_clusters(hits, membership) if membership is not None else hits


def search_expanded(vectors: DataFrame, queries: DataFrame, expanded: DataFrame, k: int) -> DataFrame:
    """Dense search over a query and its expansions: 2k hits of the query; where fewer than k names, expansions at 0.9 of their score. Best score per name."""
    own = R.vector_top(vectors, queries, 2 * k, "entity_name").select("query_id", "entity_name", "score")
    count = own.groupBy("query_id").agg(F.countDistinct("entity_name").alias("n"))
    short = queries.select("query_id").join(count, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k).select("query_id")
    more = R.vector_top(vectors, expanded.join(short, "query_id", "left_semi"), k, "entity_name").select("query_id", "entity_name", F.round(F.col("score") * 0.9, 6).alias("score"))
    best = own.unionByName(more).groupBy("query_id", "entity_name").agg(F.max("score").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "entity_name")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ppr(edges: DataFrame, seeds: DataFrame, k: int, damping: float = 0.85, iterations: int = 10, chunk_counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(top entities, all scores) of personalised PageRank from seeds (entity_name[, share]).

    Seeds count alike, or by ``share``; with ``chunk_counts`` (entity_name, n) by 1 / n, their specificity. Unknown
    seeds are skipped; the order is by falling score, then name.
    """
    share = F.col("share") if "share" in seeds.columns else F.lit(1.0)
    reset = seeds.select(F.col("entity_name").alias("node"), share.cast("double").alias("share"))
    if chunk_counts is not None:
        reset = reset.join(chunk_counts.select(F.col("entity_name").alias("node"), "n"), "node").select("node", (F.col("share") / F.greatest("n", F.lit(1))).alias("share"))
    scores = G.pagerank(edges, iterations, damping, reset).select(F.col("node").alias("entity_name"), F.round("score", 6).alias("score"))
    return R.top_by(scores, F.col("score"), "entity_name", k), scores


def onehop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct neighbours of the seeds that aren't seeds, with their degree as rank."""
    s = seeds.select(F.col("entity_name").alias("node"))
    near = G.neighbours(edges, s).select(F.col("node").alias("entity_name")).distinct().join(seeds.select("entity_name"), "entity_name", "left_anti")
    return with_rank(near, edges)


def onehop_limited(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """Per seed its neighbours of highest degree: seed, entity_name, rank."""
    near = with_rank(G.neighbours(edges, seeds.select(F.col("entity_name").alias("node"))).withColumnRenamed("node", "entity_name"), edges)
    w = W.partitionBy("seed").orderBy(F.desc("rank"), "entity_name")
    return near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def link(vectors: DataFrame, mentions: DataFrame, threshold: float = -1.0) -> DataFrame:
    """Each mention (query_id, q) to its nearest node: linked_from, entity_name, score, status (linked or not_found)."""
    top = R.vector_top(vectors, mentions, 1, "entity_name")
    out = mentions.select("query_id").join(top, "query_id", "left")
    ok = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return out.select(F.col("query_id").alias("linked_from"), F.when(ok, F.col("entity_name")).alias("entity_name"), F.when(ok, F.col("score")).alias("score"), F.when(ok, "linked").otherwise("not_found").alias("status"))


def tfidf(nodes: DataFrame, query: str, k: int, candidates: DataFrame | None = None) -> DataFrame:
    """Cosine of TF-IDF over 'name type description' without stop words: entity_name, score, tfidf_rank."""
    docs = nodes.select("entity_name", F.concat_ws(" ", "entity_name", "entity_type", "description").alias("text"))
    top = R.Tfidf(docs, "entity_name", "text", T.STOPWORDS).top(query, k, candidates)
    return top.withColumn("tfidf_rank", F.row_number().over(W.orderBy(F.desc("score"), "entity_name")))


def choose_tails(relations: DataFrame, width: int, score: Column | None = None) -> DataFrame:
    """Candidate tails of chosen relations (head, relation, tail): the provider's score, or 1 / n each; zeros go, the widest stay."""
    n = F.count("*").over(W.partitionBy("head", "relation"))
    s = score if score is not None else 1.0 / n
    rated = relations.select("head", "relation", F.col("tail").alias("entity_name"), F.round(s, 6).alias("score")).filter("score > 0")
    return rated.orderBy(F.desc("score"), "entity_name", "head", "relation").limit(width)


def rel_node(edges: DataFrame, edge_id: Column, chosen: DataFrame | None = None, role: str = "both", relations: list[str] | None = None) -> DataFrame:
    """Ends of the chosen edges (edge_id, or 'src->tgt'): entity_name, role (source, target or both), n_edges."""
    e = edges.withColumns({"edge_id": edge_id, "arrow": F.concat_ws("->", "src", "tgt")})
    if chosen is not None:
        ids = chosen.select("edge_id").distinct()
        hit = [e.join(ids.withColumnRenamed("edge_id", "_a"), e[c] == F.col("_a"), "left_semi") for c in ("edge_id", "arrow")]
        e = hit[0].unionByName(hit[1]).distinct()
    if relations:
        e = e.filter(F.col("relation").isin(*relations))
    ends = e.select("edge_id", F.explode(F.array(F.struct(F.col("src").alias("entity_name"), F.lit("source").alias("role")), F.struct(F.col("tgt").alias("entity_name"), F.lit("target").alias("role")))).alias("x")).select("edge_id", "x.*")
    if role != "both":
        ends = ends.filter(F.col("role") == role)
    return ends.groupBy("entity_name").agg(F.when(F.min("role") == F.max("role"), F.min("role")).otherwise("both").alias("role"), F.countDistinct("edge_id").alias("n_edges"))


def id_variants(name: Column) -> Column:
    """Forms of a name in order of preference: itself, cleaned, single-spaced, without kind prefix, without title."""
    c = T.clean(name)
    single = F.trim(F.regexp_replace(c, " +", " "))
    return F.array_distinct(F.array(name, c, single, F.regexp_replace(name, "^[a-z_]+:", ""), F.regexp_replace(single, "^(mr|mrs|ms|dr|sir|the) ", ""), F.translate(name, "_", " ")))


def resolve(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """name to entity_name by the first of its variants that a node has; null where none has."""
    asked = names.select("name").distinct()
    v = asked.select("name", F.posexplode(id_variants(F.col("name"))).alias("pos", "variant"))
    own = nodes.select("entity_name", F.explode(F.array_distinct(F.array(F.col("entity_name"), F.trim(F.regexp_replace(T.clean(F.col("entity_name")), " +", " "))))).alias("variant"))
    best = v.join(own, "variant").groupBy("name").agg(F.min_by("entity_name", F.struct("pos", "entity_name")).alias("entity_name"))
    return asked.join(best, "name", "left")


def resolve_fuzzy(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """name to the node whose tokens hold all of the name's (fewest tokens first), else the one sharing most: name, entity_name, shared."""
    t = names.select("name", F.array_distinct(T.tokens(F.col("name"))).alias("t")).filter(F.size("t") > 0)
    ask = t.select("name", F.size("t").alias("n"), F.explode("t").alias("token"))
    own = nodes.select("entity_name", F.array_distinct(T.tokens(F.col("entity_name"))).alias("o")).select("entity_name", F.size("o").alias("m"), F.explode("o").alias("token"))
    hit = own.join(ask, "token").groupBy("name", "n", "entity_name", "m").agg(F.count("*").alias("shared"))
    best = hit.groupBy("name").agg(F.min_by(F.struct("entity_name", "shared"), F.struct((F.col("shared") < F.col("n")).cast("int"), -F.col("shared"), "m", "entity_name")).alias("b"))
    return best.select("name", "b.entity_name", "b.shared")
