"""Communities: clustering, schema, reports and lookups. Membership is (node, level, cluster)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import vectors as V
from graphloom.lineage import cut
from graphloom.operators import graph as G


def propagate_labels(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, label) by weighted label propagation with a damped start, ties to the least label.

    Deterministic: even and odd nodes (by hash) take turns, so two ends don't swap labels for ever.
    """
    adj = cut(G.adjacency(edges.select("src", "tgt", "weight")))
    label = cut(adj.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    for i in range(rounds):
        votes = adj.join(label.withColumnRenamed("node", "tgt"), "tgt").groupBy("src", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("new"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2
        label = cut(label.join(best, "node", "left").select("node", F.when(turn & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("label")).alias("label")))
    return label


def cluster(edges: DataFrame, most: int = 10, levels: int = 4) -> DataFrame:
    """Hierarchical membership: level 0 by label propagation; clusters of over ``most`` nodes are clustered again inside, level by level."""
    out, at, scope = None, edges.select("src", "tgt", "weight"), None
    for level in range(levels):
        label = propagate_labels(at)
        if scope is None:
            own = label.select("node", F.lit(level).alias("level"), F.col("label").alias("cluster"))
        else:
            own = label.join(scope, "node").select("node", F.lit(level).alias("level"), F.concat_ws("/", "_s", "label").alias("cluster"))
        own = cut(own)
        out = own if out is None else out.unionByName(own)
        size = own.groupBy("cluster").agg(F.count("*").alias("n"))
        parents = scope.groupBy("_s").agg(F.count("*").alias("p")) if scope is not None else None
        large = size.filter(F.col("n") > most).select("cluster")
        if parents is not None:  # a cluster that didn't split won't on another try
            large = large.join(size, "cluster").join(own.select("cluster", "node").join(scope, "node").groupBy("cluster").agg(F.first("_s").alias("_s")), "cluster").join(parents, "_s").filter("n < p").select("cluster")
        members = cut(own.join(large, "cluster", "left_semi").select("node", F.col("cluster").alias("_s")))
        if members.isEmpty():
            break
        a, b = members.select(F.col("node").alias("src"), F.col("_s").alias("_a")), members.select(F.col("node").alias("tgt"), F.col("_s").alias("_b"))
        at = cut(at.join(a, "src").join(b, "tgt").filter("_a = _b").select("src", "tgt", "weight"))
        scope = members
    return out


def inner_clusters(membership: DataFrame) -> DataFrame:
    """level, cluster, sub: the clusters of the next level whose nodes all lie in a cluster."""
    m = membership.select("node", "level", "cluster").distinct()
    up, down = m.alias("u"), m.alias("d")
    shared = up.join(down, F.col("u.node") == F.col("d.node")).filter("d.level = u.level + 1").groupBy(F.col("u.level").alias("level"), F.col("u.cluster").alias("cluster"), F.col("d.level").alias("_l"), F.col("d.cluster").alias("sub")).agg(F.count("*").alias("_n"))
    size = m.groupBy(F.col("level").alias("_l"), F.col("cluster").alias("sub")).agg(F.count("*").alias("_m"))
    return shared.join(size, ["_l", "sub"]).filter("_n = _m").select("level", "cluster", "sub")


def schema(membership: DataFrame, edges: DataFrame, node_chunks: DataFrame) -> DataFrame:
    """Per (level, cluster): n_nodes, n_edges (with an end in it), n_chunks, occurrence = chunks / most chunks, sub_communities.

    A sub-community is a cluster of the next level whose nodes all lie in it.
    """
    m = membership.select("node", "level", "cluster").distinct()
    base = m.groupBy("level", "cluster").agg(F.count("*").alias("n_nodes"))
    ends = edges.select("src", "tgt", F.explode(F.array("src", "tgt")).alias("node")).join(m, "node").select("level", "cluster", "src", "tgt").distinct()
    e = ends.groupBy("level", "cluster").agg(F.count("*").alias("n_edges"))
    c = m.join(node_chunks.select(F.col("entity_name").alias("node"), "chunk_id"), "node").groupBy("level", "cluster").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    whole = inner_clusters(m)
    subs = whole.groupBy("level", "cluster").agg(F.array_join(F.array_sort(F.collect_set("sub")), ",").alias("sub_communities"))
    out = base.join(e, ["level", "cluster"], "left").join(c, ["level", "cluster"], "left").join(subs, ["level", "cluster"], "left").fillna(0, ["n_edges", "n_chunks"]).fillna("", ["sub_communities"])
    top = F.broadcast(out.agg(F.max("n_chunks").alias("_top")))
    return out.crossJoin(top).select("level", "cluster", "n_nodes", "n_edges", "n_chunks", F.round(F.when(F.col("_top") == 0, 0.0).otherwise(F.col("n_chunks") / F.col("_top")), 6).alias("occurrence"), "sub_communities")


def from_entities(membership: DataFrame, seeds: DataFrame, reports: DataFrame, level: int, budget: int | None = None, single: bool = False) -> DataFrame:
    """Communities of the seeds up to ``level``: cluster, hits, rating, tokens; by (hits, rating) falling, within the budget."""
    hit = membership.filter(F.col("level") <= level).join(seeds.select(F.col("entity_name").alias("node")), "node").groupBy("cluster").agg(F.count("*").alias("hits"))
    out = hit.join(reports.select("cluster", "rating", F.size(T.words(F.col("report_string"))).cast("long").alias("tokens")), "cluster")
    order = [F.desc("hits"), F.desc("rating"), F.col("cluster")]
    if budget is not None:
        out = out.withColumn("_ok", V.within_budget(F.col("tokens"), order, budget)).filter("_ok").drop("_ok")
    return out.orderBy(*order).limit(1) if single else out


def from_level(reports: DataFrame, level: int, most: int, min_rating: float = 0.0) -> DataFrame:
    """The ``most`` communities up to ``level`` by occurrence, those rated at least ``min_rating``, by (occurrence, rating) falling."""
    top = reports.filter(F.col("level") <= level).orderBy(F.desc("occurrence"), "cluster").limit(most)
    return top.filter(F.col("rating") >= min_rating).select("cluster", "level", "occurrence", "rating")


def detect(membership: DataFrame, seeds: DataFrame, reports: DataFrame, k: int = 5) -> DataFrame:
    """Communities by the number of seeds among their nodes, then occurrence."""
    hit = membership.join(seeds.select(F.col("entity_name").alias("node")).distinct(), "node").groupBy("cluster").agg(F.countDistinct("node").alias("overlap"))
    return hit.join(reports.select("cluster", "occurrence"), "cluster").orderBy(F.desc("overlap"), F.desc("occurrence"), "cluster").limit(k)


def layer(reports: DataFrame, depth: int) -> DataFrame:
    """Communities with level <= depth and their place in the order (level as text, occurrence falling)."""
    w = W.orderBy(F.col("level").cast("string"), F.desc("occurrence"), "cluster")
    return reports.filter(F.col("level") <= depth).select("cluster", "level", "occurrence", F.row_number().over(w).alias("place"))


def render_report(title: Column, summary: Column, findings: Column) -> Column:
    """A report as text: title, summary, then every finding (struct summary, explanation) under its own heading."""
    parts = F.transform(findings, lambda f: F.concat(F.lit("## "), f["summary"], F.lit("\n\n"), f["explanation"]))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), summary, F.array_join(parts, "\n\n"))


def describe(membership: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int, reports: DataFrame | None = None) -> DataFrame:
    """Per cluster the packed description: nodes by degree and edges by degree sum, each within half the budget: cluster, kind, item, place.

    Where a cluster's nodes don't fit and sub-community ``reports`` (cluster, sub, report_string) are
    given, these come first and the covered items last.
    """
    d = G.degree(edges).select(F.col("node"), "degree")
    n = membership.join(nodes.select(F.col("entity_name").alias("node"), "description"), "node").join(d, "node", "left").fillna(0, ["degree"])
    rows = n.select("cluster", F.lit("node").alias("kind"), F.concat_ws(",", "node", "description").alias("item"), F.col("degree").alias("rank"))
    e = G.edge_degree(edges).join(membership.select(F.col("node").alias("src"), F.col("cluster")), "src").join(membership.select(F.col("node").alias("tgt"), F.col("cluster").alias("_c")), "tgt").filter("cluster = _c")
    rows = rows.unionByName(e.select("cluster", F.lit("edge").alias("kind"), F.concat_ws(",", "src", "relation", "tgt").alias("item"), "rank"))
    w = W.partitionBy("cluster", "kind").orderBy(F.desc("rank"), "item")
    size = F.size(T.words(F.col("item"))).cast("long")
    packed = rows.withColumns({"place": F.row_number().over(w), "_sum": F.sum(size).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))}).filter(F.col("_sum") <= budget // 2).select("cluster", "kind", "item", "place")
    if reports is None:
        return packed
    cut_off = rows.groupBy("cluster").agg(F.count("*").alias("all")).join(packed.groupBy("cluster").agg(F.count("*").alias("own")), "cluster", "left").filter(F.coalesce("own", F.lit(0)) < F.col("all")).select("cluster")
    subs = reports.join(cut_off, "cluster", "left_semi").select("cluster", F.lit("report").alias("kind"), F.col("report_string").alias("item"), (-F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("sub")))).alias("place"))
    return packed.unionByName(subs)
