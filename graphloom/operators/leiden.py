"""Communities by the Leiden method as joins: moves by modularity gain, refinement, contraction, and a bound on cluster size.

Graphs are undirected; an edge counts once, parallel edges add up, missing weights count 1 and self-loops are kept. ``scope`` names
the part of the graph a node belongs to: parts are clustered at once, each with its own total weight and resolution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.lineage import written
from graphloom.operators import graph as G

#: gains up to this share of a weight are rounding
ROUNDING = 1e-9


def weighted(edges: DataFrame) -> DataFrame:
    """src < tgt or a self-loop, with the sum of weights."""
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    return G.canonical(edges.select("src", "tgt", weight.alias("weight"))).groupBy("src", "tgt").agg(F.sum("weight").alias("weight"))


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of ``membership`` (node, cluster) on ``edges``; nodes without a cluster are each their own. No edges give null."""
    member = membership.select("node", F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("cluster"))
    e = weighted(edges)
    own = lambda end, name: member.select(F.col("node").alias(end), F.col("cluster").alias(name))
    e = e.join(own("src", "_a"), "src", "left").join(own("tgt", "_b"), "tgt", "left")
    a, b = F.coalesce("_a", F.concat(F.lit("n"), F.col("src"))), F.coalesce("_b", F.concat(F.lit("n"), F.col("tgt")))
    ends = e.select(F.explode(F.array(F.struct(a.alias("c"), (a == b).alias("inside")), F.struct(b.alias("c"), (a == b).alias("inside")))).alias("x"), "weight")
    per = ends.groupBy("x.c").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("x.inside"), F.col("weight"))).alias("inside"))
    # squares are divided by the total once it's known
    return per.agg(F.sum("k").alias("m2"), F.coalesce(F.sum("inside"), F.lit(0.0)).alias("inside"), F.sum(F.col("k") * F.col("k")).alias("squares"), F.count("*").alias("n_clusters")).select(
        F.round((F.col("inside") - resolution * F.col("squares") / F.col("m2")) / F.col("m2"), 9).alias("modularity"), "n_clusters")


def _nodes(edges: DataFrame, gamma: DataFrame | None, scope: DataFrame | None, n: int) -> DataFrame:
    """node, scope, strength, pull = resolution x strength / total strength of the scope."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("strength"))
    ends = ends.withColumn("scope", F.lit("")) if scope is None else ends.join(G.of_size(scope, n), "node")
    total = ends.groupBy("scope").agg(F.sum("strength").alias("m2"))
    total = total.withColumn("gamma", F.lit(1.0)) if gamma is None else total.join(gamma, "scope")
    return ends.join(total, "scope").select("node", "scope", "strength", (F.col("gamma") * F.col("strength") / F.col("m2")).alias("pull"))


def _wishes(adj: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """``state`` with alone (nobody else is in a node's cluster), stay (gain of being where it is) and top (loss, cluster, alone): the
    best other cluster it has an edge to, of equal ones the least name. ``n``: no fewer than the nodes, as in all steps below."""
    there = state.select(F.col("node").alias("tgt"), "cluster")
    to = adj.join(G.of_size(there, n), "tgt").groupBy(F.col("src").alias("node"), "cluster").agg(F.sum("weight").alias("w"))
    own = state.select("node", F.col("cluster").alias("own"), "strength", "pull")
    totals = state.groupBy("cluster").agg(F.sum("strength").alias("total"), F.count("*").alias("n"))
    is_own = F.col("cluster") == F.col("own")
    gain = F.col("w") - F.col("pull") * (F.col("total") - F.when(is_own, F.col("strength")).otherwise(0.0))
    stay = state.select("node", "cluster", F.lit(0.0).alias("w"))
    ways = to.unionByName(stay).groupBy("node", "cluster").agg(F.sum("w").alias("w")).join(G.of_size(own, n), "node").join(G.of_size(totals, n), "cluster")
    ways = ways.select("node", "own", "cluster", (F.col("n") == 1).alias("alone"), gain.alias("gain"))
    best = ways.groupBy("node").agg(
        F.max(F.when(is_own, F.col("gain"))).alias("stay"), F.max(F.when(is_own, F.col("alone"))).alias("alone"),
        F.min(F.when(~is_own, F.struct((-F.col("gain")).alias("loss"), "cluster", "alone"))).alias("top"))
    return state.join(G.of_size(best, n), "node")


def _move(adj: DataFrame, state: DataFrame, rounds: int, n: int) -> DataFrame:
    """Moves to the cluster of the largest gain, in rounds. A share of the nodes (by hash) has its turn, so that two ends
    don't swap; a round that lowers the quality is taken back and the share halved."""
    best, kept, share = None, None, 2
    for r in range(rounds + 1):
        wish = written(_wishes(adj, state, n))
        # of two nodes alone only the one with the larger cluster name joins the other
        wants = F.col("top").isNotNull() & (-F.col("top.loss") > F.col("stay") + ROUNDING) & ~(F.col("alone") & F.col("top.alone") & (F.col("top.cluster") > F.col("cluster")))
        # what modularity is in proportion to
        now, wishes = wish.agg(F.coalesce(F.sum("stay"), F.lit(0.0)), F.count_if(F.coalesce(wants, F.lit(False)))).first()
        if best is not None and now < best - ROUNDING * (1 + abs(best)):
            share *= 2
            if share > 16:
                return kept[0]
            state, wish = kept
            wishes = 1
        else:
            if best is not None and not wishes or r == rounds:
                return state
            best, kept = now, (state, wish)
        if not wishes:
            return state
        turn = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(share)) == 0
        state = wish.select("node", "scope", "strength", "pull", F.when(wants & turn, F.col("top.cluster")).otherwise(F.col("cluster")).alias("cluster"))
    return kept[0]


def _refine(adj: DataFrame, state: DataFrame, rounds: int, n: int) -> DataFrame:
    """Within each cluster, nodes that are still alone join a neighbouring group with gain; a group so stays connected.

    Nodes with a turn join groups that have other nodes or none with a turn. Returns ``state`` with column ``part``.
    """
    own = state.select(F.col("node").alias("tgt"), F.col("cluster").alias("_c"))
    inside = written(adj.join(G.of_size(state.select(F.col("node").alias("src"), "cluster"), n), "src").join(G.of_size(own, n), "tgt").filter("cluster = _c").select("src", "tgt", "weight"))
    part = state.withColumns({"whole": F.col("cluster"), "cluster": F.col("node")})
    for r in range(rounds):
        turn = lambda c, r=r: F.pmod(F.xxhash64(c, F.lit(r), F.lit("part")), F.lit(2)) == 0
        wish = _wishes(inside, part, n)
        # a group of one is named by its node: it may be joined unless that node has its turn
        goes = F.col("alone") & turn("node") & F.col("top").isNotNull() & (-F.col("top.loss") > F.col("stay") + ROUNDING) & ~(F.col("top.alone") & turn("top.cluster"))
        part = written(wish.select("node", "scope", "strength", "pull", "whole", F.when(goes, F.col("top.cluster")).otherwise(F.col("cluster")).alias("cluster")))
    return part.select("node", "scope", "strength", "pull", F.col("whole").alias("cluster"), F.col("cluster").alias("part"))


def leiden(edges: DataFrame, scope: DataFrame | None = None, gamma: DataFrame | None = None, rounds: int = 8, levels: int = 5) -> DataFrame:
    """node, cluster (named by one of its nodes), the same at each run: clusters are connected and of high modularity.

    ``scope`` (node, scope) parts the graph, ``gamma`` (scope, gamma) gives a part's resolution instead of 1; edges between parts must not be
    in ``edges``. Each level moves nodes, refines the clusters into connected groups and contracts these to nodes, which start
    in the clusters found; it ends when nothing more is contracted. Nodes without edges are absent. Every round
    is joins and sums on node and cluster names; only two numbers a round come to the driver.
    """
    graph = written(weighted(edges))
    n = whole = 2 * graph.count()
    nodes = written(_nodes(graph, gamma, scope, n))
    state = nodes.withColumn("cluster", F.col("node"))
    place = nodes.select("node", F.col("node").alias("at"))
    for level in range(levels):
        adj = written(G.adjacency(graph.filter("src <> tgt")))
        state = _move(adj, state, rounds if level == 0 else rounds // 2, n)
        state = written(state)
        many, clusters = state.agg(F.count("*"), F.countDistinct("cluster")).first()
        if many == clusters:
            break
        parts = _refine(adj, state, 3, n)
        where = parts.select(F.col("node").alias("at"), "part", "cluster")
        place = written(place.join(G.of_size(where, n), "at").select("node", F.col("part").alias("at"), "cluster"))
        next_nodes = parts.groupBy(F.col("part").alias("node")).agg(F.first("scope").alias("scope"), F.sum("strength").alias("strength"), F.sum("pull").alias("pull"), F.min("cluster").alias("cluster"))
        next_nodes = written(next_nodes)
        if next_nodes.count() == many:
            break
        a, b = parts.select(F.col("node").alias("src"), F.col("part").alias("_a")), parts.select(F.col("node").alias("tgt"), F.col("part").alias("_b"))
        graph = written(weighted(graph.join(G.of_size(a, n), "src").join(G.of_size(b, n), "tgt").select(F.col("_a").alias("src"), F.col("_b").alias("tgt"), "weight")))
        n = 2 * graph.count()
        state, place = next_nodes, place.select("node", "at")
    label = place.join(G.of_size(state.select(F.col("node").alias("at"), F.col("cluster")), n), "at").select("node", "cluster") if "cluster" not in place.columns else place.select("node", "cluster")
    return _connected(edges, written(label), whole)


def _connected(edges: DataFrame, label: DataFrame, n: int) -> DataFrame:
    """Clusters that moves at once have left in parts become one cluster a part, which never lowers modularity."""
    a, b = label.select(F.col("node").alias("src"), F.col("cluster").alias("_a")), label.select(F.col("node").alias("tgt"), F.col("cluster").alias("_b"))
    inside = edges.select("src", "tgt").join(G.of_size(a, n), "src").join(G.of_size(b, n), "tgt").filter("_a = _b").select("src", "tgt")
    joined = G.connected_components(inside)
    return written(label.select("node").join(G.of_size(joined, n), "node", "left").select("node", F.coalesce("component", "node").alias("cluster")))


def hierarchical_leiden(edges: DataFrame, most: int = 10, levels: int = 20, rounds: int = 8) -> DataFrame:
    """node, level, cluster, parent, final: level 0 covers the graph; clusters of over ``most`` nodes are clustered again inside, level by level.

    A cluster that doesn't split is tried at twice the resolution, so at the last level no cluster holds over ``most`` nodes
    (``levels`` is a stop for graphs where that takes more than 2**levels the resolution). ``final`` marks the level at which a
    node's cluster isn't split again. Cluster names are unique across levels; deterministic.
    """
    graph = written(weighted(edges))
    n = 2 * graph.count()
    found = leiden(graph, rounds=rounds)
    own = written(found.select("node", F.lit(0).alias("level"), F.concat(F.lit("0/"), "cluster").alias("cluster"), F.lit(None).cast("string").alias("parent"), F.lit(1.0).alias("gamma")))
    out = []
    for level in range(1, levels + 1):
        size = own.groupBy("cluster").agg(F.count("*").alias("n"))
        large = written(size.filter(F.col("n") > most))
        if level == levels or large.isEmpty():
            out.append(own.withColumn("final", F.lit(True)))
            break
        out.append(own.join(large.select("cluster", F.lit(1).alias("_l")), "cluster", "left").withColumn("final", F.col("_l").isNull()).drop("_l"))
        inner = written(own.join(large, "cluster", "left_semi"))
        scope = inner.select("node", F.col("cluster").alias("scope"))
        a, b = scope.select(F.col("node").alias("src"), F.col("scope").alias("_a")), scope.select(F.col("node").alias("tgt"), F.col("scope").alias("_b"))
        part = written(graph.join(G.of_size(a, n), "src").join(G.of_size(b, n), "tgt").filter("_a = _b").select("src", "tgt", "weight"))
        gamma = inner.groupBy(F.col("cluster").alias("scope")).agg(F.max("gamma").alias("gamma"))
        next_label = leiden(part, scope, gamma, rounds)
        kids = next_label.join(G.of_size(scope, n), "node")
        split = kids.groupBy("scope").agg((F.countDistinct("cluster") > 1).alias("split"))
        step = F.when(F.col("split"), F.col("gamma")).otherwise(F.col("gamma") * 2)
        own = written(kids.join(split, "scope").join(gamma, "scope").select(
            "node", F.lit(level).alias("level"), F.concat(F.lit(f"{level}/"), "cluster").alias("cluster"), F.col("scope").alias("parent"), step.alias("gamma")))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result.select("node", "level", "cluster", "parent", "final")
