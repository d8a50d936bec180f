"""The prize-collecting tree: moats grow with prizes as budgets, tight edges join them, and the best subtree stays; all in joins by rounds."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.lineage import written
from graphloom.operators import graph as G

#: times and worths this close are equal
CLOSE = 1e-9


def _tight(edges: DataFrame, nodes: DataFrame, moats: DataFrame, n: int) -> DataFrame:
    """Edges between moats with the time ``at`` at which both sides together cover the cost; those that never do are left out.

    A moat grows at one unit a unit of time from ``since`` until its budget ``left`` is used up, so an edge's time follows
    from its two moats alone.
    """
    side = nodes.join(G.of_size(moats, n), "moat").select("node", "moat", "base", "since", "left")
    a = side.select(F.col("node").alias("src"), F.col("moat").alias("m1"), F.col("base").alias("b1"), F.col("since").alias("s1"), F.col("left").alias("l1"))
    b = side.select(F.col("node").alias("tgt"), F.col("moat").alias("m2"), F.col("base").alias("b2"), F.col("since").alias("s2"), F.col("left").alias("l2"))
    e = edges.join(G.of_size(a, n), "src").join(G.of_size(b, n), "tgt").filter("m1 <> m2")
    # both sides from the later start on: what the earlier one has grown by then is taken off
    start = F.greatest("s1", "s2")
    g1, g2 = F.least(start - F.col("s1"), F.col("l1")), F.least(start - F.col("s2"), F.col("l2"))
    need = F.greatest(F.col("cost") - F.col("b1") - F.col("b2") - g1 - g2, F.lit(0.0))
    short, long = F.least(F.col("l1") - g1, F.col("l2") - g2), F.greatest(F.col("l1") - g1, F.col("l2") - g2)
    wait = F.when(need <= 2 * short + CLOSE, need / 2).when(need <= short + long + CLOSE, need - short)
    return e.withColumn("at", start + wait).filter("at is not null").select("scope", "src", "tgt", "cost", "m1", "m2", "at")


def grow(nodes: DataFrame, edges: DataFrame, window: float = 0.0) -> DataFrame:
    """The forest (scope, src, tgt, cost) of the edges that joined moats; each scope is a graph of its own.

    ``nodes`` (scope, node, prize >= 0), ``edges`` (scope, src, tgt, cost >= 0) without self-loops or repeats, names unique over scopes. Each round takes a
    scope's earliest time at which an edge is tight, and with it all edges tight up to (1 + window) times that: 0 keeps the exact
    order, a larger window bounds the number of rounds by the logarithm of the ratio of times and weakens the guarantee by as
    much. Each moat picks its first tight edge, so what is picked has no circle, and the moats that picked edges join are one
    moat with what is left of their budgets.
    """
    at = written(nodes.select("node", F.col("node").alias("moat"), F.lit(0.0).alias("base")))
    moats = written(nodes.select(F.col("node").alias("moat"), F.lit(0.0).alias("since"), F.col("prize").cast("double").alias("left")))
    n = at.count()
    left, found = edges.select("scope", "src", "tgt", F.col("cost").cast("double").alias("cost")), []
    for r in count():
        tight = written(_tight(left, at, moats, n))
        first = tight.groupBy("scope").agg((F.min("at") * (1 + window) + CLOSE).alias("until"))
        both = tight.join(first, "scope").filter("at <= until").select(F.explode(F.array("m1", "m2")).alias("moat"), F.struct("at", "src", "tgt", "scope", "cost", "m1", "m2").alias("e"))
        picked = written(both.groupBy("moat").agg(F.min("e").alias("e")).select("e.*").distinct())
        few = 2 * picked.count()
        if not few:
            break
        found.append(picked.select("scope", "src", "tgt", "cost"))
        joined = G.connected_components(picked.select(F.col("m1").alias("src"), F.col("m2").alias("tgt"))).withColumnRenamed("node", "moat")
        when = picked.select(F.col("m1").alias("moat"), "at").join(G.of_size(joined, few), "moat").groupBy("component").agg(F.max("at").alias("at"))
        # the joined moats' time is that of their last edge; each has grown until then, or as far as its budget went
        grown = G.of_size(joined.join(G.of_size(when, few), "component"), few).join(moats, "moat").withColumn("by", F.least(F.greatest(F.col("at") - F.col("since"), F.lit(0.0)), F.col("left")))
        grown = written(grown)
        at = written(at.join(G.of_size(grown.select("moat", "component", "by"), few), "moat", "left").select("node", F.coalesce("component", "moat").alias("moat"), (F.col("base") + F.coalesce("by", F.lit(0.0))).alias("base")))
        new = grown.groupBy(F.col("component").alias("moat")).agg(F.max("at").alias("since"), F.sum(F.col("left") - F.col("by")).alias("left"))
        moats = written(moats.join(G.of_size(grown.select("moat"), few), "moat", "left_anti").unionByName(new))
        if r % 8 == 7:  # edges within a moat are of no more use
            a, b = at.select(F.col("node").alias("src"), F.col("moat").alias("_a")), at.select(F.col("node").alias("tgt"), F.col("moat").alias("_b"))
            left = written(left.join(G.of_size(a, n), "src").join(G.of_size(b, n), "tgt").filter("_a <> _b").select("scope", "src", "tgt", "cost"))
    return written(reduce(DataFrame.unionByName, found)) if found else edges.select("scope", "src", "tgt", "cost").limit(0)


def prune(nodes: DataFrame, forest: DataFrame) -> DataFrame:
    """Of each scope, the connected part of ``forest`` whose prizes exceed its costs by most: scope, node, prize, parent and cost (null at its top), worth.

    Leaves are peeled off round by round; a leaf adds what its branch is worth beyond its edge to the node it hangs on. Of parts
    of equal worth the one with the least name at its top stays. No nodes give no rows.
    """
    worth = written(nodes.select("node", F.col("prize").cast("double").alias("worth")))
    n = worth.count()
    left, done = written(forest.select("src", "tgt", "cost")), []
    while True:
        few = 2 * left.count()
        if not few:
            break
        ways = G.adjacency(left)
        leaves = ways.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("tgt").alias("parent"), F.min("cost").alias("cost")).filter("n = 1")
        # of two leaves on one edge the one with the larger name hangs on the other
        other = leaves.select(F.col("node").alias("parent"), F.lit(1).alias("leaf"))
        peeled = leaves.join(G.of_size(other, few), "parent", "left").filter("leaf is null or node > parent")
        peeled = G.of_size(peeled, few).join(worth, "node")
        peeled = written(peeled.select("node", "parent", "cost", (F.col("worth") - F.col("cost") > CLOSE).alias("keep"), (F.col("worth") - F.col("cost")).alias("gain")))
        gain = peeled.filter("keep").groupBy(F.col("parent").alias("node")).agg(F.sum("gain").alias("gain"))
        worth = written(worth.join(G.of_size(gain, few), "node", "left").select("node", (F.col("worth") + F.coalesce("gain", F.lit(0.0))).alias("worth")))
        done.append(peeled)
        gone = peeled.select(F.least("node", "parent").alias("src"), F.greatest("node", "parent").alias("tgt"))
        left = written(G.canonical(left).join(G.of_size(gone, few), ["src", "tgt"], "left_anti"))
    best = F.row_number().over(W.partitionBy("scope").orderBy(F.desc(F.round("worth", 9)), "node"))
    top = worth.join(G.of_size(nodes.select("scope", "node"), n), "node").withColumn("best", best).filter("best = 1")
    last = written(top.select("node", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("cost")))
    chosen = [last]
    branches = written(reduce(DataFrame.unionByName, done).filter("keep").select("node", "parent", "cost")) if done else None
    while done:
        last = written(branches.join(G.of_size(last.select(F.col("node").alias("parent")), last.count()), "parent").select("node", "parent", "cost"))
        if last.isEmpty():
            break
        chosen.append(last)
    out = reduce(DataFrame.unionByName, chosen)
    return out.join(G.of_size(nodes, n), "node").join(G.of_size(worth, n), "node").select("scope", "node", "prize", "parent", "cost", F.round("worth", 9).alias("worth"))


def prize_tree(nodes: DataFrame, edges: DataFrame, window: float = 0.0) -> DataFrame:
    """node, prize, parent, cost, worth of the tree found by :func:`grow` and :func:`prune`; with a column ``scope`` in both frames, one tree a scope.

    ``nodes`` (node, prize), ``edges`` (src, tgt, cost) in any order: ends without a prize have none, negative and null prizes count as
    0, null costs too; of repeated edges the cheapest counts, self-loops don't. Costs of the tree plus prizes left out are at most about
    twice the least possible ones, at ``window`` 0. Without nodes there are no rows; with no edges the node of the largest prize stays.
    """
    scoped, mark = "scope" in nodes.columns, F.lit("\u0001")
    scope = F.col("scope").cast("string") if scoped else F.lit("")
    inner = lambda c: F.concat(scope, mark, F.col(c))
    e = edges.select(scope.alias("scope"), inner("src").alias("src"), inner("tgt").alias("tgt"), F.greatest(F.coalesce("cost", F.lit(0.0)), F.lit(0.0)).cast("double").alias("cost"))
    e = written(G.canonical(e).filter("src < tgt").groupBy("scope", "src", "tgt").agg(F.min("cost").alias("cost")))
    given = nodes.select(scope.alias("scope"), inner("node").alias("node"), F.greatest(F.coalesce("prize", F.lit(0.0)), F.lit(0.0)).cast("double").alias("prize"))
    ends = e.select("scope", F.explode(F.array("src", "tgt")).alias("node"), F.lit(0.0).alias("prize"))
    n = written(given.unionByName(ends).filter("node is not null").groupBy("scope", "node").agg(F.max("prize").alias("prize")))
    out = prune(n, grow(n, e, window))
    plain = lambda c: F.element_at(F.split(c, "\u0001"), -1).alias(c)
    return out.select(*([F.col("scope")] if scoped else []), plain("node"), "prize", plain("parent"), "cost", "worth")
