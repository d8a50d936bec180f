"""Graph primitives, traversals, propagation and analytics over (src, tgt, weight) edges.

Edges are undirected, each held once with src <= tgt, unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.lineage import cut, written

#: rows of a counted side of a join up to which it is broadcast
BROADCAST = 10_000


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge in one scan: src, tgt and the other columns."""
    rest = [c for c in edges.columns if c not in ("src", "tgt")]
    way = F.explode(F.array(F.struct("src", "tgt"), F.struct(F.col("tgt").alias("src"), F.col("src").alias("tgt")))).alias("way")
    return edges.select(way, *rest).select("way.src", "way.tgt", *rest)


def of_size(side: DataFrame, n: int) -> DataFrame:
    """A join's side of at most ``n`` rows, counted: it is broadcast up to BROADCAST rows and meets the other side by a shuffle beyond.

    Left to itself Spark goes by the bytes of compressed files, and sends sides that are many times as large to the driver in every round.
    """
    return side.hint("broadcast" if n <= BROADCAST else "merge")


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with src <= tgt."""
    return edges.withColumns({"src": F.least("src", "tgt"), "tgt": F.greatest("src", "tgt")})


def has_nodes(nodes: DataFrame, names: DataFrame) -> DataFrame:
    return nodes.join(names, "entity_name", "left_semi")


def get_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges of the given (src, tgt) pairs, in either order."""
    return edges.join(canonical(pairs).distinct(), ["src", "tgt"])


def degree(edges: DataFrame) -> DataFrame:
    """node, degree; a self-loop counts twice. Nodes without edges are absent (take them as 0)."""
    return edges.select(F.explode(F.array("src", "tgt")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def edge_degree(edges: DataFrame) -> DataFrame:
    """Edges with ``rank``, the sum of their ends' degrees."""
    d = degree(edges)
    a, b = d.select(F.col("node").alias("src"), F.col("degree").alias("_a")), d.select(F.col("node").alias("tgt"), F.col("degree").alias("_b"))
    return edges.join(a, "src").join(b, "tgt").withColumn("rank", F.col("_a") + F.col("_b")).drop("_a", "_b")


def incident(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges with an end among seeds (node), each once."""
    a = edges.join(seeds.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    b = edges.join(seeds.select(F.col("node").alias("tgt")).distinct(), "tgt", "left_semi").join(seeds.select(F.col("node").alias("src")).distinct(), "src", "left_anti")
    return a.unionByName(b)


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node) for every neighbour of every seed."""
    return adjacency(edges.select("src", "tgt")).join(seeds.select(F.col("node").alias("src")).distinct(), "src").select(F.col("src").alias("seed"), F.col("tgt").alias("node")).distinct()


def induced(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with both ends among names (node)."""
    n = names.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "tgt"), "tgt", "left_semi").select(*edges.columns)


def khop(edges: DataFrame, seeds: DataFrame, k: int, mode: str = "frontier") -> DataFrame:
    """Nodes by number of hops from any seed: ``frontier`` gives those at exactly k, ``cumulative`` all up to k (seeds at 0)."""
    adj = adjacency(edges.select("src", "tgt")).distinct()
    seen = cut(seeds.select("node").distinct().withColumn("hop", F.lit(0)))
    for h in range(1, k + 1):
        last = seen.filter(F.col("hop") == h - 1).select(F.col("node").alias("src"))
        new = adj.join(last, "src").select(F.col("tgt").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = cut(seen.union(new.withColumn("hop", F.lit(h))))
    return seen.filter(F.col("hop") == k) if mode == "frontier" else seen


def distances(edges: DataFrame, seeds: DataFrame, cutoff: int = 64) -> DataFrame:
    """(seed, node, hops) by breadth-first search from each seed; ends when nothing new is met or at the cutoff."""
    adj = cut(adjacency(edges.select("src", "tgt")).distinct())
    seen = cut(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hops", F.lit(0)))
    for h in range(1, cutoff + 1):
        last = seen.filter(F.col("hops") == h - 1).select("seed", F.col("node").alias("src"))
        new = cut(last.join(adj, "src").select("seed", F.col("tgt").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(h)))
        if new.isEmpty():
            break
        seen = cut(seen.union(new))
    return seen


def simple_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, cutoff: int = 3) -> DataFrame:
    """All paths without repeated nodes from starts to ends of at most ``cutoff`` edges: path (array), hops."""
    adj = adjacency(edges.select("src", "tgt")).distinct()
    goal = ends.select(F.col("node").alias("_end")).distinct()
    at = starts.select(F.array("node").alias("path"), F.col("node").alias("src")).distinct()
    out = None
    for h in range(1, cutoff + 1):
        at = at.join(adj, "src").filter(~F.array_contains("path", F.col("tgt"))).select(F.concat("path", F.array("tgt")).alias("path"), F.col("tgt").alias("src"))
        hit = at.join(goal, at["src"] == goal["_end"], "left_semi").select("path", F.lit(h).cast("long").alias("hops"))
        out = hit if out is None else out.union(hit)
    return out


def ego_paths(edges: DataFrame, starts: DataFrame, hops: int = 2, per_target: int = 2, most: int | None = 10) -> DataFrame:
    """Around each start, up to ``per_target`` shortest paths without repeated nodes to every node within ``hops``: start, target, hops, path.

    Paths go by (hops, names). At most ``most`` paths are returned, by (start, hops, path); with None all are. A start that has had its
    ``most`` paths isn't followed further, and until then it has met fewer nodes than that, so only its last round is larger.
    Without a bound the number of paths is exponential in ``hops``, as such paths are.
    """
    adj = written(adjacency(edges.select("src", "tgt")).distinct())
    last = written(starts.select(F.col("node").alias("start"), F.col("node").alias("target"), F.array("node").alias("path")).filter("start is not null").distinct())
    found = last.select("start", "target", F.lit(0).cast("long").alias("hops"), "path", F.lit(0).alias("n")).limit(0)
    for h in range(1, hops + 1):
        ahead = last.join(adj.withColumnRenamed("src", "target"), "target").filter(~F.array_contains("path", F.col("tgt")))
        last = written(ahead.select("start", F.col("tgt").alias("target"), F.concat("path", F.array("tgt")).alias("path")))
        had = found.groupBy("start", "target").agg(F.count("*").alias("had"))
        place = F.row_number().over(W.partitionBy("start", "target").orderBy("path"))
        new = last.join(had, ["start", "target"], "left").withColumn("n", place + F.coalesce("had", F.lit(0))).filter(F.col("n") <= per_target)
        found = written(found.unionByName(new.select("start", "target", F.lit(h).cast("long").alias("hops"), "path", "n")))
        if most is not None:
            full = found.groupBy("start").agg(F.count("*").alias("k")).filter(F.col("k") >= most)
            last = last.join(full, "start", "left_anti")
    out = found.select("start", "target", "hops", "path")
    return out if most is None else out.orderBy("start", "hops", "path").limit(most)


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, cutoff: int = 5) -> DataFrame:
    """For each pair of a start and an end, its least shortest path in the order of names: seed, node, hops, path."""
    adj = cut(adjacency(edges.select("src", "tgt")).distinct())
    seen = cut(starts.select(F.col("node").alias("seed"), "node", F.array("node").alias("path")).distinct())
    last = seen
    for _ in range(cutoff):
        new = last.withColumnRenamed("node", "src").join(adj, "src").select("seed", F.col("tgt").alias("node"), F.concat("path", F.array("tgt")).alias("path"))
        new = cut(new.join(seen, ["seed", "node"], "left_anti").groupBy("seed", "node").agg(F.min("path").alias("path")))
        if new.isEmpty():
            break
        seen, last = cut(seen.union(new.select(*seen.columns))), new
    goal = ends.select("node").distinct()
    return seen.join(goal, "node", "left_semi").filter("seed <> node").select("seed", "node", (F.size("path") - 1).cast("long").alias("hops"), "path")


def chain_seeds(edges: DataFrame, seeds: DataFrame, cutoff: int = 5, most: int = 500) -> DataFrame:
    """Greedy chain over a bounded seed set: from each seed to the nearest one left. step, seed, node, path.

    The seeds of a question are few (more than ``most`` are an error); their pairwise paths, not the graph, come to the driver.
    """
    left = sorted(r["node"] for r in seeds.select("node").distinct().limit(most + 1).collect())
    if len(left) > most:
        raise ValueError(f"over {most} seeds: raise ``most`` if their pairs of paths may come to the driver")
    rows = shortest_paths(edges, seeds, seeds, cutoff).collect()
    out, here = [], left.pop(0) if left else None
    while left:
        ways = sorted((r["hops"], r["node"], r["path"]) for r in rows if r["seed"] == here and r["node"] in left)
        if not ways:
            here = left.pop(0)
            continue
        _, there, path = ways[0]
        out.append((len(out), here, there, path))
        left.remove(there)
        here = there
    return edges.sparkSession.createDataFrame(out, "step int, seed string, node string, path array<string>")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least name reachable; nodes without edges are absent.

    Rounds of hooking to the neighbour of least rank with a jump, on edges contracted to the
    roots. Ranks are hashes of the names: whatever the order of names along a chain, a fixed share of
    the nodes is contracted in a round, so rounds grow as the logarithm of their number.
    """
    rank = lambda c: F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), F.lit(":"), c)
    ranked = edges.select(rank("src").alias("src"), rank("tgt").alias("tgt"))
    left = cut(canonical(ranked).filter("src <> tgt").distinct())
    label = ranked.select(F.explode(F.array("src", "tgt")).alias("node")).distinct().withColumn("root", F.col("node"))
    names = None
    while n := left.count():
        hook = adjacency(left).groupBy("src").agg(F.least(F.min("tgt"), F.col("src")).alias("up"))
        jump = cut(hook.join(of_size(hook.select(F.col("src").alias("up"), F.col("up").alias("top")), 2 * n), "up").select("src", "top"))
        label = cut(label.join(of_size(jump.select(F.col("src").alias("root"), "top"), 2 * n), "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        names = names or label.count()
        a, b = jump.select("src", F.col("top").alias("a")), jump.select(F.col("src").alias("tgt"), F.col("top").alias("b"))
        left = cut(canonical(left.join(of_size(a, 2 * n), "src").join(of_size(b, 2 * n), "tgt").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("tgt"))).distinct())
    named = label.select(F.expr("substring(node, 18)").alias("node"), "root")
    least = named.groupBy("root").agg(F.min("node").alias("component"))
    return named.join(of_size(least, names) if names else least, "root").select("node", "component")


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the component with most nodes (the least name wins a tie), as upper-case unescaped names."""
    c = cut(connected_components(edges))
    top = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(F.broadcast(top.select("component")), "component", "left_semi").select("node", F.upper("node").alias("name"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of directed edges, by coloring: forward least labels, then backward from each root inside its color."""
    edges = cut(edges.select("src", "tgt").filter("src <> tgt").distinct())
    left = cut(edges.select(F.explode(F.array("src", "tgt")).alias("node")).distinct())
    out = None
    while not left.isEmpty():
        color = left.withColumn("color", F.col("node"))
        while True:
            seen = edges.join(color.select(F.col("node").alias("src"), F.col("color").alias("c")), "src").groupBy(F.col("tgt").alias("node")).agg(F.min("c").alias("c"))
            new = cut(color.join(seen, "node", "left").select("node", F.least("color", "c").alias("color"), F.col("color").alias("was")))
            color = new.select("node", "color")
            if new.filter("color <> was").isEmpty():
                break
        inside = cut(edges.join(color.select(F.col("node").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("node").alias("tgt"), F.col("color").alias("b")), "tgt").filter("a = b").select("src", "tgt"))
        reach = cut(color.filter("node = color"))
        while True:
            new = cut(inside.join(reach.select(F.col("node").alias("tgt"), "color"), "tgt").select(F.col("src").alias("node"), "color").distinct().join(reach, "node", "left_anti"))
            if new.isEmpty():
                break
            reach = cut(reach.union(new))
        found = reach.select("node", F.col("color").alias("component"))
        out = found if out is None else out.union(found)
        left = cut(left.join(reach, "node", "left_anti"))
        edges = cut(edges.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("tgt")), "tgt", "left_semi"))
    return out


def pagerank(edges: DataFrame, iterations: int = 10, damping: float = 0.85, reset: DataFrame | None = None) -> DataFrame:
    """(node, score) by a fixed number of power iterations over weighted, undirected edges.

    ``reset`` (node, share) personalises the jump; without it the jump is uniform. Every node here has an
    edge, so none loses score. ``damping`` is the probability to go on along an edge.
    """
    adj = adjacency(canonical(edges.select("src", "tgt", "weight")).groupBy("src", "tgt").agg(F.sum("weight").alias("weight")))
    out = adj.groupBy("src").agg(F.sum("weight").alias("_out"))
    step = cut(adj.join(out, "src").select("src", "tgt", (F.col("weight") / F.col("_out")).alias("p")))
    node = step.select(F.col("src").alias("node")).distinct()
    if reset is None:
        total = node.count()
        base = node.withColumn("jump", F.lit(1.0 / max(1, total)))
    else:
        known = reset.join(node, "node", "left_semi").groupBy("node").agg(F.sum("share").alias("share"))
        total = known.agg(F.sum("share")).first()[0] or 1.0
        base = node.join(known, "node", "left").select("node", (F.coalesce("share", F.lit(0.0)) / total).alias("jump"))
    base = cut(base)
    rank = base.select("node", F.col("jump").alias("score"))
    for i in range(iterations):
        got = step.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("tgt").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("got"))
        rank = base.join(got, "node", "left").select("node", ((1 - damping) * F.col("jump") + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        if i % 3 == 2:
            rank = cut(rank)
    return rank


def incidence(edges: DataFrame, edge_id: Column) -> DataFrame:
    """(node, edge_id, v): 1 for each end of each edge."""
    return edges.select(F.explode(F.array("src", "tgt")).alias("node"), edge_id.alias("edge_id")).withColumn("v", F.lit(1.0))


def node_texts(nodes: DataFrame) -> DataFrame:
    """Nodes with ``content``: name, type and description, the empty ones left out."""
    full = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    return nodes.withColumn("content", F.concat_ws(": ", full("entity_name"), full("entity_type"), full("description")))


def edge_texts(edges: DataFrame) -> DataFrame:
    """Edges with ``content``: the relation, or else the ends' names."""
    return edges.withColumn("content", F.when(F.coalesce(F.trim("relation"), F.lit("")) != "", F.col("relation")).otherwise(F.concat_ws(" ", "src", "tgt")))


def subgraph_documents(lines: DataFrame) -> DataFrame:
    """Per source chunk one text of its edges: 'src relation tgt; ...'."""
    return lines.groupBy("chunk_id").agg(F.concat_ws("; ", F.array_sort(F.collect_set(F.concat_ws(" ", "src", "relation", "tgt")))).alias("content"))


def expand_until(edges: DataFrame, seeds: DataFrame, most: int = 10, rounds: int = 3, enough: int | None = None) -> DataFrame:
    """Incident edges of the seeds, widened round by round until there are more than ``most``; with ``enough``, not at all if they are more than that."""
    found = cut(incident(edges, seeds))
    if enough is not None and found.count() > enough:
        return found
    for _ in range(rounds):
        if found.count() > most:
            break
        wider = cut(incident(edges, found.select(F.explode(F.array("src", "tgt")).alias("node")).distinct()))
        if wider.count() == found.count():
            break
        found = wider
    return found


# analytics


def basic_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """n, m, density, self_loops, average_degree of a simple undirected graph."""
    n = nodes.agg(F.count("*").alias("n"))
    m = edges.agg(F.count("*").alias("m"), F.count_if(F.col("src") == F.col("tgt")).alias("self_loops"))
    return n.crossJoin(m).select("n", "m", "self_loops", F.round(F.when(F.col("n") > 1, 2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0), 9).alias("density"), F.round(2 * F.col("m") / F.col("n"), 6).alias("average_degree"))


def degree_centrality(nodes: DataFrame, edges: DataFrame, top: int | None = None) -> DataFrame:
    """node, degree, centrality = degree / (n - 1)."""
    n = nodes.count()
    out = degree(edges).select("node", "degree", F.round(F.col("degree") / max(1, n - 1), 9).alias("centrality"))
    return out.orderBy(F.desc("degree"), "node").limit(top) if top else out


TASK = 12_000_000  # edges that one task searches for triangles, about


def _closed(u, v, least: int = 4_000_000):
    """Triangles of distinct edges between numbers, each once, as three arrays a piece; edges lead from the end of lower degree, which bounds the wedges."""
    import numpy as np

    n = int(max(u.max(), v.max())) + 1
    order = np.argsort(np.bincount(u, minlength=n) + np.bincount(v, minlength=n), kind="stable").astype(np.int32)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    u, v = place[u], place[v]
    key = np.minimum(u, v).astype(np.int64)
    key *= n
    key += np.maximum(u, v)
    key.sort()
    u, v = (key // n).astype(np.int32), (key % n).astype(np.int32)
    after = np.searchsorted(u, u, "right") - np.arange(len(u)) - 1  # edges behind this one from the same end
    # most wedges stay open: a table of bits tells nearly all of these at once
    bits = max(16, int(len(key) * 8).bit_length())
    slot = lambda k: (k * np.int64(-7046029254386353131)).view(np.uint64) >> np.uint64(64 - bits)
    seen = np.zeros(1 << bits, bool)
    for at in range(0, len(key), least):
        seen[slot(key[at : at + least])] = True
    ends, at = np.cumsum(after), 0
    while at < len(u):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + least, "right")))
        k = after[at:to]
        first = np.repeat(np.arange(at, to), k)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(k) - k, k)
        far = v[first].astype(np.int64) * n + v[second]
        near = np.nonzero(seen[slot(far)])[0]
        far, i = far[near], np.searchsorted(key, far[near])
        ok = key[np.minimum(i, len(key) - 1)] == far
        hit = near[ok]
        yield order[u[first[hit]]], order[v[first[hit]]], order[v[second[hit]]]
        at = to


def _packed(src, tgt) -> bytes:
    """The distinct edges of a block, sorted, in a few bytes each: names in order, then steps of the first end's number and the second end's in two halves."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    both = pa.concat_arrays([src, tgt]).dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at, names = place[np.asarray(both.indices)], both.dictionary.take(pa.array(order))
    key = np.unique(at[: len(src)] * len(order) + at[len(src) :])
    u, v = key // len(order), key % len(order)
    if pa.types.is_integer(names.type):
        names = pa.array(np.diff(names.to_numpy(), prepend=0), names.type)
    parts = {"names": names, "step": pa.array(np.diff(u, prepend=0).astype(np.int32)), "low": pa.array((v & 0xFFFF).astype(np.uint16)), "high": pa.array((v >> 16).astype(np.uint16))}
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in parts.values()], list(parts))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data):
    """names, and each edge's two ends as places among them."""
    import numpy as np
    import pyarrow as pa

    names, step, low, high = (c.flatten() for c in pa.ipc.open_stream(data).read_next_batch().columns)
    if pa.types.is_integer(names.type):
        names = pa.array(np.cumsum(names.to_numpy()), names.type)
    return names, np.cumsum(step.to_numpy(), dtype=np.int64), low.to_numpy().astype(np.int64) + (high.to_numpy().astype(np.int64) << 16)


def _by_colours(edges: DataFrame, count: bool) -> DataFrame:
    """Triangles as (a, b, c) in any order, or with ``count`` per node and task its triangles and its edges: node, t, d. Edges may repeat.

    Nodes have colours by hash, and a task gets the edges among three of them: each triangle lies in one task, and edges instead of
    wedges are moved, each once a colour, packed by pairs of colours. The number of colours is set so that a task has about ``TASK`` edges.
    """
    import numpy as np
    import pyarrow as pa

    kind = dict(edges.dtypes)["src"]
    e = canonical(edges.select("src", "tgt")).filter("src <> tgt")
    colours = max(4, int((6 * e.count() / TASK) ** 0.5) + 1)
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(colours)).cast("int")

    def pack(key, rows):
        data = _packed(rows.column("src").combine_chunks(), rows.column("tgt").combine_chunks())
        return pa.table({"x": pa.array([key[0].as_py() // colours], pa.int32()), "y": pa.array([key[0].as_py() % colours], pa.int32()), "edges": pa.array([data], pa.binary())})

    blocks = e.withColumn("xy", colour("src") * colours + colour("tgt")).groupBy("xy").applyInArrow(pack, "x int, y int, edges binary")
    third = F.explode(F.sequence(F.lit(0), F.lit(colours - 1)))
    spread = blocks.withColumn("z", third).withColumn("three", F.array_sort(F.array("x", "y", "z"))).drop("z")

    def run(key, rows):
        three = np.array(key[0].as_py())
        own = [_unpacked(b.as_py()) for b in rows.column("edges")]
        names = pa.concat_arrays([x[0] for x in own]).dictionary_encode()
        at, names = np.asarray(names.indices).astype(np.int64), names.dictionary
        upto = np.cumsum([0, *(len(x[0]) for x in own)])
        u, v = (np.concatenate([at[i + x[k]] for i, x in zip(upto, own)]) for k in (1, 2))
        of = np.empty(len(names), np.int64)
        for i, x, *xy in zip(upto, own, rows.column("x").to_pylist(), rows.column("y").to_pylist()):
            of[at[i + x[1]]], of[at[i + x[2]]] = xy
        del own
        mixed = len(set(three.tolist())) == 3
        found, t = [], np.zeros(len(names), np.int64)
        for abc in _closed(u, v):
            abc = np.stack(abc, 1)
            if not mixed:
                abc = abc[(np.sort(of[abc], 1) == three).all(1)]
            if count:
                t += np.bincount(abc.ravel(), minlength=len(names))
            else:
                found.append(abc)
        if count:
            # of the tasks that have an edge the one with its first colour twice counts it
            low, high = np.minimum(of[u], of[v]), np.maximum(of[u], of[v])
            mine = (np.stack([low, low, high], 1) == three).all(1)
            d = np.bincount(np.concatenate([u[mine], v[mine]]), minlength=len(names))
            some = np.nonzero(t + d)[0]
            return pa.table({"node": names.take(pa.array(some)), "t": t[some], "d": d[some]})
        abc = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        return pa.table({c: names.take(pa.array(abc[:, i])) for i, c in enumerate("abc")})

    groups = spread.groupBy("three")
    return groups.applyInArrow(run, f"node {kind}, t long, d long" if count else f"a {kind}, b {kind}, c {kind}")


def triangles(edges: DataFrame, name=lambda c: c) -> DataFrame:
    """(a, b, c) with a < b < c, each triangle once; ``name`` makes names, which are ordered, of the edges' ends."""
    three = F.array_sort(F.array(*[name(F.col(c)) for c in "abc"]))
    return _by_colours(edges, False).select(three[0].alias("a"), three[1].alias("b"), three[2].alias("c"))


def clustering(edges: DataFrame) -> DataFrame:
    """triangles, transitivity, average_clustering over the nodes with edges."""
    per = _by_colours(edges, True).groupBy("node").agg(F.sum("t").alias("t"), F.sum("d").alias("degree"))
    both = per.select("t", (F.col("degree") * (F.col("degree") - 1) / 2).alias("w"))
    return both.agg((F.sum("t") / 3).cast("long").alias("triangles"), F.round(F.sum("t") / F.sum("w"), 6).alias("transitivity"), F.round(F.avg(F.when(F.col("w") > 0, F.col("t") / F.col("w")).otherwise(0.0)), 6).alias("average_clustering"))


def component_details(edges: DataFrame, top: int = 10) -> DataFrame:
    """The largest components: component, n_nodes, n_edges, density, sample (first three names)."""
    c = cut(connected_components(edges))
    e = edges.join(c.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count("*").alias("n_edges"))
    n = c.groupBy("component").agg(F.count("*").alias("n_nodes"), F.min("node").alias("first"))
    w = W.partitionBy("component").orderBy("node")
    sample = c.withColumn("r", F.row_number().over(w)).filter("r <= 3").groupBy("component").agg(F.concat_ws(",", F.array_sort(F.collect_list("node"))).alias("sample"))
    best = n.join(e, "component").orderBy(F.desc("n_nodes"), "component").limit(top)
    return best.join(sample, "component").select("component", "n_nodes", "n_edges", F.round(2 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 9).alias("density"), "sample")


def path_metrics(edges: DataFrame, most: int = 5000) -> DataFrame:
    """diameter, radius, average_path of a connected graph by search from every node; refused beyond ``most`` nodes."""
    nodes = edges.select(F.explode(F.array("src", "tgt")).alias("node")).distinct()
    if nodes.count() > most:
        raise ValueError(f"path metrics search from every node; the graph has over {most}")
    d = distances(edges, nodes).filter("seed <> node")
    ecc = d.groupBy("seed").agg(F.max("hops").alias("e"), F.sum("hops").alias("s"), F.count("*").alias("n"))
    return ecc.agg(F.max("e").cast("long").alias("diameter"), F.min("e").cast("long").alias("radius"), F.round(F.sum("s") / F.sum("n"), 6).alias("average_path"))


def closeness(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, closeness of the seeds: reached / distance sum, scaled by reached / (n - 1)."""
    n = edges.select(F.explode(F.array("src", "tgt")).alias("node")).distinct().count()
    d = distances(edges, seeds).filter("seed <> node").groupBy(F.col("seed").alias("node")).agg(F.count("*").alias("k"), F.sum("hops").alias("s"))
    return d.select("node", F.round(F.col("k") / F.col("s") * F.col("k") / max(1, n - 1), 9).alias("closeness"))


def betweenness(edges: DataFrame, sources: DataFrame | None = None, rows: int = 50_000_000) -> DataFrame:
    """node, betweenness: the share of shortest paths (in hops) between other nodes that pass through it, over (n - 1)(n - 2).

    Brandes' sums in rounds for many sources at once: numbers of shortest paths go outward level by level, dependencies come
    back. ``sources`` (node) are all nodes unless given. A batch of sources holds a row for each source and
    node, so batches are cut to at most about ``rows`` rows; no graph is held in one place. Weights and self-loops play no part.
    """
    adj = written(adjacency(edges.select("src", "tgt")).filter("src <> tgt").distinct())
    names = written(adj.select(F.col("src").alias("node")).distinct())
    n = names.count()
    start = names if sources is None else names.join(sources.select("node").distinct(), "node", "left_semi")
    batches, found = max(1, -(-n * n // rows)), []
    for k in range(batches):
        last = written(start.filter(F.pmod(F.xxhash64("node"), F.lit(batches)) == k).select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")))
        levels = [last]
        while not last.isEmpty():
            ahead = last.withColumnRenamed("node", "src").join(adj, "src").groupBy("s", F.col("tgt").alias("node")).agg(F.sum("paths").alias("paths"))
            for near in levels[-2:]:  # a neighbour of a level is in it, the one before or the next
                ahead = ahead.join(near.select("s", "node"), ["s", "node"], "left_anti")
            last = written(ahead)
            levels.append(last)
        back = None
        for level, before in zip(levels[-2:0:-1], levels[-3::-1]):
            own = level.withColumn("dep", F.lit(0.0)) if back is None else level.join(back, ["s", "node"], "left").withColumn("dep", F.coalesce("dep", F.lit(0.0)))
            own = written(own)
            found.append(own.select("node", "dep"))
            share = own.select("s", F.col("node").alias("src"), ((1 + F.col("dep")) / F.col("paths")).alias("each")).join(adj, "src").select("s", F.col("tgt").alias("node"), "each")
            back = share.join(before, ["s", "node"]).groupBy("s", "node").agg(F.sum(F.col("each") * F.col("paths")).alias("dep"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    none = names.select("node", F.lit(0.0).alias("dep"))
    return reduce(DataFrame.unionByName, found, none).groupBy("node").agg(F.round(F.sum("dep") * scale, 9).alias("betweenness"))


def eigenvector(edges: DataFrame, iterations: int = 20) -> DataFrame:
    """node, eigenvector centrality by a fixed number of shifted power iterations, scaled to unit length."""
    adj = cut(adjacency(edges.select("src", "tgt")).distinct())
    x = adj.select(F.col("src").alias("node")).distinct().withColumn("v", F.lit(1.0))
    for i in range(iterations):
        got = adj.join(x.withColumnRenamed("node", "src"), "src").groupBy(F.col("tgt").alias("node")).agg(F.sum("v").alias("g"))
        y = x.join(got, "node", "left").select("node", (F.col("v") + F.coalesce("g", F.lit(0.0))).alias("v"))
        size = y.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("s"))
        x = y.crossJoin(F.broadcast(size)).select("node", (F.col("v") / F.col("s")).alias("v"))
        if i % 3 == 2:
            x = cut(x)
    return x.select("node", F.round("v", 6).alias("eigenvector"))


def steiner_tree(edges: DataFrame, terminals: DataFrame, cutoff: int = 8, most: int = 500) -> DataFrame:
    """src, tgt of a 2-approximate Steiner tree of the terminals, which are a question's and so few; more than ``most`` are an error.

    Shortest paths between terminals are found on the cluster; Kruskal's choice among these few paths is
    made on the driver.
    """
    few = sorted(r["node"] for r in terminals.select("node").distinct().limit(most + 1).collect())
    if len(few) > most:
        raise ValueError(f"over {most} terminals: raise ``most`` if their pairs of paths may come to the driver")
    spark = edges.sparkSession
    at = spark.createDataFrame([(x,) for x in few], "node string")
    root = {x: x for x in few}

    def top(x: str) -> str:
        while root[x] != x:
            x = root[x]
        return x

    kept: set[tuple[str, str]] = set()
    for r in sorted(shortest_paths(edges, at, at, cutoff).collect(), key=lambda r: (r["hops"], r["seed"], r["node"])):
        if r["seed"] < r["node"] and top(r["seed"]) != top(r["node"]):
            root[top(r["seed"])] = top(r["node"])
            kept |= {(min(a, b), max(a, b)) for a, b in zip(r["path"], r["path"][1:], strict=False)}
    return spark.createDataFrame(sorted(kept), "src string, tgt string")
