"""Ego paths, betweenness by rounds, subsequences of every length and contexts against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from graphloom.operators import context as CX
from graphloom.operators import enrich as A
from graphloom.operators import graph as G
from graphloom.operators import memory as M


def some_graph(n, p, seed):
    rng = random.Random(seed)
    return [(f"n{i:02d}", f"n{j:02d}") for i in range(n) for j in range(i + 1, n) if rng.random() < p]


def near_of(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def brute_paths(edges, start, hops, per_target):
    near, by, todo = near_of(edges), defaultdict(list), [[start]]
    for _ in range(hops):
        todo = [[*p, x] for p in todo for x in near[p[-1]] if x not in p]
        for p in todo:
            by[p[-1]].append(p)
    return sorted((start, len(p) - 1, p, t) for t, ps in by.items() for p in sorted(ps, key=lambda p: (len(p), p))[:per_target])


@pytest.mark.parametrize(("most", "hops"), [(None, 3), (10, 3), (40, 2), (1000, 2)])
def test_ego_paths_of_sixty_nodes(spark, most, hops):
    edges = some_graph(60, 0.06, 4)
    starts = ["n00", "n07", "n31", "nobody"]
    e = spark.createDataFrame([(b, a, 1.0) for a, b in edges] + [("n00", "n00", 1.0)], "src string, tgt string, weight double")
    got = [(r["start"], r["hops"], list(r["path"]), r["target"]) for r in G.ego_paths(e, spark.createDataFrame([(s,) for s in starts], "node string"), hops, most=most).collect()]
    want = sorted(p for s in starts for p in brute_paths(edges, s, hops, 2))
    assert sorted(got) == (want if most is None else want[:most])


def brute_betweenness(edges):
    near = near_of(edges)
    names = sorted(near)

    def search(s):
        far, ways, queue = {s: 0}, Counter({s: 1}), [s]
        for v in queue:
            for w in near[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    ways[w] += ways[v]
        return far, ways

    of = {s: search(s) for s in names}
    n, out = len(names), {}
    for v in names:
        total = 0.0
        for s, t in permutations(names, 2):
            if v not in (s, t) and t in of[s][0] and v in of[s][0] and t in of[v][0] and of[s][0][v] + of[v][0][t] == of[s][0][t]:
                total += of[s][1][v] * of[v][1][t] / of[s][1][t]
        out[v] = total / ((n - 1) * (n - 2))
    return out


@pytest.mark.parametrize("rows", [50_000_000, 500])
def test_betweenness_by_rounds(spark, rows):
    edges = some_graph(24, 0.12, 9) + [("x", "y"), ("y", "z"), ("z", "z")]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges] + [(b, a, 2.0) for a, b in edges[:5]], "src string, tgt string, weight double")
    got = {r["node"]: r["betweenness"] for r in G.betweenness(e, rows=rows).collect()}
    want = brute_betweenness(edges)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-8 for v in want)


def test_nodes_have_their_betweenness(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, tgt string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "entity_name string")
    got = {r["entity_name"]: r["betweenness"] for r in A.with_centrality(nodes, e).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 0.0, "d": 0.0}
    assert {r["betweenness"] for r in A.with_centrality(nodes, e, most=3).collect()} == {None}


@pytest.mark.parametrize(("least", "support"), [(2, 2), (1, 3), (3, 1)])
def test_subsequences_of_every_length(spark, least, support):
    rng = random.Random(6)
    rows = [(k, t, rng.choice("abc")) for k in range(8) for t in range(rng.randint(1, 14))] + [(20, t, "xyxyxyx"[t]) for t in range(7)] + [(21, 0, None), (21, 1, "a"), (21, 2, None), (21, 3, "b")]
    want = Counter()
    seqs = defaultdict(list)
    for k, _, x in rows:
        seqs[k].append(x)
    for s in seqs.values():
        for i in range(len(s)):
            for j in range(i + least, len(s) + 1):
                if None not in s[i:j]:
                    want[">".join(s[i:j])] += 1
    df = spark.createDataFrame(rows, "k int, t int, x string")
    got = M.all_subsequences(df, "k", ["t"], "x", least, support).collect()
    assert {r["pattern"]: r["n"] for r in got} == {p: n for p, n in want.items() if n >= support}
    assert all(r["length"] == r["pattern"].count(">") + 1 for r in got)
    assert M.all_subsequences(df.limit(0), "k", ["t"], "x").count() == 0


def fill(lengths, budgets):
    """Whole passes over the tables until nothing more is carried over."""
    upto, left, rest = dict.fromkeys(lengths, 0), dict(budgets), 0
    while True:
        before = rest
        for t, sizes in lengths.items():
            while upto[t] < len(sizes):
                if sizes[upto[t]] <= rest:
                    rest -= sizes[upto[t]]
                elif sizes[upto[t]] <= left[t]:
                    left[t] -= sizes[upto[t]]
                else:
                    break
                upto[t] += 1
            rest, left[t] = rest + left[t], 0
        if rest == before:
            return upto


def test_contexts_within_budgets(spark):
    rng = random.Random(3)
    tables = ("entities", "relationships", "chunks")
    rows, budgets, want = [], [], {}
    for q in range(80):
        own = {t: [rng.randint(1, 30) for _ in range(rng.randint(0, 8))] for t in tables}
        rows += [(q, t, i, "x" * (n - 1), i) for t in tables for i, n in enumerate(own[t])]
        b = [rng.randint(0, 60) for _ in tables]
        budgets.append((q, *b))
        want[q] = fill(own, dict(zip(tables, b)))
    rows += [(q, "other", 0, "x", 0) for q in range(5)] + [(999, "chunks", 0, "x", 0)]
    df = spark.createDataFrame(rows, "question int, table string, place int, item string, _n_ int")
    bs = spark.createDataFrame(budgets, "question int, entities int, relationships int, chunks int")
    kept = CX.assemble(df, bs)
    assert kept.columns == df.columns
    got = Counter((r["question"], r["table"]) for r in kept.collect())
    assert all(got[q, t] == n for q, own in want.items() for t, n in own.items()) and sum(got.values()) == sum(sum(w.values()) for w in want.values())
    text = {r["question"]: r["context"] for r in CX.render(kept.filter("question = 1"), df.select("question").filter("question in (1, 999)")).collect()}
    assert text[999] == "\n#Entities: None\n\n\n## Relationships: None\n\n\n## Sources: None\n"
    assert text[1].count("```csv") == sum(want[1][t] > 0 for t in tables[:2])


def test_merged_contexts_number_rows_anew(spark):
    schema = "question int, place int, item string"
    high = spark.createDataFrame([(1, 0, "b,1"), (1, 1, "a,1"), (1, 2, ""), (2, 0, "z,9")], schema)
    low = spark.createDataFrame([(1, 0, "a,1"), (1, 1, "c,1"), (1, 2, None)], schema)
    got = {r["question"]: r["text"] for r in CX.merged_text(CX.merge_contexts(high, low), "id,name,n").collect()}
    assert got == {1: "id,\tname,\tn\n1,\tb,1\n2,\ta,1\n3,\tc,1", 2: "id,\tname,\tn\n1,\tz,9"}


def test_truncated_lists_end_at_the_first_row_too_long(spark):
    rows = spark.createDataFrame([(1, 0, 3), (1, 1, 9), (1, 2, 1), (2, 0, 5)], "g int, place int, n int")
    assert sorted((r["g"], r["place"]) for r in CX.truncate_tokens(rows, F.col("n"), [F.col("place")], 5, "g").collect()) == [(1, 0), (2, 0)]
