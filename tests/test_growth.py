"""Steps whose work once grew faster than the input: what they move, build or compute is bounded, with the same results."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import crossmodal as X
from graphloom.operators import graph as G
from graphloom.operators import leiden as LE
from graphloom.operators import merge as M
from graphloom.operators import prize_tree as PT
from graphloom.operators import relations as L
from graphloom.operators import retrieval as R
from graphloom.operators import server as S
from graphloom.operators import vector_index as I
from graphloom.providers import HashEmbedding
from graphloom.queries import QUERIES
from tests.compare import SF


def test_triangles_by_many_colours(spark, monkeypatch):
    monkeypatch.setattr(G, "TASK", 60)  # about twelve colours, most triangles across three of them
    random.seed(3)
    pairs = {(f"n{a}", f"n{b}") for a, b in ((random.randrange(60), random.randrange(60)) for _ in range(900))} | {("hub", f"n{i}") for i in range(60)}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {(a, b, c) for a in near for b, c in itertools.combinations(sorted(near[a]), 2) if a < b and c in near[b]}
    edges = spark.createDataFrame(sorted(pairs), "src string, tgt string")
    got = [tuple(r) for r in G.triangles(edges).collect()]
    assert len(got) == len(want) and set(got) == want
    per = {n: sum(n in t for t in want) for n in near}
    wedges = sum(len(x) * (len(x) - 1) / 2 for x in near.values())
    row = G.clustering(edges).first()
    assert row["triangles"] == len(want) and row["transitivity"] == round(sum(per.values()) / wedges, 6)


def test_triangles_move_packed_blocks(spark):
    pairs = sorted({(a, b) for a in range(1000, 1400) for b in (a + 1, a + 2, a * 7 % 400 + 1000) if a != b})
    for kind in ("string", "long"):
        edges = spark.createDataFrame([(f"n{a}", f"n{b}") if kind == "string" else (a, b) for a, b in pairs * 2], f"src {kind}, tgt {kind}")
        plan = G.triangles(edges)._jdf.queryExecution().optimizedPlan().toString()
        assert "three" in plan and "collect_list" not in plan and "edges" in plan
    data = G._packed(pa.array([f"part:{a}" for a, _ in pairs * 2]), pa.array([f"part:{b}" for _, b in pairs * 2]))
    names, u, v = G._unpacked(data)
    assert sorted(zip(names.take(pa.array(u)).to_pylist(), names.take(pa.array(v)).to_pylist(), strict=True)) == sorted((f"part:{a}", f"part:{b}") for a, b in pairs)
    names, u, v = G._unpacked(G._packed(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs])))
    assert sorted(zip(names.take(pa.array(u)).to_pylist(), names.take(pa.array(v)).to_pylist(), strict=True)) == pairs
    assert len(data) < 9 * len(pairs)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_local_plan_finds_its_seeds_once(spark):
    assert exchanges(QUERIES["basic_local_plan"](spark, SF)) < 20


def test_lexical_index_moves_no_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 7, f"red {i} blue {i * i} ring" if i % 3 else "green blue blue") for i in range(40)], "id long, text string")
    few = [tuple(r) for r in R.Tfidf(docs, "id", "text").top("blue ring 4", 9).collect()]
    plan = R.Tfidf(docs, "id", "text").norms._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "hashpartitioning(id" in plan
    monkeypatch.setattr(R, "BROADCAST", 0)  # the way of a large vocabulary
    assert [tuple(r) for r in R.Tfidf(docs, "id", "text").top("blue ring 4", 9).collect()] == few and len(few) == 7


def test_vectors_move_once_a_large_block(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(500, 8)), rng.normal(size=(6, 8)).repeat(100, 0) + rng.normal(size=(600, 8)) / 9])
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)] + [(5000, None)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.9, 1)), strict=True)}
    core = np.nonzero((s >= 0.9).sum(1) + 1 >= 3)[0]
    for size, blocks in ((R.BLOCK_BYTES, 3), (1100 * 8 * 8 // 5, 5)):  # as large as they may be, and five of them
        monkeypatch.setattr(R, "BLOCK_BYTES", size)
        assert {(r["a"], r["b"]) for r in R.similar_pairs(v, 0.9).collect()} == want
        near = {}
        for r in R.nearest(v, 0.9, 4).collect():
            near.setdefault(r["id"], set()).add(r["other"])
        assert near == {i: {j for j in np.lexsort((np.arange(len(s)), -s[i]))[:4] if s[i, j] >= 0.9} for i in range(len(s)) if s[i].max() >= 0.9}
        got = {r["vec_id"]: r["cluster"] for r in X.dbscan(v, 0.1, 3).collect()}
        assert set(core) <= got.keys() and all(got[i] == got[j] for i, j in want if {i, j} <= set(core)) and len({got[i] for i in core}) == len({min(j for j in core if got[j] == got[i]) for i in core})


def test_known_edges_told_by_a_rule_need_no_rows(spark):
    assert "Join" not in QUERIES["synonym_edges"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_mentions_move_once_when_merged(spark):
    m = spark.createDataFrame([("a", "x", "one", "c1"), ("a", "y", "", "c2"), ("a", "y", "two", "c1"), ("b", "x", "one", "c3")], "entity_name string, entity_type string, description string, source_id string")
    nodes = M.merge_nodes(m)
    assert exchanges(nodes) == 1
    assert {r["entity_name"]: (r["entity_type"], r["description"], r["source_ids"]) for r in nodes.collect()} == {"a": ("y", "one<SEP>two", ["c1", "c2"]), "b": ("x", "one", ["c3"])}


def test_search_makes_no_row_a_pair(spark, monkeypatch):
    """Only each query's best leave a task, whatever is compared there; the same with many shares of vectors and of queries."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 60, 0)])
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    asked = v.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    index = I.build(v, cells=6)
    want = sorted(tuple(r) for r in R.vector_top(v, asked, 5).select("query_id", "vec_id", "score", "rank").collect())
    for share in (I.SHARE, 7):
        monkeypatch.setattr(I, "SHARE", share)
        monkeypatch.setattr(I, "WAITING", share)
        found = I.search(index, asked, 5, probes=6)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" in plan and "Join" not in plan  # vectors and queries meet as matrices
        assert sorted(tuple(r) for r in found.select("query_id", "vec_id", "score", "rank").collect()) == want


def test_records_are_split_once(spark):
    for name in ("parse_entity_records", "parse_relation_records"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("regexp_extract(") == 1 and plan.count("[^a-z0-9 ]") == 2


def test_edges_move_once_when_merged(spark):
    schema = "src_id string, tgt_id string, relation_name string, description string, keywords string, weight double, source_id string"
    m = spark.createDataFrame([("a", "b", "r", "x", "", 1.0, "c1"), ("b", "a", "", "y", "k", 2.0, "c2"), ("a", "c", "r", "x", "", 1.0, "c1")], schema)
    new = spark.createDataFrame([("a", "b", "q", "z", "", 4.0, "c1"), ("b", "a", "s", "x", "", 8.0, "c3"), ("d", "a", "", "", "", None, None)], schema)
    edges = M.merge_edges(m)
    assert exchanges(edges) == 1 and exchanges(M.upsert_edges(edges, new)) == 2  # those of the old edges, and one
    assert {(r["src"], r["tgt"]): tuple(r)[2:] for r in M.upsert_edges(edges, new).collect()} == {
        ("a", "b"): (11.0, "r<SEP>s", "x<SEP>y", "k", ["c1", "c2", "c3"]), ("a", "c"): (1.0, "r", "x", "", ["c1"]), ("a", "d"): (None, "", "", "", [None])}


def test_citations_of_one_chunk_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 10)
    answers = spark.createDataFrame([(i, "red" if i % 2 else "blue", ["hot", "none", f"c{i}"][: i % 4] if i % 5 else None) for i in range(200)], "id long, span string, chunk_ids array<string>")
    chunks = spark.createDataFrame([("hot", "all RED here"), ("c3", "blue"), ("c7", "a red one")] + [(f"c{i}", "blue-red") for i in range(8, 99)], "chunk_id string, content string")
    text = {r["chunk_id"]: r["content"].lower() for r in chunks.collect()}
    want = {r["id"]: any(r["span"] in text.get(c, "") for c in r["chunk_ids"] or []) for r in answers.collect()}
    found = S.span_support(answers, chunks)
    assert {r["id"]: r["supported"] for r in found.collect()} == want and sum(want.values()) > 40
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "hashpartitioning(chunk_id" in (plan := S.span_support(answers, chunks)._jdf.queryExecution().executedPlan().toString()) and re.search(r"hashpartitioning\(chunk_id#\d+, share#\d+", plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vectors_of_names_are_made_where_they_lie(spark):
    for name in ("method_lightrag", "method_fastgraphrag"):
        asked = []
        real, held = R.embed_distinct, R.embed_each
        R.embed_distinct = lambda *a: asked.append("distinct") or real(*a)
        R.embed_each = lambda *a: asked.append("each") or held(*a)
        try:
            QUERIES[name](spark, SF)
        finally:
            R.embed_distinct, R.embed_each = real, held
        assert asked and set(asked) == {"each"}
    rows = spark.createDataFrame([(1, "red blue"), (2, None), (3, "red blue"), (4, ""), (5, "Green")], "id long, text string")
    embed = HashEmbedding(8).embed
    plain = lambda df: {r["id"]: r["embedding"] for r in df.collect()}
    each = R.embed_each(rows, "text", embed)
    assert exchanges(each) == 0 and plain(each) == plain(R.embed_distinct(rows, "text", embed)) and plain(each)[2] is None


def test_edges_are_merged_once_and_scored_before_their_chunks(spark):
    plan = QUERIES["method_fastgraphrag"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan and "edge_id" not in plan
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("d", 0.125)], "entity_name string, score double")
    edges = spark.createDataFrame([("a", "b", ["c1", "c2"]), ("b", "c", ["c2", "gone"]), ("c", "e", ["c3"]), ("d", "d", ["c4"])], "src string, tgt string, source_ids array<string>")
    chunks = spark.createDataFrame([(f"c{i}",) for i in range(9)], "chunk_id string")
    assert [tuple(r) for r in L.aggregate_chunks(scores, edges, chunks, 9).collect()] == [("c2", 1.0), ("c1", round(0.5 / 0.75, 6)), ("c4", 0.0)]


def test_a_pair_gathers_one_list(spark):
    schema = "src_id string, tgt_id string, relation_name string, description string, keywords string, weight double, source_id string"
    m = spark.createDataFrame([("a", "b", "r", "x", "", 1.0, "c2"), ("b", "a", None, "y", "k", None, "c1"), ("a", "b", "q", "x", "k", 2.0, "c2"), ("c", "a", "", None, "k", None, None), ("d", "a", "r", "x", "", 3.0, "c3")], schema)
    edges = M.merge_edges(m)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "hashpartitioning(src" in plan and exchanges(edges) == 1
    assert {tuple(r)[:2]: tuple(r)[2:] for r in edges.collect()} == {
        ("a", "b"): (3.0, "q<SEP>r", "x<SEP>y", "k", ["c1", "c2"]), ("a", "c"): (None, "", "", "k", []), ("a", "d"): (3.0, "r", "x", "", ["c3"])}


def test_missing_ends_are_found_without_merging(spark):
    df = QUERIES["backfill_endpoints"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert exchanges(df) == 2 and "SortMergeJoin" not in plan and "BroadcastExchange" not in plan and "sum(" not in plan
    e = spark.createDataFrame([("a", "t", "d", "c1"), ("a", "t", "d", "c1"), ("b", "", "", None)], "entity_name string, entity_type string, description string, source_id string")
    r = spark.createDataFrame([("a", "x", "c2"), ("x", "y", "c1"), ("x", "b", "c1"), ("y", "y", None), ("x", "z", "c2")], "src_id string, tgt_id string, source_id string")
    want = {"x": ["c1", "c2"], "y": ["c1"], "z": ["c2"]}
    assert {n: s for n, t, d, s in M.missing_ends(e, r).collect() if t == d == ""} == want
    edges = M.merge_edges(r.selectExpr("src_id", "tgt_id", "'' AS relation_name", "'' AS description", "'' AS keywords", "1.0D AS weight", "source_id"))
    assert {n: s for n, t, d, s in M.backfill(M.merge_nodes(e), edges).collect()} == want | {"a": ["c1"], "b": []}


def test_texts_split_at_marks_as_by_a_pattern(spark):
    texts = ["a##b<|COMPLETE|>c", "###", "##a\x01b####", "", None, "\x01", "<|COMPLETE|><|COMPLETE|>##", "a<|>b#c<|"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for marks in (("##", "<|COMPLETE|>"), ("<|>",), ("#", "##")):
        pattern = "|".join(re.escape(m) for m in marks)
        assert [r[0] for r in df.select(T.split_at(df.t, *marks)).collect()] == [None if t is None else re.split(pattern, t) for t in texts]
    names = ["A &lt;b&amp;lt; C", " \tx\x01Y\n ", "plain Name 5", "S #5", "", None, "\u00c4b\x85", "&nbsp;q"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(T.clean(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["a  b lt  c", "xy", "plain name 5", "s  5", "", None, "b", "q"]


def test_quotes_at_the_ends_go_once(spark):
    texts = ['"a"', '""a""', '"', '""', ' "a', 'a" ', '"a"\n', "", None, 'a"b', '" a "']
    want = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M._bare(F.col("t")), F.expr("""trim(regexp_replace(trim(t), '^"|"$', ''))"""))
    assert all(r[1] == r[2] for r in want.collect())


def kinds_of_joins(monkeypatch, module, name) -> list:
    """(kind, first key) of each join in the frames that ``module`` writes, as they are gathered."""
    seen, real = [], getattr(module, name)

    def spied(df):
        seen.extend(re.findall(r"(\w+Join) \[(?:knownfloatingpointnormalized\()?([a-z_0-9]+)", df._jdf.queryExecution().executedPlan().toString()))
        return real(df)

    monkeypatch.setattr(module, name, spied)
    return seen


def test_components_send_no_large_side_to_the_driver(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{i}", f"n{(i * 7) % 40 + 40 * (i > 60)}") for i in range(120)], "src string, tgt string")
    want = sorted(tuple(r) for r in G.connected_components(edges).collect())
    monkeypatch.setattr(G, "BROADCAST", 0)
    seen = kinds_of_joins(monkeypatch, G, "cut")
    assert sorted(tuple(r) for r in G.connected_components(edges).collect()) == want
    assert seen and {k for k, _ in seen} == {"SortMergeJoin"}


def test_prize_tree_sends_no_large_side_to_the_driver(spark, monkeypatch):
    random.seed(5)
    nodes = spark.createDataFrame([(f"s{i % 2}", f"n{i}", float(random.randrange(4))) for i in range(40)], "scope string, node string, prize double")
    edges = spark.createDataFrame([(f"s{i % 2}", f"n{i}", f"n{(i * 3 + 2 * j) % 40 // 2 * 2 + i % 2}", 0.5 + (i + j) % 3) for i in range(40) for j in (1, 2)], "scope string, src string, tgt string, cost double")
    want = sorted(map(str, PT.prize_tree(nodes, edges).collect()))
    monkeypatch.setattr(G, "BROADCAST", 0)
    seen = kinds_of_joins(monkeypatch, PT, "written")
    assert sorted(map(str, PT.prize_tree(nodes, edges).collect())) == want and len(want) > 3
    assert len(seen) > 9 and all(kind == "SortMergeJoin" for kind, key in seen if key != "scope")


def test_leiden_sends_no_large_side_to_the_driver(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(24) for j in range(i) if i // 6 == j // 6 or (i, j) in ((6, 5), (12, 11), (18, 17))], "src string, tgt string")
    want = sorted(tuple(r) for r in LE.leiden(edges, rounds=2, levels=1).collect())
    monkeypatch.setattr(G, "BROADCAST", 0)
    seen = kinds_of_joins(monkeypatch, LE, "written")
    assert sorted(tuple(r) for r in LE.leiden(edges, rounds=2, levels=1).collect()) == want and len(want) == 24
    assert len(seen) > 9 and all(kind == "SortMergeJoin" for kind, key in seen if key != "scope")
