"""Small graphs with results worked out by hand, and invariants."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from graphloom import providers as P
from graphloom.functions import text as T
from graphloom.operators import chunking as C
from graphloom.operators import communities as CO
from graphloom.operators import crossmodal as X
from graphloom.operators import entities as E
from graphloom.operators import evaluate as V
from graphloom.operators import graph as G
from graphloom.operators import memory as M
from graphloom.operators import relations as L
from graphloom.operators import server as S
from graphloom.operators import trees as TR
from graphloom.sources import files as FS


@pytest.fixture(scope="module")
def directed(spark):
    rows = [("A", "B", 1.0), ("A", "C", 2.0), ("A", "D", 1.5), ("B", "C", 1.0), ("C", "B", 1.0), ("D", "E", 1.0), ("E", "F", 1.0), ("F", "D", 2.0), ("X", "Y", 1.0), ("Y", "Z", 1.0)]
    return spark.createDataFrame(rows, "src string, tgt string, weight double")


def test_components_of_the_nine_node_graph(directed):
    weak = {r["node"]: r["component"] for r in G.connected_components(directed).collect()}
    assert {n for n, c in weak.items() if c == "A"} == set("ABCDEF") and {n for n, c in weak.items() if c == "X"} == set("XYZ")
    strong = {}
    for r in G.strong_components(directed).collect():
        strong.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, strong.values())) == [["A"], ["B", "C"], ["D", "E", "F"], ["X"], ["Y"], ["Z"]]


def test_basic_stats_and_degree(spark, directed):
    nodes = spark.createDataFrame([(x,) for x in "ABCDEFXYZ"], "entity_name string")
    row = G.basic_stats(nodes, directed).first()
    assert (row["n"], row["m"]) == (9, 10)
    loop = spark.createDataFrame([("A", "A"), ("A", "B")], "src string, tgt string")
    assert {r["node"]: r["degree"] for r in G.degree(loop).collect()} == {"A": 3, "B": 1}


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)], "src string, tgt string")
    assert {r["component"] for r in G.connected_components(chain).collect()} == {"n0000"}


def test_empty_graph(spark):
    none = spark.createDataFrame([], "src string, tgt string, weight double")
    assert G.connected_components(none).count() == 0 and G.triangles(none).count() == 0
    assert G.pagerank(none, 2).count() == 0 and X.adjacency_long(none).count() == 0


def test_pagerank_sums_to_one_and_ignores_seed_order(spark, directed):
    a = {r["node"]: r["score"] for r in G.pagerank(directed, 5).collect()}
    assert abs(sum(a.values()) - 1) < 1e-9
    seeds = lambda *s: spark.createDataFrame([(x, 1.0) for x in s], "node string, share double")
    p, q = (sorted(map(tuple, G.pagerank(directed, 5, 0.85, seeds(*s)).collect())) for s in ("AX", "XA"))
    assert [x[0] for x in p] == [x[0] for x in q] and all(abs(x[1] - y[1]) < 1e-12 for x, y in zip(p, q, strict=True))


@pytest.fixture(scope="module")
def people(spark):
    edges = [("person_1", "company_1", "works_at"), ("person_2", "company_1", "works_at"), ("person_3", "company_2", "works_at"), ("person_1", "person_2", "knows"), ("person_2", "person_3", "knows"), ("company_1", "location_1", "headquartered_in"), ("company_2", "location_2", "headquartered_in"), ("person_1", "location_1", "lives_in"), ("person_3", "location_2", "lives_in")]
    return spark.createDataFrame([(*e, 1.0) for e in edges], "src string, tgt string, relation string, weight double")


def seeds(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "entity_name string, position int")


def test_onehop(spark, people):
    near = {r["entity_name"] for r in E.onehop(people, seeds(spark, "person_1")).collect()}
    assert near == {"company_1", "person_2", "location_1"}
    assert E.onehop(people, seeds(spark, "isolated_entity", "unknown")).count() == 0
    few = E.onehop_limited(people, seeds(spark, "person_1"), 2).collect()
    assert len(few) == 2 and few[0]["seed"] == "person_1"


def test_directions_and_roles(spark, people):
    out = L.directed_onehop(people, seeds(spark, "company_1"), "outgoing")
    assert [r["tgt"] for r in out.collect()] == ["location_1"]
    assert L.directed_onehop(people, seeds(spark, "company_1"), "incoming").count() == 2
    roles = {r["entity_name"]: r["role"] for r in E.rel_node(people, F.concat_ws("|", "src", "relation", "tgt")).collect()}
    assert roles["person_1"] == "source" and roles["location_1"] == "target" and roles["company_1"] == "both"


def test_budget_is_a_prefix(spark, people):
    everything = L.onehop(people, seeds(spark, "person_1", "person_2", "person_3")).count()
    some = L.onehop(people, seeds(spark, "person_1", "person_2", "person_3"), 9).count()
    assert some == 3 and everything == 7
    assert L.onehop(people, seeds(spark, "person_1"), 0).count() == 0


def test_triangle_and_clustering(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, tgt string")
    assert [tuple(r) for r in G.triangles(e).collect()] == [("a", "b", "c")]
    row = G.clustering(e).first()
    assert row["triangles"] == 1 and row["transitivity"] == 0.6


def test_separator_chunks_lose_no_word(spark):
    text = "One two three. " + "word " * 50 + "\n\nFour! Five? " + "x" * 30
    chunks = C.by_separators(spark.createDataFrame([(1, text), (2, None), (3, "  ")], "doc_id long, text string"), 10, 2).orderBy("idx").collect()
    words = text.split()
    assert {r["doc_id"] for r in chunks} == {1} and all(r["tokens"] <= 10 for r in chunks)
    assert [w for w in words if w not in " ".join(r["content"] for r in chunks)] == []


def test_windows(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r["idx"], r["content"]) for r in C.by_tokens(docs, 3, 1).orderBy("idx").collect()]
    assert got == [(0, "a b c"), (1, "c d e"), (2, "e")]
    with pytest.raises(ValueError):
        C.by_tokens(docs, 3, 3)


def test_text_functions(spark):
    row = spark.range(1).select(T.clean(F.lit(" Caf&amp;e-No.1 ")).alias("clean"), T.answer(F.lit("The  Cat, a dog!")).alias("answer"), T.unfence(F.lit("x ```json\n{}\n``` y")).alias("fence"), T.mentions(F.lit("The Ada Lovelace met Alan. Ada Lovelace left")).alias("m")).first()
    assert row["clean"] == "caf e no 1" and row["answer"] == "cat dog" and row["fence"] == "{}"
    assert row["m"] == ["The Ada Lovelace", "Alan", "Ada Lovelace"]


def test_scores(spark):
    rows = spark.createDataFrame([("the cat sat", "a cat sat sat"), ("yes", "no"), ("", "x"), ("Paris", "paris.")], "predicted string, gold string")
    got = [r["s"] for r in rows.select(V.answer_scores(F.col("predicted"), F.col("gold")).alias("s")).collect()]
    assert got[0]["f1"] == 0.8 and got[1]["f1"] == 0 and got[2]["em"] == 0 and got[3]["em"] == 1
    b = rows.select(V.bleu(F.lit("the the the"), F.lit("the cat"), 1).alias("b")).first()["b"]
    assert abs(b - 1 / 3) < 1e-6


def test_crossmodal_invariants(spark, people):
    long = X.adjacency_long(people.withColumn("relation", F.lit("r")))
    cells = {(r["row"], r["col"]): r["weight"] for r in long.collect()}
    assert all(cells[b, a] == w for (a, b), w in cells.items()) and len(cells) == 2 * people.count()
    back = X.matrix_to_edges(X.adjacency_wide(people))
    assert back.count() == people.count()
    vectors = spark.createDataFrame([(i, [float(i % 3 == j) + 0.1 * i for j in range(3)]) for i in range(9)], "vec_id long, embedding array<double>")
    counts = [X.similarity_graph(vectors, t).count() for t in (-1.0, 0.5, 0.9, 0.999)]
    assert counts == sorted(counts, reverse=True) and counts[0] == 36
    with pytest.raises(ValueError):
        X.convert(vectors, "vector", "sound")
    same = X.preservation(people.select(F.col("src").alias("entity_name")), people, people.select("src"), people).first()
    assert same["overall"] == 1.0


def test_sequence_similarity(spark):
    p = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], [])], "a array<string>, b array<string>")
    got = [r["similarity"] for r in M.sequence_similarity(p).collect()]
    assert abs(got[0] - (0.4 * 2 / 3 + 0.6 * 0.8)) < 1e-6 and got[1] == 1.0


def test_dates(spark):
    t = "Born May 3, 1901 in May 1902 or 1903, on 4 June 1904 and 1905-06-07."
    got = [(r["normalized_date"], r["precision"]) for r in S.dates(spark.createDataFrame([("c", t), ("d", None)], "chunk_id string, content string")).collect()]
    assert got == [("1901-05-03", "day"), ("1902-05", "month"), ("1903", "year"), ("1904-06-04", "day"), ("1905-06-07", "day")]


def test_balanced_clusters_are_balanced(spark):
    v = spark.createDataFrame([(i, [float(i % 2), i / 100.0]) for i in range(21)], "id long, embedding array<double>")
    sizes = [r["count"] for r in TR.balanced_clusters(v, 4).groupBy("cluster").count().collect()]
    assert sum(sizes) == 21 and max(sizes) <= 6


def test_clusters_cover_every_node(spark):
    e = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(4) for j in range(i + 1, 4)] + [("a0", "b0", 0.1)]
    m = CO.cluster(spark.createDataFrame(e, "src string, tgt string, weight double"), 10, 2)
    level = {r["node"]: r["cluster"] for r in m.filter("level = 0").collect()}
    assert len(level) == 8 and len({level[f"a{i}"] for i in range(4)}) == 1 and level["a1"] != level["b1"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("whole text")
    (tmp_path / "b.json").write_text(json.dumps({"results": [{"Title": "t", "Body": "one", "n": 1}, {"Title": "u", "Body": " "}]}))
    (tmp_path / "c.jsonl").write_text('{"text": "x", "name": "n"}\n')
    (tmp_path / "d.csv").write_text("title,content\nq,\"two\nlines\"\n")
    (tmp_path / "e.bin").write_text("skip")
    docs = FS.prepare_corpus(spark, str(tmp_path), str(tmp_path / "out")).collect()
    assert sorted(r["content"] for r in docs) == ["one", "two\nlines", "whole text", "x"]
    assert sorted(r["doc_id"] for r in docs) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        FS.read_file(spark, str(tmp_path / "e.bin"))
    (tmp_path / "bad.jsonl").write_text('{"text": "x"}\nnot json\n')
    assert FS.read_jsonl(spark, str(tmp_path / "bad.jsonl"), strict=False).count() == 1
    with pytest.raises(Exception):
        FS.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_graph_round_trip(spark, people, tmp_path):
    nodes = spark.createDataFrame([("person_1", "Person", "p")], "entity_name string, entity_type string, description string")
    FS.write_graph(nodes, people, str(tmp_path / "g"))
    FS.write_graph(nodes.limit(0), people, str(tmp_path / "g"))
    n, e = FS.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 1 and e.count() == people.count()
    assert json.loads(FS.export_graph(n, e).first()["graph"])["metadata"] == {"n_nodes": 1, "n_edges": 0}


def test_embedding_is_cached_and_unit(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, t string")
    got = {r["id"]: r["embedding"] for r in P.embed(rows, "t").collect()}
    assert got[1] == got[2] and got[3] is None and abs(sum(x * x for x in got[1]) - 1) < 1e-6
