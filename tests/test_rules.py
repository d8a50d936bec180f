"""Rules held against values worked out by hand or by brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import crossmodal as X
from graphloom.operators import enrich as A
from graphloom.operators import memory as M
from graphloom.operators import merge as G
from graphloom.queries import QUERIES
from graphloom.sources import files as S
from tests.compare import SF


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_sequences_of_users(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect()
    own = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        own.setdefault(r["user_id"], []).append(r["event_type"])
    got = {r["x"]: r for r in QUERIES["sequence_pairs"](spark, SF).collect()}
    assert got.keys() == {u for u in own if u + 1 in own}
    for u, r in got.items():
        a, b = own[u], own[u + 1]
        j = len(set(a) & set(b)) / len(set(a) | set(b))
        assert r["similarity"] == pytest.approx(0.4 * j + 0.6 * 2 * brute_lcs(a, b) / (len(a) + len(b)), abs=2e-6)


def test_nearest_edges_against_brute_force(spark):
    x = np.random.default_rng(1).normal(size=(40, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    v = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    directed = [(i, j) for i in range(40) for j in sorted((j for j in range(40) if j != i), key=lambda j: (-s[i, j], j))[:2] if s[i, j] >= 0.5]
    want = {}
    for i, j in directed:
        want[min(i, j), max(i, j)] = want.get((min(i, j), max(i, j)), 0) + 0.8 * s[i, j]
    got = {(r["src"], r["tgt"]): r["weight"] for r in A.similarity_edges(v, 0.5, 0.8, 3).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(w, abs=2e-6) for k, w in want.items())
    known = spark.createDataFrame([(b, a) for a, b in list(want)[:3]], "src long, tgt long")
    assert {(r["src"], r["tgt"]) for r in A.synonym_edges(v, known, 0.5, 2).collect()} == set(list(want)[3:])


def test_relevance(spark):
    rows = [("1", "Graph Theory of graphs", 0.5, 3, "2024-01-31 12:00:00", {"a": "x", "b": "y"}), ("2", "none", 1.0, 90, "2023-01-01 00:00:00", {}), ("3", "graph theory of many things", 1.0, 10, "2024-02-01 00:00:00", {"a": "z"})]
    m = spark.createDataFrame(rows, "id string, content string, importance double, access_count int, ts string, metadata map<string,string>")
    got = {r["id"]: r["relevance"] for r in M.relevance("theory of GRAPH things", m, "2024-02-01 00:00:00", ["a", "c"]).collect()}
    assert got["1"] == pytest.approx(min(1, 0.2 * 3 + 0.3 * 0.5 + 0.2 / 1.5 + 0.1 * 0.3 + 0.2), abs=1e-6) and got["3"] == 1.0
    assert got["2"] == pytest.approx(0.3 + 0.2 / 397 + 0.1, abs=1e-6)


def test_passages_linked_by_titles(spark):
    m = spark.createDataFrame([(1, "Rome", 0.9), (2, "Rome", 0.8), (3, "Rome", 0.4), (1, "Peru", 0.9), (2, "Peru", 0.9), (3, "", 1.0), (1, "", 1.0), (4, "Rome", 0.9), (4, None, 0.9)], "chunk_id long, term string, prior double")
    assert sorted(tuple(r) for r in G.passage_links(m, 0.4).collect()) == [(1, 2, "Peru", "1<SEP>2"), (1, 4, "Rome", "1<SEP>4"), (2, 4, "Rome", "2<SEP>4")]


def test_columns_found_by_name(spark):
    pick = lambda *names: X.entity_columns(spark.createDataFrame([tuple("a" * (i + 1) for i in range(len(names)))], ", ".join(f"{n} string" for n in names)))
    assert pick("src", "dst", "Subject", "OBJECT") == ("Subject", "OBJECT") and pick("entity1", "entity2", "z") == ("entity1", "entity2") and pick("only") == ("only", "only")
    doc = lambda *names: S.find_column(list(names), S.TEXT_NAMES)
    assert doc("text", "Context") == "Context" and doc("summary") == "summary" and doc("post", "abstract") == "post" and S.find_column(["author", "id"], S.TITLE_NAMES) == "author"


def test_signal_tokens(spark):
    row = spark.createDataFrame([("Which King of NY won in 14 by the sea?",)], "c string").select(T.signal_tokens(F.col("c")).alias("t")).first()
    assert row["t"] == ["won", "14", "sea"]


def test_quoted_entities_and_hints(spark):
    q = spark.createDataFrame([(1, 'List the "old town" of New York before recent trade'), (2, "what is it"), (3, None), (4, "")], "id long, question string")
    got = {}
    for r in M.atoms(q).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["atom"], r["text"], list(r["depends"])))
    assert got[1] == [("entity", "List", []), ("entity", "New", []), ("entity", "New York", []), ("entity", "York", []), ("entity", "old town", []), ("relationship", "temporal", [0, 1]), ("attribute", "temporal:recent", []), ("action", "enumeration", [0, 1, 2, 3, 4, 5])]
    assert got[2] == [("action", "retrieve_information", [])]


@pytest.mark.parametrize("block", [1000, 7])
def test_pairs_of_a_key_that_holds_many(spark, monkeypatch, block):
    """A hot key's pairs are dealt to many tasks; none is lost or met twice."""
    monkeypatch.setattr(A, "BLOCK", block)
    rows = [("hot", f"n{i}") for i in range(60)] + [("b", "n1"), ("b", "n2"), ("one", "n3"), (None, "n4"), (None, "n5"), ("b", None)]
    got = [tuple(r) for r in A.pairs_within(spark.createDataFrame(rows, "k string, v string"), "k", "v").collect()]
    names = sorted(f"n{i}" for i in range(60))
    assert len(got) == len(set(got)) and set(got) == {("hot", x, y) for x in names for y in names if x < y} | {("b", "n1", "n2")}
    m = spark.createDataFrame(rows + rows, "chunk_id string, entity_name string")
    edges = A.cooccurrence(m).collect()
    assert len(edges) == 60 * 59 // 2 and {(r["src"], r["tgt"]): r["source_id"] for r in edges}["n1", "n2"] == "b"
    assert A.pairs_within(spark.createDataFrame([], "k string, v long"), "k", "v").count() == 0
