"""Steps rated by a provider, composed searches, and tables that are kept."""

from __future__ import annotations

import json
import os
import re
import tempfile

import pytest

from graphloom.operators import agents as AG
from graphloom.operators import search as SE
from graphloom.operators import vector_index as I
from graphloom.providers import HashEmbedding
from graphloom.sources import store as ST

EDGES = "src string, tgt string, relation string, weight double"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("ada", "engine", "designed"), ("ada", "notes", "wrote"), ("ada", "letters", "wrote"), ("byron", "ada", "father of"), ("engine", "brass", "made of")]
    return spark.createDataFrame([(*r, 1.0) for r in rows], EDGES)


@pytest.fixture(scope="module")
def topics(spark):
    return spark.createDataFrame([(1, "What did Ada write?", "ada"), (2, "Who?", "engine"), (3, "Nobody", "nobody")], "id long, question string, entity_name string")


class Rater:
    def complete(self, prompts):
        out = []
        for p in prompts:
            task, question, body = p.split("\t", 2)
            if task == "relations":
                out.append("{wrote (Score: 0.8)} {made up (Score: 0.9)} and {father of (Score: 0.2)}" if "Ada" in question else "no idea")
            elif task == "tails":
                names = body.split("\n")[1].split("; ")
                out.append("; ".join(f"{0.1 * (k + 1):.1f}" for k in range(len(names))) if "Ada" in question else "0.5")
            else:
                out.append("the paths 2 and 9, then 0" if "Ada" in question else "none of them")
        return out


def test_relations_are_rated(spark, edges, topics):
    got = sorted((r["id"], r["relation"], r["head"], r["score"]) for r in AG.rate_relations(edges, topics, 2, Rater()).collect())
    assert got == [(1, "father of", False, 0.2), (1, "wrote", True, 0.8), (2, "designed", False, 0.5), (2, "made of", True, 0.5)]
    plain = sorted((r["id"], r["relation"], r["score"]) for r in AG.rate_relations(edges, topics, 1).collect())
    assert plain == [(1, "wrote", 0.5), (2, "designed", 0.5)]
    before = spark.createDataFrame([(1, "q", "ada", ["father of", "wrote"], True)], "id long, question string, entity_name string, previous array<string>, previous_head boolean")
    assert {r["relation"] for r in AG.rate_relations(edges, before, 9).collect()} == {"wrote", "designed"}


def test_far_ends_are_rated(spark, edges, topics):
    chosen = AG.rate_relations(edges, topics, 2, Rater())
    got = [(r["id"], r["entity_name"], r["score"], r["topic_entity"]) for r in AG.rate_tails(edges, chosen, 3, Rater()).orderBy("id", "score", "entity_name").collect()]
    assert got == [(1, "letters", 0.1, "ada"), (1, "byron", 0.2, "ada"), (1, "notes", 0.2, "ada"), (2, "ada", 0.5, "engine"), (2, "brass", 0.5, "engine")]
    even = {(r["id"], r["entity_name"]): r["score"] for r in AG.rate_tails(edges, chosen, 9).collect()}
    assert even[1, "letters"] == even[1, "notes"] == 0.5 and even[1, "byron"] == 0.2


def test_many_far_ends_are_asked_in_pages(spark, monkeypatch):
    monkeypatch.setattr(AG, "PAGE", 3)
    edges = spark.createDataFrame([("hub", f"n{k}", "r", 1.0) for k in range(8)], EDGES)
    chosen = spark.createDataFrame([(1, "Ada", "hub", "r", True, 0.7)], "id long, question string, entity_name string, relation string, head boolean, score double")
    got = {r["entity_name"]: r["score"] for r in AG.rate_tails(edges, chosen, 99, Rater()).collect()}
    assert got == {f"n{k}": round(0.1 * (k % 3 + 1), 1) for k in range(8)}


def test_paths_are_picked(spark):
    paths = spark.createDataFrame([(i, k, ["a", str(k)]) for i in (1, 2) for k in range(4)], "id long, position long, path array<string>")
    questions = spark.createDataFrame([(1, "Ada"), (2, "Who")], "id long, question string")
    got = sorted((r["id"], r["position"]) for r in AG.pick_paths(paths, questions, 5, Rater()).collect())
    assert got == [(1, 0), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3)]
    assert AG.pick_paths(paths, questions).count() == 8 and AG.pick_paths(paths, questions, 1, Rater()).filter("id = 1").count() == 1


def test_questions_are_expanded_where_names_are_few(spark):
    names = ["french revolution", "french revolution", "revolution", "garden tea", "tea"]
    vectors = spark.createDataFrame([(n, e) for n, e in zip(names, HashEmbedding().embed(names))], "entity_name string, embedding array<double>")
    asked = spark.createDataFrame([(1, "What caused the French Revolution?"), (2, "tea")], "query_id long, question string")
    got = {}
    for r in SE.search_questions(vectors, asked, 4).collect():
        got.setdefault(r["query_id"], {})[r["entity_name"]] = r["score"]
    assert got[1].keys() == {"french revolution", "revolution", "garden tea", "tea"} and max(got[1], key=got[1].get) in ("french revolution", "revolution")
    near = SE.expand_plans(vectors, asked, 2, spark.createDataFrame([("tea", "pot"), ("garden tea", "pot")], "src string, tgt string"))
    assert {(r["seed"], r["entity_name"]) for r in near.filter("query_id = 2").collect()} >= {("tea", "pot")}


def test_questions_are_augmented(spark):
    rows = spark.createDataFrame([("Who is Ada?", ["ada", "Byron ", ""]), ("", ["x", "y"]), (None, ["x"]), ("q", None)], "q string, n array<string>")
    assert [r[0] for r in rows.select(SE.augmented(rows["q"], rows["n"])).collect()] == ["Who is Ada? Byron", "x y", "x", "q"]


def test_search_select_expand(spark, edges):
    chunks = spark.createDataFrame([(f"c{k}", t) for k, t in enumerate(["ada wrote notes on the engine", "byron wrote poems", "tea in the garden", "the engine was made of brass"])], "chunk_id string, content string")
    mentions = spark.createDataFrame([("c0", "ada"), ("c0", "engine"), ("c0", "notes"), ("c1", "byron"), ("c3", "engine"), ("c3", "brass")], "chunk_id string, entity_name string")
    nodes = spark.createDataFrame([(x, "thing", x) for x in ("ada", "engine", "notes", "letters", "byron", "brass")], "entity_name string, entity_type string, description string")
    got = SE.search_then_expand(chunks, mentions, nodes, edges, "who wrote notes?", ["engine"], top_chunks=2, most=2, neighbours=3)
    assert [r["chunk_id"] for r in got["chunks"].collect()][0] == "c0" and got["chunks"].count() == 2
    selected = {r["entity_name"] for r in got["selected"].collect()}
    assert len(selected) == 2 and selected <= {r["entity_name"] for r in got["candidates"].collect()}
    near = {(r["seed"], r["entity_name"]) for r in got["neighbours"].collect()}
    both = {(a, b) for a, b, *_ in edges.collect()} | {(b, a) for a, b, *_ in edges.collect()}
    assert near and near <= both and {s for s, _ in near} == selected
    none = SE.search_then_expand(chunks, mentions.limit(0), nodes, edges, "zzz")
    assert none["selected"].count() == 0 and none["neighbours"].count() == 0


def test_stores_keep_load_and_clean(spark):
    store = ST.Store(spark, tempfile.mkdtemp(prefix="store-"))
    a, b = (spark.createDataFrame([(k,)], "x int") for k in (1, 2))
    assert store.load("t") is None and store.save("t", a) and not store.save("t", b) and store.load("t").first()[0] == 1
    assert store.save("t", b, force=True) and store.load("t").first()[0] == 2
    store.clean("t")
    assert not store.exists("t")


def test_key_value_files(spark):
    folder = tempfile.mkdtemp(prefix="kv-")
    for name, text in (("a.json", json.dumps({"k1": {"x": 1}, "k2": "two"})), ("b.json", json.dumps({"k1": [1, 2]})), ("c.json", "broken")):
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    pairs = ST.read_kv(spark, folder)
    assert {r["key"]: r["value"] for r in pairs.collect()} == {"k1": "[1,2]", "k2": "two"}
    out = tempfile.mkdtemp(prefix="kv-") + "/rows"
    ST.write_kv(ST.upsert_kv(pairs, spark.createDataFrame([("k2", "new"), ("k3", None)], "key string, value string")), out)
    assert {r["key"]: r["value"] for r in ST.read_kv_rows(spark, out).collect()} == {"k1": "[1,2]", "k2": "new", "k3": None}


def test_indexes_are_kept(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)], "vec_id long, embedding array<double>")
    store, asked = ST.Store(spark, tempfile.mkdtemp(prefix="index-")), v.limit(5).selectExpr("vec_id AS query_id", "embedding AS q")
    assert ST.load_index(store, "i") is None
    kept = ST.save_index(I.build(v), store, "i")
    again = ST.load_index(store, "i")
    rows = lambda x: sorted(map(tuple, I.search(x, asked, 5).collect()))
    assert rows(kept) == rows(again) == rows(I.build(v)) and again.probes == kept.probes
    empty = ST.save_index(I.build(v.limit(0)), store, "none")
    assert I.search(empty, asked, 5).count() == 0


def test_communities_are_made_once(spark):
    store, made = ST.Store(spark, tempfile.mkdtemp(prefix="com-")), []
    member = spark.createDataFrame([("a", 0, "c")], "node string, level int, cluster string")

    def cluster():
        made.append("cluster")
        return member

    def report(m):
        made.append("report")
        return m.selectExpr("cluster", "'r' AS report_string")

    for force in (False, False, True):
        got = ST.communities(store, "x", cluster, report, force)
        assert got[0].count() == got[1].count() == 1
    assert made == ["cluster", "report", "report"] and re.match("r", got[1].first()["report_string"])
