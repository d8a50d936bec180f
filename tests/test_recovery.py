"""Name resolution, JSON recovery, ontologies and builds in batches against plain versions."""

from __future__ import annotations

import json
import os
import random
import tempfile

import pytest

from graphloom import providers as P
from graphloom.functions import recovery as RC
from graphloom.operators import merge as M
from graphloom.operators import ontology as ON
from graphloom.operators import resolution as RS
from graphloom.streaming import build as B


def plain_nearest(nodes, tokens):
    best = None
    for n in nodes:
        own = set(n.lower().split())
        shared = len(own & set(tokens))
        if shared and (best is None or (-shared, len(own), len(n), n) < best):
            best = (-shared, len(own), len(n), n)
    return best


def test_nearest_names_equal_a_full_comparison(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)] + ["of", "the"] * 6
    nodes = sorted({" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(150)}) + ["Mixed Case w1"]
    asked = {f"q{i}": sorted({*rng.choices([*words, "unknown", "nope"], k=rng.randint(1, 6))}) for i in range(80)}
    index = RS.token_index(spark.createDataFrame([(n,) for n in nodes] + [(None,)], "entity_name string"))
    got = {r["name"]: (r["entity_name"], r["shared"]) for r in RS.nearest_names(index, spark.createDataFrame(list(asked.items()), "name string, tokens array<string>")).collect()}
    want = {q: plain_nearest(nodes, t) for q, t in asked.items()}
    assert got == {q: (w[3], -w[0]) for q, w in want.items() if w}


def test_names_without_nodes_and_chunks_of_names(spark):
    nodes = spark.createDataFrame([("ada lovelace", "person", ["c1", "c2"]), ("chunk nine", "chunk", []), ("engine", "thing", [])], "entity_name string, entity_type string, source_ids array<string>")
    asked = ["Ada_Lovelace", "lovelace", "chunk_c3", "chunk nine", "chunk  nine!", "!!", "engine", None, "analytical engine", "zzz"]
    names = spark.createDataFrame([(a,) for a in asked], "name string")
    got = {r["name"]: (r["entity_name"], r["how"]) for r in RS.resolve_ids(nodes, names).collect()}
    assert got == {
        "Ada_Lovelace": ("ada lovelace", "clean"), "lovelace": ("ada lovelace", "subset"), "chunk_c3": (None, "chunk"), "chunk nine": ("chunk nine", "exact"), "chunk  nine!": (None, "none"), "!!": (None, "none"),
        "engine": ("engine", "exact"), "analytical engine": ("engine", "partial"), "zzz": (None, "none")}
    edges = spark.createDataFrame([("chunk nine", "engine"), ("ada lovelace", "engine")], "src string, tgt string")
    chunks = spark.createDataFrame([(c, f"text of {c}") for c in ("c1", "c2", "chunk_c3", "chunk nine")], "chunk_id string, content string")
    rows = sorted((r["name"], r["chunk_id"]) for r in RS.chunks_of_names(nodes, edges, names, chunks).collect())
    assert rows == sorted([("Ada_Lovelace", "c1"), ("Ada_Lovelace", "c2"), ("lovelace", "c1"), ("lovelace", "c2"), ("chunk_c3", "chunk_c3"), ("engine", "chunk nine"), ("analytical engine", "chunk nine")])
    assert [(r["name"], r["chunk_id"]) for r in RS.chunks_of_names(nodes, edges, names.filter("name = 'lovelace'"), chunks, 1).collect()] == [("lovelace", "c1")]


@pytest.mark.parametrize(("text", "want"), [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}), ('```{"a": 1}```', {"a": 1}), ("[1, 2]", [1, 2]), ('so {"a": {"b": "}"}} then {"c": 1}', {"a": {"b": "}"}}),
    ('bad {oops} good {"a": 2}', {"a": 2}), ('] } {"a": "x \\" } y"}', {"a": 'x " } y'}), ('{"a": 1, "b": "two", "c": true', {"a": 1, "b": "two", "c": True}), ("score: 4.5\nname: Ada", {"score": 4.5, "name": "Ada"}),
    ('{"a": [1, 2], oops, "n": {"x": 1}', {"a": [1, 2], "n": {"x": 1}}), ('{"a": [1, b]', {"a": "[1, b]"}), ("v: 1.2.3", {"v": "1.2.3"}), ("nothing", {}), ("", {}), ('"just a string"', {}), ("{" * 3000, {}), (None, None)])
def test_broken_answers(text, want):
    assert RC.recover(text) == want


def test_recovered_column(spark):
    rows = spark.createDataFrame([('x {"b": 1, "a": "é"}',), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(RC.recovered(rows["t"])).collect()] == ['{"a": "é", "b": 1}', None, "{}"]


def plain_union(views):
    entities, shared = {}, set()
    for v in views:
        for name, d in v["entities"].items():
            if name in entities:
                shared.add(name)
                entities[name]["properties"] = {**entities[name]["properties"], **d["properties"]}
            else:
                entities[name] = json.loads(json.dumps(d))
    relations = {}
    for v in views:
        for name, d in v["relationships"].items():
            relations.setdefault(name, d)
    return entities, shared, relations


def test_ontologies_are_united(spark):
    rng = random.Random(2)
    groups = []
    for g in range(6):
        views = []
        for k in range(rng.randint(1, 4)):
            entity = lambda k=k: {"description": f"d{k}", "properties": {p: f"{p}{k}" for p in rng.sample("abcd", rng.randint(0, 3))}, "key_property": rng.choice(["a", None])}
            relation = {"description": f"r{k}", "domain": "User", "range": None, "properties": ["t"]}
            views.append({"entities": {e: entity() for e in rng.sample(["User", "Post", "Tag"], rng.randint(0, 3))}, "relationships": {r: relation for r in rng.sample(["LIKES", "SEES"], rng.randint(0, 2))}})
        groups.append(views)
    rows = [(g, k, json.dumps(v)) for g, views in enumerate(groups) for k, v in enumerate(views)] + [(90, 0, "no json"), (91, 0, None)]
    parsed = ON.parse(spark.createDataFrame(rows, "g int, place int, ontology string"))
    e = ON.unify_entities(parsed, ["g"])
    got = {}
    for r in e.collect():
        got.setdefault(r["g"], {})[r["name"]] = (r["description"], r["key_property"], r["properties"], r["shared"])
    links = {}
    for r in ON.unify_relationships(parsed, ["g"]).collect():
        links.setdefault(r["g"], {})[r["name"]] = r["description"]
    tied = {r["g"] for r in ON.bridges(e, ["g"]).collect()}
    for g, views in enumerate(groups):
        entities, shared, relations = plain_union(views)
        assert got.get(g, {}) == {n: (d["description"], d["key_property"], d["properties"], n in shared) for n, d in entities.items()}
        assert links.get(g, {}) == {n: d["description"] for n, d in relations.items()}
        assert (g in tied) == ("User" in shared and "Post" in entities)
    assert 90 not in got and 91 not in got


def record(i):
    return f'("entity"<|>"e{i % 5}"<|>"kind{i % 2}"<|>"about {i}")##("relationship"<|>"e{i % 5}"<|>"e{(i + 1) % 5}"<|>"tie {i}"<|>{i + 1})<|COMPLETE|>'


class Echo:
    """Gives back the chunk; fails on the first try of some, for good on one. It counts in files, as tasks are other processes."""

    def __init__(self, folder, once=(), always=()):
        self.folder, self.once, self.always = folder, once, always

    def complete(self, prompts):
        if len(prompts) > 1 and any(f"about {i}\"" in p for p in prompts for i in (*self.once, *self.always)):
            raise ValueError("the batch has one that fails")
        out = []
        for p in prompts:
            for i in (*self.once, *self.always):
                if f'about {i}"' in p:
                    mark = os.path.join(self.folder, f"{i}")
                    if i in self.always or not os.path.exists(mark):
                        open(mark, "w").close()
                        raise ValueError("no answer")
            out.append(p.split("\t", 1)[1])
        return out


def put(folder, name, ids):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f".{name}"), "w") as f:
        f.writelines(json.dumps({"chunk_id": f"c{i}", "content": record(i)}) + "\n" for i in ids)
    os.rename(os.path.join(folder, f".{name}"), os.path.join(folder, name))


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_a_build_in_parts_equals_one_in_one_go(spark):
    base = tempfile.mkdtemp(prefix="build-")
    source = lambda x: spark.readStream.schema("chunk_id string, content string").option("maxFilesPerTrigger", 1).json(f"{base}/{x}")
    put(f"{base}/in", "a.json", range(6))
    provider = Echo(tempfile.mkdtemp(), once=(2, 7), always=(4,))
    B.build(source("in"), f"{base}/parts", provider)
    seen = {r["chunk_id"]: (r["status"], r["attempt"]) for r in B.ledger(spark, f"{base}/parts").collect()}
    assert seen["c2"] == ("done", 2) and seen["c4"] == ("failed", 2) and seen["c0"] == ("done", 1)
    put(f"{base}/in", "b.json", [*range(4, 10), 0])  # some come again
    B.build(source("in"), f"{base}/parts", provider)
    put(f"{base}/all", "a.json", range(10))
    B.build(source("all"), f"{base}/whole", Echo(tempfile.mkdtemp(), always=(4,)))
    for a, b in zip(B.graph(spark, f"{base}/parts"), B.graph(spark, f"{base}/whole")):
        assert rows_of(a) == rows_of(b)
    done = {r["chunk_id"] for r in B.ledger(spark, f"{base}/parts").filter("status = 'done'").collect()}
    assert done == {f"c{i}" for i in range(10) if i != 4}


def test_provider_failures_end_the_job_unless_asked_otherwise(spark):
    rows = spark.createDataFrame([(f"records\t{record(i)}",) for i in range(3)] + [(None,)], "p string").coalesce(1)
    got = P.complete(rows, rows["p"], "a", Echo(tempfile.mkdtemp(), always=(1,)), nulls=True).collect()
    assert [r["a"] for r in got] == [record(0), None, record(2), None]
    with pytest.raises(Exception, match="fails|no answer"):
        P.complete(rows, rows["p"], "a", Echo(tempfile.mkdtemp(), always=(1,))).collect()


def test_upserted_edges_equal_a_full_merge(spark):
    rng = random.Random(1)
    schema = "src_id string, tgt_id string, relation_name string, description string, keywords string, weight double, source_id string"
    rows = [(rng.choice("abc"), rng.choice("cde"), rng.choice(["r", "s", ""]), rng.choice(["x", "y", ""]), rng.choice(["k", ""]), float(rng.randint(1, 3)), f"s{i}") for i in range(40)]
    old, new = spark.createDataFrame(rows[:25], schema), spark.createDataFrame(rows[25:] + rows[20:25], schema)  # five come again
    got, want = M.upsert_edges(M.merge_edges(old), new), M.merge_edges(spark.createDataFrame(rows, schema))
    assert rows_of(got) == rows_of(want)
    assert rows_of(M.upsert_edges(M.merge_edges(old), new.limit(0))) == rows_of(M.merge_edges(old))
