"""Queries leave nothing out: on tables whose keys all lie beyond any short range, and on whole texts."""

from __future__ import annotations

import math
import os
import random
import re
import string
from collections import Counter

import duckdb
import pytest

from graphloom.queries import QUERIES, SQL
from graphloom.queries.registry import WHOLE
from tests.compare import SF, TABLES, same

SHIFT = 200_000


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """The smallest tables with SHIFT added to every order's key."""
    top = tmp_path_factory.mktemp("far")
    for t in TABLES:
        key = {"lineitem": "l_orderkey", "orders": "o_orderkey"}.get(t)
        if key:
            duckdb.sql(f"COPY (SELECT * REPLACE ({key} + {SHIFT} AS {key}) FROM read_parquet('{SF}/{t}.parquet')) TO '{top}/{t}.parquet'")
        else:
            os.symlink(f"{SF}/{t}.parquet", f"{top}/{t}.parquet")
    return str(top)


def test_whole_forms_are_registered():
    assert len(WHOLE) == 15 and all(n in SQL and "_orderkey <" not in SQL[n].replace("l_orderkey < 2000", "") for n in WHOLE)


@pytest.mark.parametrize("name", WHOLE)
def test_no_key_is_left_out(spark, far, name):
    got, want = same(spark, QUERIES[name], SQL[name], far)
    assert got == want and got


def test_every_line_is_parsed_and_merged(spark, far):
    lines = duckdb.sql(f"SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM read_parquet('{far}/lineitem.parquet')").fetchall()
    assert QUERIES["parse_entity_records"](spark, far).count() == QUERIES["parse_relation_records"](spark, far).count() == len(lines)
    weight = {}
    for part, supplier, _, number in lines:
        pair = (f"part {part}", f"supplier  {supplier}")
        weight[pair] = weight.get(pair, 0) + number
    assert {(r["src"], r["tgt"]): r["weight"] for r in QUERIES["merge_edges_undirected"](spark, far).collect()} == weight


@pytest.fixture(scope="module")
def passages(spark, tmp_path_factory):
    """(items, documents, folder): passages far behind the first 400 characters, of other ids modulo 40, in any language."""
    random.seed(4)
    word = lambda: "".join(random.choices(string.ascii_lowercase, k=random.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = {1: text(30), 2: text(20), 3: "a short item here", 4: text(8)}
    docs = {
        10: (text(300) + " " + items[1], "en"), 11: (items[1] + " The, " + text(200) + ". " + items[2].upper(), "de"), 12: (text(90) + " " + " ".join(items[2].split()[5:13]) + " thing mention " + text(9), "es"),
        13: (" ".join(items[2].split()[:7]) + " " + text(100), "en"), 14: (text(100) + " A short ITEM, here", "en"), 15: (text(100) + " short item here " + items[4], "fr"), 16: (items[4], "en"), 17: (None, "en"), 18: ("", "en")}
    top = str(tmp_path_factory.mktemp("passages"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(i, *x) for i, x in docs.items()], "doc_id long, text string, lang string").write.parquet(f"{top}/documents.parquet")
    return items, {i: x[0] for i, x in docs.items()}, top


HELD = {(1, 10), (1, 11), (2, 11), (2, 12), (3, 14), (4, 15), (4, 16)}


def plain_answer(t):
    t = "".join(c for c in t.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", t).split())


def grams(w, n):
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute_scores(p, g):
    p, g = plain_answer(p), plain_answer(g)
    same_n = sum((grams(p.split(), 1) & grams(g.split(), 1)).values())
    a, b = same_n / len(p.split()), same_n / len(g.split())
    return (float(p == g), 2 * a * b / (a + b), a, b, float(g in p))


def brute_bleu(p, g, order, smooth):
    p, g, logs = p.lower().split(), g.lower().split(), 0.0
    for n in range(1, order + 1):
        add = 1.0 if smooth and n > 1 else 0.0
        logs += math.log((sum((grams(p, n) & grams(g, n)).values()) + add) / (max(0, len(p) - n + 1) + add)) / order
    return (1.0 if len(p) >= len(g) else math.exp(1 - len(g) / len(p))) * math.exp(logs)


def brute_rouge(p, g):
    p, g = p.lower().split(), g.lower().split()
    t = [[0] * (len(g) + 1) for _ in range(len(p) + 1)]
    for i, x in enumerate(p):
        for j, y in enumerate(g):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return 2 * t[-1][-1] / (len(p) + len(g))


def test_answers_are_scored_whole(spark, passages):
    items, docs, top = passages
    rows = lambda name: {(r["item_id"], r["doc_id"]): r for r in QUERIES[name](spark, top).collect()}
    names = ("em", "f1", "precision", "recall", "accuracy")
    want = {(i, d): brute_scores(docs[d], items[i]) for i, d in HELD}
    got = rows("qa_em_f1")
    assert got.keys() == HELD and all(got[k][n] == pytest.approx(v, abs=1e-6) for k in HELD for n, v in zip(names, want[k], strict=True))
    assert want[1, 10][4] == 1.0 and want[4, 16][0] == 1.0
    mean = QUERIES["qa_short_form"](spark, top).first()
    assert mean["n"] == len(HELD) and all(mean[n] == pytest.approx(100 * sum(v[j] for v in want.values()) / len(HELD), abs=1e-4) for j, n in enumerate(names))
    got = rows("qa_bleu1")
    assert got.keys() == HELD and all(got[i, d]["bleu1"] == pytest.approx(brute_bleu(docs[d], items[i], 1, False), abs=1e-6) for i, d in HELD)
    got = rows("qa_bleu4_rouge_l")
    assert got.keys() == HELD and all(got[i, d]["bleu4"] == pytest.approx(brute_bleu(docs[d], items[i], 4, True), abs=1e-6) for i, d in HELD)
    assert all(got[i, d]["rouge_l"] == pytest.approx(brute_rouge(docs[d], items[i]), abs=1e-6) for i, d in HELD)


def test_string_hits_read_whole_texts(spark, passages):
    _, docs, top = passages
    got = {r["doc_id"]: r for r in QUERIES["qa_str_hit"](spark, top).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        t = plain_answer(t or "")
        hits = [any(x in t for x in ("of and", "thing")), "tion" in t]
        assert docs[i] is None or (got[i]["str_em"], got[i]["str_hit"]) == (sum(hits) / 2, float(all(hits)))
    assert got[12]["str_hit"] == 1.0 and docs[12].index("thing") > 400
