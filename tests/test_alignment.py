"""Stems, common subsequences, METEOR and ROUGE-Lsum: fixed values and plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from graphloom.functions import alignment as AL
from graphloom.queries import QUERIES
from tests.compare import SF


@pytest.mark.parametrize(("word", "want"), [x.split() for x in (
    "caresses caress|ponies poni|ties ti|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|"
    "fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|valenci valenc|digitizer digit|conformabli conform|radicalli radic|differentli differ|vileli vile|analogousli analog|"
    "vietnamization vietnam|predication predic|operator oper|feudalism feudal|decisiveness decis|hopefulness hope|callousness callous|formaliti formal|sensitiviti sensit|sensibiliti sensibl|triplicate triplic|formative form|"
    "formalize formal|electriciti electr|electrical electr|hopeful hope|goodness good|revival reviv|allowance allow|inference infer|airliner airlin|gyroscopic gyroscop|adjustable adjust|defensible defens|irritant irrit|replacement replac|"
    "adjustment adjust|dependent depend|adoption adopt|homologou homolog|communism commun|activate activ|angulariti angular|homologous homolog|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll|"
    "generalizations gener|oscillators oscil|be be|yes ye").split("|")])
def test_stems(word, want):
    assert AL.stem(word) == want


def plain_lcs(a, b):
    best = 0
    for r in range(len(a), 0, -1):
        for some in combinations(a, r):
            it = iter(b)
            if all(x in it for x in some):
                return r
    return best


def test_common_subsequences():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 8))] for _ in range(2))
        n = plain_lcs(a, b)
        places = AL.lcs_places(a, b)
        it = iter(b)
        assert AL.lcs_length(a, b) == n == len(places) and all(a[i] in it for i in sorted(places))
    a, b = ([rng.choice("abcdefgh") for _ in range(3000)] for _ in range(2))
    assert AL.lcs_length(a, b) == len(AL.lcs_places(a, b))


def plain_lsum(said, told):
    cut = lambda t: [s for s in ([AL.stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", p)] for p in re.split(r"(?<=[.!?])\s+|\n", t.lower())) if s]
    said, told = cut(said), cut(told)
    left, right, hits = Counter(w for s in said for w in s), Counter(w for s in told for w in s), 0
    n, m = left.total(), right.total()
    for t in told:
        held = set()
        for s in said:
            table = [[0] * (len(s) + 1) for _ in range(len(t) + 1)]
            for i, x in enumerate(t):
                for j, y in enumerate(s):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            i, j = len(t), len(s)
            while i > 0 and j > 0:
                if t[i - 1] == s[j - 1]:
                    held.add(i - 1)
                    i, j = i - 1, j - 1
                elif table[i][j - 1] > table[i - 1][j]:
                    j -= 1
                else:
                    i -= 1
        for k in sorted(held):
            if left[t[k]] and right[t[k]]:
                hits, left[t[k]], right[t[k]] = hits + 1, left[t[k]] - 1, right[t[k]] - 1
    return (hits / n if n else 0.0), (hits / m if m else 0.0)


def test_rouge_lsum():
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice(["walking", "walks", "the", "cat", "cats.", "runs!", "on", "a\n", "mat"]) for _ in range(rng.randint(0, 25)))
    for _ in range(150):
        a, b = text(), text()
        p, r, f = AL.rouge_lsum(a, b)
        assert (p, r) == pytest.approx(plain_lsum(a, b)) and f == pytest.approx(2 * p * r / (p + r) if p + r else 0.0)
    assert AL.rouge_lsum("one two three\nfour", "four\nthree two one")[1] == pytest.approx(0.5)


@pytest.mark.parametrize(("said", "told", "pairs", "chunks"), [
    ("the cat sat", "the cat sat", 3, 1), ("the cat sat", "sat the cat", 3, 2), ("cats running", "the cat runs", 2, 1), ("a b", "c d", 0, 0), ("a a", "a", 1, 1), ("x quick y", "x fast y", 3, 1)])
def test_meteor(said, told, pairs, chunks):
    p, r = pairs / len(said.split()), pairs / len(told.split())
    want = p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (chunks / pairs) ** 3) if pairs else 0.0
    assert AL.meteor(said, told, {"quick": "1", "fast": "1"}) == pytest.approx(want)


def test_pairs_use_each_place_once():
    rng = random.Random(5)
    for _ in range(100):
        a, b = ([rng.choice(["run", "runs", "cat", "dog"]) for _ in range(rng.randint(0, 9))] for _ in range(2))
        found = AL.align(a, b, [lambda w: w, AL.stem])
        assert len({i for i, _ in found}) == len(found) == len({j for _, j in found})
        assert len(found) == (Counter(map(AL.stem, a)) & Counter(map(AL.stem, b))).total()


def test_best_of_several_references(spark):
    rows = spark.createDataFrame([("a cat", ["no", "a cat", None]), ("a cat", []), (None, ["a"]), ("", ["a"]), ("a", None)], "p string, r array<string>")
    got = [r["s"] for r in rows.select(AL.alignment_scores(rows["p"], rows["r"]).alias("s")).collect()]
    assert got[0]["rouge_lsum"] == 1.0 and got[0]["meteor"] == pytest.approx(1 - 0.5 / 8) and all(tuple(g) == (0.0,) * 4 for g in got[1:])


def test_query_takes_the_best_item_of_each_document(spark):
    got = QUERIES["qa_meteor_rouge_lsum"](spark, SF).collect()
    assert got and len({r["doc_id"] for r in got}) == len(got) and all(0 < r["rouge_lsum"] <= 1 and 0 < r["meteor"] <= 1 for r in got)
