"""Scores of answers by alignment: word stems, longest common subsequences, METEOR and ROUGE-Lsum, best of several references."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: weights of METEOR
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5
#: fixed values: the suffixes of the stemmer's second and third step with what takes their place, and those its fourth drops
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """A letter a run: v for vowels, c for consonants; y after a consonant is a vowel."""
    kinds = ""
    for k, x in enumerate(stem):
        vowel = x in "aeiou" or (x == "y" and k > 0 and kinds[-1:] == "c")
        kinds += "v" if vowel else "c"
    return kinds


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, pairs: Iterable[tuple[str, str]], least: int) -> str:
    """The longest suffix that fits is replaced if what is before it has a measure over ``least``."""
    for end, put in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + put if _measure(stem) > least and (end != "ion" or stem[-1:] in ("s", "t")) else word
    return word


@lru_cache(100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word after Porter (1980)."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: len(word) - len(end)]):
                word = word[: len(word) - len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word[-2:-1] == word[-1:] and _shape(word)[-1:] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP_2, 0), STEP_3, 0)
    word = _swap(word, [(x, "") for x in STEP_4], 1)
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    at: dict = defaultdict(int)
    for k, x in enumerate(b):
        at[x] |= 1 << k
    row = full = (1 << len(b)) - 1
    for x in a:
        kept = row & at.get(x, 0)
        row = ((row + kept) | (row - kept)) & full
    return len(b) - row.bit_count()


def lcs_places(a: list, b: list) -> set[int]:
    """Places in ``a`` of one longest common subsequence: from the ends, a match is taken, else the side with more left is kept, of equal ones a shorter ``a``."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    codes: dict = {}
    y = np.array([codes.setdefault(x, len(codes)) for x in b], np.int64)
    for i, x in enumerate(a):
        # a match adds one to the diagonal; the rest of the row is the best so far from above and the left
        diagonal = table[i, :-1] + (y == codes.get(x, -1))
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], diagonal))
    out, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif table[i, j - 1] > table[i - 1, j]:
            j -= 1
        else:
            i -= 1
    return out


def _sentences(text: str) -> list[list[str]]:
    """Stemmed words of each sentence; a sentence ends at a line's end, or at . ! ? before white space."""
    parts = re.split(r"(?<=[.!?])\s+|\n", text.lower())
    found = [[stem(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", p)] for p in parts]
    return [s for s in found if s]


def rouge_lsum(prediction: str, reference: str) -> tuple[float, float, float]:
    """Precision, recall and F of the words of each reference sentence that a longest common subsequence with any sentence of the prediction holds.

    A word counts at most as often as either side has it.
    """
    said, told = _sentences(prediction), _sentences(reference)
    n, m = sum(map(len, said)), sum(map(len, told))
    left, right = defaultdict(int), defaultdict(int)
    for s in said:
        for w in s:
            left[w] += 1
    for s in told:
        for w in s:
            right[w] += 1
    hits = 0
    for t in told:
        for k in sorted(set().union(*(lcs_places(t, s) for s in said)) if said else ()):
            if left[t[k]] > 0 and right[t[k]] > 0:
                hits += 1
                left[t[k]] -= 1
                right[t[k]] -= 1
    p, r = (hits / n if n else 0.0), (hits / m if m else 0.0)
    return p, r, 2 * p * r / (p + r) if hits else 0.0


def align(a: list[str], b: list[str], stages: Iterable) -> list[tuple[int, int]]:
    """Pairs of places, each used once. A stage pairs words whose form it maps to one value: from the end of ``a``, with the last free word of ``b``."""
    pairs: list[tuple[int, int]] = []
    free_a, free_b = list(range(len(a))), list(range(len(b)))
    for form in stages:
        places: dict = defaultdict(list)
        for j in free_b:
            if (f := form(b[j])) is not None:
                places[f].append(j)
        for i in reversed(free_a):
            if (own := places.get(form(a[i]))):
                pairs.append((i, own.pop()))
        used_a, used_b = {i for i, _ in pairs}, {j for _, j in pairs}
        free_a, free_b = [i for i in free_a if i not in used_a], [j for j in free_b if j not in used_b]
    return sorted(pairs)


def meteor(prediction: str, reference: str, synonyms: dict[str, str] | None = None) -> float:
    """METEOR of white-space words in lower case: equal words, then equal stems, then words of one class of ``synonyms`` are paired;
    the weighted mean of precision and recall, less a penalty for pairs that don't run on from one another."""
    a, b = prediction.lower().split(), reference.lower().split()
    stages = [lambda w: w, stem] + ([synonyms.get] if synonyms else [])
    pairs = align(a, b, stages)
    if not pairs:
        return 0.0
    p, r, n = len(pairs) / len(a), len(pairs) / len(b), len(pairs)
    chunks = 1 + sum(y != (x[0] + 1, x[1] + 1) for x, y in zip(pairs, pairs[1:]))
    return (1 - GAMMA * (chunks / n) ** BETA) * p * r / (ALPHA * p + (1 - ALPHA) * r)


def alignment_scores(prediction: Column, references: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Struct of meteor, rouge_lsum (F), rouge_lsum_precision and rouge_lsum_recall, each the best over an array of references.

    Null or empty texts score 0, as do no references; null references are left out.
    """

    @F.pandas_udf("meteor double, rouge_lsum double, rouge_lsum_precision double, rouge_lsum_recall double")
    def run(said, told):
        import pandas as pd

        out = []
        for p, refs in zip(said, told, strict=True):
            best = [0.0] * 4
            for r in refs if refs is not None else ():
                if p and r:
                    precision, recall, f = rouge_lsum(p, r)
                    best = [max(x, round(y, 6)) for x, y in zip(best, (meteor(p, r, synonyms), f, precision, recall))]
            out.append(best)
        return pd.DataFrame(out, columns=["meteor", "rouge_lsum", "rouge_lsum_precision", "rouge_lsum_recall"])

    return run(prediction, references)
