"""Exact dedup, importance resampling and periodic runs against plain versions of themselves, with edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import resample as R
from graphloom.llm import runs as PR
from graphloom.llm import trie_dedup as T
from graphloom.llm.queries import QUERIES
from tests.compare import SF

DOCS = "doc_id long, text string, lang string, id string, record int, sha string, size int, part int, rank int, runs string, words string, owner string"
LONG = "very long word list " * 20_000


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "id", 1, "sha", 2, 3, 4, "r", "w", "o") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns with the names used inside."""
    return docs_of(spark, [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a b c"), (5, "a b c"), (6, "a b c"), (7, "a b"), (8, "A b"), (None, "a b c"), (None, None), (None, "alone"), (None, "alone"), (9, "漢字 ▁ é x\r\n🙂" * 3)])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


# exact dedup


def test_tries_hold_what_was_put_in():
    rng = random.Random(2)
    tries, want, got = T.Tries(), Counter(), Counter()
    for _ in range(4000):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) + rng.choice([b"", b"same tail", b"same tail too"])
        node = tries.reach(text, zlib.crc32(text), 8)
        node.end = (node.end or 0) + 1
        want[text] += 1
        if tries.bytes > 20_000:
            before = tries.bytes
            for found, n in tries.spill(10_000):
                assert len(found) >= 0
                got[found] += n
            assert tries.bytes < before and tries.bytes <= 10_000
    for found, n in tries.spill(-1):
        got[found] += n
    assert got == want and not tries.parts


def test_subtree_is_a_compressed_radix_trie():
    part = T.Subtree()
    for text in (b"romane", b"romanu", b"romulu", b"rubens"):
        part.reach(text).end = 1
    (r,) = part.root.children.values()
    assert r.label == b"r" and sorted(c.label for c in r.children.values()) == [b"om", b"ubens"]
    assert sorted(t for t, _ in part.ends()) == [b"romane", b"romanu", b"romulu", b"rubens"]
    assert part.reach(b"romulu").end == 1 and part.reach(b"romul").end is None


def brute_groups(rows, largest):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        ids = [j for j in same if j is not None]
        out.append((i, (max(ids) if largest else min(ids)) if ids else None, len(same), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("held", [T.HELD, 3000])
def test_exact_groups_equal_brute_force(spark, odd, keep, held):
    rng = random.Random(7)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(100 + k, rng.choice(["copy of many", "x" * rng.randrange(40), f"own {k}", "x" * 20 + "y"])) for k in range(300)]
    got = T.exact_groups(docs_of(spark, rows).repartition(5), keep=keep, held=held).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute_groups(rows, keep == "largest")
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_groups_edges(spark, odd, none):
    assert T.exact_groups(none).count() == 0 and T.drop_copies(none).count() == 0
    kept = T.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(((r["doc_id"], (r["text"] or "")[:5]) for r in kept.collect()), key=str) == sorted([(1, ""), (3, " \n\t "), (4, "very "), (5, "a b c"), (7, "a b"), (8, "A b"), (9, "漢字 ▁ "), (None, "alone")], key=str)
    lower = {r["doc_id"]: r["keep_id"] for r in T.exact_groups(odd, text=F.lower("text")).collect()}
    assert lower[8] == 7


# importance resampling


def brute_resample(rows, target, orders, buckets, percent, least, seed):
    def counts(text):
        w = R.words_of(text or "")
        return len(w), Counter(zlib.crc32(b" ".join(w[i : i + n])) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1))

    each = [(i, *counts(t)) for i, t in rows]
    s, t = sum((c for _, _, c in each), Counter()), sum((counts(x)[1] for x in target), Counter())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out = []
    for i, n, c in each:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(k * gain[b] for b, k in c.items())
        out.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    ranked = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = ranked[: percent * len(ranked) // 100]
    return sorted((tuple(r[:4]) for r in out), key=str), [r[0] for r in drawn]


@pytest.mark.parametrize("orders", [1, 2])
@pytest.mark.parametrize("block", [R.BLOCK_FEATURES, 5])
def test_resample_equals_brute_force(spark, odd, monkeypatch, orders, block):
    monkeypatch.setattr(R, "BLOCK_FEATURES", block)
    rng = random.Random(11)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(100 + k, " ".join(rng.choices(["Alpha", "beta2", "gamma-delta", "é", "x_y"], k=rng.randrange(40)))) for k in range(200)]
    target = ["beta2 beta2 X y alpha", None, "é"]
    got = R.resample(docs_of(spark, rows).repartition(3), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"), orders=orders, buckets=97, percent=30).collect()
    want, drawn = brute_resample(rows, target, orders, 97, 30, 20, 2024)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=str) == want
    assert [r["doc_id"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_resample_without_rows_or_target(spark, odd, none):
    target = spark.createDataFrame([], "item_id long, text string")
    assert R.resample(none, target).count() == 0
    got = R.resample(odd, target).collect()
    assert len(got) == odd.count() and {r["weight"] for r in got if not r["n_features"]} == {0} and all(r["rank"] is None for r in got if not r["n_features"])


def test_matrix_is_compressed_rows(spark, odd):
    blocks = R.count_matrix(odd.coalesce(1), buckets=50)
    for b in blocks.collect():
        assert len(b["starts"]) == len(b["ids"]) + 1 == len(b["words"]) + 1 and b["starts"][-1] == len(b["columns"]) == len(b["counts"])
        for k in range(len(b["ids"])):
            row = b["columns"][b["starts"][k] : b["starts"][k + 1]]
            assert row == sorted(set(row)) and sum(b["counts"][b["starts"][k] : b["starts"][k + 1]]) == b["words"][k]
    assert R.column_sums(blocks, 50).sum() == sum(sum(b["words"]) for b in blocks.collect())


# periodic runs


def brute_runs(w, least, power):
    out = set()
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                out.add((i, j - i + q, q))
            i = j + 1
    return sorted(r for r in out if not any(all(w[t] == w[t + d] for t in range(r[0], r[0] + r[1] - d)) for d in range(1, r[2])))


def some_words(rng, n):
    w = [bytes([97 + rng.randrange(rng.choice([1, 2, 3, 5]))]) for _ in range(n)]
    if rng.random() < 0.6:
        p, a = rng.randint(1, 12), rng.randrange(n)
        w = w[:a] + (w[a : a + p] * n)[: n - a]
        if rng.random() < 0.5:
            w[rng.randrange(n)] = b"z"
    return w


@pytest.mark.parametrize(("least", "power"), [(24, 3), (6, 3), (12, 3), (2, 2), (4, 2), (16, 4)])
def test_runs_equal_brute_force(least, power):
    rng = random.Random(least * power)
    for _ in range(250):
        w = some_words(rng, rng.randint(1, 70))
        want = brute_runs(w, least, power)
        assert PR.runs_of_many([w], least, power) == [want]
        stretches = PR.repeating(np.array([x[0] for x in w], np.uint64), least, power)
        own = PR.runs_of_many([w[a:b] for a, b in stretches], least, power) if stretches else []
        assert sorted((a + s, n, q) for (a, _), r in zip(stretches, own) for s, n, q in r) == want


def test_covering_squares_hold_each_leftmost_square():
    rng = random.Random(5)
    for _ in range(60):
        w = [rng.randrange(3) for _ in range(rng.randint(2, 40))]
        _, x = np.unique(w, return_inverse=True)
        tree = PR.SuffixTree(np.append(x, x.max() + 1))
        low, high, period = PR.covering_squares(tree)
        held = {(s, q) for a, b, q in zip(low.tolist(), high.tolist(), period.tolist()) for s in range(a, b - 2 * q + 1)}
        seen = set()
        for s in range(len(w)):
            for q in range(1, (len(w) - s) // 2 + 1):
                root = tuple(w[s : s + q])
                primitive = not any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q))
                if primitive and tuple(w[s + q : s + 2 * q]) == root and root not in seen:
                    seen.add(root)
                    assert (s, q) in held


def test_runs_of_one_long_text(spark):
    words = [b"%d" % (k % 3000) for k in range(20_000)]
    assert PR.runs_of_many([words, [b"a"] * 30_000]) == [[(0, 20_000, 3000)], [(0, 30_000, 1)]]


def test_find_runs_rows(spark, odd, none):
    text = "one two " + "x y z " * 9 + "three"
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(50, text), (51, text), (None, text)]
    got = PR.find_runs(docs_of(spark, rows).repartition(2), batch=10).collect()
    by = {(r["doc_id"], r["collapsed"][:20]): r for r in got}
    assert len(got) == len(rows) and all(r["runs"] is not None for r in got)
    for i in (50, 51, None):
        r = by[i, "one two x y z three"]
        assert [tuple(t) for t in r["runs"]] == [(2, 27, 3)]
    assert [tuple(t) for t in by[4, "very long word list"]["runs"]] == [(0, 80_000, 4)]
    assert by[1, ""]["runs"] == [] and by[3, ""]["runs"] == []
    assert PR.find_runs(none).count() == 0
    digests = {r["doc_id"]: r for r in PR.run_digests(PR.find_runs(odd)).collect()}
    assert digests[1]["n_runs"] == 0 and digests[1]["start"] is None and digests[1]["runs_sha256"] == digests[1]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert digests[4]["exponent_milli"] == 20_000_000


def test_query_equals_plain_version(spark):
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    n = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = r["text"].encode().split()
        h = zlib.crc32(b"%d" % r["doc_id"])
        g = h // 10
        if len(words) > 4000:
            continue
        if h % 10 == 0 and words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = fast_brute(words)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = max(runs, key=lambda t: (t[1] / t[2], -t[0], -t[2]), default=None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want = (r["doc_id"], len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
                sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda t: (t[0], t[2]))).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))
        assert got[r["doc_id"]] == want
        n += bool(runs)
    assert n > 5


def fast_brute(words):
    """All runs by comparing the text with itself shifted by each period."""
    _, x = np.unique(np.array(words, object), return_inverse=True) if words else (None, np.zeros(0, int))
    out = []
    for q in range(1, len(x) // 3 + 1):
        step = np.diff(np.concatenate([[0], (x[q:] == x[:-q]).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            m = b - a + q
            if m >= max(24, 3 * q) and not any((x[a + d : a + m] == x[a : a + m - d]).all() for d in range(1, q)):
                out.append((a, m, q))
    return out


def test_blocks_are_read_in_small_row_groups(spark, monkeypatch):
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 997}" for j in range(300))) for i in range(400)], "id long, text string").coalesce(1)
    want = sorted(map(tuple, R.resample(docs, docs.limit(9), id_col="id", target_id="id").collect()))
    monkeypatch.setattr(R, "BLOCK_FEATURES", 2000)
    monkeypatch.setattr(R, "BLOCK_GROUP", 8, raising=False)
    seen, drop = [], R.discard

    def look(df):
        for f in df.inputFiles():
            m = pq.ParquetFile(f.removeprefix("file://")).metadata
            at = next(i for i in range(m.num_columns) if m.row_group(0).column(i).path_in_schema.startswith("columns"))
            seen.extend(m.row_group(k).column(at).num_values for k in range(m.num_row_groups))
        drop(df)

    monkeypatch.setattr(R, "discard", look)
    assert sorted(map(tuple, R.resample(docs, docs.limit(9), id_col="id", target_id="id").collect())) == want
    assert sum(seen) > 50_000 and max(seen) < sum(seen) / 3
