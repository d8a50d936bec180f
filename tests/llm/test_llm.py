"""Training-data operators against brute force, exact round trips and held-out accuracy, with edge cases."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate as D
from graphloom.llm import fingerprints as FP
from graphloom.llm import html_text as H
from graphloom.llm import jaccard_join as J
from graphloom.llm import line_dedup as L
from graphloom.llm import pieces as P
from graphloom.llm import quality as Q
from graphloom.llm import secrets as S
from graphloom.llm import sharding as SH
from graphloom.llm import token_counts as TC
from graphloom.llm.queries import QUERIES, SQL
from tests.compare import SF, same

LONG = "very long word list " * 20_000
DOCS = "doc_id long, text string, lang string, a string, id string, size int, cls int, fp string, part int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns with the names used inside."""
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f"), (7, "a b"), (8, "a b"), (None, "a b c d e f"), (None, None), (9, "漢字 ▁ é x\r\n🙂" * 3)]
    return spark.createDataFrame([(i, t, None, "a", "id", 1, 2, "fp", 3) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    got, want = same(spark, QUERIES[name], SQL[name])
    assert got == want


def brute_classes(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_part_enum_loses_no_link():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        base = rng.integers(0, 2**63, n + 60).astype(np.uint64)
        a = np.unique(base[:n])
        drop, add = int(rng.integers(0, 1 + n // 5)), int(rng.integers(0, 1 + n // 5))
        b = np.unique(np.concatenate([a[drop:], base[n : n + add]]))
        if not len(b):
            continue
        common = np.sort(a[: int(rng.integers(0, n + 1))]) if rng.random() < 0.5 else a[:0]
        same_n = len(np.intersect1d(a, b))
        if 100 * same_n >= 85 * (len(a) + len(b) - same_n) and not np.array_equal(a, b):
            assert np.intersect1d(J.part_enum(a, common, 85, 100), J.part_enum(b, common, 85, 100)).size


def test_part_enum_signs_subsets_of_second_level_parts():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    outer = 40
    sig, empty = J.subsets(codes, outer, 7)
    assert sig.shape == empty.shape == (outer, J.INNER) and not empty.any() and len(np.unique(sig)) == sig.size
    # a difference in one second-level part leaves equal the one subset of its first-level part that leaves it out, and all others
    for i in range(60):
        other, _ = J.subsets(np.delete(codes, i), outer, 7)
        same = (other == sig).sum(1)
        assert sorted(same)[0] == J.INNER - J.KEPT and (same == J.INNER).sum() == outer - 1
    plan = J.bands(85, 100, 4096)
    at = next(i for i in range(len(plan) - 1, -1, -1) if plan[i][0] <= len(codes))
    assert len(J.part_enum(codes, codes[:0], 85, 100)) >= sum(J.INNER * (plan[i][2] + plan[i][3]) - plan[i][3] * J.INNER for i in (at, at + 1))


@pytest.mark.parametrize(("cross", "block"), [(4, 4), (0, 4), (10**9, 256)])  # open pairs by both ways, all by blocks, all listed
def test_near_copies_of_one_base_are_found(spark, monkeypatch, cross, block):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "CROSS", cross)
    monkeypatch.setattr(J, "WORK", 0 if cross == 0 else 4)
    monkeypatch.setattr(J, "BUFFER", 3000)
    random.seed(5)
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(w if random.random() > 0.02 else f"x{i}" for w in base[: random.choice((70, 80, 90))])) for i in range(60)]
    rows += [(100 + i, " ".join(random.choices([f"v{j}" for j in range(40)], k=30))) for i in range(30)]
    # texts that are half alike: they share signatures and aren't linked
    rows += [(200 + i, " ".join([f"h{j}" for j in range(150)] + [f"o{i // 2}y{j}" for j in range(45)] + [f"q{i}"])) for i in range(24)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=4, num=85, den=100).collect()}
    assert got == brute_classes(rows, 4, 85, 100)


def test_rows_without_id_are_bridges(spark):
    words = [f"w{i}" for i in range(100)]
    one, x, two = " ".join(words), " ".join([*words[9:], *(f"a{i}" for i in range(9))]), " ".join([*words[18:], *(f"a{i}" for i in range(18))])
    for i in (9, None):
        rows = spark.createDataFrame([(1, one), (i, x), (2, two)], "doc_id long, text string")
        assert {(r["doc_id"], r["component_id"]) for r in J.jaccard_classes(rows, words=4, num=8, den=10).collect()} == {(1, 1), (i, 1), (2, 1)}
    alone = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in J.jaccard_classes(alone, words=4, num=8, den=10).collect()} == {(1, 1), (2, 2)}


def test_near_stage_keeps_texts_of_repeated_ids(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, b), (5, c), (3, a), (7, a), (7, b + " more"), (None, c), (None, "own words of nobody at all"), (None, None), (8, " "), (5, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_stage(spark, docs, SF).collect()), key=str)
    assert got == sorted([(5, b), (5, c), (3, a), (None, "own words of nobody at all"), (None, None), (8, " ")], key=str)


def test_jaccard_edge_cases(odd, none):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_classes(odd, words=4).collect()]
    assert len(got) == odd.count() and (1, 0, 1) in got and (2, 0, 2) in got and (6, 3, 5) in got and (8, 1, 7) in got
    assert J.jaccard_classes(none).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i * 7919 % 101, (i + 1) * 7919 % 101) for i in range(40)], "a long, b long")  # nodes are hashes there
    roots = J.components(edges, "t").collect()
    assert len(roots) == 41 and len({r["root"] for r in roots}) == 1


def test_line_dedup(spark, odd, none):
    rows = [(i, f"{chr(97 + i) * 9} {'quite ' * i}different line\nPosted on 2024-01-0{i} by admin today\nShared line for all documents") for i in range(5)] + [(9, "Own line again\n\nOwn line again")]
    got = {r["doc_id"]: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["text"] == rows[0][1] and got[9]["n_dropped"] == 0
    assert all(got[i]["text"] == rows[i][1].split("\n")[0] and got[i]["n_dropped"] == 2 for i in range(1, 5))
    out = L.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.count() == odd.count() and L.dedup_lines(none).count() == 0
    assert [r["text"] for r in out.filter("doc_id = 1").collect()] == [None]


def test_passage_of_two_documents(spark):
    passage, brief = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(L.LONG + 1)), " ".join(f"other{chr(97 + i)}" for i in range(20))
    rows = [(i, f"{chr(97 + i) * 9} line of its own\n{x}") for i, x in enumerate((passage, passage, brief, brief, passage.replace("worda", "0")))] + [(None, passage)]
    docs = spark.createDataFrame(rows[:5], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(docs, passage_docs=L.PAIR).collect()}
    assert got == {**dict(rows[:5]), 1: rows[1][1].split("\n")[0]}
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()} == dict(rows[:5])
    again = spark.createDataFrame([rows[0], rows[0], rows[5]], "doc_id long, text string")  # one document twice, and one without an id
    assert all(r["n_dropped"] == 0 for r in L.dedup_lines(again, passage_docs=L.PAIR).collect())
    import corpus_pipeline

    full = docs.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, full, SF).collect()} == got


def test_decontamination(spark, odd, none):
    item = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    swapped = item.split()
    for i in (3, 14, 25, 36):
        swapped[i] = "other"
    tests = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " * 30 + item.upper() + " after"), (2, "x, " + ", ".join(swapped)), (3, " ".join(item.split()[:9])), (4, "clean " * 50), (5, None), (6, "")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in D.contaminated(docs, tests).collect()) == [(1, 1), (2, 1)]
    left = D.decontaminate(docs, tests)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6]
    assert D.contaminated(odd, tests).count() == 0 and D.decontaminate(odd, tests).count() == odd.count() and D.contaminated(none, tests).count() == 0
    assert D.contaminated(docs, tests.limit(0)).count() == 0


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_WORDS", 0)
    got, want = same(spark, QUERIES["op5_benchmark_decontamination"], SQL["op5_benchmark_decontamination"])
    assert got == want


def test_decontamination_moves_no_words_with_places(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(90))), (1, "other words " * 9), (None, "x y " + " ".join(f"w{i}" if i % 7 else "no" for i in range(40, 70))), (3, None), (4, " ".join(f"v{i}" for i in range(50)))], "doc_id long, text string")
    tests = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(44, 64))) for k in range(5)] + [(9, " ".join(f"v{i}" for i in range(45, 60))), (None, " ".join(f"v{i}" for i in range(30)))], "item_id long, text string")
    want = sorted(map(str, D.contaminated(docs, tests).collect()))
    assert len(want) == 10

    def carried(plan) -> list[set]:
        own = [{a.name() for a in (x.apply(i) for x in [plan.output()] for i in range(x.size()))}] if plan.nodeName() == "Generate" or plan.nodeName() == "Join" else []
        return own + [s for i in range(plan.children().size()) for s in carried(plan.children().apply(i))]

    for most in (0, 20):  # 35 words of different items: all places, then those of known pairs
        monkeypatch.setattr(D, "BROADCAST_WORDS", most)
        found = D.contaminated(docs, tests)
        assert sorted(map(str, found.collect())) == want
        joins = [s for s in carried(found._jdf.queryExecution().optimizedPlan()) if {"seed", "t"} <= s]
        assert joins and not any("words" in s for s in joins)
    monkeypatch.setattr(D, "BROADCAST_WORDS", 35)  # copies of an item don't count
    found = D.contaminated(docs, tests)
    assert "Exchange hashpartitioning(seed" not in found._jdf.queryExecution().executedPlan().toString() and sorted(map(str, found.collect())) == want
    assert [r["doc_id"] for r in D.decontaminate(docs, tests).orderBy("doc_id").collect()] == [None, 3, 4]


def test_token_counts_equal_whole_encoding(spark, odd, none):
    own = TC.counter(TC.RANKS)
    random.seed(2)
    texts = [r["text"][:6000] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(25).collect()] + ["", "  \n ", "x"]
    for text in texts:
        tree = TC.Tree.build(text, own)
        for _ in range(4):
            a = random.randint(0, len(tree.text))
            tree.edit(a, a + random.choice((0, 1, 7, 300)), random.choice(("", " ", "  ", "'s", " two words", "\n\n", "é")), own)
            assert tree.tokens == len(own.coder.encode_ordinary(tree.text)) == sum(tree.leaves)
    rows = TC.count_with_edits(odd, F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("zz").alias("put")))).collect()
    assert len(rows) == odd.count() and all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (1, 2))
    assert TC.count_with_edits(none, F.lit(None).cast("array<struct<start:int,end:int,put:string>>")).count() == 0


def test_fingerprints_against_brute_force(spark, odd, none):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    order = sorted(rows, key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in QUERIES["op7_document_fingerprints"](spark, SF).collect()}
    for i, r in enumerate(order):
        t, n = r["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        g, own = got[r["doc_id"]], FP.signatures(t)
        assert g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and g["n_chars"] == len(t) and g["fingerprint"] == FP.pack(own)
        assert g["near_next"] == FP.likeness(own, FP.signatures(n)) and g["near_edited"] == FP.likeness(own, FP.signatures(edited))
    assert FP.compare_with_next(odd).count() == odd.count() and FP.compare_with_next(none).count() == 0
    one = FP.compare_with_next(odd.filter("doc_id = 7")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    a = FP.signatures("the quick brown fox is a very lazy old dog")
    assert FP.likeness(a, FP.unpack(FP.pack(a))) == 1.0 and FP.likeness(a, a[:1], 0.9) == 0.0


def test_sharding_edge_cases(odd, none):
    rows = SH.shard_by_bytes(odd, 4).collect()
    assert len(rows) == odd.count() and {r["text_crc32"] for r in rows if r["doc_id"] == 7} == {zlib.crc32(b"a b")}
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert SH.shard_by_bytes(none).count() == 0


def test_quality_on_held_out_labels(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    out = Q.classify(odd, labels.limit(0)).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert Q.classify(none, labels).count() == 0


def test_sampled_pieces(spark, odd, none):
    lattice = P.lattice(P.MODEL, P.ALPHA)
    for text in ("", " ", "a  b\n\n c", "▁x▁ y", "漢字🙂\x00\t\r\n", "x" * 9000, " " * 70 + "end"):
        ids = lattice.encode(text, 5)
        assert lattice.decode(ids) == text and (ids == lattice.encode_all(["noise", text], [1, 5])[1]).all()
    word, w = " that", lambda p: lattice.weight[lattice.id[p]]

    def ways(i):
        if i == len(word):
            yield 1.0, ()
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in lattice.id:
                for p, rest in ways(j):
                    yield p * w(word[i:j]), (lattice.id[word[i:j]], *rest)

    exact = {r: p for p, r in ways(0)}
    drawn = [tuple(x) for x in lattice.encode_all([word] * 20_000, [P.seed_of(i) for i in range(20_000)])]
    assert max(abs(drawn.count(r) / 20_000 - p / sum(exact.values())) for r, p in exact.items()) < 0.015
    rows = P.tokenize(odd).collect()
    assert len(rows) == odd.count() and all(r["lossless"] is not False for r in rows) and P.tokenize(none).count() == 0


def test_main_text():
    page = (
        '<html><head><title>t</title><script>var x="</p>";</script></head><body><header><a href="/">Home</a></header><nav><ul><li><a href="/a">a</a><li><a href="/b">b</a></ul></nav><div class="cookie-notice">We use cookies on this site.</div>'
        '<article><h1>The  title</h1><p>First &amp; <b>bold</b><br>text&nbsp;here.<p>Second.<div class="ad">Buy this now</div><p>Third &lt;p&gt; one.</p><form><label>Mail</label></form></article>'
        '<section id="comments"><article><p>Great post, thanks a lot for writing it.</p></article></section><aside><p>More to read</p></aside><footer>&copy; me</footer></body>')
    assert H.main_text(page) == "The title\nFirst & bold text here.\nSecond.\nThird <p> one."
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>x</nav>") == ""
    plain = "<body><div><a href=x>Home</a></div><div><p>" + "word " * 40 + "</p><p>short one</p><p>" + "text " * 50 + "</p></div><div><a href=y>About us</a></div></body>"
    assert H.main_text(plain).split("\n")[1] == "short one" and "Home" not in H.main_text(plain)


def test_pages(spark):
    rows = QUERIES["op3_html_extraction"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_secrets(spark, odd, none):
    found = S.labelled_findings(spark, 3000)
    model = S.train(found.filter("pmod(xxhash64(id), 4) > 0"))
    from pyspark.ml.feature import VectorAssembler

    held = model.transform(VectorAssembler(inputCols=list(S.FEATURES), outputCol="features").transform(S.with_features(found.filter("pmod(xxhash64(id), 4) = 0"))))
    row = held.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).first()
    assert row["a"] > 0.97
    key = hashlib.sha1(b"x").hexdigest()
    docs = spark.createDataFrame([(1, f'set token = "{key}" now', "src1"), (2, f"see commit {key} of it", "src2"), (3, "card 4785380592391139 here", None), (4, "password = 'Tr0ub4dorX9q'", "src")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["is_secret"] for r in S.scan(docs, model).collect()}
    assert got[1] and not got[2] and not got[3] and got[4]
    assert S.scan(odd, model, path_col="a").count() == 0 and S.scan(none, model, path_col="a").count() == 0


def test_secrets_of_any_characters(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    want = {
        1: ('before it password = "correctHorseBatteryStaple" after', 4, "correctHorseBatteryStaple"), 2: ("password: P@ss!w0rd#2024$x", 1, "P@ss!w0rd#2024$x"), 3: ("db\n the db_password='S3cr3t!Pa55', end", 2, "S3cr3t!Pa55"),
        4: (f"see Authorization: Bearer {jwt} now", 3, jwt), 5: ("a = 1\npassphrase := 'correct horse battery staple' x", 5, "correct horse battery staple"), 6: ('{"user": "me", "client_secret":"abcXYZqrsTUVmnoKLM"}', 2, "abcXYZqrsTUVmnoKLM")}
    rows = [(i, x[0], "src") for i, x in want.items()] + [(7, 'author: "Jane Doe" and tokenizer = words', "src"), (8, "password: required", "src"), (9, "token = config.auth.value", "src"), (10, 'token = "' + "x\\\"" * 20_000, "src")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = [(r["id"], r["word_at"], r["token"]) for r in S.candidates(docs).collect()]
    assert len(found) == len(set(found)) and {(i, p, t) for i, (_, p, t) in want.items()} <= set(found) and 7 not in {x[0] for x in found}
    got = {(r["doc_id"], r["token_sha256"]): r["is_secret"] for r in S.scan(docs, S.train(S.labelled_findings(spark))).collect()}
    assert all(got[i, hashlib.sha256(t.encode()).hexdigest()] for i, (_, _, t) in want.items())
    assert not any(v for (i, _), v in got.items() if i in (8, 9))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = corpus_pipeline.materialise(stage(spark, kept, SF), "t")
        assert new.columns == list(corpus_pipeline.COLUMNS) and new.join(kept, "doc_id", "left_anti").count() == 0
        kept = new
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()}
    lattice = P.lattice(P.MODEL, P.ALPHA)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert out.keys() == texts.keys() and all(lattice.decode(np.array(out[i], np.int32)) == t for i, t in texts.items())
    rows = [(i, t) for i, t in texts.items()]
    assert all(c == i or not n for i, (n, c) in brute_classes(rows, 5, 4, 5).items())


@pytest.mark.parametrize("n", [15, 16, 17, 18, 40])
def test_one_changed_token_is_one_place(spark, n):
    """The rule is one for lines of any length: a single changed token of n makes a single place variable."""
    rows = [(i, " ".join(f"t{chr(97 + j // 26)}{chr(97 + j % 26)}" if j != 9 else f"own{chr(97 + i)}" for j in range(n))) for i in range(5)]
    got = {r["doc_id"]: r["n_dropped"] for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


def test_short_lines_with_equal_starts_stay(spark):
    rows = [(i, f"I am from {x}") for i, x in enumerate(("Paris", "Berlin", "Madrid", "Rome", "Vienna"))]
    rows += [(10 + i, f"We had some {a} and {b} then") for i, (a, b) in enumerate((("bread", "milk"), ("fish", "rice"), ("soup", "figs")))]
    assert {r["n_dropped"] for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_secret_values_of_one_long_text(spark):
    """A value costs no more the more values there are; each is found once, at its word, with its neighbours."""
    n = 30_000
    text = "\n".join(f"password_k = 'v{i}xY9 q{i}' end" for i in range(n))
    start = time.time()
    got = {r["word_at"]: (r["token"], r["before"], r["within"], r["after"]) for r in S.candidates(spark.createDataFrame([(1, text, None)], "doc_id long, text string, source string")).filter("token like '% %'").collect()}
    assert time.time() - start < 60 and len(got) == n
    for i in (0, 1, 17, n - 1):
        before = "end password_k =" if i else "password_k ="
        assert got[5 * i + 2] == (f"v{i}xY9 q{i}", before, f"'v{i}xY9 q{i}'", "end password_k" if i < n - 1 else "end")


def test_secret_values_in_one_word(spark):
    rows = [(1, 'a="x1234567" token="k1234567"secret="k7654321" \x01token=abc12345\x02 pwd=' + "'two words1'", None)]
    got = sorted((r["word_at"], r["token"]) for r in S.candidates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got == [(1, "k1234567"), (1, "k7654321"), (2, "abc12345"), (2, "abc12345\x02"), (3, "two words1")]


def test_lines_told_by_figures_stay(spark):
    """Rows of figures and numbered headings differ from document to document; equal ones recur as they are."""
    rows = [(i, f"1.{i} 0 {7 + i}\nChapter {i}\n| {i} | {i}2 | total |\nUpdated 0{i} May by the board\n4 8 15 16 23 42") for i in range(5)]
    got = {r["doc_id"]: r for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["text"] == rows[0][1]
    for i in range(1, 5):
        own = rows[i][1].split("\n")
        assert got[i]["text"].split("\n") == own[:3] and got[i]["n_dropped"] == 2


def test_line_dedup_with_clashing_columns(spark):
    rows = [(i, f"own words {'x' * (i + 1)}\nShared line for all documents", 1, 2, 3) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _gone int, _cut int")
    out = L.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["_id"], r["_gone"], r["_cut"], r["n_dropped"]) for r in out.collect()) == [(i, 1, 2, 3, int(i > 0)) for i in range(4)]


def test_edits_at_leaf_ends():
    own = TC.counter(TC.RANKS)
    for tail, put in (("\n\n", " edited"), ("\n \n", "x"), (" '", "ll"), (" 'l", "l"), ("   ", "a"), ("'r", "e")):
        for lead in range(TC.LEAF - 4, TC.LEAF + 4):
            head = "".join(f" w{chr(97 + i % 26)}" for i in range(lead))
            tree = TC.Tree.build(head + tail + "ok then", own)
            for at in range(len(head), len(head) + len(tail) + 1):
                other = TC.Tree.build(head + tail + "ok then", own)
                other.edit(at, at, put, own)
                assert other.tokens == len(own.coder.encode_ordinary(other.text))
            tree = TC.Tree.build(head + tail, own)
            tree.edit(len(tree.text), len(tree.text), put, own)
            assert tree.tokens == len(own.coder.encode_ordinary(tree.text))


def prose(*sizes):
    return [" ".join(f"word{i}x{j}" for j in range(n)) for i, n in enumerate(sizes)]


def test_blocks_of_labelled_pages():
    """Pages of several makes whose blocks are known: share of blocks decided right, by F1 of main text."""
    menu, foot = "<ul><li><a href=/a>Home</a><li><a href=/b>News and more</a></ul>", "<div><a href=/i>Imprint</a> <a href=/p>Privacy</a></div>"
    body = prose(30, 45, 18, 60, 25)
    paragraphs = "".join(f"<p>{x}</p>" for x in body)
    pages = [
        (f"<body>{menu}<h1>The title</h1>{paragraphs}{foot}", ["The title", *body]),
        (f'<div class="page no-sidebar"><article><h2>A</h2>{paragraphs}</article></div>', ["A", *body]),
        (f'<div class="share-price">{paragraphs}</div><div class="related-posts"><p>{body[0]} again</p></div>', body),
        (f'<nav>{menu}<article class="related-work">{paragraphs}<ul><li><a href=x>One link</a><li><a href=y>Two</a></ul></article>', [*body, "One link", "Two"]),
        (f'<form id=aspnetForm><div id="siteHeader">Big name</div><div role="main"><h1>T</h1>{paragraphs}</div><div class="siteFooter">{body[1]}</div></form>', body),
        (f"<header><h1>Site</h1></header><main><header><h1>Own title</h1></header>{paragraphs}<section class=comment-list><article><p>{body[1]} said a reader</p></article></section></main>", ["Own title", *body]),
        ("<h1>Title</h1><p>Short para.</p>", ["Title", "Short para."]),
        (f"<table><tr><td>{menu}</td><td>{paragraphs}</td></tr></table><div class='cookie-notice'>{body[0]}</div>", body),
    ]
    right = wrong = missed = 0
    for page, want in pages:
        got = H.main_text(page).split("\n")
        right += len(set(got) & set(want))
        wrong += len(set(got) - set(want))
        missed += len(set(want) - set(got))
    assert 2 * right / (2 * right + wrong + missed) > 0.95
    assert [H.main_text(p).split("\n") == w for p, w in pages].count(True) >= len(pages) - 2


@pytest.mark.parametrize("bad", ["<a ", '<a href="x', '<a ">" ', "<button>", "<div>", "<p>x</b>", "<!--", "<script>", "<a b='", "</", "<b><div></b>"])
def test_broken_pages_take_one_pass(bad):
    start = time.process_time()
    assert isinstance(H.main_text(bad * (1_000_000 // len(bad)) + ">"), str)
    assert time.process_time() - start < 6


def test_extract_edge_cases(spark):
    page = "<article><p>" + "one  two\n" * 40_000 + "</p></article>"
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<nav>x</nav>"), (3, "u", page), (4, "u", " \n "), (5, "u", "plain & simple text")]
    pages = spark.createDataFrame([(*r, "t", 7) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = H.extract(pages).collect()
    assert sorted(((r["page_id"], r["url"], r["n_chars"]) for r in out), key=str) == sorted([(1, "u", 0), (1, "u", 0), (2, None, 0), (None, "u", 0), (3, "u", 319_999), (4, "u", 0), (5, "u", 19)], key=str)
    assert all(r["text"] is not None and len(r["text"]) == r["n_chars"] for r in out) and H.extract(pages.limit(0)).count() == 0


def test_quality_learns_words_themselves(spark):
    """Texts that differ by their words only, not by shapes, lengths or repetition."""
    rng = random.Random(8)
    bank = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(120)]
    rows = [(i, " ".join(rng.choices(bank[:60] if i % 2 else bank[60:], k=80))) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    out = Q.classify(docs, labels).filter("held_out").collect()
    assert len(out) > 30 and all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in out)
    shapes = ["".join(x) for x in ("a-" * 7, "a-" * 9)]
    assert Q._shape(shapes[0]) != Q._shape(shapes[1])  # shapes of any length


def test_fingerprints_of_texts_without_anchors():
    code = "\n".join(f"x{i} <- f{i % 7}({i}); call{i}!" for i in range(200))
    other = code.replace("x50 ", "y50 ")
    assert 0.9 < FP.likeness(FP.signatures(code), FP.signatures(other)) < 1
    assert FP.likeness(FP.signatures(code), FP.signatures("\n".join(f"z{i} -> g{i}" for i in range(200)))) == 0
    chinese = "".join(chr(0x4E00 + i * 37 % 900) for i in range(400))
    assert FP.likeness(FP.signatures(chinese), FP.signatures(chinese[:200] + "中" + chinese[200:])) > 0.9
    assert len(FP.signatures("x")) == len(FP.signatures("a")) == len(FP.signatures("...")) == 1 and FP.likeness(FP.signatures("x"), FP.signatures("y")) == 0


def test_fingerprints_of_half_kept_texts():
    """Which rule gives a signature is told by the words around it, so the kept half of any text keeps its signatures."""
    prose = "It was the best of times for all who lived in the old town by the sea, and the winter that came was long. " * 20
    prose = " ".join(f"{w}{i}" if i % 4 == 0 else w for i, w in enumerate(prose.split()))
    texts = {
        "code": "\n".join(f"x{i} <- f{i % 7}({i}); call{i}!" for i in range(200)), "signs": " ".join("".join("*#$%&"[i // 5**j % 5] for j in range(5)) for i in range(900)),
        "chinese": "".join(chr(0x4E00 + i * i * 37 % 9000) for i in range(1500)), "prose": prose}
    for name, text in texts.items():
        for other in texts.values():
            half = len(text) // 2
            near = FP.likeness(FP.signatures(text), FP.signatures(text[: len(text) - half] + other[:half]))
            assert near > 0.2 and (near < 0.9 or other is text), (name, near)
    assert FP.likeness(FP.signatures(texts["code"]), FP.signatures(prose)) == 0.0


def test_main_text_beside_unknown_names():
    body = "<article><h1>Head line</h1><p>" + "word " * 40 + "</p>{}<p>" + "text " * 30 + "</p></article>{}"
    want = "Head line\n" + ("word " * 40).strip() + "\n" + ("text " * 30).strip()
    said = "<p>" + "Not the article but long enough to look like some of it, really. " * 3 + "</p>"
    for name in ("user-comments-wrapper", "commentlist", "comment-list-v2", "more-stories", "outbrain", "OUTBRAIN_widget", "reader-comments", "teaser-card", "promo-x1", "cookieBanner", "js-newsletter-signup newsletter-box", "advert-slot-3"):
        for page in (body.format(f'<div class="{name}">{said}</div>', ""), body.format("", f'<section class="{name}">{said}</section>')):
            assert H.main_text(page) == want, name
    for inside, after in (('<p class="legal">Terms apply to all of it.</p>', ""), ("<label>Your mail</label>", ""), ("", "<div>© 2024 Example Corp. All rights reserved.</div>"), ("", "<div>Example Corp, all rights reserved</div>")):
        assert H.main_text(body.format(inside, after)) == want
    for name in ("no-sidebar", "post comments-open", "tag-cookies hentry", "with-comments", "commentary", "prose"):
        assert H.main_text(f'<div class="{name}">' + body.format("", "") + "</div>") == want, name
    code = '<pre><span class="hljs-comment"># a note</span> x = 1</pre>'
    assert "# a note x = 1" in H.main_text(body.format(code, ""))


def test_main_text_after_elements_left_open():
    prose = "<div class=content><p>" + "word " * 40 + "</p><p>" + "text " * 30 + "</p></div>"
    want = ("word " * 40).strip() + "\n" + ("text " * 30).strip()
    menu = "<ul><li><a href=a>Home</a><li><a href=b>News</a></ul>"
    for start in (f"<nav>{menu}", f"<nav><div>{menu}</div>", "<nav><a href=a>Home</a> <a href=b>News</a>", f"<header><h1>Site</h1><nav>{menu}</nav>", "<form>Search <input>", f"<div><nav>{menu}</div>", f"<nav>{menu}</nav>"):
        assert H.main_text("<body>" + start + prose + "<footer>me</footer></body>") == want, start
    assert H.main_text(f"<nav><div>{menu}</div><div>{menu}</div></nav>" + prose) == want


def test_sharding_keeps_groups_and_spreads_beside_large_rows(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "x" * 5000 if i == 3 else f"{i} " + "y" * rng.randint(1, 120)) for i in range(200)]
    rows = [(i, "copy" if i in (17, 90, 150) else t) for i, t in rows]
    got = SH.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    by = {r["doc_id"]: r for r in got}
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(8)]
    assert by[3]["shard"] == 7 and by[3]["slot"] == 0 and sizes[7] == 5001 and max(sizes[:7]) - min(sizes[:7]) <= 2 * 130
    assert len({by[i]["shard"] for i in (17, 90, 150)}) == 1 and by[90]["slot"] == by[17]["slot"] + 1 == by[150]["slot"] - 1
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    # a group of over a hundredth of a share is cut, smaller ones never are, whatever cut they lie on
    rows = [(i, f"same {i // 4:04d}") for i in range(8004)]
    parts = {}
    for r in SH.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect():
        parts.setdefault(r["doc_id"] // 4, set()).add(r["shard"])
    assert all(len(x) == 1 for x in parts.values()) and set().union(*parts.values()) == set(range(8))
    monkeypatch.setattr(SH, "HOT", 10)
    one = SH.shard_by_bytes(spark.createDataFrame([(i, "all equal") for i in range(80)], "doc_id long, text string"), 8).groupBy("shard").count().collect()
    assert sorted((r["shard"], r["count"]) for r in one) == [(s, 10) for s in range(8)]
