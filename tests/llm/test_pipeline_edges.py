"""The corpus pipeline as a whole on rows with nulls, repeats, blank and very long texts and further columns, and on no rows."""

from __future__ import annotations

import tempfile

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import pieces as P
from tests.compare import SF

LONG = 30_000


@pytest.fixture(scope="module")
def folder(spark):
    base = tempfile.mkdtemp(prefix="pipeline-")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id").orderBy("doc_id").limit(12).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    # a last line of words that no other text has: lines that differ in a word or two would be one template
    own = lambda r, k: r["text"] + "\n" + " ".join(f"{'abcdefghijkl'[k]}{w}" for w in ("anchor", "bramble", "cobalt", "dune", "ember"))
    rows = [(1000 + k, own(r, k), r["lang"], r["source"], None) for k, r in enumerate(good)]
    rows += [(1000, own(good[0], 0), "en", "s", 1), (2000, own(good[1], 1), "en", None, None), (None, own(good[2], 2), None, None, None)]  # a repeated row, a copy, and one without an id
    rows += [(3000, None, "en", "s", 0), (3001, "", "en", "s", 0), (3002, " \n\t", "en", "s", 0), (None, None, None, None, None)]
    rows += [(4000, own(good[3], 3) + "\n" + item, "en", "s", 0)]
    rows += [(5000, " ".join(t for k in range(LONG // 10) for t in (f"word{k}", "and", "so", "the", "story", "went", "on", f"with{k * 7}", "more", "news.")), "en", "s", 0)]
    more = [(*r, "x", 1, "y") for r in rows]
    frame = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, _id string, _score int, root string")
    frame.repartition(3).write.parquet(f"{base}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{base}/{t}.parquet")
    return base, {(r[0], r[1]) for r in rows}


def test_the_whole_on_odd_rows(spark, folder):
    base, rows = folder
    out = corpus_pipeline.run(spark, base)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_pieces"]
    got = out.collect()
    scored = {(r["doc_id"], r["text"]) for r in corpus_pipeline.quality_stage(spark, spark.read.parquet(f"{base}/documents.parquet"), base).collect()}
    assert scored <= rows
    ids = [r["doc_id"] for r in got]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})  # repeats and copies go
    assert 4000 not in ids  # a benchmark passage
    lattice = P.lattice(P.MODEL, P.ALPHA)
    text = {r["doc_id"]: lattice.decode(np.array(r["ids"], np.int32)) if r["ids"] else r["ids"] for r in got if r["doc_id"] is not None}
    # what the classifier keeps and nothing else takes stays: its own last line is proof
    for i, t in scored:
        if i is not None and 1000 <= i < 1012:
            assert text[i].endswith(t.split("\n")[-1])
    if 2000 in ids:  # a copy of a smaller id: its shared passages went, so what may be left is no copy any more
        whole = next(t for j, t in rows if j == 2000)
        assert set(text[2000].split("\n")) < set(whole.split("\n")) and text[2000] != text[1001]
    for i in (3000, 3001, 3002):
        assert (i in ids) == any(j == i for j, _ in scored)
    assert (5000 in ids) == any(j == 5000 for j, _ in scored)
    if 5000 in ids:
        assert text[5000] == next(t for j, t in scored if j == 5000)


def test_the_whole_on_no_rows(spark, folder):
    base = tempfile.mkdtemp(prefix="pipeline-")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{base}/{t}.parquet")
    assert corpus_pipeline.run(spark, base).count() == 0
