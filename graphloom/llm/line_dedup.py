"""Line dedup with a log-template tree: token count, leading tokens, then templates by position votes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import bound_batches, discard, materialise, trim

DEPTH = 3  # leading tokens that, after the token count, make the tree's fixed levels
MIN_DOCS = 3
LONG = 50  # a line of more tokens is a passage; where asked, its repetition in PAIR documents is enough
PAIR = 2
BITS = 1 << 26  # of the map of leaves that tells which lines need their tokens compared, at most
MASK = "<*>"
_DIGIT, _LETTER = regex.compile(r"[0-9]"), regex.compile(r"\p{L}")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tokens(line: str) -> list[str]:
    """The line's tokens; those with a digit are the variable MASK, unless they are over three tenths of those with a digit or a letter: such a line, as a row of figures or "Chapter 1", is told by them."""
    tokens = line.split()
    if not _DIGIT.search(line):
        return tokens
    masked = [MASK if _DIGIT.search(t) else t for t in tokens]
    figures, words = masked.count(MASK), sum(1 for t in masked if _LETTER.search(t))
    return masked if 7 * figures <= 3 * words else tokens


def _leaf(tokens: list[str]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(f"{len(tokens)} {' '.join(tokens[:DEPTH])}"))


def _whole(tokens: list[str]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(f"{len(tokens)} {' '.join(tokens)}"))


def parse(line: str) -> tuple[int, int, bool] | None:
    """(leaf, whole line) as 64-bit codes and whether it has more than LONG tokens. None for a blank line."""
    tokens = _tokens(line)
    return (_leaf(tokens), _whole(tokens), len(tokens) > LONG) if tokens else None


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, leaves, lines, passages = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seen = set()
            for line in (text.as_py() or "").split("\n"):
                if (found := parse(line)) and found[1] not in seen:
                    seen.add(found[1])
                    ids.append(key)
                    leaves.append(found[0])
                    lines.append(found[1])
                    passages.append(found[2])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(leaves, pa.int64()), pa.array(lines, pa.int64()), pa.array(passages, pa.bool_())], ["id", "leaf", "line", "passage"])
    trim()


def _bitmap(leaves: DataFrame) -> np.ndarray:
    """A bit for each leaf's remainder, 16 a leaf up to BITS: a line whose bit isn't set is in no such leaf."""
    bits = min(BITS, max(64, 1 << (16 * leaves.count()).bit_length()))
    at = F.expr(f"pmod(leaf, {bits})")
    rows = leaves.groupBy((at / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(leaf, {bits}) % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out.view(np.uint8)


def _cells(sent: Broadcast):
    """Texts to (leaf, line, codes of the tokens after the leading ones) of the lines whose leaf has its bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = sent.value, set()
        size = 8 * len(bits)
        out, load = [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["leaf", "line", "cells"])

        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    tokens = _tokens(line)
                    if len(tokens) <= DEPTH:
                        continue
                    leaf = _leaf(tokens)
                    at = leaf % size
                    if not bits[at >> 3] >> (at & 7) & 1 or (whole := _whole(tokens)) in seen:
                        continue
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(whole)
                    out.append((leaf, whole, b"".join(map(xxhash.xxh3_64_digest, tokens[DEPTH:]))))
                    load += len(tokens)
                    if load >= 200_000:
                        yield rows()
                        out, load = [], 0
        if out:
            yield rows()
        seen.clear()
        trim()

    return run


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A line's cells as rows (place, token code)."""
    for whole in batches:
        for start in range(0, len(whole), 200):
            batch = whole.slice(start, 200)
            cells = batch.column(3).to_pylist()
            size = np.array([len(x) // 8 for x in cells], np.int64)
            rows = pa.array(np.repeat(np.arange(len(size)), size))
            token = pa.Array.from_buffers(pa.int64(), int(size.sum()), [None, pa.py_buffer(b"".join(cells))])
            place = pa.array((np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pc.take(batch.column(0), rows), pc.take(batch.column(1), rows), pc.take(batch.column(2), rows), place, token], ["leaf", "line", "docs", "place", "token"])


def recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, passage_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lines by document, recurring lines with the document that keeps them).

    The tree's levels are a line's token count and its first DEPTH tokens. Tokens with digits are variable where they are three tenths at most of a line's
    tokens with letters or digits; a line with more of them recurs as it is only. Within a leaf a token is constant at its place if lines of at least ``min_docs`` documents
    have it there, else variable. Lines with equal constants are one template, if seven tenths of the places after the
    leading ones are constant and have no digit; lines beyond that are templates of their own, and so is a line that has leading tokens only. A line of more than LONG
    tokens under no recurring template recurs by itself in ``passage_docs`` documents. All counts come from
    partial sums over every document, so the outcome doesn't depend on the order of rows.

    Tokens move for the lines of leaves that have several lines and enough documents only; which these are is known in a
    second reading of the texts from a map of at most BITS bits, and then by an exact join.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lines = materialise(source.mapInArrow(_lines, "id long, leaf long, line long, passage boolean"), "lines")
    distinct = materialise(lines.groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min("id").alias("first"), F.first("passage").alias("passage")), "distinct")
    # a leaf with one line, or with too few documents, has nothing to generalise
    leaves = distinct.groupBy("leaf").agg(F.count("*").alias("variants"), F.sum("docs").alias("all")).filter(f"variants > 1 and all >= {int(min_docs)}").select("leaf")
    leaves = materialise(leaves, "leaves")
    open_ = distinct.join(leaves, "leaf", "left_semi").select("leaf", "line", "docs")
    cells = source.select("text").mapInArrow(_cells(docs.sparkSession.sparkContext.broadcast(_bitmap(leaves))), "leaf long, line long, cells binary")
    cells = cells.groupBy("leaf", "line").agg(F.first("cells").alias("cells"))
    mask = int(np.frombuffer(xxhash.xxh3_64_digest(MASK), np.int64)[0])  # as _cells and _unfold code it
    tree = materialise(open_.join(cells, ["leaf", "line"]).select("leaf", "line", "docs", "cells").mapInArrow(_unfold, "leaf long, line long, docs long, place int, token long"), "tree")
    fixed = tree.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("own")).filter(F.col("own") >= min_docs).select("leaf", "place", "token", F.lit(1).alias("fixed"))
    voted = tree.select("leaf", "line", "place", "token").join(fixed, ["leaf", "place", "token"], "left")
    shape = voted.groupBy("leaf", "line").agg(
        F.count("*").alias("places"), F.count("fixed").alias("constant"), F.count_if((F.col("fixed") == 1) & (F.col("token") != mask)).alias("told"),
        F.sum(F.when(F.col("fixed") == 1, F.xxhash64("place", "token").cast("decimal(20,0)"))).alias("template"))
    shape = shape.filter("10 * told >= 7 * places").select("leaf", "line", F.xxhash64("leaf", F.col("template").cast("string"), "constant").alias("template"))
    templates = distinct.select("leaf", "line", "docs", "first", "passage").join(shape, ["leaf", "line"], "left").withColumn("template", F.coalesce("template", "line"))
    templates = materialise(templates, "templates")
    # lines of one template in one document count once: exact where a template has several lines
    many = templates.groupBy("template").agg(F.count("*").alias("variants"), F.sum("docs").alias("all"), F.min("first").alias("keep")).filter(f"all >= {int(min_docs)}")
    several = many.filter("variants > 1").select("template")
    exact = templates.join(several, "template", "left_semi").select("leaf", "line", "template").join(lines.select("id", "leaf", "line"), ["leaf", "line"])
    exact = exact.groupBy("template", F.coalesce("id", F.lit(-1)).alias("id")).agg(F.lit(1)).groupBy("template").agg(F.count("*").alias("exact"))
    kept = many.join(exact, "template", "left").filter(F.coalesce("exact", "all") >= min_docs).select("template", "keep")
    found = templates.join(kept, "template").select("leaf", "line", "template", "keep")
    if passage_docs < min_docs:
        passages = templates.filter(F.col("passage") & (F.col("docs") >= passage_docs))
        found = found.unionByName(passages.join(kept, "template", "left_anti").select("leaf", "line", F.col("line").alias("template"), F.col("first").alias("keep")))
    found = materialise(found, "recurring")
    for x in (distinct, leaves, tree, templates):
        discard(x)
    return lines, found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, passage_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` in all its columns, without the lines whose template recurs, plus n_lines and n_dropped.

    A template recurs if lines of at least ``min_docs`` documents fall under it; a line of more than LONG
    tokens also if ``passage_docs`` documents have it, its tokens with digits aside. The document
    with the smallest id keeps its lines of it, every other document loses them, so each
    passage stays once. Lines are cut at \\n and otherwise untouched; blank lines and a
    document's own repetitions stay. A null text stays null with n_lines 0, an empty one has one line.
    Rows that repeat an id are one document here; null ids have nothing dropped and count as documents.
    A document may end with an empty text.
    """
    lines, found = recurring(docs, id_col, text_col, min_docs, passage_docs)
    # names that no column of docs can have
    key, lost_lines, done = (f"{x}{uuid.uuid4().hex}" for x in ("id", "gone", "cut"))
    gone = lines.filter("id is not null").join(found.select("leaf", "line", "keep"), ["leaf", "line"]).filter("keep is null or id <> keep")
    gone = materialise(gone.groupBy(F.col("id").alias(key)).agg(F.collect_set("line").alias(lost_lines)), "gone")
    discard(lines)
    discard(found)

    @F.arrow_udf("struct<text string, n_lines long, n_dropped long>")
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for text, lost in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
            own = text.split("\n") if text is not None else []
            kept = own
            if lost:
                lost = set(lost)
                kept = [x for x in own if not ((p := parse(x)) and p[1] in lost)]
            out.append({"text": text if len(kept) == len(own) else "\n".join(kept), "n_lines": len(own), "n_dropped": len(own) - len(kept)})
        return pa.array(out, pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]))

    # the documents that lose lines grow with the corpus, so their list is never broadcast
    joined = docs.join(gone.hint("merge"), docs[id_col] == gone[key], "left").withColumn(done, cut(F.col(text_col), F.col(lost_lines)))
    kept = [F.col(f"{done}.text").alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*kept, F.col(f"{done}.n_lines").alias("n_lines"), F.col(f"{done}.n_dropped").alias("n_dropped"))
