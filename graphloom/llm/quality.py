"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from graphloom.llm.shared import bound_batches, trim

WORDS, SHAPES, LENGTHS, EXTRA = 1024, 384, 128, 16  # buckets of whole words, of their shapes, of short words and lengths, and counts
TERMS = WORDS + SHAPES + LENGTHS + EXTRA
SAMPLE = 6000  # labelled documents that are fitted and broadcast, at most
LATENT = 64
NEIGHBOURS = 31
BLOCK = 512  # documents compared with all labelled vectors at once
THRESHOLD = 0.3


def _shape(word: str) -> str:
    """Runs of letters as a, A or Aa, of digits as 0; other characters stay, a run of one as at most three."""
    out, last, times = [], "", 0
    for c in word:
        k = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        times = times + 1 if k == last else 1
        if times == 1 or not k.isalnum() and times <= 3:
            out.append(k)
        last = k
    return "".join(out)


class _Terms(dict):
    """Word to its three term numbers packed in one, remembered within bounds."""

    def __missing__(self, word: str) -> int:
        if len(self) > 120_000:
            self.clear()
        plain = word.strip(".,;:!?*#$%&|\"'()[]").lower()
        whole = xxhash.xxh32_intdigest(plain)
        shape = xxhash.xxh32_intdigest(_shape(word)) % SHAPES
        length = whole % (LENGTHS // 2) if len(plain) <= 3 else LENGTHS // 2 + min(len(plain), LENGTHS // 2 - 1)
        code = self[word] = whole % WORDS << 24 | shape << 12 | length
        return code


def term_shares(text: str | None, known: _Terms) -> np.ndarray:
    """Square roots of each term's share of the text; terms are hashed words, word shapes, short words, word lengths and repetition."""
    words = (text or "").split()
    n = len(words)
    out = np.zeros(TERMS, np.float32)
    if not n:
        out[TERMS - 1] = 1
        return out
    codes = np.fromiter(map(known.__getitem__, words), np.int64, n)
    at = 0
    for shift, size in ((24, WORDS), (12, SHAPES), (0, LENGTHS)):
        out[at : at + size] = np.bincount(codes >> shift & 4095, minlength=size)
        at += size
    extra = out[at:]
    ids = np.fromiter(map(hash, words), np.int64, n)
    extra[0] = (ids[1:] == ids[:-1]).sum()
    extra[1] = n - len(np.unique(ids))
    extra[2] = 2 * n / max(1, (text or "").count("\n") + 1) if n > 1 else 0
    extra[3 + min(7, n.bit_length() // 2)] = n * 0.2
    return np.sqrt(out / n)


def _packed(shares: np.ndarray) -> bytes:
    """The terms that a text has, and their shares."""
    at = np.flatnonzero(shares).astype(np.uint16)
    return at.tobytes() + shares[at].tobytes()


def _unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), TERMS), np.float32)
    for i, x in enumerate(rows):
        n = len(x) // 6
        out[i, np.frombuffer(x, np.uint16, n)] = np.frombuffer(x[2 * n :], np.float32)
    return out


@dataclass
class Model:
    mean: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def fit(shares: np.ndarray, labels: np.ndarray) -> Model:
    """Latent space (truncated SVD of weighted term shares) with one unit vector per labelled document."""
    if not len(labels):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5)
    seen = (shares > 0).sum(0)
    weight = (np.log((1 + len(labels)) / (1 + seen)) + 1).astype(np.float32)
    weight /= weight.mean()
    scaled = shares * weight
    # right singular vectors by way of the terms' products: there are fewer terms than labelled texts
    _, axes = np.linalg.eigh((scaled.T @ scaled).astype(np.float64))
    basis = np.ascontiguousarray(axes[:, ::-1][:, :LATENT], np.float32)
    model = Model(weight, basis, np.zeros((0, 1)), labels.astype(np.float32), float(labels.mean()))
    model.vectors = latent(shares, model)
    return model


def latent(shares: np.ndarray, model: Model) -> np.ndarray:
    out = (shares * model.mean) @ model.basis
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def vote(vectors: np.ndarray, model: Model) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by a steep function of cosine; ties at the edge all vote."""
    if not len(model.labels):
        return np.full(len(vectors), model.prior)
    near = np.round(vectors @ model.vectors.T, 5)
    k = min(NEIGHBOURS, near.shape[1])
    edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
    row, col = np.nonzero(near >= np.maximum(edge, 1e-5)[:, None])
    w = near[row, col].astype(np.float64) ** 16
    ones = np.bincount(row, w * model.labels[col], len(vectors))
    every = np.bincount(row, w, len(vectors))
    return (ones + 0.01 * model.prior) / (every + 0.01)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows, taken in order of a hash of the id.

    Rows whose crc32(id as text) mod 5 is 0 are held out and never read as labels. The bound
    holds whatever the number of labels; ids without a text, and null labels or ids, aren't used. The
    labelled vectors (sample x LATENT floats) and the basis (TERMS x LATENT) are what is broadcast.
    """
    bound_batches(docs.sparkSession)
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    chosen = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    held = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms()
        for batch in batches:
            found = [_packed(term_shares(x.as_py(), known)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["_id", "shares", "label"])
        known.clear()
        trim()

    kept = held.select(F.col("_id").cast("long"), "_text", F.col("_label").cast("int")).mapInArrow(shares, "_id long, shares binary, label int")
    rows = sorted({(r["_id"], bytes(r["shares"]), r["label"]) for r in kept.collect()})
    return fit(_unpacked([r[1] for r in rows]), np.array([r[2] for r in rows], np.float32))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, the higher the likelier label 1.

    Only the whole text counts, so equal texts score alike. Null, empty and blank texts share one
    term and score as their labelled like do; with no labelled rows at all every score is 0.5.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, own = _Terms(), sent.value
        for batch in texts:
            found = []
            for at in range(0, len(batch), BLOCK):
                piece = np.array([term_shares(x.as_py(), known) for x in batch.slice(at, BLOCK)], np.float32).reshape(-1, TERMS)
                found.append(vote(latent(piece, own), own))
            yield pa.array(np.round(np.concatenate(found), 6) if found else [], pa.float64())
        known.clear()
        trim()

    return docs.withColumn(out, scored(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Train on ``labels`` and score all of ``docs``: id, held_out, score, predicted; one row per input row."""
    model = train(docs, labels, id_col, text_col)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    scored = score(docs.select(id_col, text_col), model, text_col)
    return scored.select(id_col, (F.crc32(key) % 5 == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
