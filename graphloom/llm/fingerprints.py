"""Document fingerprints by SpotSigs: chains of content words that follow common words."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import bound_batches, mix, trim, width

CHAIN = 3
GAP = 16  # words without an anchor before a word after which it is one itself
RUN = 8  # characters of a signature where there are no words to chain
LONG = 64  # characters beyond which a word is a stretch without words
# Common words of English, German, French and Spanish, the anchors.
ANCHORS = frozenset(
    "a an and are as at be by for from has have he in is it not of on or that the they this to was were when which will with "
    "als auf aus das dem den der des die ein eine einer es für im ist mit nach nicht sich sie und von war zu zum zur "
    "au aux avec ce dans de du elle en est et il la le les par pas pour que qui se sur un une "
    "al como con del el ella en es esta la las lo los más no para pero por que se su un una y".split())
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|/\\-_«»“”„…"
_NO_WORD, _ANCHOR = 1, 2


class _Codes(dict):
    """Word to a 64-bit code whose two lowest bits tell anchors and words without a letter or digit."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        plain = word.strip(_EDGES).lower()
        code = xxhash.xxh3_64_intdigest((plain or word).encode("utf-8", "surrogatepass")) & ~3
        code = self[word] = code | (_ANCHOR if plain in ANCHORS else 0 if plain else _NO_WORD)
        return code


def _far(marked: np.ndarray) -> np.ndarray:
    """Whether the last marked place lies over ``GAP`` places before, or nowhere before."""
    at = np.arange(len(marked))
    return at - np.maximum.accumulate(np.where(marked, at, -GAP - 1)) > GAP if len(marked) else marked


def _runs(text: str) -> np.ndarray:
    """A code for each run of ``RUN`` characters; a shorter text is one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    run = min(RUN, len(points))
    out = mix(points[: len(points) - run + 1])
    for i in range(1, run):
        out = mix(out + points[i : len(points) - run + 1 + i] + np.uint64(i))
    return out


def signatures(text: str, known: _Codes | None = None) -> np.ndarray:
    """The text's distinct spot signatures, sorted, 32 bits each.

    A signature is an anchor with the next ``CHAIN`` content words after it. Where the last ``GAP`` words hold no anchor (code,
    other languages, a text's beginning) a word is an anchor itself, and where they hold no letter or digit a word of signs
    counts; of a word of over ``LONG`` characters a quarter of its runs of ``RUN`` characters, by hash, are signatures. Each rule looks at the
    words around a place only, so an edit changes the signatures beside it and no others. A text that has none by these rules (a few words)
    has its runs of characters; a shorter text is its own, so that other texts aren't taken for it, and an empty text has none.
    """
    if not text:
        return np.empty(0, np.uint32)
    known = _Codes() if known is None else known
    words = text.split()
    code = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    plain = code & np.uint64(3) != _NO_WORD
    code = code[plain | _far(plain)]
    anchor = code & np.uint64(3) == _ANCHOR
    content = np.flatnonzero(~anchor)
    spot = np.flatnonzero(anchor | _far(anchor))
    after = np.searchsorted(content, spot, "right")
    ok = after + CHAIN <= len(content)
    spot, after = spot[ok], after[ok]
    out = mix(code[spot])
    for i in range(CHAIN):
        out = mix(out + code[content[after + i]] + np.uint64(i + 1))
    long = [_runs(word) for word in words if len(word) > LONG]
    out = np.concatenate([out, *(x[x & np.uint64(3) == 0] for x in long)])
    if not len(out):
        out = _runs(text)
    return np.unique((out >> np.uint64(32)).astype(np.uint32))


def pack(own: np.ndarray) -> str:
    return base64.b64encode(own.astype("<u4").tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two signature sets; 0 where their sizes alone keep it under ``least``. Two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    out = same / (len(both) - same)
    return out if out >= least else 0.0


def length_bands(top: int, least: float) -> list[int]:
    """Starts of the set-size bands 1..top: sets at least ``least`` alike lie in one band or in neighbouring ones."""
    out, low = [], 1
    while low <= top:
        out.append(low)
        low = max(low + 1, int(low / least) + 1)
    return out


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_LOWEST = -(1 << 63)


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (range, guest, id downwards) to fingerprints: each row is followed by its next document."""
    known = _Codes()
    held = None  # (range, id, is null, text, signatures)

    def row(one: tuple, text: str, own: np.ndarray) -> tuple:
        changed = _edited(one[3], text)
        other = signatures(changed, known)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return (None if one[2] else one[1], len(one[3]), sha, pack(one[4]), pack(other), likeness(one[4], other), likeness(one[4], own))

    for batch in batches:
        rows = []
        for span, guest, key, none, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            own = signatures(text, known)
            if held is not None and held[0] == span:
                rows.append(row(held, text, own))
            held = None if guest else (span, key, none, text, own)
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    known.clear()
    trim()


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edit, and compare both with the next document's.

    The next document is the one with the next smaller id; after the last comes the first. The
    edit replaces the last half of the text (code points, rounded down) by as many of the next one's first, or all.
    Returns id, n_chars, edited_sha256, fingerprint and edited_fingerprint (base64 of the sorted
    32-bit signatures), near_edited and near_next. Null texts count as empty; empty texts have an
    empty fingerprint, alike to each other only. Null ids count as smallest. Rows that repeat an id follow each other
    in the order of their texts. One row alone is its own next.

    Texts move once, to ranges of ids; a range also gets, as a guest, the first row of the range
    below it. What comes to the driver is a bound and a greatest id per range.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    ranges = 4 * width(spark)
    low = F.lit(_LOWEST).cast("long")
    light = docs.select(F.coalesce(F.col(id_col).cast("long"), low).alias("key"))
    cuts = light.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("cuts")).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(bounds, batch.column(0).to_numpy(), "left").astype(np.int32))], ["key", "span"])

    tops = sorted((r["span"], r["key"]) for r in light.mapInArrow(ranged, "key long, span int").groupBy("span").agg(F.max("key").alias("key")).collect())
    guest_of = {key: tops[(i + 1) % len(tops)][0] for i, (_, key) in enumerate(tops)}

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            span = np.searchsorted(bounds, key, "left").astype(np.int32)
            stay = np.zeros(len(key), bool)
            yield pa.RecordBatch.from_arrays([pa.array(span), pa.array(stay), *(batch.column(i) for i in range(3))], ["span", "guest", "key", "none", "text"])
            goes = [i for i, k in enumerate(key.tolist()) if k in guest_of]
            if goes:
                some = batch.take(pa.array(goes))
                to = pa.array([guest_of[k] for k in some.column(0).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array(np.ones(len(goes), bool)), *(some.column(i) for i in range(3))], ["span", "guest", "key", "none", "text"])

    source = docs.select(F.coalesce(F.col(id_col).cast("long"), low).alias("key"), F.col(id_col).isNull().alias("none"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    moved = source.mapInArrow(placed, "span int, guest boolean, key long, none boolean, text string")
    ordered = moved.repartition(width(spark), "span").sortWithinPartitions("span", "guest", F.desc("key"), "text")
    return ordered.mapInArrow(_printed, _OUT).withColumnRenamed("id", id_col)
