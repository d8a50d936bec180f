"""Periodic runs of words: squares from Lempel-Ziv blocks, their types and occurrences from a suffix tree, merged into runs."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import WordCodes, bound_batches, mix, trim

#: a run has at least so many words, and at least so many periods
LEAST, POWER = 24, 3
#: words of repeating stretches, of several texts, that share one suffix tree; a longer stretch has its own
BATCH = 60_000


def repeating(codes: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int]]:
    """Stretches [a, b) of a text outside which no run can be: all others hold a window of words that occurs once only.

    Within a run of ``least`` words and ``power`` periods each window of least * (power - 2) / power words (one at least)
    occurs again a period earlier or later, within the run. Equal codes may only widen a stretch.
    """
    width, n = max(1, least * (power - 2) // power), len(codes)
    if n < least:
        return []
    window = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        window = window * np.uint64(0xF1357AEA2E62A9C5) + codes[k : n - width + 1 + k]
    window = mix(window)
    order = np.argsort(window, kind="stable")
    equal = window[order[1:]] == window[order[:-1]]
    again = np.zeros(len(window) + 2, np.int8)
    again[order[1:][equal] + 1] = 1
    again[order[:-1][equal] + 1] = 1
    step = np.diff(again)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + width - 1
    return [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a >= least]


class SuffixTree:
    """The suffix tree of ``x`` (0, 1, ... with an end that occurs once) as arrays: leaves in order, and depths where neighbours part.

    A node is a range of leaves that agree on its depth. The suffix link from a leaf leads to the leaf of the next position,
    so a walk along links is a slice of ``rank``. ``names[k][i]`` names the 2**k symbols from i on, equal for equal symbols.
    """

    def __init__(self, x: np.ndarray):
        self.n, name, self.names = len(x), x.astype(np.int64), [x.astype(np.int32)]
        while name.max() < self.n - 1:
            step = 1 << (len(self.names) - 1)
            after = np.zeros(self.n, np.int64)
            after[: self.n - step] = name[step:] + 1
            name = np.unique(name * (self.n + 1) + after, return_inverse=True)[1]
            self.names.append(name.astype(np.int32))
        self.rank = name.astype(np.int64)
        self.leaves = np.empty(self.n, np.int64)
        self.leaves[self.rank] = np.arange(self.n)
        self.depth = np.zeros(self.n, np.int64)  # of the node at which a leaf parts from the one before it
        self.depth[1:] = self.ahead(self.leaves[:-1], self.leaves[1:])
        self.least = [self.depth]  # least[k][i]: least depth of the 2**k from i on
        while 2 << (len(self.least) - 1) <= self.n:
            a, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(a[:-half], a[half:]))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different positions, how many symbols from there on are equal."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            same = self.names[k][i] == self.names[k][j]
            step = same.astype(np.int64) << k
            out += step
            i += step
            j += step
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different positions, how many symbols before them are equal."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            same = (a >= 0) & (b >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])
            step = same.astype(np.int64) << k
            out += step
            i -= step
            j -= step
        return out

    def node(self, i: np.ndarray, deep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf below the place of the ``deep`` symbols from i on."""
        low, high = self.rank[i], self.rank[i]
        for k in range(len(self.least) - 1, -1, -1):
            at = low - (1 << k) + 1
            low = np.where((at >= 1) & (self.least[k][np.maximum(at, 0)] >= deep), at - 1, low)
            at = high + 1
            last = self.n - (1 << k)
            high = np.where((at <= last) & (self.least[k][np.minimum(at, last)] >= deep), high + (1 << k), high)
        return low, high

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks: the longest start of the rest that occurs from an earlier position on, or one symbol."""
        leaves, n = self.leaves.tolist(), self.n
        before, after, stack = [-1] * n, [-1] * n, []
        for p in leaves:  # nearest leaf on either side of an earlier position
            while stack and stack[-1] > p:
                after[stack.pop()] = p
            before[p] = stack[-1] if stack else -1
            stack.append(p)
        longest = np.zeros(n, np.int64)
        for side in (np.array(before), np.array(after)):
            at = np.flatnonzero(side >= 0)
            longest[at] = np.maximum(longest[at], self.ahead(at, side[at]))
        starts, at, longest = [], 0, longest.tolist()
        while at < n:
            starts.append(at)
            at += max(1, longest[at])
        return np.array(starts)


def _primitive(tree: SuffixTree, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the ``period`` symbols from ``at`` on, which a second copy follows, are no power of fewer symbols."""
    out, rest, factor = np.ones(len(at), bool), period.copy(), 2
    most = int(period.max(initial=1))
    while factor <= most:
        if factor * factor > most:  # what is left of a period is a prime
            hit = np.flatnonzero(rest > 1)
            by = rest[hit]
        else:
            hit = np.flatnonzero(rest % factor == 0)
            by = np.full(len(hit), factor)
        if len(hit):
            short = period[hit] // by
            out[hit] &= tree.ahead(at[hit], at[hit] + short) < 2 * period[hit] - short
        if factor * factor > most:
            break
        while len(hit):
            rest[hit] //= factor
            hit = hit[rest[hit] % factor == 0]
        factor += 1 if factor == 2 else 2
    return out


def covering_squares(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of repetitions that hold the leftmost occurrence of every square of primitive root.

    The leftmost occurrence of a square crosses the start of a block. With the last such start h in the right half, the half
    lies in two blocks, as a block that starts within it reaches its end; with h in the left half, the right half lies in the
    block from h on. So periods up to the two blocks' length before h, and up to the block's length after it, are tried, and
    each repetition is taken as far as it goes.
    """
    starts = tree.blocks()
    edges = np.append(starts, tree.n)
    h, size, last = edges[1:-1], edges[2:] - edges[1:-1], edges[1:-1] - edges[:-2]
    found = []
    for many, side in ((np.minimum(size + last - 1, h), -1), (np.minimum(size, tree.n - 1 - h), 1)):
        period = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + 1
        at = np.repeat(h, many)
        left = np.minimum(at, at + side * period)
        ahead = tree.ahead(left, left + period)
        near = np.flatnonzero(ahead > 0) if side < 0 else np.arange(len(at))
        left, period, ahead = left[near], period[near], ahead[near]
        behind = tree.behind(left, left + period)
        good = ahead + behind >= period
        found.append((left[good] - behind[good], left[good] + period[good] + ahead[good], period[good]))
    low, high, period = (np.concatenate(x) for x in zip(*found))
    _, one = np.unique(low * (tree.n + 1) + period, return_index=True)
    low, high, period = low[one], high[one], period[one]
    keep = _primitive(tree, low, period)
    return low[keep], high[keep], period[keep]


def _spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers first, first + 1, ... of each row, ``many`` of them, and the rows they are of."""
    row = np.repeat(np.arange(len(many)), many)
    return first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many), row


def runs_of(x: np.ndarray, least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of all runs in ``x``, whose symbols are numbered from 0 without a gap, the last one occurring once.

    From each covering square, suffix links lead to the places of its rotations, the repetition's next squares, up to the last different
    one; places reached before are left out. The leaves below a place are all occurrences of its square; occurrences of one
    period at neighbouring positions make up a run.
    """
    tree = SuffixTree(x)
    low, high, period = covering_squares(tree)
    start, row = _spread(low, np.minimum(period, high - low - 2 * period + 1))
    half = period[row]
    first, last = tree.node(start, 2 * half)
    _, one = np.unique(first * (tree.n + 1) + half, return_index=True)
    leaf, row = _spread(first[one], last[one] - first[one] + 1)
    key = np.sort(half[one][row] * (2 * tree.n) + tree.leaves[leaf])
    if not len(key):
        return []
    edge = np.flatnonzero(np.diff(key) != 1)
    begin, end = key[np.append(0, edge + 1)], key[np.append(edge, len(key) - 1)]
    period, start = np.divmod(begin, 2 * tree.n)
    length = end - begin + 2 * period
    keep = length >= np.maximum(least, power * period)
    return sorted(zip(start[keep].tolist(), length[keep].tolist(), period[keep].tolist()))


def runs_of_many(stretches: list[list[bytes]], least: int = LEAST, power: int = POWER) -> list[list[tuple[int, int, int]]]:
    """Runs of each stretch of words. All share one suffix tree, parted by symbols that occur once."""
    known: dict[bytes, int] = {}
    flat = [[known.setdefault(w, len(known)) for w in s] for s in stretches]
    ends = np.cumsum([len(s) + 1 for s in stretches])
    x = np.empty(ends[-1], np.int64)
    for k, s in enumerate(flat):
        x[ends[k] - 1 - len(s) : ends[k] - 1] = s
        x[ends[k] - 1] = len(known) + k
    out: list[list] = [[] for _ in stretches]
    for start, length, period in runs_of(x, least, power):
        k = int(np.searchsorted(ends, start, "right"))
        out[k].append((start - (int(ends[k]) - 1 - len(stretches[k])), length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that follow the first period of a run they are in."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(w for w, g in zip(words, np.cumsum(gone)[:-1].tolist()) if not g)


def planted(words: list[bytes], name: bytes) -> list[bytes]:
    """Of one name in ten by checksum, the words with a tail that repeats one of its own stretches."""
    h, n = zlib.crc32(name), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


_RUNS = "array<struct<start:long,length:long,period:long>>"
_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, power: int = POWER, plant: bool = False, batch: int = BATCH) -> DataFrame:
    """One row for each row of ``docs``: id, runs, collapsed.

    ``runs`` are all stretches of consecutive words (white space of ASCII parts them) with a smallest period q, that no neighbouring word extends, of ``least`` words and
    ``power`` periods or more, by start, then period. ``collapsed`` is the text's words joined by one space, without those that follow the first period of
    a run. Null, empty and blank texts have no runs and collapse to the empty text; null and repeated ids stay as they are; other columns, whatever their
    names, are left out; no rows give no rows. With ``plant``, a tenth of the texts by checksum of the id first gets a periodic tail (no id: never).

    Whole texts, one after another: nothing is shuffled, and a task holds the stretches of up to ``batch`` words, or one longer
    stretch, with some 500 bytes a word. Time is n log n in a text's repeating words.
    """
    bound_batches(docs.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        rows: list = []  # (id, words, stretches as (row, a, b)) in order, until their stretches have been looked at
        held: list = []

        def done() -> pa.RecordBatch:
            runs: list = [[] for _ in rows]
            for (k, a, b), own in zip(held, runs_of_many([rows[k][1][a:b] for k, a, b in held], least, power) if held else []):
                runs[k] += [(a + s, n, q) for s, n, q in own]
            each = [sorted(r, key=lambda t: (t[0], t[2])) for r in runs]
            return pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), pa.array([[dict(zip(("start", "length", "period"), t)) for t in r] for r in each], _TYPE),
                 pa.array([collapse(w, r).decode() for (_, w), r in zip(rows, each)], pa.string())], ["id", "runs", "collapsed"])

        size = texts = 0
        for piece in batches:
            for i, text in zip(piece.column(0).to_pylist(), piece.column(1)):
                words = text.as_py().encode().split()
                if plant and i is not None:
                    words = planted(words, b"%d" % i)
                rows.append((i, words))
                near = repeating(known.of(words), least, power)
                held += [(len(rows) - 1, a, b) for a, b in near]
                size += sum(b - a for a, b in near)
                texts += len(words)
                if size >= batch or texts >= 8 * batch:
                    yield done()
                    rows.clear()
                    held.clear()
                    size = texts = 0
        yield done()
        known.clear()
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(found, f"id long, runs {_RUNS}, collapsed string").withColumnRenamed("id", id_col)


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of :func:`find_runs` in figures: the number of runs, the run with the most periods, and checksums of runs and collapsed text."""
    best, line = f"b{uuid.uuid4().hex}", f"r{uuid.uuid4().hex}"
    # of equal length / period the first in order of start and period, as runs are in that order
    most = f"aggregate(runs, cast(null as struct<start:long,length:long,period:long>), ({best}, {line}) -> if({best} is null or {line}.length * {best}.period > {best}.length * {line}.period, {line}, {best}))"
    text = f"array_join(transform(runs, {line} -> concat({line}.start, ',', {line}.length, ',', {line}.period, '\\n')), '')"
    return found.withColumns({"best": F.expr(most), "listed": F.expr(text)}).select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
