"""Edit-aware token counts: a sum tree over runs of pre-tokens per document, re-encoded only where edits touch it."""

from __future__ import annotations

import base64
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import bound_batches

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the vocabulary's public pre-token pattern: it looks ahead, over a run of white space at most, and never back
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64  # pre-tokens in a leaf


class Counter:
    """Tokens of single pre-tokens, remembered within bounds."""

    def __init__(self, ranks: str = RANKS):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known = _Known(self.coder)

    def tokens(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))


class _Known(dict):
    def __init__(self, coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, part: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        n = self[part] = len(self.coder.encode_ordinary(part))
        return n


@lru_cache(maxsize=2)
def counter(ranks: str) -> Counter:
    return Counter(ranks)


class Tree:
    """A text's leaves (end in code points, tokens) under a binary tree of token sums.

    Node i has the children 2i and 2i + 1; the leaves are the last level, padded with zeros to a power of two.
    """

    def __init__(self, text: str, ends: list[int], leaves: list[int]):
        self.text, self.ends, self.leaves = text, ends, leaves
        self._sum()

    def _sum(self) -> None:
        width = 1 << max(0, (len(self.leaves) - 1).bit_length()) if self.leaves else 1
        level = np.zeros(width, np.int64)
        level[: len(self.leaves)] = self.leaves
        levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            levels.append(level)
        self.sums = np.concatenate([np.zeros(1, np.int64), *reversed(levels)])

    @property
    def tokens(self) -> int:
        return int(self.sums[1])

    @classmethod
    def build(cls, text: str, own: Counter) -> Tree:
        parts = own.pattern.findall(text)
        if not parts:
            return cls(text, [], [])
        starts = np.arange(0, len(parts), LEAF)
        ends = np.cumsum(np.add.reduceat(np.fromiter(map(len, parts), np.int64, len(parts)), starts))
        return cls(text, ends.tolist(), np.add.reduceat(own.tokens(parts), starts).tolist())

    def edit(self, start: int, end: int, put: str, own: Counter) -> int:
        """Replace text[start:end]; returns how many code points were encoded again.

        Encoding restarts at the leaf that holds the character before the edit, since the pre-token
        that ends there may look at the edit. A leaf that starts after white space or an apostrophe isn't safe to
        start from: where that pre-token ends depends on all of the run, or on two characters. Encoding stops at the first old leaf end after it
        that is a pre-token's end in the new text: from there on nothing differs.
        """
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        first = min(bisect_left(self.ends, start), max(0, len(self.ends) - 1))
        while first and ((last := self.text[self.ends[first - 1] - 1]).isspace() or last == "'"):
            first -= 1
        begin = self.ends[first - 1] if first else 0
        shift = len(put) - (end - start)
        self.text = self.text[:start] + put + self.text[end:]
        parts: list[str] = []
        at, last = begin, len(self.ends)
        for m in own.pattern.finditer(self.text, begin):
            parts.append(m[0])
            at = m.end()
            if at - shift >= end:
                i = bisect_left(self.ends, at - shift)
                if i < len(self.ends) and self.ends[i] == at - shift:
                    last = i + 1
                    break
        ends, leaves = [], []
        if parts:
            starts = np.arange(0, len(parts), LEAF)
            ends = (begin + np.cumsum(np.add.reduceat(np.fromiter(map(len, parts), np.int64, len(parts)), starts))).tolist()
            leaves = np.add.reduceat(own.tokens(parts), starts).tolist()
        same = len(leaves) == last - first
        tail = self.ends[last:]
        self.ends[first:] = ends + ([e + shift for e in tail] if shift else tail)
        self.leaves[first:last] = leaves
        if same and leaves:
            self._raise(first, leaves)
        else:
            self._sum()
        return at - begin

    def _raise(self, first: int, leaves: list[int]) -> None:
        """New sums on the paths from changed leaves to the root."""
        base = len(self.sums) // 2
        touched = set()
        for i, n in enumerate(leaves):
            self.sums[base + first + i] = n
            touched.add((base + first + i) // 2)
        while touched and 0 not in touched:
            for i in touched:
                self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]
            touched = {i // 2 for i in touched}


TREE = "struct<ends array<int>, leaves array<int>, n_tokens long>"


def token_tree(text: Column, ranks: str = RANKS) -> Column:
    """The tree of each text: leaf ends, leaf tokens and their sum; null and empty texts have no leaf and 0 tokens."""

    @F.arrow_udf(TREE)
    def built(texts: pa.Array) -> pa.Array:
        own, out = counter(ranks), []
        for t in texts:
            x = Tree.build(t.as_py() or "", own)
            out.append({"ends": x.ends, "leaves": x.leaves, "n_tokens": x.tokens})
        return pa.array(out, pa.struct([("ends", pa.list_(pa.int32())), ("leaves", pa.list_(pa.int32())), ("n_tokens", pa.int64())]))

    return built(text)


def recount(text: Column, tree: Column, edits: Column, ranks: str = RANKS) -> Column:
    """Apply ``edits`` (array of struct start, end, put; code points, each on the outcome of those before) to text and tree.

    Gives text, ends, leaves, n_tokens and n_encoded, the code points that were encoded again. Bounds outside
    the text are moved to its ends; a null ``put`` deletes; null edits change nothing.
    """

    @F.arrow_udf("struct<text string, ends array<int>, leaves array<int>, n_tokens long, n_encoded long>")
    def changed(texts: pa.Array, trees: pa.Array, edits: pa.Array) -> pa.Array:
        own, out = counter(ranks), []
        for t, x, es in zip(texts, trees, edits, strict=True):
            x = x.as_py()
            now, encoded = Tree(t.as_py() or "", list(x["ends"]), list(x["leaves"])), 0
            for e in es.as_py() or []:
                encoded += now.edit(e["start"], e["end"], e["put"] or "", own)
            out.append({"text": now.text, "ends": now.ends, "leaves": now.leaves, "n_tokens": now.tokens, "n_encoded": encoded})
        return pa.array(out, pa.struct([("text", pa.string()), ("ends", pa.list_(pa.int32())), ("leaves", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("n_encoded", pa.int64())]))

    return changed(text, tree, edits)


def count_with_edits(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """One row per document: its tokens before and after ``edits``, and what was encoded again.

    Returns id, n_chars, n_tokens, n_leaves, edited_n_chars, edited_n_tokens, n_encoded. Null texts
    count as empty; repeated rows repeat; other columns are left out.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    built = docs.select(F.col(id_col), text.alias("_text"), edits.alias("_edits")).withColumn("_tree", token_tree(F.col("_text"), ranks))
    new = built.withColumn("_new", recount(F.col("_text"), F.col("_tree"), F.col("_edits"), ranks))
    return new.select(
        id_col, F.length("_text").cast("long").alias("n_chars"), F.col("_tree.n_tokens").alias("n_tokens"), F.size("_tree.leaves").cast("long").alias("n_leaves"),
        F.length("_new.text").cast("long").alias("edited_n_chars"), F.col("_new.n_tokens").alias("edited_n_tokens"), F.col("_new.n_encoded").alias("n_encoded"))
