"""SentencePiece encoding by sampling from the piece lattice, and its lossless decoding."""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import bound_batches, mix, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
ALPHA = 1.0  # exponent of a piece's weight; larger values favour the likeliest segmentation
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Lattice:
    """Samples segmentations of texts into the vocabulary's pieces.

    The model is BPE and has merge ranks in place of probabilities, so a piece's weight is
    Zipf's law of its rank, to the power ``alpha``. Characters without a piece, and the mark that stands for a space
    where a text has it, are the bytes of their UTF-8 form.

    No piece has the space mark after another character or holds a line end, so words with the
    spaces before them are independent parts of the lattice. Forward sums are made once for each distinct word
    of a chunk, for all words of one length at a time; backward sampling goes over all words' places at a
    time. The draws are hashes of (seed, number of the word, step), so how texts are batched has no influence.
    """

    def __init__(self, model: str = MODEL, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.piece: list[bytes] = []
        self.byte = np.zeros(256, np.int64)
        self.id: dict[str, int] = {}
        weight = np.zeros(sp.get_piece_size())
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if m := _BYTE.fullmatch(p):
                self.byte[int(m[1], 16)] = i
                self.piece.append(bytes([int(m[1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.piece.append(b"")
            else:
                text = p.replace(SPACE, " ")
                self.piece.append(text.encode())
                self.id[text] = i
                weight[i] = math.exp(-alpha * math.log(10 + max(0.0, -sp.get_score(i))))
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.id):
            raise ValueError("a piece crosses words")
        self.weight = weight
        self.log = np.log(np.where(weight > 0, weight, 1.0)).tolist()
        self.longest = max(map(len, self.id))
        self.fallback = math.exp(-alpha * math.log(10 + len(weight)))  # of a character spelt in bytes
        self._index()

    def _index(self) -> None:
        """Two direct tables from a piece's hash to its id; the second takes what meets another in the first."""
        self.tables = [np.full(1 << TABLE, -1, np.int32) for _ in range(2)]
        self.hash = np.zeros(len(self.piece), np.uint64)
        for text, i in self.id.items():
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in text:
                    h = (h + np.uint64(ord(c) + 1)) * _STEP
            self.hash[i] = h
            first, second = self._slots(h)
            if self.tables[0][first] < 0:
                self.tables[0][first] = i
            elif self.tables[1][second] < 0:
                self.tables[1][second] = i
            else:
                raise ValueError("two pieces share both slots")

    @staticmethod
    def _slots(h):
        return h >> np.uint64(64 - TABLE), (h >> np.uint64(40 - TABLE)) & np.uint64((1 << TABLE) - 1)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed strings, -1 for those that are no piece."""
        first, second = self._slots(h)
        out = self.tables[0][first]
        out[self.hash[out] != h] = -1
        other = self.tables[1][second]
        return np.where((out < 0) & (other >= 0) & (self.hash[other] == h), other, out)

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length (rows of characters): by end and piece length, cumulated shares and ids.

        A character spelt in several bytes has its negative code in place of an id.
        """
        n, size = codes.shape
        most = min(self.longest, size)
        ids = np.full((n, size + 1, most), -1, np.int32)
        share = np.zeros((n, size + 1, most))
        for start in range(size):
            h = np.zeros(n, np.uint64)
            for k in range(min(most, size - start)):
                h = (h + (codes[:, start + k] + np.uint64(1))) * _STEP
                found = self._find(h)
                w = self.weight[found]
                if k:
                    w[found < 0] = 0
                else:
                    bare = found < 0
                    if bare.any():
                        c = codes[bare, start].astype(np.int64)
                        found[bare] = np.where(c < 128, self.byte[np.minimum(c, 127)], -c)
                        w[bare] = self.fallback
                ids[:, start + k + 1, k] = found
                share[:, start + k + 1, k] = w
        total = np.ones((n, size + 1))
        for end in range(1, size + 1):
            k = min(most, end)
            share[:, end, :k] *= total[:, end - k : end][:, ::-1]
            np.cumsum(share[:, end], axis=1, out=share[:, end])
            total[:, end] = share[:, end, -1]
            share[:, end] /= total[:, end, None]
        return share, ids

    def _long(self, word: str, base: int) -> list[int]:
        """As the other two, for one word of any length: logarithms of the forward sums, and the shares of the places passed on the way back."""
        bare = math.log(self.fallback)

        def ways(end: int) -> Iterator[tuple[int, int | None, float]]:
            for start in range(max(0, end - self.longest), end):
                i = self.id.get(word[start:end])
                if i is not None or end - start == 1:
                    # the place before is no further off than a few pieces, so its sum is a safe unit
                    yield start, i, math.exp(total[start] - total[end - 1] + (bare if i is None else self.log[i]))

        total = array("d", [0.0])
        for end in range(1, len(word) + 1):
            total.append(total[end - 1] + math.log(sum(s for _, _, s in ways(end))))
        out, end, step = [], len(word), 0
        while end:
            own = list(ways(end))
            shares = list(accumulate(s for _, _, s in own))
            start, i, _ = own[min(bisect_right(shares, float(_draw(np.uint64(base), step)) * shares[-1]), len(own) - 1)]
            out.append([i] if i is not None else [int(self.byte[b]) for b in word[start:end].encode("utf-8", "surrogatepass")])
            end, step = start, step + 1
        return [i for own in reversed(out) for i in own]

    def encode_all(self, texts: list[str], seeds: list[int]) -> list[np.ndarray]:
        """Ids of one sampled segmentation for each text; a text and a seed give the same ids anywhere."""
        out, words, sizes = [], [], []
        for text in texts:
            own = _WORD.findall(text)
            words += own
            sizes.append(len(own))
            if len(words) >= CHUNK:
                out += self._chunk(words, sizes, seeds[len(out) : len(out) + len(sizes)])
                words, sizes = [], []
        return out + self._chunk(words, sizes, seeds[len(out) :]) if sizes else out

    def _chunk(self, words: list[str], sizes: list[int], seeds: list[int]) -> list[np.ndarray]:
        if not words:
            return [np.empty(0, np.int32) for _ in sizes]
        known = _Numbers()
        of = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        place = np.arange(len(words)) - np.repeat(ends - sizes, sizes)
        base = mix(np.repeat(np.array(seeds, np.uint64), sizes) + mix(place.astype(np.uint64) + np.uint64(1)))
        distinct = list(known)
        length = np.fromiter(map(len, distinct), np.int64, len(distinct))
        by_length = np.argsort(length[of], kind="stable")
        cuts = np.searchsorted(length[of][by_length], np.arange(length.max() + 2))
        at, found = [], []  # place in the chunk << 32 | start in the word, id
        for size in range(1, min(int(length.max()), TABLED) + 1):
            occ = by_length[cuts[size] : cuts[size + 1]]
            if not len(occ):
                continue
            types, row = np.unique(of[occ], return_inverse=True)
            codes = np.frombuffer("".join([distinct[i] for i in types]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size).astype(np.uint64)
            share, ids = self._forward(codes)
            most = ids.shape[2]
            end, live, step = np.full(len(occ), size), np.arange(len(occ)), 0
            while len(live):
                r, e = row[live], end[live]
                k = np.minimum((share[r, e] <= _draw(base[occ[live]], step)[:, None]).sum(1), most - 1)
                e = e - k - 1
                at.append(occ[live] << 32 | e)
                found.append(ids[r, e + k + 1, k])
                end[live] = e
                live, step = live[e > 0], step + 1
        for j in by_length[cuts[min(int(length.max()), TABLED) + 1] :]:
            own = self._long(words[j], int(base[j]))
            # ids of a long word have their order in place of a start
            at.append(int(j) << 32 | np.arange(len(own)))
            found.append(np.array(own, np.int32))
        at, found = np.concatenate(at), np.concatenate(found)
        order = np.argsort(at, kind="stable")
        at, found = at[order] >> 32, found[order]
        spelt = found < 0
        if spelt.any():
            raw = [chr(-c).encode("utf-8", "surrogatepass") for c in found[spelt].tolist()]
            times = np.ones(len(found), np.int64)
            times[spelt] = [len(x) for x in raw]
            first = np.cumsum(times) - times
            at, whole = np.repeat(at, times), np.repeat(found, times)
            places = np.concatenate([np.arange(f, f + len(x)) for f, x in zip(first[spelt], raw, strict=True)])
            whole[places] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
            found = whole
        return np.split(found.astype(np.int32), np.searchsorted(at, ends[:-1]))

    def encode(self, text: str, seed: int) -> np.ndarray:
        return self.encode_all([text], [seed])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text that any encoding of it came from."""
        return b"".join(map(self.piece.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        return i


def _draw(base, step: int):
    """Numbers in [0, 1)."""
    with np.errstate(over="ignore"):
        return (mix(base + np.uint64((step * 0x9E3779B97F4A7C15 + 1) & (1 << 64) - 1)) >> np.uint64(11)) * 2.0**-53


_STEP = np.uint64(0x9FB21C651E98DF25)
TABLE = 20  # bits of the tables from hash to piece
TABLED = 32  # longest word, in characters, that goes by tables
CHUNK = 200_000  # words handled at once
#: a line end, spaces with the word after them, or spaces
_WORD = re.compile(r"\n| *+[^ \n]++| ++")


@lru_cache(maxsize=2)
def lattice(model: str, alpha: float) -> Lattice:
    return Lattice(model, alpha)


def seed_of(key: object, salt: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(str(key).encode(), seed=salt)


def _lists(found: list[np.ndarray | None]) -> pa.ListArray:
    ends = np.cumsum([0] + [0 if x is None else len(x) for x in found])
    flat = [x for x in found if x is not None]
    none = pa.array([x is None for x in found], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32), pa.int32()), mask=none)


def _sampled(own: Lattice, keys: pa.Array, texts: pa.Array, salt: int) -> list[np.ndarray | None]:
    raw, valid = texts.to_pylist(), texts.is_valid().to_pylist()
    ids = iter(own.encode_all([t for t in raw if t is not None], [seed_of(k, salt) for k, v in zip(keys.to_pylist(), valid, strict=True) if v]))
    out = [next(ids) if v else None for v in valid]
    trim()
    return out


def encode(key: Column, text: Column, model: str = MODEL, alpha: float = ALPHA, salt: int = 0) -> Column:
    """Sampled ids of each text (array<int>), seeded by the row's key. Null gives null, an empty text an empty array."""

    @F.arrow_udf("array<int>")
    def sampled(keys: pa.Array, texts: pa.Array) -> pa.Array:
        return _lists(_sampled(lattice(model, alpha), keys, texts, salt))

    return sampled(key, text)


def decode(ids: Column, model: str = MODEL) -> Column:
    """The texts of arrays of ids. Null gives null."""

    @F.arrow_udf("string")
    def whole(batch: pa.Array) -> pa.Array:
        own = lattice(model, ALPHA)
        return pa.array([own.decode(np.array(x.as_py(), np.int32)) if x.is_valid else None for x in batch], pa.string())

    return whole(ids)


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA, salt: int = 0) -> DataFrame:
    """One row per document: id, ids (array<int>), n_pieces, n_chars, decoded_sha256 and lossless.

    ``ids`` is one segmentation drawn from the lattice by forward filtering and backward
    sampling, seeded by the row's id, so equal texts under different ids may differ and a rerun
    doesn't; no word or run of spaces is cut, however long. ``decoded_sha256`` is of the text decoded from ``ids``; ``lossless`` tells whether
    it equals the input. Texts aren't normalised. Null texts give null ids, hash and lossless
    and 0 pieces; rows that repeat an id and text repeat their ids. Other columns are left out.
    """

    @F.arrow_udf("struct<ids array<int>, decoded_sha256 string, lossless boolean>")
    def coded(keys: pa.Array, texts: pa.Array) -> pa.Array:
        own = lattice(model, alpha)
        ids = _sampled(own, keys, texts, salt)
        back = [None if x is None else own.decode(x) for x in ids]
        sha = [None if x is None else hashlib.sha256(x.encode()).hexdigest() for x in back]
        same = [None if x is None else x == t.as_py() for x, t in zip(back, texts, strict=True)]
        return pa.StructArray.from_arrays([_lists(ids), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["ids", "decoded_sha256", "lossless"])

    bound_batches(docs.sparkSession)
    done = docs.select(F.col(id_col), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"), coded(F.col(id_col), F.col(text_col)).alias("c"))
    return done.select(id_col, "c.ids", F.coalesce(F.size("c.ids"), F.lit(0)).cast("long").alias("n_pieces"), "n_chars", "c.decoded_sha256", "c.lossless")
