"""N-gram Jaccard join with PartEnum signatures, exact, down to connected classes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import WordCodes, bound_batches, discard, materialise, mix, shingles, trim, width

INNER, KEPT = 3, 2  # second-level parts of a first-level part, and how many of them make a subset
KINDS = 4  # partitions tried, with other hashes, until a set has few empty subsets
BLOCK = 512  # sets in a block; texts that go to one centre at a time
WORK = 4  # times its signatures' squares up to which a group's square is compared as one
CROSS = 4  # open pairs for each member up to which a group's pairs are listed; beyond, it is compared by blocks
PART_BYTES = 16_000_000  # bytes of text whose signatures make one part of the hash range
BUFFER = 300_000  # signatures that a task holds and groups before they move
BROADCAST = 500_000  # rows of 64-bit numbers up to which a table is broadcast
COMMON = 0.002  # share of documents from which on a shingle is left out of signatures
SAMPLE = 20_000  # documents by which that share is estimated


@lru_cache(maxsize=None)
def bands(num: int, den: int, top: int) -> tuple[tuple[int, int, int, int], ...]:
    """(smallest size, k, first-level parts, spare ones) of each size band up to ``top``, for similarity num / den.

    Sets that are similar enough lie in one band or in neighbouring ones, so band i compares
    sizes from band i-1's start to its own end r, whose symmetric difference is at most
    k = floor((1-s)/(1+s) * 2r). A first-level part tolerates INNER - KEPT = 1 difference, so at most k // 2
    parts differ by more, and of k // 2 + 1 + spare parts at least spare + 1 share a subset.
    """
    out, low = [], 1
    while low <= top:
        high = max(low, low * den // num)
        k = 2 * high * (den - num) // (den + num)
        need = k // (INNER - KEPT + 1) + 1
        mean = need * INNER * math.exp(-0.8 * low * KEPT / INNER / need)
        out.append((low, k, need, 0 if k < 4 else 1 + math.ceil(mean + math.sqrt(mean))))
        low = high + 1
    return tuple(out)


def subsets(features: np.ndarray, outer: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, is empty) by first-level part and by the second-level part that its subset leaves out."""
    s = np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    hashed = mix(features ^ s)
    cell = ((hashed >> np.uint64(32)) % np.uint64(outer * INNER)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    inside = np.bincount(cell, minlength=outer * INNER)
    content = np.zeros(outer * INNER, np.uint64)
    if len(features):
        starts = np.cumsum(inside) - inside
        content[inside > 0] = np.add.reduceat(hashed[order], starts[inside > 0])
    content, inside = content.reshape(outer, INNER), inside.reshape(outer, INNER)
    name = mix(np.arange(1, outer * INNER + 1, dtype=np.uint64) + s).reshape(outer, INNER)
    return mix(content.sum(1, keepdims=True) - content + name), inside.sum(1, keepdims=True) == inside


def part_enum(codes: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of a set: for its band and the next one, of each first-level part's subsets of second-level parts.

    Features in ``common`` (sorted) are left out at first: that can't enlarge a difference, and subsets
    filled by them alone would match in too many sets. Empty subsets make no signature, which loses nothing while a set has
    them in no more than the spare parts. Sets with more are matched with their like under other partitions of all
    their features, at last with the empty subsets as signatures.
    """
    n, found = len(codes), []
    plan = bands(num, den, 1 << max(4, (4 * n).bit_length()))
    at = next(i for i in range(len(plan) - 1, -1, -1) if plan[i][0] <= n) if n else 0
    if not plan[at + 1][1]:
        return codes[:0]  # in such bands only equal sets are similar enough; these are one node
    rare = codes[common[np.minimum(np.searchsorted(common, codes), len(common) - 1)] != codes] if len(common) else codes
    for i in (at, at + 1):
        _, k, need, spare = plan[i]
        if not k:
            continue
        for kind in range(KINDS):
            sig, empty = subsets(codes if kind else rare, need + spare, i * KINDS + kind + 1)
            found.append(sig[~empty])
            if empty.any(1).sum() <= spare:
                break
        else:
            found.append(sig[empty])
    return np.concatenate(found) if found else codes[:0]


def _codes(text: bytes | None, words: int, known: WordCodes) -> np.ndarray:
    return shingles(known.of((text or b"").lower().split()), words)


def _fingerprint(codes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(codes.tobytes(), seed=len(codes) % 4096)))) if len(codes) else 0


def _grouped(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ordered (signatures, nodes), the hub of each one's signature, and which nodes are hubs: the least by hash, so that signatures of one group share few."""
    order = np.lexsort((mix(node.view(np.uint64)), sig))
    sig, node = sig[order], node[order]
    first = np.r_[True, sig[1:] != sig[:-1]][: len(sig)]
    return sig, node, node[first][np.cumsum(first) - 1], first


_SIGNED = "id long, tk long, fp long, n int, part int, packed binary, sig long, hub long"
_ROW = [x.split()[0] for x in _SIGNED.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]


def _rows(**given: object) -> pa.RecordBatch:
    size = max(len(x) for x in given.values())
    return pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(size, t) for c, t in zip(_ROW, _TYPES, strict=True)], _ROW)


def _signed(words: int, num: int, den: int, parts: int, common: np.ndarray):
    """Documents (id, text key, text) to rows of themselves, of the signatures their task shares, and of its hubs' signatures, packed by part of the hash range."""

    def pack(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sig = np.concatenate([s for _, s in held])
        node = np.repeat(np.array([f for f, _ in held], np.int64), [len(s) for _, s in held])
        # a part's number over 32 bits of the signature
        sig = ((sig % np.uint64(parts)) << np.uint64(32) | sig >> np.uint64(32)).astype(np.int64)
        sig, node, hub, first = _grouped(sig, node)
        if not first.all():
            yield _rows(sig=sig[~first], fp=node[~first], hub=hub[~first])
        sig, node = sig[first], node[first]
        part = sig >> 32
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        low = (sig & 0xFFFFFFFF).astype(np.uint32)
        yield _rows(part=part[cuts[:-1]].astype(np.int32), packed=[node[a:b].tobytes() + low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordCodes(), set()
        held, load = [], 0
        for batch in batches:
            fps, ns = [], []
            for text in batch.column(2):
                codes = _codes(text.as_py(), words, known)
                fp = _fingerprint(codes)
                fps.append(fp)
                ns.append(len(codes))
                if len(codes) and fp not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(fp)
                    if len(sig := part_enum(codes, common, num, den)):
                        held.append((fp, sig))
                        load += len(sig)
                if load >= BUFFER:
                    yield from pack(held)
                    held, load = [], 0
            yield _rows(id=batch.column(0), tk=batch.column(1), fp=fps, n=ns)
        if held:
            yield from pack(held)
        known.clear()
        seen.clear()
        trim()

    return run


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed signatures, in order of their part, to stars: each member of a signature but the hub, with the hub."""

    def stars(part: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        sizes = [len(x) // 12 for x in held]
        node = np.concatenate([np.frombuffer(x, np.int64, m) for x, m in zip(held, sizes, strict=True)])
        low = np.concatenate([np.frombuffer(x, np.uint32, m, 8 * m) for x, m in zip(held, sizes, strict=True)])
        sig, node, hub, first = _grouped(low, node)
        again = np.r_[False, (sig[1:] == sig[:-1]) & (node[1:] == node[:-1])][: len(sig)]
        more = ~first & (node != hub) & ~again
        sig, node, hub = (part << 32 | sig[more].astype(np.int64)), node[more], hub[more]
        for at in range(0, len(sig), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (sig, hub, node)], ["sig", "hub", "fp"])

    own, held = None, []
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != own and held:
                yield from stars(own, held)
                held = []
            own = part
            held.append(blob.as_py())
    if held:
        yield from stars(own, held)
    trim()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): one root, a node itself, for all nodes connected by ``edges`` (a, b); nodes without edges are absent.

    Every round hooks each node to its least neighbour, jumps once and contracts the edges to
    the roots, which at least halves the nodes that still have edges; the rounds' tables are written to the shared
    folder.
    """
    left = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    label = None
    while not left.isEmpty():
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        hook = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up")), f"{name}-hook")
        jump = hook.join(hook.select(F.col("node").alias("up"), F.col("up").alias("root")), "up").select("node", "root")
        jump = materialise(jump, f"{name}-jump")
        discard(hook)
        of = lambda c: jump.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))  # noqa: B023, E731
        rest = left.join(of("a"), "a").join(of("b"), "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        rest = materialise(rest, f"{name}-edges")
        discard(left)
        left = rest
        if label is None:
            label = jump
        else:
            # a node whose root has no edges left keeps it
            next_ = materialise(label.join(jump.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")), f"{name}-label")
            discard(label)
            discard(jump)
            label = next_
    discard(left)
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)


def _sent(df: DataFrame) -> DataFrame:
    """Broadcast, up to a counted size."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _compared(words: int, num: int, den: int):
    """Texts in order of (centre, share of its texts, side), the centre's own first, to links with the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at, size, centre = WordCodes(), None, 0, None
        for batch in batches:
            out = []
            for a, s, side, fp, n, text in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5), strict=True):
                if not side:
                    at, size, centre = (a, s), n, _codes(text.as_py(), words, known)
                elif at == (a, s) and den * min(n, size) >= num * max(n, size):
                    own = _codes(text.as_py(), words, known)
                    both = np.concatenate([centre, own])
                    both.sort(kind="stable")
                    same = int((both[1:] == both[:-1]).sum())
                    if den * same >= num * (len(both) - same):
                        out.append((a, fp))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
        known.clear()
        trim()

    return run


def _linked_pairs(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int, name: str) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough; the texts of a hot centre a go to several tasks."""
    hot = pairs.groupBy("a").count().filter(F.col("count") > BLOCK).select("a", F.ceil(F.col("count") / BLOCK).alias("shares"))
    dealt = pairs.join(_sent(hot), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))).cast("int").alias("s"))
    row = ("fp", "n", "text")
    members = dealt.join(texts, dealt.b == texts.fp).select("a", "s", F.lit(1).alias("side"), *row)
    centres = dealt.select("a", "s").distinct().join(texts, F.col("a") == texts.fp).select("a", "s", F.lit(0).alias("side"), *row)
    rows = members.unionByName(centres).repartition(width(pairs.sparkSession), "a", "s").sortWithinPartitions("a", "s", "side")
    return materialise(rows.mapInArrow(_compared(words, num, den), "a long, b long"), name)


def _block(words: int, num: int, den: int):
    """Texts of a pair of blocks to linked pairs, no more than join the classes of their members."""

    def run(table: pa.Table) -> pa.Table:
        node, side, before = (table.column(c).to_numpy() for c in ("fp", "side", "root"))
        known = WordCodes()
        sets = [_codes(x.as_py(), words, known) for x in table.column("text")]
        known.clear()
        size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        _, code = np.unique(flat, return_inverse=True)
        times = np.bincount(code)
        code, owner = code[times[code] > 1], owner[times[code] > 1]
        _, code = np.unique(code, return_inverse=True)
        same = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        for low in range(0, (code[-1] + 1) if len(code) else 0, 8192):
            a, b = np.searchsorted(code, [low, low + 8192])
            hot = np.zeros((len(sets), 8192), np.float32)
            hot[owner[a:b], code[a:b] - low] = 1
            same += hot @ hot.T
        whole = size[:, None] + size[None, :] - same
        link = den * same.astype(np.float64) >= num * whole.astype(np.float64)
        if side.min() != side.max():
            link &= side[:, None] != side[None, :]
        _, first, of = np.unique(before, return_index=True, return_inverse=True)
        link &= of[:, None] != of[None, :]
        root = first[of].tolist()  # members of one class are joined from the start

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for i, j in zip(*np.nonzero(np.triu(link, 1)), strict=True):
            if (p := top(i)) != (q := top(j)):
                root[max(p, q)] = min(p, q)
                out.append((int(node[i]), int(node[j])))
        trim()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _linked_blocks(members: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links within the groups of ``members`` (unit, fp, root, m), each pair of a group's blocks in a task of its own."""
    placed = members.withColumn("b", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), "b").cast("int"))
    o = F.col("own")
    goes = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: F.struct(F.least(o, j).alias("p"), F.greatest(o, j).alias("q"), F.signum(j - o).cast("int").alias("side")))
    spread = placed.join(texts, "fp").select("unit", F.explode(goes).alias("x"), "fp", "root", "text").select("unit", "x.*", "fp", "root", "text")
    return materialise(spread.groupBy("unit", "p", "q").applyInArrow(_block(words, num, den), "a long, b long"), "blocks")


def _units(members: DataFrame) -> DataFrame:
    """Groups (grp, fp, root, m) as what is compared whole: (unit, fp, root, m).

    Groups connected by common members become one unit where that is less work, that is, where the square of its size is no
    more than its groups' together: pairs that meet in many groups are then compared once.
    """
    hubs = members.groupBy("grp").agg(F.min("fp").alias("a"))
    whole = components(members.join(_sent(hubs), "grp").select("a", F.col("fp").alias("b")).distinct(), "units")
    held = members.join(whole.select(F.col("node").alias("fp"), F.col("root").alias("unit")), "fp")
    size = held.groupBy("unit", "fp").agg(F.sum("m").alias("work")).groupBy("unit").agg(F.sum("work").alias("work"), F.count("*").alias("size"))
    held = held.join(_sent(size), "unit").withColumn("joint", F.col("size") * F.col("size") <= F.col("work"))
    pick = lambda yes, no: F.when(F.col("joint"), F.col(yes)).otherwise(F.col(no))
    # a group and a class may have one number
    held = held.select("joint", pick("unit", "grp").alias("unit"), "fp", "root", pick("size", "m").alias("m")).distinct()
    out = materialise(held.select(F.xxhash64("joint", "unit").alias("unit"), "fp", "root", "m"), "members")
    discard(whole)
    return out


def _members(signed: DataFrame, matched: DataFrame) -> DataFrame:
    """(sig, grp, fp): each signature's members but its hub, and that hub of all tasks, which names the group."""
    local = signed.filter("hub is not null").select("sig", "hub", "fp")
    top = materialise(matched, "matched")
    up = top.select("sig", F.col("fp").alias("hub"), F.col("hub").alias("up"))
    own = top.select("sig", F.col("hub").alias("grp"), "fp").unionByName(local.join(up, ["sig", "hub"], "left").select("sig", F.coalesce("up", "hub").alias("grp"), "fp"))
    own = materialise(own.filter("grp <> fp").distinct(), "member")  # copies of a text are signed by every task that has one
    discard(top)
    return own


def _open(member: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (grp, fp, root, m, main, cross) of the groups whose members have several roots and more pairs than those with their hub.

    A group holds the members of all signatures that have one hub, unless its square is far more than theirs; then each
    signature is a group. ``main`` is the root of most members, ``cross`` the number of pairs with different roots.
    """
    of = roots.select(F.col("node").alias("fp"), "root")

    def several(groups: DataFrame) -> DataFrame:
        held = groups.join(of, "fp", "left").select("grp", "fp", F.coalesce("root", "fp").alias("root"))
        size = held.groupBy("grp", "root").agg(F.count("*").alias("c"))
        size = size.groupBy("grp").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.count("*").alias("roots"))
        size = size.filter("roots > 1 and m > 2").select("grp", "m", F.col("top.root").alias("main"), ((F.col("m") * F.col("m") - F.col("squares")) / 2).alias("cross"))
        return held.join(_sent(size), "grp")

    work = member.groupBy("grp", "sig").agg((F.count("*") + 1).alias("c")).groupBy("grp").agg(F.sum(F.col("c") * F.col("c")).alias("work"))
    hubs = pairs.select(F.col("a").alias("grp"), F.col("a").alias("fp")).distinct()
    whole = materialise(several(pairs.select(F.col("a").alias("grp"), F.col("b").alias("fp")).unionByName(hubs)), "whole")
    loose = materialise(whole.select("grp", "m").distinct().join(work, "grp").filter(F.col("m") * F.col("m") > WORK * F.col("work")).select("grp"), "loose")
    apart = member.join(_sent(loose), "grp", "left_semi").select("sig", "grp", "fp")
    apart = apart.select("sig", "fp").unionByName(apart.select("sig", F.col("grp").alias("fp")).distinct())
    out = materialise(whole.join(_sent(loose), "grp", "left_anti").unionByName(several(apart.select(F.xxhash64("sig").alias("grp"), "fp"))), "open")
    discard(whole)
    discard(loose)
    return out


def _common(source: DataFrame, rows: int, words: int) -> np.ndarray:
    """Codes of the shingles in at least ``COMMON`` of the documents, by a sample of about ``SAMPLE``.

    At most the mean set size / COMMON of them. Which they are bears on the number of candidates only, never on
    the result.
    """
    fraction = min(1.0, SAMPLE / max(1, rows))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        for batch in batches:
            found = [_codes(x.as_py(), words, known) for x in batch.column(0)] or [np.empty(0, np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["code"])
        known.clear()
        trim()

    least = max(3, int(COMMON * min(rows, SAMPLE)))
    found = source.select("text").sample(fraction=fraction, seed=1).mapInArrow(codes, "code long").groupBy("code").count().filter(F.col("count") >= least).select("code").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def row_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """A row for each row of ``docs``: id, tk (:func:`text_key` of its text), n (size of its set), root (its class, a 64-bit number) and least (the class's smallest id).

    See :func:`jaccard_classes`. Rows without shingles have no class.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("tk"), F.col(text_col).cast("binary").alias("text"))
    size = source.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = min(1 << 30, max(4 * width(spark), (size["bytes"] or 0) // PART_BYTES))
    common = _common(source, size["rows"], words)
    signed = materialise(source.mapInArrow(_signed(words, num, den, parts, common), _SIGNED), "signed")
    meta = materialise(signed.filter("n is not null").select("id", "tk", "fp", "n"), "meta")
    packed = signed.filter("part is not null").select("part", "packed").repartition(4 * width(spark), "part").sortWithinPartitions("part")
    matched = packed.mapInArrow(_matched, "sig long, hub long, fp long")
    member = _members(signed, matched)
    discard(signed)
    pairs = materialise(member.select(F.col("grp").alias("a"), F.col("fp").alias("b")).distinct(), "pairs")

    nodes = meta.filter("n > 0").groupBy("fp").agg(F.min("id").alias("rep"), F.min("tk").alias("tk"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes, "fp").select("fp", F.col("tk").alias("key"))
    wanted = materialise(wanted, "wanted")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordCodes()
        for batch in batches:
            sets = [_codes(x.as_py(), words, known) for x in batch.column(1)]
            # another text may have the same key
            keep = pa.array([_fingerprint(c) == fp for c, fp in zip(sets, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in sets], pa.int32()), batch.column(1)], ["fp", "n", "text"]).filter(keep)
        known.clear()
        trim()

    # texts move, not their codes: they shrink in a shuffle, and a code is as long as a word
    chosen = source.join(_sent(wanted), source.tk == wanted.key).select("fp", "text").dropDuplicates(["fp", "text"])
    texts = materialise(chosen.mapInArrow(checked, "fp long, n int, text binary"), "texts")

    links = _linked_pairs(pairs, texts, words, num, den, "links")
    roots = components(links, "classes")
    # what is left: members of one signature that the links with their hub leave in different classes
    open_ = _open(member, pairs, roots)
    if not open_.isEmpty():
        few, many = open_.filter(F.col("cross") <= CROSS * F.col("m")), open_.filter(F.col("cross") > CROSS * F.col("m"))
        aside = few.filter("root <> main").select("grp", F.col("fp").alias("a"), F.col("root").alias("ra"))
        listed = aside.join(few.select("grp", F.col("fp").alias("b"), F.col("root").alias("rb"), "main"), "grp").filter("ra <> rb and (rb = main or a < b)").select("a", "b").distinct()
        for known in (pairs, pairs.select(F.col("a").alias("b"), F.col("b").alias("a"))):
            listed = listed.join(known, ["a", "b"], "left_anti")
        listed = materialise(listed, "listed")
        units = _units(many.select("grp", "fp", "root", "m"))
        more = [_linked_pairs(listed, texts, words, num, den, "more"), _linked_blocks(units, texts, words, num, den)]
        whole = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more[0]).unionByName(more[1]), "whole")
        for x in (roots, listed, units, *more):
            discard(x)
        roots = whole
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    found = materialise(named.join(least, "root").select("fp", "root", "least"), "found")
    for x in (member, wanted, texts, pairs, links, open_, roots):
        discard(x)
    # a hot class is one row here and many in meta: AQE splits the skewed side of the join
    return meta.join(found, "fp", "left").select("id", "tk", "n", "root", "least")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Classes of documents joined by links of shingle Jaccard similarity at least num / den.

    Returns one row per input row: id, n_shingles (size of the set), component_id (smallest id
    reachable over links, itself included). Words are runs of bytes other than ASCII white
    space, A-Z in lower case; a text with fewer than ``words`` words is one shingle; null, empty
    or blank texts have no shingle, link to nothing and are their own class. Equal sets are one
    node from the start (rows that repeat an id share a class; rows without an id are compared and join
    others like any row, and a class of null ids only has a null class id). Other columns are left out.

    PartEnum: every node signs subsets of second-level parts within first-level parts of its size band's feature
    domain; nodes that share a signature are candidates, and no link is lost (codes are 64 bits). Signatures are
    grouped in their own task first, so that of a group of near copies only a hub for each buffer moves. Members are compared with
    their hub; then only members of one group that these links leave in different classes are compared with each
    other, as listed pairs where these are few for the group's size and by pairs of
    blocks of about BLOCK sets where they are many.
    """
    rows = row_classes(docs, id_col, text_col, words, num, den)
    return rows.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))
