"""Exact duplicates by Patricia tries: every text's full bytes are inserted, and the node where it ends knows its owner."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import bound_batches, materialise, trim

#: bytes of labels, nodes and ids that the tries of one task may hold before subtrees leave it
HELD = 48 << 20
#: tries for each length, by content hash
SLOTS = 16
#: bytes that a node costs beside its label
NODE = 400


class Node:
    __slots__ = ("children", "end", "label")

    def __init__(self, label: bytes):
        self.label, self.children, self.end = label, {}, None


class Subtree:
    """One length-and-content-hash partition: a compressed radix trie over whole byte strings of one length."""

    __slots__ = ("bytes", "root", "rows")

    def __init__(self):
        self.root, self.bytes, self.rows = Node(b""), NODE, 0

    def reach(self, text: bytes) -> Node:
        """The node at which ``text`` ends, made where there is none."""
        node, at, n = self.root, 0, len(text)
        while at < n:
            child = node.children.get(text[at])
            if child is None:
                leaf = node.children[text[at]] = Node(text[at:])
                self.bytes += n - at + NODE
                return leaf
            if not text.startswith(child.label, at):
                child = self._split(node, child, text, at)
            node, at = child, at + len(child.label)
        return node

    def _split(self, node: Node, child: Node, text: bytes, at: int) -> Node:
        """A node for what ``child``'s label and the rest of ``text`` share, between ``node`` and ``child``."""
        label, low, high = child.label, 1, min(len(child.label), len(text) - at)
        while low < high:  # the longest shared start, compared in halves
            half = (low + high + 1) // 2
            low, high = (half, high) if text.startswith(label[low:half], at + low) else (low, half - 1)
        shared = node.children[label[0]] = Node(label[:low])
        child.label = label[low:]
        shared.children[child.label[0]] = child
        self.bytes += NODE
        return shared

    def ends(self) -> Iterator[tuple[bytes, object]]:
        """All texts with what their last nodes hold."""
        open_nodes = [(self.root, b"")]
        while open_nodes:
            node, before = open_nodes.pop()
            text = before + node.label
            if node.end is not None:
                yield text, node.end
            open_nodes += [(c, text) for c in node.children.values()]


class Tries:
    """The subtrees of one task, by length and content hash, within a bound of bytes."""

    def __init__(self):
        self.parts: dict[tuple[int, int], Subtree] = {}
        self.bytes = 0

    def reach(self, text: bytes, code: int, more: int) -> Node:
        """``more``: bytes that the caller is about to hang on the node."""
        part = self.parts.get((len(text), code % SLOTS))
        if part is None:
            part = self.parts[len(text), code % SLOTS] = Subtree()
            self.bytes += NODE
        before = part.bytes
        node = part.reach(text)
        part.rows += 1
        part.bytes += more
        self.bytes += part.bytes - before
        return node

    def spill(self, down_to: int) -> Iterator[tuple[bytes, object]]:
        """Whole subtrees leave, those with the most bytes a row first: where there are many copies, tries save most."""
        for key in sorted(self.parts, key=lambda k: self.parts[k].rows / self.parts[k].bytes):
            if self.bytes <= down_to:
                return
            part = self.parts.pop(key)
            self.bytes -= part.bytes
            yield from part.ends()


def _better(a: int | None, b: int | None, largest: bool) -> bool:
    """Whether ``a`` owns rather than ``b``; an id before none."""
    if a is None or b is None:
        return b is None and a is not None
    return a > b if largest else a < b


_RECORD = pa.schema([("n", pa.int64()), ("code", pa.int64()), ("text", pa.binary()), ("sha", pa.string()), ("best", pa.int64()), ("ids", pa.list_(pa.int64()))])
_OWNED = pa.schema([("record", pa.int64()), ("owner", pa.int64()), ("size", pa.int64()), ("holds", pa.bool_())])


def _records(found: Iterator, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A record for each text: the owner's id comes first among its ids."""
    rows, held = [], 0
    for text, ids in found:
        rows.append((len(text), xxhash.xxh3_64_intdigest(text) - (1 << 63), text, hashlib.sha256(text).hexdigest(), ids[0], ids))
        held += len(text) + 8 * len(ids)
        if held > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORD.types)], schema=_RECORD)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORD.types)], schema=_RECORD)


def _gather(largest: bool, held: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = Tries()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                node = tries.reach(text, xxhash.xxh3_64_intdigest(text), 16)
                if node.end is None:
                    node.end = [i]
                else:
                    node.end.append(i)
                    if _better(i, node.end[0], largest):
                        node.end[0], node.end[-1] = i, node.end[0]
                if tries.bytes > held:
                    yield from _records(tries.spill(held // 2))
        yield from _records(tries.spill(-1))
        trim()

    return gather


def _merge(largest: bool, held: int):
    def owned(found: Iterator) -> pa.RecordBatch:
        rows = [(r, owner, size, r == first) for _, (owner, first, size, records) in found for r in records]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, _OWNED.types)], schema=_OWNED)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, last = Tries(), None
        for batch in batches:
            for record, n, code, text, best, rows in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (n, code) != last and tries.bytes > held:  # in order of (n, code): the subtrees held are complete
                    yield owned(tries.spill(-1))
                last = n, code
                node = tries.reach(text, code, 48)
                if node.end is None:
                    node.end = [best, record, rows, [record]]
                    continue
                end = node.end
                if _better(best, end[0], largest) or (best == end[0] and record < end[1]):
                    end[0], end[1] = best, record
                end[2] += rows
                end[3].append(record)
        yield owned(tries.spill(-1))
        trim()

    return merge


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text: Column | None = None, keep: str = "smallest", held: int = HELD) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their whole texts are, byte for byte, after ``text`` (a string column over ``docs``; the text itself
    where none is given). Null counts as the empty text. Of equal rows the one with the smallest (``keep="largest"``: largest)
    id stays; a row without an id stays only if no equal row has one, keep_id is then null. Of rows equal in text and id just
    one has ``kept``. Ids are whole numbers; other columns of ``docs``, whatever their names, are left out; no rows give no rows.

    Each task inserts its texts into its own tries first, so that copies meet before anything is moved; beyond ``held`` bytes
    whole subtrees leave as records, which loses nothing, as records of one text meet again. The records are dealt out by
    length and content hash, in that order within a task, inserted whole into tries that are emptied whenever a bound is
    passed and all records of a text are in. A text that a third of all rows share comes as one record a task; the ids of its rows never move to one
    place, as each record's rows get the owner by the record's number.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    largest = {"largest": True, "smallest": False}[keep]
    whole = F.coalesce(F.col(text_col) if text is None else text, F.lit("")).cast("binary")
    light = docs.select(F.col(id_col).cast("long").alias("id"), whole.alias("text"))
    found = light.mapInArrow(_gather(largest, held), "n long, code long, text binary, sha string, best long, ids array<long>")
    # written once: a record's number, which brings its rows together with their owner, holds for one run only
    records = materialise(found.withColumn("record", F.monotonically_increasing_id()), "texts")
    dealt = records.select("record", "n", "code", "text", "best", F.size("ids").cast("long").alias("rows")).repartition("n", "code").sortWithinPartitions("n", "code")
    owners = dealt.mapInArrow(_merge(largest, held), "record long, owner long, size long, holds boolean")
    rows = records.select("record", "sha", "ids").join(owners, "record").select("owner", "size", "holds", "sha", F.posexplode("ids").alias("place", "id"))
    return rows.select(
        F.col("id").alias(id_col), F.col("owner").alias("keep_id"), F.col("size").alias("group_size"), (F.col("holds") & (F.col("place") == 0)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text: Column | None = None, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all their columns; of rows equal in text and id any one stays."""
    whole = F.coalesce(F.col(text_col) if text is None else text, F.lit(""))
    sha, key = f"sha{uuid.uuid4().hex}", f"id{uuid.uuid4().hex}"
    kept = exact_groups(docs, id_col, text_col, text, keep).filter("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias("sha"))
    rows = docs.withColumn(sha, F.sha2(whole, 256))
    stay = rows.join(kept, (rows[sha] == kept["sha"]) & rows[id_col].cast("long").eqNullSafe(kept[key]), "left_semi")
    return stay.dropDuplicates([id_col, sha]).drop(sha)
