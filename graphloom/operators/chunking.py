"""Chunkers: column expressions or one pandas pass per batch, and lookups of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T

# The marks after which the separator chunker cuts.
SEPARATORS = ("\n\n", "\r\n\r\n", "\n", "\r\n", "。", "．", ".", "！", "!", "？", "?", " ", "\t", "　", "​")


def by_tokens(docs: DataFrame, size: int = 1200, overlap: int = 100) -> DataFrame:
    """Windows of white-space tokens that start at 0, step, 2 step ...: doc_id, idx (within the document), tokens, content.

    step = size - overlap; the last windows may be short. Blank texts give no window.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    w = docs.select("doc_id", T.words(F.coalesce(F.col("text"), F.lit(""))).alias("w")).filter(F.size("w") > 0)
    at = w.select("doc_id", "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("idx", "start"))
    part = F.slice("w", F.col("start") + 1, size)
    return at.select("doc_id", F.col("idx").cast("long").alias("idx"), F.size(part).cast("long").alias("tokens"), F.array_join(part, " ").alias("content"))


def with_global_index(chunks: DataFrame) -> DataFrame:
    """``index`` over all chunks in the order of (doc_id, idx): offsets per document from its own count, summed over ranges."""
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    ranged = per.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    from graphloom.lineage import cut

    ranged = cut(ranged)
    totals = ranged.groupBy("part").agg(F.sum("n").alias("t"))
    before = totals.select("part", F.coalesce(F.sum("t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + inside).alias("first"))
    return chunks.join(starts, "doc_id").withColumn("index", F.col("first") + F.col("idx")).drop("first")


def _merge(text: str, size: int, overlap: int) -> list[str]:
    """Cut after separators, join greedily up to size tokens, carry the last tokens over; an oversized piece is cut into windows."""
    import regex

    pattern = "|".join(regex.escape(s) for s in sorted(SEPARATORS, key=len, reverse=True))
    pieces = [x for x in regex.split(rf"(?<={pattern})", text) if x]
    out, held, count = [], "", 0
    for p in pieces:
        n = len(p.split())
        if n > size:
            if held.strip():
                out.append(held)
            words = p.split()
            out += [" ".join(words[i : i + size]) for i in range(0, len(words), max(1, size - overlap))]
            held, count = "", 0
        elif count + n > size:
            out.append(held)
            tail = held.split()[-overlap:] if overlap else []
            while tail and len(tail) + n > size:
                tail.pop(0)
            held, count = (" ".join(tail) + " " if tail else "") + p, len(tail) + n
        else:
            held, count = held + p, count + n
    if held.strip():
        out.append(held)
    return [x.strip() for x in out]


def by_separators(docs: DataFrame, size: int = 1200, overlap: int = 100) -> DataFrame:
    """Greedy chunks at separators: doc_id, idx, tokens, content; no word is lost (an oversized piece is cut again)."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [(d, i, len(c.split()), c) for d, t in zip(batch["doc_id"], batch["text"], strict=True) if isinstance(t, str) for i, c in enumerate(_merge(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "tokens", "content"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, idx long, tokens long, content string")


def by_characters(docs: DataFrame, budget: int, per_token: int = 4) -> DataFrame:
    """Windows of budget x per_token characters: doc_id, idx, content."""
    size = budget * per_token
    at = docs.filter(F.length("text") > 0).select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(size))).alias("idx", "start"))
    return at.select("doc_id", F.col("idx").cast("long").alias("idx"), F.expr(f"substring(text, start + 1, {size})").alias("content"))


def whole_documents(docs: DataFrame) -> DataFrame:
    """One chunk a document: chunk_<doc_id>, tokens by white space."""
    return docs.select(F.concat(F.lit("chunk_"), F.col("doc_id").cast("string")).alias("chunk_id"), "doc_id", F.col("text").alias("content"), F.size(T.words(F.coalesce("text", F.lit("")))).cast("long").alias("tokens"))


def with_content_ids(chunks: DataFrame) -> DataFrame:
    """chunk_id from the content's md5; of equal contents the one with the largest doc_id and idx stays. Blank ones go."""
    keyed = chunks.filter(F.trim("content") != "").withColumn("chunk_id", T.content_id("chunk-", F.col("content")))
    best = keyed.groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in keyed.columns if c != "chunk_id"]), F.struct("doc_id", "idx")).alias("r"))
    return best.select("chunk_id", "r.*")


METHODS: dict[str, Callable[..., DataFrame]] = {"chunking_by_token_size": by_tokens, "chunking_by_separators": by_separators, "chunking_by_characters": by_characters}


def register(name: str, method: Callable[..., DataFrame]) -> None:
    METHODS[name] = method


def chunk(docs: DataFrame, method: str = "chunking_by_token_size", **options) -> DataFrame:
    return METHODS[method](docs, **options)


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids, "chunk_id", "left_semi")


def missing_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids that no chunk has."""
    return ids.join(chunks, "chunk_id", "left_anti")


def texts(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """(chunk_id, content, found) for every id asked for."""
    return ids.distinct().join(chunks.select("chunk_id", "content", F.lit(True).alias("found")), "chunk_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def merged(chunks: DataFrame, key: Column) -> DataFrame:
    """Contents joined per key in the order of chunk ids."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_id", "content")))
    return chunks.groupBy(key.alias("key")).agg(F.array_join(F.transform(rows, lambda r: r["content"]), "\n").alias("content"))
