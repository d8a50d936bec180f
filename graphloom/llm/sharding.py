"""Contiguous shards of near-equal bytes from prefix sums of per-partition totals. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.shared import discard, materialise

#: rows of equal texts from which on a group's first id is broadcast, so that its rows needn't meet; such groups are at most rows / HOT
HOT = 100_000
#: groups of equal texts of up to a share's hundredth are never cut apart
WHOLE = 100


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """first (the least id of the rows with an equal text), id, size, crc."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    light = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"), F.md5(text).alias("digest"))
    same = ["digest", "size"]
    groups = light.groupBy(same).agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    hot = F.broadcast(groups.filter(F.col("n") > HOT).drop("n"))
    cold = light.join(hot.drop("first"), same, "left_anti").join(groups.filter(F.col("n") <= HOT).drop("n"), same, "left")
    return light.join(hot, same).unionByName(cold).select(F.coalesce("first", "id").alias("first"), "id", "size", "crc")


def _alone(placed: DataFrame, total: int, shards: int) -> tuple[list[tuple[int, int]], int]:
    """(place, size) of the rows that are larger than an equal share of what is left beside them, largest first, and the bytes left."""
    out = []
    for row in placed.select("place", "size").orderBy(F.desc("size"), "place").limit(shards - 1).collect():
        if row["size"] * (shards - len(out)) <= total:
            break
        out.append((row["place"], row["size"]))
        total -= row["size"]
    return out, total


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row into one of ``shards`` contiguous shards of near-equal size, in order of id, rows of equal texts at the first of them.

    Size is the text's UTF-8 length plus 1 (null and empty: 1, equal texts). A row goes to the shard that
    holds the middle of its bytes, so a shard's size differs from an equal share by at most one
    row's; a group of equal texts that a cut would part goes whole where its middle lies, if it has no more than a hundredth of a share;
    larger ones are cut, as equal sizes are the law. A row larger than an equal share of what is left beside it
    has a shard of its own, from the last down; the others share the rest alike. Law "bytes": a row's place depends on all sizes, so
    ``grown_shard`` is null. Rows are ordered by (the least id of the rows with an equal text, id, size, crc32), null ids first;
    rows equal in all of them are interchangeable. An empty table gives no rows. Other columns are left out.

    Texts aren't shuffled, only their digests. To the driver come up to a row for each shard; the
    only table without a partition key is the one of totals, a row a partition.
    """
    # written once, as a partition's number holds for one run of the shuffle only
    order = ["first", "id", "size", "crc"]
    ranged = materialise(_grouped(docs, id_col, text_col).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # offsets has one row for each shuffle partition, whatever the number of documents
    placed = materialise(ranged.join(F.broadcast(offsets), "part").select(
        *order, (F.col("bytes_before") + F.sum("size").over(inside)).alias("upto"), (F.col("rows_before") + F.row_number().over(inside) - 1).alias("place")), "placed")
    alone, total = _alone(placed, placed.agg(F.sum("size")).first()[0] or 0, shards)
    discard(ranged)
    shares, twice = shards - len(alone), 2 * max(total, 1)

    def less(value, i):  # what the rows with shards of their own add before a row
        return sum((F.when(F.col("place") > one[0], one[1] if i else 1).otherwise(0) for one in alone), F.lit(0)) * -1 + value

    own = F.coalesce(*[F.when(F.col("place") == place, shards - 1 - i) for i, (place, _) in enumerate(alone)], F.lit(None).cast("int"))
    rows = placed.select("first", "id", "size", "crc", own.alias("own"), less(F.col("upto"), 1).alias("upto"), less(F.col("place"), 0).alias("place"))
    cut = rows.withColumn("shard", F.coalesce("own", F.expr(f"cast((2 * upto - size) * {shares} div {twice} as int)")))
    # groups over a cut: at most one for each cut
    ends = cut.filter("own is null").groupBy("shard").agg(F.min_by("first", "place").alias("low"), F.max_by("first", "place").alias("high")).orderBy("shard").collect()
    parted = [a["high"] for a, b in zip(ends, ends[1:], strict=False) if a["high"] is not None and a["high"] == b["low"]]
    moved = {}
    if parted:
        found = cut.filter(F.col("own").isNull() & F.col("first").isin(parted)).groupBy("first").agg(F.sum("size").alias("bytes"), F.min(F.col("upto") - F.col("size")).alias("start"))
        moved = {r["first"]: (2 * r["start"] + r["bytes"]) * shares // twice for r in found.collect() if WHOLE * r["bytes"] * shares <= total}
    whole = F.coalesce(*[F.when(F.col("first") == key, shard) for key, shard in moved.items()], F.lit(None).cast("int"))
    cut = cut.withColumn("shard", F.coalesce("own", whole, "shard"))
    first = cut.filter("own is null").groupBy("shard").agg(F.min("place").alias("at"))
    return cut.join(F.broadcast(first), "shard", "left").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.when(F.col("own").isNotNull(), 0).otherwise(F.col("place") - F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
