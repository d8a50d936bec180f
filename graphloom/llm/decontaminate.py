"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: which word positions a seed keeps; each mask starts with two kept ones
MASKS = ("11101011", "1101100111", "110010110101")
WINDOW = 24
BROADCAST_WORDS = 1_000_000  # words of all different test items up to which their seeds (3 a word) are broadcast


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null or for a text without them."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _seed(mask: str, words: Column, at: Column) -> Column:
    kept = [F.get(words, at + i) for i, c in enumerate(mask) if c == "1"]
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(mask), *kept))


def _start(window: str) -> Column:
    """Where an item's window begins around a seed."""
    return F.greatest(F.lit(0), F.least(F.expr(f"j + span div 2 - {WINDOW // 2}"), F.col("n") - F.col(window)))


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Of ``docs`` (id, text) and ``items`` (t, own), where t names a list of words: id, t, from, matched, window of each pair that shares a passage."""
    words = items.agg(F.sum(F.size("own"))).first()[0] or 0
    small, few = words <= BROADCAST_WORDS, words <= 2 * BROADCAST_WORDS
    least = min(map(len, MASKS))

    def positions(df: DataFrame, words: str, at: str) -> DataFrame:
        return df.filter(F.size(words) >= least).withColumn(at, F.explode(F.sequence(F.lit(0), F.size(words) - least)))

    def pair(words: str, at: str) -> Column:
        return F.xxhash64(F.get(F.col(words), F.col(at)), F.get(F.col(words), F.col(at) + 1))

    placed = positions(items, "own", "j")
    shapes = F.explode(F.array(*[F.struct(F.lit(len(m)).alias("span"), _seed(m, F.col("own"), F.col("j")).alias("seed")) for m in MASKS]))
    seeds = placed.select("t", F.size("own").alias("n"), "j", shapes.alias("s")).select("t", "n", "j", "s.span", "s.seed").filter("seed is not null").distinct()
    seeds = seeds.withColumn("window", F.least(F.lit(WINDOW), F.col("n"))).select("seed", "t", "j", "window", _start("window").alias("a"))

    near = positions(docs.select("id", words_of(F.col("text")).alias("words"), F.xxhash64("text").alias("r")), "words", "p")
    if few:
        pairs = placed.select(pair("own", "j").alias("pair")).distinct()
        near = near.withColumn("pair", pair("words", "p")).join(F.broadcast(pairs), "pair", "left_semi")
    tried = F.explode(F.array(*[_seed(m, F.col("words"), F.col("p")) for m in MASKS])).alias("seed")
    at = (F.col("p") - F.col("j") + F.col("a")).alias("from")
    want = F.slice("own", F.col("a") + 1, F.col("window")).alias("want")
    if small:
        hits = near.select("id", "words", "p", tried).filter("seed is not null").join(F.broadcast(seeds), "seed").join(F.broadcast(items), "t").select("id", "t", "words", want, "window", at)
    else:
        # places go without their document's words; these come to what is left once more
        hits = near.select("id", "r", "p", tried).filter("seed is not null").join(seeds.hint("merge"), "seed").select("id", "r", "t", "window", "a", at).distinct()
        hits = hits.join(items.hint("merge"), "t").select(F.col("id").alias("_id"), F.col("r").alias("_r"), "t", want, "window", "from")
        own = docs.select("id", F.xxhash64("text").alias("r"), words_of(F.col("text")).alias("words"))
        own = own.join(hits.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("r") == F.col("_r")))
        hits = own.select("id", "t", "words", "want", "window", "from")

    lead = F.greatest(F.lit(0), -F.col("from"))
    length = F.greatest(F.lit(0), F.col("window") - lead)
    same = F.zip_with(F.slice("want", lead + 1, length), F.slice("words", F.col("from") + lead + 1, length), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    scored = hits.select("id", "t", "window", "from", F.aggregate(same, F.lit(0), lambda s, x: s + x).alias("matched"))
    return scored.filter("5 * matched >= 4 * window").groupBy("id", "t").agg(F.min("from").alias("from"), F.max("matched").alias("matched"), F.max("window").alias("window"))


def _sides(docs: DataFrame, tests: DataFrame, id_col: str, text_col: str, test_id: str, test_text: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`_found` tells of the texts, and (t, item) of the items that have them; items of equal words are compared once."""
    own = tests.select(F.col(test_id).alias("item"), words_of(F.col(test_text)).alias("own")).filter("item is not null").withColumn("t", F.md5(F.array_join("own", " ")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _found(rows, own.groupBy("t").agg(F.any_value("own").alias("own"))), own.select("t", "item").distinct()


def contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", test_id: str = "item_id", test_text: str = "text") -> DataFrame:
    """Documents that hold a passage of a test item, substitutions allowed: a row for each (document, item).

    Seeds are hashes of the words that a fixed mask keeps, so words under its gaps may differ. A
    seed shared by a document and an item aligns them; around it, a window of the item (24 words,
    the whole item if shorter) is compared with the document word by word, and at least four
    fifths must be equal. Returns id, item, first_word (0-based place in the document of the
    first such window, negative if it starts before the text), matched (most equal words in a
    window), window (its words) and similarity. Items shorter than the shortest mask (8 words), and null or empty
    texts on either side, match nothing; rows that repeat an id count as one; null ids too.

    Items of equal words count as one until the end. Each position is tested by its word pair first, as all masks keep the first two words, and
    only pairs of the benchmark go on. The benchmark is broadcast up to ``BROADCAST_WORDS`` words of different items, which are
    counted; beyond, positions and seeds meet by a shuffle, without their words, and beyond twice as many all positions are tried.
    """
    found, items = _sides(docs, tests, id_col, text_col, test_id, test_text)
    out = found.join(items, "t").groupBy("id", "item").agg(F.min("from").alias("first_word"), F.max("matched").alias("matched"), F.max("window").alias("window"))
    return out.select(
        F.col("id").alias(id_col), F.col("item").alias(test_id), F.col("first_word").cast("long"), F.col("matched").cast("long"), F.col("window").cast("long"),
        F.round(F.col("matched") / F.col("window"), 6).alias("similarity"))


def decontaminate(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", test_id: str = "item_id", test_text: str = "text") -> DataFrame:
    """``docs``, in all its columns, without the rows whose id :func:`contaminated` returns; null ids stay."""
    bad = _sides(docs, tests, id_col, text_col, test_id, test_text)[0].select(F.col("id").alias("_bad")).distinct()
    return docs.join(bad, docs[id_col] == bad["_bad"], "left_anti")
