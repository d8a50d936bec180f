"""From extracted records to one property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.enrich import pairs_within


def _bare(c):
    """Trimmed, without the quote at either end; what has both needs no pattern."""
    x = F.trim(c)
    quoted = F.startswith(x, F.lit('"')) & F.endswith(x, F.lit('"')) & (F.length(x) > 1)
    return F.trim(F.when(quoted, F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(F.regexp_replace(x, '^"|"$', "")))


def parse_records(chunks: DataFrame, tuple_mark: str = "<|>", record_mark: str = "##", end_mark: str = "<|COMPLETE|>", keywords: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entity mentions, relation mentions) from delimited text in ``content``.

    Entities need four fields, relations five; a last field that isn't a number gives weight 1.
    Names are cleaned and may not be empty.
    """
    # a filter isn't pushed below what explode or inline gives, so a record is split and a name cleaned once; other fields are worked out only where they are asked for
    inside = F.transform(T.split_at(F.col("content"), record_mark, end_mark), lambda x: F.regexp_extract(x, r"(?s)\((.*)\)", 1))
    f = chunks.select(F.col("chunk_id").alias("source_id"), F.explode(F.transform(inside, lambda x: T.split_at(x, tuple_mark))).alias("f"))
    field = lambda i: _bare(F.get("f", F.lit(i)))
    kind = F.lower(field(0))
    named = lambda **names: F.inline(F.array(F.struct(*[T.clean(F.col(c)).alias(name) for name, c in names.items()])))
    e = f.filter((kind == "entity") & (F.size("f") >= 4)).select("source_id", "f", field(1).alias("a")).select("source_id", "f", named(entity_name="a")).filter("entity_name <> ''")
    r = f.filter((kind == "relationship") & (F.size("f") >= 5)).select("source_id", "f", field(1).alias("a"), field(2).alias("b"))
    r = r.select("source_id", "f", named(src_id="a", tgt_id="b")).filter("src_id <> '' and tgt_id <> ''")
    last = _bare(F.element_at("f", -1))
    weight = F.coalesce(F.when(T.is_number(last), last.try_cast("double")), F.lit(1.0))
    return (
        e.select("entity_name", T.clean(field(2)).alias("entity_type"), field(3).alias("description"), "source_id"),
        r.select("src_id", "tgt_id", F.lit("").alias("relation_name"), field(3).alias("description"), (field(4) if keywords else F.lit("")).alias("keywords"), weight.alias("weight"), "source_id"))


def triples_to_edges(triples: DataFrame) -> DataFrame:
    """Rows (head, relation, tail, source_id) to relation mentions of weight 1; a triple with an empty cleaned part goes."""
    t = triples.select(T.clean(F.col("head")).alias("src_id"), T.clean(F.col("relation")).alias("relation_name"), T.clean(F.col("tail")).alias("tgt_id"), "source_id")
    return t.filter("src_id <> '' and relation_name <> '' and tgt_id <> ''").select("src_id", "tgt_id", "relation_name", F.lit("").alias("description"), F.lit("").alias("keywords"), F.lit(1.0).alias("weight"), "source_id")


def _united(parts: DataFrame) -> DataFrame:
    """Rows (entity_name, entity_type, descriptions, source_ids, n) to one per name; rows are moved once, by name."""
    all_of = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    typed = parts.repartition("entity_name").groupBy("entity_name", "entity_type").agg(F.sum("n").alias("n"), all_of("descriptions").alias("descriptions"), all_of("source_ids").alias("source_ids"))
    out = typed.groupBy("entity_name").agg(F.min_by("entity_type", F.struct(-F.col("n"), F.col("entity_type"))).alias("entity_type"), all_of("descriptions").alias("d"), all_of("source_ids").alias("s"))
    text = F.array_join(F.array_sort(F.filter("d", lambda x: x != "")), T.SEP)
    return out.select("entity_name", "entity_type", text.alias("description"), F.array_sort(F.filter("s", lambda x: x.isNotNull())).alias("source_ids"))


def _mentioned(mentions: DataFrame) -> DataFrame:
    return mentions.select("entity_name", "entity_type", F.array("description").alias("descriptions"), F.array("source_id").alias("source_ids"), F.lit(1).cast("long").alias("n"))


def merge_nodes(mentions: DataFrame) -> DataFrame:
    """One row per name: the most frequent type (the least of equals), distinct descriptions and sources.

    Mentions are taken together by (name, type) first, so a name met everywhere costs no more than its distinct values.
    """
    return _united(_mentioned(mentions))


def _paired(mentions: DataFrame) -> DataFrame:
    return mentions.withColumns({"src": F.least("src_id", "tgt_id"), "tgt": F.greatest("src_id", "tgt_id")})


def _distinct_text(c: str):
    lists = F.col("m")[c]
    return F.when(F.size("m") == 1, F.coalesce(lists[0], F.lit(""))).otherwise(F.array_join(F.sort_array(F.array_distinct(F.array_remove(lists, ""))), T.SEP))


def merge_edges(mentions: DataFrame) -> DataFrame:
    """One row per unordered pair: summed weight, distinct relations, descriptions, keywords and sources.

    Mentions are moved once, by pair. Most pairs have few, so what a pair gathers is one list, made distinct afterwards, instead of a set a column.
    """
    texts = ("relation_name", "description", "keywords")
    rows = _paired(mentions).select("src", "tgt", "weight", F.struct(*texts, "source_id").alias("m")).repartition("src", "tgt")
    per = rows.groupBy("src", "tgt").agg(F.sum("weight").alias("weight"), F.collect_list("m").alias("m"))
    sources = F.sort_array(F.array_distinct(F.array_compact(F.col("m")["source_id"])))
    return per.select("src", "tgt", "weight", *[_distinct_text(c).alias(c) for c in texts], sources.alias("source_ids"))


def _lacking(ends: DataFrame, names: DataFrame) -> DataFrame:
    """Of the ends (entity_name, source_id) those not among ``names``, as nodes with empty type and description.

    Ends are moved once, by name; names are taken once each and looked up where the ends lie, so neither goes to the driver or is sorted.
    """
    new = ends.join(names.select("entity_name").distinct().hint("shuffle_hash"), "entity_name", "left_anti")
    return new.groupBy("entity_name").agg(F.sort_array(F.collect_set("source_id")).alias("source_ids")).select("entity_name", F.lit("").alias("entity_type"), F.lit("").alias("description"), "source_ids")


def missing_ends(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """What :func:`backfill` adds to the merged nodes, from the mentions themselves: nothing need be merged to know it."""
    return _lacking(relations.select(F.explode(F.array("src_id", "tgt_id")).alias("entity_name"), "source_id"), entities)


def backfill(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes plus the ends of edges that lack one, with empty type and description and the edges' sources."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("entity_name"), "source_ids").select("entity_name", F.explode_outer("source_ids").alias("source_id"))
    return nodes.unionByName(_lacking(ends, nodes))


def upsert_nodes(old: DataFrame, mentions: DataFrame) -> DataFrame:
    """Merge new mentions into merged nodes: the old type counts once, descriptions and sources are united."""
    had = old.select("entity_name", "entity_type", F.split("description", T.SEP).alias("descriptions"), F.coalesce("source_ids", F.array().cast(dict(old.dtypes)["source_ids"])).alias("source_ids"), F.lit(1).cast("long").alias("n"))
    return _united(had.unionByName(_mentioned(mentions)))


def upsert_edges(old: DataFrame, mentions: DataFrame) -> DataFrame:
    """Merge new relation mentions into merged edges: weights add up, relations, descriptions, keywords and sources are united.

    Only pairs that ``mentions`` names are merged again; all other rows of ``old`` pass through as they are. A mention of a source the pair
    already has is a repeat of a batch and counts for nothing.
    """
    texts = ("relation_name", "description", "keywords")
    pair, row = ("src", "tgt"), ("weight", *texts, "source_ids")
    kind = dict(old.dtypes)["source_ids"]
    held = old.select(*pair, F.lit(True).alias("had"), *row)
    new = _paired(mentions).select(*pair, F.lit(False).alias("had"), "weight", *texts, F.array("source_id").cast(kind).alias("source_ids"))
    # rows and mentions are moved once, by pair; all below is within a partition
    each = held.unionByName(new).repartition(*pair).select(*pair, "had", *row, F.posexplode_outer("source_ids").alias("at", "source_id"))
    each = each.select(*pair, "had", "source_id", F.when(~F.col("had"), F.struct(*row[:-1])).alias("m"), F.when(F.col("had") & (F.coalesce("at", F.lit(0)) == 0), F.struct(*row)).alias("row"))
    each = each.groupBy(*pair, "source_id").agg(
        F.max(F.col("had") & F.col("source_id").isNotNull()).alias("known"), F.collect_list("row").alias("rows"), F.count("m").alias("n"), F.sum("m.weight").alias("weight"),
        *[F.collect_set(f"m.{c}").alias(c) for c in texts])
    fresh = lambda c: F.when(~F.col("known") & (F.col("n") > 0), c)
    all_of = lambda c: F.flatten(F.collect_list(c))
    out = each.groupBy(*pair).agg(
        all_of("rows").alias("rows"), F.sum("n").alias("n"), F.sum(fresh(F.col("weight"))).alias("weight"), all_of(fresh(F.array("source_id"))).alias("source_ids"), *[all_of(fresh(F.col(c))).alias(c) for c in texts])
    weights = F.array_compact(F.concat(F.col("rows")["weight"], F.array("weight")))
    weight = F.when(F.size(weights) > 0, F.aggregate(weights, F.lit(0.0), lambda s, x: s + x.cast("double")))
    parts = lambda c: F.filter(F.flatten(F.transform(F.array_compact(F.concat(F.col("rows")[c], F.col(c))), lambda x: F.split(x, T.SEP))), lambda x: x != "")
    sources = F.array_sort(F.array_distinct(F.concat(F.flatten(F.array_compact(F.col("rows")["source_ids"])), "source_ids")))
    merged = F.struct(weight.cast(dict(old.dtypes)["weight"]).alias("weight"), *[F.array_join(F.array_sort(F.array_distinct(parts(c))), T.SEP).alias(c) for c in texts], sources.alias("source_ids"))
    return out.select(*pair, F.inline(F.when(F.col("n") > 0, F.array(merged)).otherwise(F.col("rows"))))


def summarise_long(nodes: DataFrame, limit: int, summary) -> DataFrame:
    """Descriptions of ``limit`` words or more pass through ``summary`` (a column function), others stay."""
    return nodes.withColumn("description", F.when(F.size(T.words(F.col("description"))) >= limit, summary(F.col("description"))).otherwise(F.col("description")))


def passage_links(mentions: DataFrame, least: float = 0.0) -> DataFrame:
    """Edges of chunks that mention a common title: src, tgt, relation (the least such title), source_id (both chunks).

    ``mentions`` has chunk_id, term and prior, the probability that the term's title is meant; mentions of no more than ``least``, and
    empty terms, don't count. Every pair of a title's chunks is an edge, so a title in a share of all chunks has as
    many edges as that share's square: choose ``least`` so that only telling titles are left. The pairs of one title are dealt to many tasks.
    """
    m = mentions.filter((F.col("term") != "") & (F.col("prior") > least)).select("chunk_id", "term").distinct()
    pair = pairs_within(m, "term", "chunk_id").withColumnsRenamed({"a": "src", "b": "tgt"})
    return pair.groupBy("src", "tgt").agg(F.min("term").alias("relation")).withColumn("source_id", F.concat_ws(T.SEP, F.col("src").cast("string"), F.col("tgt").cast("string")))


def extract_graph(chunks: DataFrame, keywords: bool = False, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse and merge chunks; those whose ids ``done`` holds are skipped, so a build can go on after a failure."""
    left = chunks.join(done, "chunk_id", "left_anti") if done is not None else chunks
    e, r = parse_records(left, keywords=keywords)
    edges = merge_edges(r)
    return backfill(merge_nodes(e), edges), edges


def first_source(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key in the given order."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
