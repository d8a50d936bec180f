"""The star schema as a graph: suppliers, customers, parts, nations and regions, tied by order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(kind: str, c: str):
    return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


def nodes(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("supplier", "customer", "part", "nation", "region")) -> DataFrame:
    """entity_name, entity_type, description."""
    text = {
        "supplier": ("s_suppkey", F.col("s_name")), "customer": ("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment")), "part": ("p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type")),
        "nation": ("n_nationkey", F.col("n_name")), "region": ("r_regionkey", F.col("r_name")),
    }
    out = None
    for k in kinds:
        key, description = text[k]
        one = table(spark, sf_dir, k).select(_key(k, key).alias("entity_name"), F.lit(k).alias("entity_type"), description.alias("description"))
        out = one if out is None else out.unionByName(one)
    return out


def _edge(a, b):
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("tgt")]


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers in nations, nations in regions: src, tgt, relation, weight."""
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    parts = [
        c.select(*_edge(_key("customer", "c_custkey"), _key("nation", "c_nationkey")), F.lit("located_in").alias("relation")),
        s.select(*_edge(_key("supplier", "s_suppkey"), _key("nation", "s_nationkey")), F.lit("located_in").alias("relation")),
        n.select(*_edge(_key("nation", "n_nationkey"), _key("region", "n_regionkey")), F.lit("in_region").alias("relation"))]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("weight", F.lit(1.0))


def trade_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line and relation, before merging: src, tgt, relation, chunk_id."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")  # noqa: E741
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sold = l.select(*_edge(_key("supplier", "l_suppkey"), _key("part", "l_partkey")), F.lit("supplies").alias("relation"), _key("order", "l_orderkey").alias("chunk_id"))
    bought = l.join(o, l.l_orderkey == o.o_orderkey).select(*_edge(_key("customer", "o_custkey"), _key("part", "l_partkey")), F.lit("bought").alias("relation"), _key("order", "l_orderkey").alias("chunk_id"))
    return sold.union(bought)


def trade_edges(spark: SparkSession, sf_dir: str, sources: bool = False) -> DataFrame:
    """Merged supply and purchase edges: weight is the number of order lines. Lines are merged by their keys, which are narrower than names."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")  # noqa: E741
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    aggs = [F.count("*").cast("double").alias("weight")]
    if sources:
        aggs.append(F.collect_set("l_orderkey").alias("source_ids"))

    def merged(lines: DataFrame, kind: str, c: str, relation: str) -> DataFrame:
        named = [F.array_sort(F.transform("source_ids", lambda k: F.concat(F.lit("order:"), k.cast("string")))).alias("source_ids")] if sources else []
        return lines.groupBy(c, "l_partkey").agg(*aggs).select(*_edge(_key(kind, c), _key("part", "l_partkey")), F.lit(relation).alias("relation"), "weight", *named)

    return merged(l, "supplier", "l_suppkey", "supplies").union(merged(l.join(o, l.l_orderkey == o.o_orderkey), "customer", "o_custkey", "bought"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_edges(spark, sf_dir).unionByName(place_edges(spark, sf_dir))


def chunk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (chunk_id, entity_name): the parts an order mentions."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(_key("order", "l_orderkey").alias("chunk_id"), _key("part", "l_partkey").alias("entity_name")).distinct()


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per order: chunk_id, doc_id (customer), content, tokens."""
    o = table(spark, sf_dir, "orders")
    content = F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    return o.select(_key("order", "o_orderkey").alias("chunk_id"), _key("customer", "o_custkey").alias("doc_id"), content.alias("content")).withColumn("tokens", F.size(F.split("content", " ")).cast("long"))


#: the same tables for DuckDB, as leading common table expressions
SQL_PLACES = """places AS (
  SELECT least('customer:' || c_custkey, 'nation:' || c_nationkey) AS src, greatest('customer:' || c_custkey, 'nation:' || c_nationkey) AS tgt, 'located_in' AS relation, 1.0::DOUBLE AS weight FROM customer
  UNION ALL SELECT least('supplier:' || s_suppkey, 'nation:' || s_nationkey), greatest('supplier:' || s_suppkey, 'nation:' || s_nationkey), 'located_in', 1.0 FROM supplier
  UNION ALL SELECT least('nation:' || n_nationkey, 'region:' || n_regionkey), greatest('nation:' || n_nationkey, 'region:' || n_regionkey), 'in_region', 1.0 FROM nation)"""
SQL_LINES = """lines AS (
  SELECT least('supplier:' || l_suppkey, 'part:' || l_partkey) AS src, greatest('supplier:' || l_suppkey, 'part:' || l_partkey) AS tgt, 'supplies' AS relation, 'order:' || l_orderkey AS chunk_id FROM lineitem
  UNION ALL SELECT least('customer:' || o_custkey, 'part:' || l_partkey), greatest('customer:' || o_custkey, 'part:' || l_partkey), 'bought', 'order:' || l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SQL_TRADE = SQL_LINES + ", trade AS (SELECT src, tgt, relation, count(*)::DOUBLE AS weight FROM lines GROUP BY ALL)"
SQL_EDGES = SQL_PLACES + ", " + SQL_TRADE + ", edges AS (SELECT * FROM trade UNION ALL BY NAME SELECT * FROM places)"
SQL_NODES = """nodes AS (
  SELECT 'supplier:' || s_suppkey AS entity_name, 'supplier' AS entity_type, s_name AS description FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name || ' ' || c_mktsegment FROM customer
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name || ' ' || p_brand || ' ' || p_type FROM part
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name FROM region)"""
SQL_PARTS = "mentioned AS (SELECT DISTINCT 'order:' || l_orderkey AS chunk_id, 'part:' || l_partkey AS entity_name FROM lineitem)"
SQL_CHUNKS = "chunks AS (SELECT 'order:' || o_orderkey AS chunk_id, 'customer:' || o_custkey AS doc_id, concat_ws(' ', 'order', o_orderkey::VARCHAR, o_orderpriority, 'status', o_orderstatus) AS content, len(string_split(concat_ws(' ', 'order', o_orderkey::VARCHAR, o_orderpriority, 'status', o_orderstatus), ' '))::BIGINT AS tokens FROM orders)"
