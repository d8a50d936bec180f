"""The vector index against exact search, and query expansion by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.expansion import expand_query
from graphloom.operators import retrieval as R
from graphloom.operators import vector_index as I
from tests.compare import SF


def hits(df):
    return {(r["query_id"], r["vec_id"]) for r in df.collect()}


def test_index_recall(spark):
    v = spark.read.parquet(f"{SF.replace('0.001', '0.1')}/embeddings.parquet")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = I.build(v)
    assert index.rows.count() == v.count()
    exact, found = hits(R.vector_top(v, asked, 10)), hits(I.search(index, asked, 10))
    assert len(exact & found) >= 0.9 * len(exact)
    assert index.probes <= len(index.centroids)


def test_index_is_exact_with_all_cells(spark, monkeypatch):
    monkeypatch.setattr(I, "SHARE", 7)  # cells of many shares
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = v.limit(5).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = I.build(v, cells=4)
    got = I.search(index, asked, 6, probes=99).select("query_id", "vec_id", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.vector_top(v, asked, 6).select("query_id", "vec_id", "score", "rank").collect()))


def test_index_edge_cases(spark):
    kind = "vec_id long, embedding array<float>, cell int, key string, share int"
    v = spark.createDataFrame([(1, [1.0, 0.0], 9, "x", 3), (2, None, 9, "x", 3), (3, [0.0, 0.0], 9, "x", 3), (3, [0.0, 1.0], 9, "x", 3), (None, [1.0, 1.0], 9, "x", 3), (1, [1.0, 0.0], 9, "x", 3)], kind)
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, q array<double>")
    got = I.search(I.build(v), asked, 3, probes=99).collect()
    assert {r["query_id"] for r in got} == {7} and [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 1, None]
    assert I.search(I.build(v.limit(0)), asked, 3).count() == 0


def test_query_expansion(spark):
    rows = spark.createDataFrame([("What are the Blue Stones?",), ("who was emperor Otto",), ("Why did the fall come",), ("",), (None,)], "q string")
    got = [r["t"] for r in rows.select(expand_query(F.col("q"), {"fall": ("decline", "end")}, ("emperor",)).alias("t")).collect()]
    assert got[0] == sorted({"what are the blue stones?", "the blue stones", "blue stones", "the blue stone", "blue", "stones?"})
    assert got[1] == sorted({"who was emperor otto", "emperor otto", "otto", "emperor otto biography", "emperor otto role", "emperor"})
    assert got[2] == sorted({"why did the fall come", "decline", "end", "fall", "did", "come"}) and got[3] == [""] and got[4] is None
