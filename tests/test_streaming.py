"""Streaming forms against their batch forms."""

from __future__ import annotations

from graphloom.operators import memory as M
from graphloom.streaming import jobs

SF = "/root/testdata/sf0.001/events.parquet"


def _run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def _stream(spark, tmp_path):
    spark.read.parquet(SF).repartition(1).write.parquet(str(tmp_path / "events"))
    return spark.readStream.schema(spark.read.parquet(SF).schema).parquet(str(tmp_path / "events"))


def test_moving_average(spark, tmp_path):
    got = {r["user_id"]: round(r["ema"], 6) for r in _run(spark, jobs.moving_average(_stream(spark, tmp_path)), "ema_out", "update").collect()}
    want = {r["user_id"]: r["ema"] for r in M.ema(spark.read.parquet(SF), "user_id", ["ts", "event_id"], "value").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_windows_and_dedup(spark, tmp_path):
    n = spark.read.parquet(SF).count()
    out = _run(spark, jobs.windowed_performance(_stream(spark, tmp_path), "1 day", "60 days"), "win_out", "complete")
    assert sum(r["n"] for r in out.collect()) == n
