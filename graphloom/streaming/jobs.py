"""Structured Streaming forms of stateful operators over an event stream (ts, user_id, event_type, value)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_time(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def windowed_performance(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts, mean and total per type in tumbling windows; rows later than the delay are left out."""
    return event_time(events, delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions per user: start, end and number of events."""
    return event_time(events, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def dedup(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """The first of equal keys within the watermark: repeats are left out with bounded state."""
    return event_time(events, delay).dropDuplicatesWithinWatermark(keys)


def moving_average(events: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Per user the exponential moving average after each batch; state is one number a user, dropped after a day without events."""

    def update(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        value, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for v in rows["value"]:
            value = v if value is None else alpha * v + (1 - alpha) * value
            n += 1
        state.update((float(value), int(n)))
        state.setTimeoutDuration(86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "ema": [float(value)], "n": [int(n)]})

    rows = events.select("user_id", "ts", "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, ema double, n long", "ema double, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)
