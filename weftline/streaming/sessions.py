"""The session state machine, in batch and on a stream.

Calls of a session are folded in order: a session is open until a purchase closes it, an error
counts against it, and after MOST_ERRORS errors it is failed. The stream keeps one small state per
session and emits a row whenever a call arrives; its last row of a session equals the batch's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_ERRORS = 3
OUT = "user_id long, n_calls long, n_errors long, status string"


def status(n_errors, n_purchases):
    return F.when(n_errors >= MOST_ERRORS, "failed").when(n_purchases > 0, "closed").otherwise("open")


def batch_sessions(events: DataFrame) -> DataFrame:
    counts = events.groupBy("user_id").agg(F.count("*").alias("n_calls"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.count_if(F.col("event_type") == "purchase").alias("__bought"))
    return counts.select("user_id", "n_calls", "n_errors", status(F.col("n_errors"), F.col("__bought")).alias("status"))


def stream_sessions(events: DataFrame) -> DataFrame:
    """events: a stream with user_id and event_type."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls, errors, bought = state.get if state.exists else (0, 0, 0)
        for f in frames:
            calls += len(f)
            errors += int((f["event_type"] == "error").sum())
            bought += int((f["event_type"] == "purchase").sum())
        state.update((calls, errors, bought))
        now = "failed" if errors >= MOST_ERRORS else "closed" if bought else "open"
        yield pd.DataFrame({"user_id": [key[0]], "n_calls": [calls], "n_errors": [errors], "status": [now]})

    return events.groupBy("user_id").applyInPandasWithState(fold, OUT, "calls long, errors long, bought long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls by event-time window and type, on a stream or in batch; late ones are dropped on a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def gaps(events: DataFrame, seconds: int) -> DataFrame:
    """events plus session: a new one after a pause of more than `seconds`."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts"))
    return events.withColumn("__new", (F.coalesce(pause, F.lit(0)) > seconds).cast("int")).withColumn("session", F.sum("__new").over(w)).drop("__new")
