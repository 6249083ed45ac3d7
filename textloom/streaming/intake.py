"""Conversions as a stream: intake of files, answers already given, tasks' states, orphans, counts by time.

Event time is the rows' own timestamp; the watermark says how late a row may be.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ENDED = ("done", "error", "cancelled")
TASK = "task string, status string, progress double, events long, started timestamp, ended timestamp"
STATE = "status string, progress double, events long, started timestamp, ended timestamp"


def files(spark: SparkSession, path: str, schema, at_once: int = 1) -> DataFrame:
    """Parquet files of a folder, the oldest first, `at_once` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(path)


def first_within(events: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """Of events with equal keys those that no other within `seconds` came before: a cache whose entries expire."""
    return events.withWatermark(time, f"{seconds} seconds").dropDuplicatesWithinWatermark(keys)


def counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, hours: float) -> Iterator[pd.DataFrame]:
    """One task's rows in order of time; a cancelled task stays so; one in work for `hours` without a row becomes an error."""
    now = list(state.get) if state.exists else ["", 0.0, 0, None, None]
    if state.hasTimedOut:
        if now[0] not in ENDED:
            now[0], now[4] = "error", pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        state.remove()
    else:
        for row in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
            now[3] = now[3] or row.ts
            now[2] += 1
            if now[0] != "cancelled":
                now[0] = row.status or now[0] or "processing"
                now[1] = now[1] if pd.isna(row.progress) else float(row.progress)
                now[4] = row.ts if now[0] in ENDED else now[4]
            last = row.ts
        state.update(tuple(now))
        state.setTimeoutTimestamp(max(int((last + pd.Timedelta(hours=hours)).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([(key[0], *now)], columns=["task", "status", "progress", "events", "started", "ended"])


def task_states(events: DataFrame, hours: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """events: task, ts, status, progress. A row whenever a task's state changes."""

    def run(key, batches, state):
        return advance(key, batches, state, hours)

    return events.withWatermark("ts", late).groupBy("task").applyInPandasWithState(run, TASK, STATE, "update", GroupStateTimeout.EventTimeTimeout)
