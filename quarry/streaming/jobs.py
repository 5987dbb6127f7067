"""Structured Streaming jobs; each gives over a replayed input what its batch operator gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.feedback import RELIABILITY, START, reliability_row, reliability_step

WATERMARK = "1 day"


def usage_counts(usage: DataFrame) -> DataFrame:
    """STR-4: tokens and calls by hour and business type; rows later than the watermark are dropped."""
    kind = F.when(F.col("request_type").startswith("parse"), "parse").otherwise("qa")
    rows = usage.withWatermark("created_time", WATERMARK) if usage.isStreaming else usage
    return rows.groupBy(F.window("created_time", "1 hour"), kind.alias("business")).agg(F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))


def activity(feedback: DataFrame) -> DataFrame:
    """STR-5: rows of each user in every 24 hours, each hour."""
    rows = feedback.withWatermark("created_at", WATERMARK) if feedback.isStreaming else feedback
    return rows.groupBy("user_id", F.window("created_at", "24 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n"))


def feedback_loop(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, time_col: str = "created_at", key: str = "feedback_id", interval: str | None = None):
    """STR-1, STR-3: open rows, each key once within the watermark, handed to the batch functions batch by batch."""
    once = source.withWatermark(time_col, WATERMARK).dropDuplicatesWithinWatermark([key])
    writer = once.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class ReliabilityProcessor(StatefulProcessor):
    """STR-2: the fold of FB-8, one event after the other, with its accumulator as state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("reliability", "score double, n long, last double, verified long, rejected long, corrections long, right_corrections long, verified_weight double, rejected_weight double, correction_weight double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else START
        events = pd.concat(list(rows)).sort_values(["sec", "feedback_id"])
        for event in zip(*(events[c] for c in ("sec", "direction", "weight", "correction"))):
            state = reliability_step(state, *event)
        state = tuple(kind(x) for kind, x in zip((float, int, float, int, int, int, int, float, float, float), state))
        self.state.update(state)
        yield pd.DataFrame([reliability_row(key[0], state)])

    def close(self) -> None:
        pass


def reliability_stream(events: DataFrame) -> DataFrame:
    """STR-2: running reliability per user (update mode); events without direction or weight are skipped; needs the RocksDB state store."""
    good = events.filter("direction <> 0 and weight > 0")
    return good.groupBy("user_id").transformWithStateInPandas(ReliabilityProcessor(), RELIABILITY, "Update", "None")


class StaleProcessor(StatefulProcessor):
    """STR-6: a task is reported once no event of it has come for ``timeout`` of event time."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = max([int(r["ms"].max()) for r in rows] + ([self.state.get()[0]] if self.state.exists() else []))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0])
        self.state.update((last,))
        self.handle.registerTimer(last + self.timeout_ms)
        yield pd.DataFrame({"task_id": [], "last_ms": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0]
        self.state.clear()
        yield pd.DataFrame({"task_id": [key[0]], "last_ms": [last]})

    def close(self) -> None:
        pass


def stale_stream(events: DataFrame, timeout_ms: int) -> DataFrame:
    """STR-6: (task_id, last_ms) of tasks without events for too long; ``events`` has task_id, ms and at (a timestamp)."""
    return events.withWatermark("at", "1 minute").groupBy("task_id").transformWithStateInPandas(StaleProcessor(timeout_ms), "task_id long, last_ms long", "Append", "EventTime")
