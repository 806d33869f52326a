"""Scores that follow a stream of trials: sums by key as state, from which any later batch goes on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from scorewright.shipping import ship

_OUT = "n long, total double, mean double"


class TrialSums(StatefulProcessor):
    """The number and sum of a key's scores; a key without rows for `idle` milliseconds of event time is forgotten."""

    def __init__(self, key: str, idle: int | None):
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.sums.get() if self.sums.exists() else (0, 0.0)
        for pdf in rows:
            known = pdf["score"].dropna()
            n, total = n + len(known), total + float(known.sum())
        self.sums.update((int(n), float(total)))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.idle)
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "total": [total], "mean": [total / n if n else None]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sums.clear()
        return iter([])

    def close(self) -> None:
        pass


def running_scores(trials: DataFrame, key: str, score: str, ts: str | None = None, late: str = "1 hour", idle: str | None = None) -> DataFrame:
    """(key, n, total, mean) of a stream of trials, a row for each key that a batch touches, to be written in update mode.

    Sums don't depend on the order of rows or batches, null scores are left out, and no row changes what others weigh.
    With ts rows beyond the watermark still count, unless the key has been idle for `idle` (such as 2 days) and was
    forgotten, when it starts anew. State is a row for each key. The session needs the RocksDB state store.
    """
    ship(trials.sparkSession)
    rows = trials.select(F.col(key), F.col(score).cast("double").alias("score"), *([F.col(ts).cast("timestamp").alias("__ts")] if ts else []))
    if ts:
        rows = rows.withWatermark("__ts", late)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000) if idle and ts else None
    out = StructType.fromDDL(f"`{key}` {rows.schema[key].dataType.simpleString()}, {_OUT}")
    return rows.groupBy(key).transformWithStateInPandas(TrialSums(key, wait), out, "Update", "EventTime" if wait else "None")


def batch_scores(trials: DataFrame, key: str, score: str) -> DataFrame:
    """The same of a table."""
    known = F.col(score).cast("double")
    return trials.groupBy(key).agg(F.count(known).alias("n"), F.coalesce(F.sum(known), F.lit(0.0)).alias("total"), F.avg(known).alias("mean"))
