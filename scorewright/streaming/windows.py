"""Windowed scores of an event stream; the same expressions run over batch tables.

An extension: late rows beyond the watermark are dropped and never change the weights of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_scores(events: DataFrame, ts: str, key: str, score: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, key, n, total, mean) of tumbling windows; a stream gets a watermark."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("__ts", late)
    out = rows.groupBy(F.window("__ts", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(score).alias("total"), F.avg(score).alias("mean"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total", "mean")


def session_scores(events: DataFrame, ts: str, key: str, score: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n, mean) of sessions that end after a gap."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("__ts", late)
    out = rows.groupBy(F.session_window("__ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def resume(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has no result yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")
