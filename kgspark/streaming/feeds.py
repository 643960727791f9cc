"""Streams of facts and proposals.

The reads of the engine are batch; these are its continuous counterparts, with
the same functions on streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def inbox(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Proposals as JSON lines dropped into a folder, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def apply_each(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``handle`` on every batch of what is there, then stops; the checkpoint folder must be shared."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling window; events later than the watermark are left out of closed windows."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events less than ``gap`` apart."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def latest_facts(events: DataFrame, by: list[str], order: str = "ts") -> DataFrame:
    """The newest event of each key, as an updating stream (output mode complete or update)."""
    rest = [c for c in events.columns if c not in by]
    return events.groupBy(*by).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("r")).select(*by, "r.*")
