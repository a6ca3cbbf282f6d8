"""The edit log as a stream: the last text of each item, and autosaves debounced by session windows.

Events: event_id, ts, item_id, text. Repeated deliveries within the watermark are dropped; state is one row for each item, or for each open session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def unique(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def last_texts(events: DataFrame) -> DataFrame:
    """item_id, seq, text: last write wins by event_id, whatever the order of arrival. For output mode complete or update."""
    return events.groupBy("item_id").agg(F.max("event_id").alias("seq"), F.max_by("text", "event_id").alias("text"))


def autosaves(events: DataFrame, quiet: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """item_id, first, last_event, n: edits that follow one another within `quiet` are one save, given when the session closes (append)."""
    events = events.withWatermark("ts", late)
    saves = events.groupBy("item_id", F.session_window("ts", quiet).alias("w")).agg(F.min("ts").alias("first"), F.max("event_id").alias("last_event"), F.count("*").alias("n"))
    return saves.select("item_id", "first", "last_event", "n")
