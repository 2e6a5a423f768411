"""Incremental statistics over event streams, the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str, late: str = "10 minutes") -> DataFrame:
    """Moments of ``value`` by window and type; events later than ``late`` are dropped.

    ``events(ts timestamp, event_type, value)`` may be a stream or a table.
    """
    windowed = events.withWatermark("ts", late) if events.isStreaming else events
    out = windowed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "mean", "variance", "least", "most")


def sliding(events: DataFrame, length: str, step: str, late: str = "10 minutes") -> DataFrame:
    windowed = events.withWatermark("ts", late) if events.isStreaming else events
    out = windowed.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with no pause of ``gap`` or more."""
    windowed = events.withWatermark("ts", late) if events.isStreaming else events
    out = windowed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write all that is there to Parquet and stop; exactly once by the checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
