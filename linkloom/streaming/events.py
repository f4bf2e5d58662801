"""Extension: event-time aggregates over an event stream. The data model itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELDS = {"event_id": T.LongType(), "ts": T.TimestampNTZType(), "user_id": T.LongType(), "event_type": T.StringType(), "value": T.DoubleType(), "props": T.StringType()}
EVENTS = T.StructType([T.StructField(k, v, True) for k, v in _FIELDS.items()])


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by event-time window; rows later than ``late`` are dropped by the watermark."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = held.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a pause of ``gap``."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = held.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
