"""Streams of events: windows with watermarks and deduplication (an extension; drained to the end, the batch forms give the same rows)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """A file stream of events whose time is a proper event time."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_events(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """One event for each key: within the watermark on a stream, the earliest overall in a batch."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
    return events.groupBy(*key).agg(F.min("ts").alias("ts"))


def drain(spark: SparkSession, events: DataFrame, rows_of: Callable[[DataFrame], DataFrame], name: str, close: bool) -> DataFrame:
    """What a stream of events gives when it has been read to its end.

    The watermark holds the last windows back. With ``close``, once all files are read, a second source gives one event far in the
    future; it moves the watermark past every window, and its own window never ends.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    closing = events.schema
    marker = spark.createDataFrame([tuple(None for _ in closing)], closing).withColumn("ts", F.lit("2999-01-01").cast("timestamp"))
    marker.limit(0).write.parquet(f"{path}/closing")
    both = events.unionByName(spark.readStream.schema(closing).parquet(f"{path}/closing"))
    stream = rows_of(both)
    for last in (False, True)[: 2 if close else 1]:
        if last:
            marker.write.mode("append").parquet(f"{path}/closing")
        run = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").option("path", f"{path}/data").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")
