"""Event-time windows with bounded state; the same plan runs on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, column: str = "ts", delay: str = "1 day") -> DataFrame:
    """df with `at`, the column as a timestamp (watermarks reject one without a zone), and a watermark on it."""
    return df.withColumn("at", F.col(column).cast("timestamp")).withWatermark("at", delay)


def tumbling(df: DataFrame, size: str, *by: str) -> DataFrame:
    """Rows and sum of value in windows of a fixed size."""
    counts = df.groupBy(F.window("at", size), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, size: str, step: str, *by: str) -> DataFrame:
    counts = df.groupBy(F.window("at", size, step), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), *by, "n")


def sessions(df: DataFrame, gap: str, *by: str) -> DataFrame:
    """Rows of each run of a key whose rows follow within the gap."""
    counts = df.groupBy(F.session_window("at", gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("session_window.start").alias("start"), *by, "n")
