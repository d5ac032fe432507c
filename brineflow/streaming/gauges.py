"""Gauges as streams: late data by watermark, hours and sessions by event time, days replaced by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brineflow.sources.sinks import upsert_days


def hourly_peaks(stream: DataFrame, late: str = "3 days") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("series", F.window("ts", "1 hour")).agg(F.max("v").alias("peak"), F.count("*").alias("n")).select("series", F.col("window.start").alias("hour"), "peak", "n")


def quarter_peaks(stream: DataFrame, late: str = "3 days") -> DataFrame:
    """Peaks by quarter-hour windows that start at the quarters."""
    return stream.withWatermark("ts", late).groupBy("series", F.window("ts", "15 minutes")).agg(F.max("v").alias("peak"), F.count("*").alias("n")).select("series", F.col("window.start").alias("quarter"), "peak", "n")


def gap_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "3 days", min_rows: int = 12) -> DataFrame:
    """Sessions that end with a gap; a gap of exactly that length still joins."""
    s = stream.withWatermark("ts", late).groupBy("series", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.max("v").alias("peak"))
    return s.where(F.col("n") >= min_rows).select("series", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "peak")


def with_states(stream: DataFrame, states: DataFrame, key: str = "stage") -> DataFrame:
    """Each forecast row with its precomputed state: a stream against a table."""
    return stream.join(states, key, "left")


def replace_partitions(stream: DataFrame, path: str, keys: list[str], checkpoint: str, day: str = "day"):
    """Every batch replaces its rows by key in a table that is partitioned by ``day``, rewriting the days it has and no others; a batch that runs again gives the same table."""

    def one(batch: DataFrame, _: int) -> None:
        upsert_days(batch.sparkSession, path, batch, keys, day)

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(one)


def archive_days(stream: DataFrame, path: str, checkpoint: str, day: str = "day"):
    """Whole days of a feed take the place of those in the table at ``path``; a batch that runs again, whole or cut short, leaves the same table."""

    def one(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(one)
