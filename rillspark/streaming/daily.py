"""Streams of readings: daily means, sessions and newest rows, the same as their batch forms.

Each function takes a streaming or a plain DataFrame.  State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def readings(spark: SparkSession, path: str, schema, files_a_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def daily_means(rows: DataFrame, ts: str, value: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Mean and count of each key and day; rows later than ``late`` are left out of a stream."""
    days = rows.withWatermark(ts, late).groupBy(*keys, F.window(ts, "1 day").alias("w"))
    return days.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(*keys, F.to_date("w.start").alias("day"), "mean", "n")


def sessions(rows: DataFrame, ts: str, gap: str, *keys: str, late: str = "1 day") -> DataFrame:
    """Rows of a key with no longer pause than ``gap``: start, end (last and gap) and count."""
    runs = rows.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return runs.agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(rows: DataFrame, ts: str, *keys: str, late: str = "1 day") -> DataFrame:
    """One row of each key inside the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys)) if rows.isStreaming else rows.dropDuplicates(list(keys))


def to_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Finished rows appended to a folder, everything there is and then stop."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
