"""The batch stages as streams: keyed ingestion exactly once, and windowed counts of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def ingest_once(items: DataFrame, ts_col: str = "fetched_at", lateness: str = "48 hours") -> DataFrame:
    """Items whose key (source_name, source_url) was not seen within the watermark."""
    return items.withWatermark(ts_col, lateness).dropDuplicatesWithinWatermark(["source_name", "source_url"])


def window_counts(events: DataFrame, ts_col: str = "ts", window: str = "1 hour", slide: str | None = None, lateness: str = "2 hours") -> DataFrame:
    w = F.window(ts_col, window, slide) if slide else F.window(ts_col, window)
    counts = events.withWatermark(ts_col, lateness).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(rows: DataFrame, key: str, ts_col: str, gap: str = "48 hours", lateness: str | None = None) -> DataFrame:
    """(key, first_at, last_at, n): rows of a key chained while each follows the one before within the gap. Of a stream
    (with a lateness) a chain comes out when the watermark has passed its gap."""
    timed = rows.withWatermark(ts_col, lateness) if lateness else rows
    per = timed.groupBy(F.session_window(ts_col, gap).alias("w"), key).agg(F.min(ts_col).alias("first_at"), F.max(ts_col).alias("last_at"), F.count("*").alias("n"))
    return per.select(key, "first_at", "last_at", "n")


def run_once(df: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """Processes all that is there and stops."""
    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
