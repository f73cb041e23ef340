"""Structured Streaming: event ingest with watermarks and session windows, and
resumable document ingest by checkpointed offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: object, ts: str = "ts") -> DataFrame:
    """Parquet files as they arrive; times without a zone are taken as UTC."""
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """(start, keys..., n, total): counts per window, dropping what is later
    than the watermark."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    """(key, start, end, n): sessions that a gap ends."""
    w = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap))
    return w.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """Run over what is there and stop; the checkpoint is where a later run
    goes on, so nothing is read twice."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def deduplicated(events: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
