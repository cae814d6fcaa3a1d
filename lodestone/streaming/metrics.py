"""Metric events: rates over trailing and event-time windows, in batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trailing(events: DataFrame, seconds: int, ts: str = "ts", asof=None) -> DataFrame:
    """Events of the last ``seconds`` before ``asof`` (default: the latest event), bound included."""
    if asof is None:
        latest = events.agg(F.max(ts).alias("_now"))
        return events.join(F.broadcast(latest), F.col(ts) >= F.col("_now") - F.make_dt_interval(secs=F.lit(seconds))).drop("_now")  # one row
    return events.where(F.col(ts) >= F.lit(asof) - F.make_dt_interval(secs=F.lit(seconds)))


def rates(events: DataFrame, *keys: str) -> DataFrame:
    """total, refusals, refusal_pct and latency (mean), by key."""
    bad = F.count_if(F.col("event_type") == "error")
    return events.groupBy(*keys).agg(F.count("*").alias("total"), bad.alias("refusals"), F.round(bad * 100.0 / F.count("*"), 2).alias("refusal_pct"), F.round(F.avg("value"), 1).alias("latency"))


def windowed(events: DataFrame, size: str, slide: str | None = None, watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """Rates by event-time window; the same plan for a batch and for a stream with a watermark."""
    source = events.withWatermark(ts, watermark) if watermark else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    bad = F.count_if(F.col("event_type") == "error")
    out = source.groupBy(w.alias("w")).agg(F.count("*").alias("total"), bad.alias("refusals"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "total", "refusals", F.round("value", 4).alias("value"))


def sessions(events: DataFrame, gap: str, key: str = "user_id", watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """Sessions of each key: closed by ``gap`` without an event."""
    source = events.withWatermark(ts, watermark) if watermark else events
    out = source.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(key, F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n", F.round("value", 4).alias("value"))


def stream_of(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming plan over what is there now into an in-memory table of finished windows."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
