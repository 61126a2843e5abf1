"""Streaming aggregates and snapshots built from the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telespark import constants as K
from telespark.operators import analytics, live
from telespark.streaming.ingest import WATERMARK


def health_trend_stream(readings: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """(minute, health_score) per tumbling minute of event time."""
    timed = readings.withWatermark("timestamp", delay)
    window = F.window("timestamp", "1 minute")
    metrics = ("battery", "temperature", *analytics.HEALTH_COLUMNS)
    averages = timed.groupBy(window.alias("w")).agg(*[F.avg(c).alias(c) for c in metrics])
    return analytics.score_minutes(averages.withColumn("minute", F.col("w.start")))


def completed_missions_stream(readings: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each completed mission once: (mission_type, mission_id, timestamp). Counting it is mission_completions_stream."""
    done = readings.filter((F.col("mission_progress") >= 100.0) & F.col("mission_type").isin(*K.MISSION_TYPES) & F.col("mission_id").isNotNull())
    return done.select("mission_type", "mission_id", "timestamp").withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(
        ["mission_type", "mission_id"]
    )


def mission_completions_stream(readings: DataFrame, delay: str = "1 day") -> DataFrame:
    """Distinct completed missions per type and day of event time."""
    return completed_missions_stream(readings, delay).groupBy(F.window("timestamp", "1 day").alias("day"), "mission_type").agg(
        F.count(F.lit(1)).alias("count")
    )


def coalesce_live_stream(readings: DataFrame, interval: str = "100 milliseconds", delay: str = WATERMARK) -> DataFrame:
    return live.coalesce_live(readings.withWatermark("timestamp", delay), interval)


def snapshot_stream(snapshots, path_of, source: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Replaces the whole snapshot on every trigger.

    `snapshots(batch)` computes the authoritative rows; they are written to a new folder
    `path_of(batch_id)`, so readers never see a half-written one and gone robots disappear.
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        snapshots(batch).write.mode("overwrite").parquet(path_of(batch_id))

    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(replace)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def feed_stream(feed: DataFrame, path: str, checkpoint: str, fmt: str = "text", **trigger) -> StreamingQuery:
    """Publishes the payloads of an outgoing feed (see operators.live), one JSON message per line."""
    writer = feed.select(F.col("payload").alias("value")).writeStream.format(fmt).option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
