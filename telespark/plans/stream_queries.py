"""Streaming jobs as named queries: each drains a stream over the given tables and returns what it wrote."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from telespark import constants as K
from telespark.functions import scalars as S
from telespark.operators import analytics, live, status
from telespark.session import prepare_streaming, scratch_dir
from telespark.sources import fixtures as fx
from telespark.sources import tables
from telespark.sources.versions import Versions
from telespark.streaming import ingest, stateful, views

IDLE_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ORDERS_SCHEMA = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
)


def _stream(spark: SparkSession, sf: str, name: str, schema: str) -> DataFrame:
    # A pattern, since the file source takes a plain path for a folder.
    return prepare_streaming(spark).readStream.schema(schema).parquet(f"{sf}/{name}.parquet*")


def _readings(spark, sf):
    return fx.telemetry_from(_stream(spark, sf, "events", EVENTS_SCHEMA))


def _messages(spark, sf):
    return fx.feed_from(_stream(spark, sf, "events", EVENTS_SCHEMA))


#: An event long after all others: the watermark that it brings closes windows and releases what waits. It is of robot -1 and no command.
_LAST = [(-4, datetime(2100, 1, 1), -1, "view", 0.0, '{"k": 99}')]


def _events_and_end(spark, sf):
    """The events as a stream, and behind them one that ends event time."""
    end = scratch_dir(spark, "end")
    spark.createDataFrame(_LAST, EVENTS_SCHEMA).coalesce(1).write.parquet(end)
    return _stream(spark, sf, "events", EVENTS_SCHEMA).union(spark.readStream.schema(EVENTS_SCHEMA).parquet(end))


def _drain(df: DataFrame, label: str, mode: str = "append", idle_batches: bool = True) -> DataFrame:
    """Runs the stream to its end into a file sink (append) or per-batch folders (update), and reads it back.

    With processing-time timers there is always a next batch to wait for; without idle batches the
    run ends with the data.
    """
    spark = df.sparkSession
    out = scratch_dir(spark, label)
    spark.conf.set(IDLE_BATCHES, str(idle_batches).lower())
    writer = df.writeStream.option("checkpointLocation", f"{out}-checkpoint").outputMode(mode).trigger(availableNow=True)
    try:
        if mode == "append":
            query = writer.format("parquet").option("path", out).start()
        else:
            query = writer.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch_id={i}")).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(IDLE_BATCHES)
    stored = df.schema if mode == "append" else df.schema.add("batch_id", LongType())
    return spark.read.schema(stored).parquet(out)


def _last_update(drained: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in drained.columns if c not in (*keys, "batch_id")]
    return drained.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")


def _ingested(spark, sf):
    """The root of the tables after the whole feed has come in."""
    root = scratch_dir(spark, "ingest")
    ingest.ingest_stream(_messages(spark, sf), root, f"{root}-checkpoint").awaitTermination()
    return root


def _readings_of(rows):
    return rows.select("msg_id", "robot_id", "battery", "status", S.iso_utc(F.col("timestamp")).alias("timestamp"))


def ingest_stream(spark, sf):
    return _readings_of(tables.read_ingested(spark, _ingested(spark, sf)))


def ingest_stream_rejects(spark, sf):
    return tables.read_ingested(spark, _ingested(spark, sf), "rejects").select("msg_id", "reason")


def ingest_events(spark, sf):
    """Robot events that came in with the readings, in their own table."""
    return tables.read_ingested(spark, _ingested(spark, sf), "events").select("msg_id", "robot_id", "message", S.iso_utc(F.col("timestamp")).alias("timestamp"))


def ingest_metrics(spark, sf):
    """Readings stored, from the rows that each batch leaves in the metrics table."""
    return ingest.ingest_metrics(spark, _ingested(spark, sf)).agg(F.sum("readings").alias("readings_ingested"))


def ingest_then_compact(spark, sf):
    """The feed in two deliveries, the second with all messages of the first again, then compaction and removal of what it replaced."""
    root = scratch_dir(spark, "ingest")
    messages = fx.feed(spark, sf)
    store = ingest.store_batch(root)
    prepare_streaming(spark)
    store(messages.where("pmod(xxhash64(msg_id), 2) = 0"), 0)
    store(messages, 1)
    for table in ("telemetry", "message_ids"):
        tables.compact(spark, root, date(2100, 1, 1), table)
    Versions(spark, root).vacuum(keep_versions=1, min_age_seconds=0)
    return _readings_of(tables.read_ingested(spark, root))


def dedupe_stream(spark, sf):
    return _drain(ingest.dedupe_stream(_messages(spark, sf)), "dedupe").select("msg_id")


def health_trend_stream(spark, sf):
    drained = _drain(views.health_trend_stream(_readings(spark, sf)), "trend", "update")
    return _last_update(drained, ["minute"]).select(S.iso_utc(F.col("minute")).alias("timestamp"), "health_score")


def mission_completions_stream(spark, sf):
    """The streaming count itself: windows that the watermark has closed."""
    readings = fx.telemetry_from(_events_and_end(spark, sf))
    counts = _drain(views.mission_completions_stream(readings), "missions").groupBy("mission_type").agg(F.sum("count").alias("count"))
    return analytics.zero_fill(counts, "mission_type", K.MISSION_TYPES)


def coalesce_live_stream(spark, sf):
    drained = _drain(views.coalesce_live_stream(_readings(spark, sf)), "coalesce", "update")
    last = _last_update(drained, ["robot_id", "flushed_at"])
    return last.select("robot_id", S.iso_utc(F.col("flushed_at")).alias("flushed_at"), "id", "battery")


def replace_snapshot(spark, sf):
    out = scratch_dir(spark, "snapshot")
    last = []

    def path_of(batch_id):
        last.append(f"{out}/{batch_id}")
        return last[-1]

    source = _readings(spark, sf)
    query = views.snapshot_stream(lambda batch: status.fleet_snapshot(batch, fx.AS_OF), path_of, source, f"{out}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(last[-1]).select("robot_id", "battery", "status", "runtime_remaining_minutes")


def feed_stream(spark, sf):
    """What the stream of readings publishes, a message a line."""
    out = scratch_dir(spark, "feed")
    views.feed_stream(live.to_feed(_readings(spark, sf), "telemetry"), out, f"{out}-checkpoint").awaitTermination()
    return spark.read.text(out).withColumnRenamed("value", "payload")


def live_status_stream(spark, sf):
    return _drain(stateful.live_status_stream(_readings(spark, sf)), "status", idle_batches=False)


def status_changes_stream(spark, sf):
    changes = _drain(stateful.status_changes_stream(fx.telemetry_from(_events_and_end(spark, sf))), "changes")
    return changes.where("robot_id >= 0")


def geofence_stream(spark, sf):
    return _drain(stateful.geofence_stream(fx.telemetry_from(_events_and_end(spark, sf))), "fence").select("id", "robot_id")


def _command_outcomes(spark, sf):
    """Outcomes of all status requests; every command exists before the first of them, half of them in the table that the stream starts from."""
    start = F.lit(datetime(2023, 12, 31, tzinfo=timezone.utc))
    fresh = lambda orders: fx.commands_from(orders).withColumns({"created_at": start, "status": F.lit("PENDING"), "timeout_seconds": F.lit(None).cast("int")})
    created = fresh(_stream(spark, sf, "orders", ORDERS_SCHEMA).where("o_orderkey % 2 = 0"))
    stored = fresh(fx.table(spark, sf, "orders").where("o_orderkey % 2 <> 0"))
    updates = fx.command_updates_from(_events_and_end(spark, sf))
    outcomes = _drain(stateful.command_stream(stateful.command_log(created, updates), stored), "commands")
    return fresh(fx.table(spark, sf, "orders")), outcomes.where("update_id >= 0 OR update_id IS NULL")


def command_stream(spark, sf):
    return _command_outcomes(spark, sf)[1].select("update_id", "command_id", "outcome")


def command_table_stream(spark, sf):
    """The command table as the stream has left it."""
    after = stateful.command_table(*_command_outcomes(spark, sf))
    return after.select("id", "status", *[S.iso_utc(F.col(c)).alias(c) for c in ("dispatched_at", "acknowledged_at", "started_at", "completed_at")])


def all_queries():
    return {
        f.__name__: f
        for f in (
            ingest_stream, ingest_stream_rejects, ingest_events, ingest_metrics, ingest_then_compact, dedupe_stream, health_trend_stream, mission_completions_stream,
            coalesce_live_stream, replace_snapshot, feed_stream, live_status_stream, status_changes_stream, geofence_stream, command_stream, command_table_stream,
        )
    }
