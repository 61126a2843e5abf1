"""Stream ingest: decode, validate, normalise, de-duplicate by an index of message ids, and store by kind, with rejects kept aside."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telespark import schemas
from telespark.functions import payload as P
from telespark.operators import decode
from telespark.operators.slices import running_position
from telespark.session import prepare_streaming, shuffles_removed
from telespark.sources import tables
from telespark.sources.versions import Versions

WATERMARK = "10 minutes"
#: Message ids are filed by so many seconds of payload time, over so many days; those without one in so many slots by id.
SLOT_SECONDS, SLOT_DAYS, UNTIMED_SLOTS = 600, 30, 16


def read_messages(spark: SparkSession, path: str | None = None, max_files: int = 1000, fmt: str = "parquet", **options) -> DataFrame:
    """A stream of (msg_id, payload, received_at), from files or Kafka; the batch size of files is bounded per trigger."""
    reader = prepare_streaming(spark).readStream.format(fmt).options(**options)
    if fmt == "kafka":  # has columns of its own; options name its servers and topics
        return from_kafka(reader.load())
    return reader.schema(schemas.MESSAGES).option("maxFilesPerTrigger", max_files).load(path)


def from_kafka(records: DataFrame) -> DataFrame:
    """The same columns from a Kafka source; a record's position is its message id."""
    return records.select(
        F.concat_ws("-", "topic", "partition", "offset").alias("msg_id"),
        F.col("value").cast("string").alias("payload"),
        F.col("timestamp").alias("received_at"),
    )


def dedupe_stream(messages: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """One delivery per message id among those at most `delay` apart, for streams that keep nothing they could look up.

    Spark drops rows older than the watermark here; ingest_stream, which looks into its table instead, keeps them.
    """
    return messages.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["msg_id"])


def ingest_metrics(spark: SparkSession, root: str) -> DataFrame:
    """What each batch of stream ingest stored and how long its writes took: (batch_id, readings, events, commands, rejects, write_ms, dt)."""
    return tables.read_ingested(spark, root, "metrics")


def numbered(readings: DataFrame, batch_id: int) -> DataFrame:
    """Readings with unique ids: the batch in the high bits, below it a position by arrival second, a hash, time and message id.

    The same messages get the same ids when a batch is repeated. Positions are counted in slices of a second and a hash
    of the message id, so that a batch that arrived in one instant is not one task.
    """
    sliced = readings.withColumn("_slice", F.struct(F.unix_seconds("received_at"), F.pmod(F.xxhash64("msg_id"), F.lit(16))))
    placed = running_position(sliced.withColumn("_all", F.lit(0)), ["_all"], ["received_at", "msg_id"], "_slice", "id")
    return placed.drop("_all").withColumn("id", F.shiftleft(F.lit(batch_id).cast("bigint"), 36) + F.col("id"))


def _slot(timestamp: Column) -> Column:
    """Where a message's id is filed: by ten minutes of the time in its payload, over SLOT_DAYS days and then again from the first; without one, by its id.

    A repeat has the same payload, so its id lies in the same slot. There is a fixed number of slots, whatever clocks senders have.
    """
    timed = F.pmod(F.floor(F.unix_seconds(timestamp) / SLOT_SECONDS), F.lit(SLOT_DAYS * 86_400 // SLOT_SECONDS))
    return F.coalesce(timed, -1 - F.pmod(F.xxhash64("msg_id"), F.lit(UNTIMED_SLOTS)))


def unseen(messages: DataFrame, store: Versions) -> DataFrame:
    """Messages, with their `slot`, whose id no earlier batch has filed; `messages` itself where their slots are empty. Only these slots are read, not the day."""
    slots = {str(r["slot"]) for r in messages.select("slot").distinct().collect()}  # at most as many as there are slots
    if not any(f.part in slots for f in store.version().of("message_ids")):
        return messages
    filed = store.read("message_ids", schemas.MESSAGE_IDS, "slot", "long", only=slots).select("slot", "msg_id")
    return messages.join(filed, ["slot", "msg_id"], "left_anti")


def _typed(messages: DataFrame) -> DataFrame:
    """Messages with what their tables keep: `kind`, `slot`, `reason` (NULL for what can be stored), a reading's columns, those of the others in `other`.

    The parsed fields end here: each of them repeats all keys of its payload. The payload itself (`raw`) stays with commands and rejects.
    """
    decoded = decode.decode_messages(messages.withColumn("raw", F.col("payload")))
    usable = P.integer("robot_id").isNotNull() & F.when(F.col("kind") == "event", P.is_text("message")).otherwise(F.lit(True))
    known = F.col("kind").isin("telemetry", "event", "command")
    odd = F.when(~known, F.concat(F.lit("not a reading: "), "kind")).when(~usable, F.concat("kind", F.lit(": no usable fields")))
    others = F.struct(P.integer("robot_id").alias("robot_id"), *[P.text(c).alias(c) for c in ("message", "type", "command_id", "command_type", "status")])
    marked = decoded.withColumns({"slot": _slot(P.parse_timestamp(P.text("timestamp"))), "_kind": F.col("kind"), "_odd": odd, "other": others})
    readings = decode.normalize_telemetry(marked, F.col("received_at")).withColumnRenamed("_kind", "kind")
    judged = readings.withColumn("reason", F.when(F.col("kind") == "telemetry", decode.missing_value()).otherwise(F.col("_odd"))).drop("_odd")
    kept = (F.col("kind") == "command") | F.col("reason").isNotNull()
    return judged.withColumns({"raw": F.when(kept, F.col("raw")), "other": F.when(F.col("kind") != "telemetry", F.col("other"))})


def _outputs(fresh: DataFrame, batch_id: int) -> dict[str, DataFrame]:
    """Rows of the four tables."""
    good = lambda kind: fresh.where("reason IS NULL").where(F.col("kind") == kind)
    readings = numbered(good("telemetry").drop("raw", "slot", "kind", "reason", "other"), batch_id)
    events = numbered(good("event").select("msg_id", "received_at", "timestamp", "other"), batch_id).select("id", "other.robot_id", "other.message", "timestamp", "msg_id")
    commands = good("command").select("msg_id", *[f"other.{c}" for c in ("type", "command_id", "robot_id", "command_type", "status")], "timestamp", F.col("raw").alias("payload"))
    rejects = fresh.where("reason IS NOT NULL").select("msg_id", "received_at", F.col("raw").alias("payload"), "kind", "reason")
    days = {"telemetry": (readings, "timestamp"), "events": (events, "timestamp"), "commands": (commands, "timestamp"), "rejects": (rejects, "received_at")}
    return {table: rows.withColumn("dt", F.to_date(at)) for table, (rows, at) in days.items()}


def store_batch(root: str, on_metrics=None, writer: str = "ingest"):
    """A foreachBatch writer to the tables below `root`: readings, robot events and command messages, each to its own; all other messages to
    `rejects` with payload and reason; the ids of all to `message_ids`; a row of counts and the time taken to `metrics`.

    One commit publishes all of a batch. A repeated batch finds itself committed and does nothing, so that each message is stored once. No message is
    lost for its age: repeats within a batch are merged, those of other batches are recognised by the ids of their slots.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, begun = batch.sparkSession, time.monotonic()
        store = Versions(spark, root)
        if store.committed(writer, batch_id):
            return
        # On disk: a batch of any size takes no more memory than its tasks.
        typed = _typed(decode.dedupe_messages(batch.select("msg_id", "payload", "received_at"))).persist(StorageLevel.DISK_ONLY)
        fresh = typed
        try:
            fresh = unseen(typed, store)
            if fresh is not typed:
                fresh = fresh.persist(StorageLevel.DISK_ONLY)
            folders, counts = [], {}
            for table, rows in _outputs(fresh, batch_id).items():
                order = ("dt", "received_at") if "received_at" in rows.columns else ("dt", "timestamp")
                with shuffles_removed(spark):
                    written = store.write(rows.hint("rebalance", "dt").sortWithinPartitions(*order), table, "dt")
                counts[table] = store.rows(written)
                folders += written
            arrived = typed.agg(F.max(F.to_date("received_at"))).first()[0]
            if arrived is not None:
                ids = fresh.select("msg_id", "slot").hint("rebalance", "slot").sortWithinPartitions("slot", "msg_id")
                folders += store.write(ids, "message_ids", "slot", arrived.isoformat())
                row = (batch_id, *(counts[t] for t in ("telemetry", "events", "commands", "rejects")), int(1000 * (time.monotonic() - begun)))
                one = spark.createDataFrame([row], schemas.INGEST_METRICS).withColumn("dt", F.lit(arrived))
                folders += store.write(one, "metrics", "dt")
            store.commit(folders, writer=writer, batch=batch_id)
            if on_metrics is not None:
                on_metrics(batch_id, counts["telemetry"])
        finally:
            fresh.unpersist()
            typed.unpersist()

    return write


def ingest_stream(messages: DataFrame, root: str, checkpoint: str, on_metrics=None, **trigger) -> StreamingQuery:
    """Runs the ingest into the tables below `root`; with no trigger given it drains what is there and stops."""
    writer = messages.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(store_batch(root, on_metrics)).start()
