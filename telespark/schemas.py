"""Fixed schemas of the stored tables, the raw message stream and the accepted payloads."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields) -> StructType:
    return StructType([StructField(name, dtype, nullable) for name, dtype, nullable in fields])


_READING = (
    ("robot_id", IntegerType(), False),
    ("battery", DoubleType(), False),
    ("temperature", DoubleType(), False),
    ("speed", DoubleType(), False),
    ("status", StringType(), True),
    ("mission_id", StringType(), True),
    ("mission_type", StringType(), True),
    ("mission_progress", DoubleType(), True),
    ("mission_start_time", TimestampType(), True),
    ("battery_health", DoubleType(), True),
    ("motor_health", DoubleType(), True),
    ("sensor_health", DoubleType(), True),
    ("network_health", DoubleType(), True),
    ("x", DoubleType(), True),
    ("y", DoubleType(), True),
)

READING_COLUMNS = tuple(name for name, _, _ in _READING)
HEALTH_COLUMNS = ("battery_health", "motor_health", "sensor_health", "network_health")

# `id` orders rows by arrival and breaks ties between equal timestamps.
TELEMETRY = _struct(("id", LongType(), False), *_READING, ("timestamp", TimestampType(), False))

EVENTS = _struct(
    ("id", IntegerType(), False),
    ("robot_id", IntegerType(), False),
    ("message", StringType(), False),
    ("timestamp", TimestampType(), False),
)

COMMANDS = _struct(
    ("id", StringType(), False),
    ("robot_id", IntegerType(), False),
    ("command_type", StringType(), False),
    ("payload", StringType(), True),
    ("status", StringType(), False),
    ("idempotency_key", StringType(), True),
    ("timeout_seconds", IntegerType(), True),
    ("retry_count", IntegerType(), True),
    ("max_retries", IntegerType(), True),
    ("created_at", TimestampType(), False),
    ("dispatched_at", TimestampType(), True),
    ("acknowledged_at", TimestampType(), True),
    ("started_at", TimestampType(), True),
    ("completed_at", TimestampType(), True),
    ("expires_at", TimestampType(), True),
    ("error_code", StringType(), True),
    ("error_message", StringType(), True),
    ("result", StringType(), True),
)

COMMAND_UPDATES = _struct(
    ("update_id", LongType(), False),
    ("command_id", StringType(), False),
    ("requested_status", StringType(), False),
    ("error_code", StringType(), True),
    ("error_message", StringType(), True),
    ("result", StringType(), True),
    ("requested_at", TimestampType(), False),
)

ROBOTS = _struct(
    ("id", IntegerType(), False),
    ("name", StringType(), True),
    ("model", StringType(), True),
    ("firmware_version", StringType(), True),
    ("is_active", BooleanType(), True),
    ("registered_at", TimestampType(), True),
    ("decommissioned_at", TimestampType(), True),
)

MESSAGES = _struct(
    ("msg_id", StringType(), False),
    ("payload", StringType(), True),
    ("received_at", TimestampType(), False),
)

# What stream ingest stores below one root (see streaming.ingest).
INGESTED_READINGS = StructType([*TELEMETRY.fields, StructField("msg_id", StringType()), StructField("received_at", TimestampType())])
INGESTED_EVENTS = _struct(
    ("id", LongType(), False),
    ("robot_id", IntegerType(), False),
    ("message", StringType(), False),
    ("timestamp", TimestampType(), False),
    ("msg_id", StringType(), False),
)
INGESTED_COMMANDS = _struct(
    ("msg_id", StringType(), False),
    ("type", StringType(), False),
    ("command_id", StringType(), True),
    ("robot_id", IntegerType(), False),
    ("command_type", StringType(), True),
    ("status", StringType(), True),
    ("timestamp", TimestampType(), False),
    ("payload", StringType(), False),
)
REJECTS = _struct(
    ("msg_id", StringType(), False),
    ("received_at", TimestampType(), False),
    ("payload", StringType(), True),
    ("kind", StringType(), False),
    ("reason", StringType(), False),
)
MESSAGE_IDS = _struct(("msg_id", StringType(), False))
INGEST_METRICS = _struct(
    ("batch_id", LongType(), False),
    ("readings", LongType(), False),
    ("events", LongType(), False),
    ("commands", LongType(), False),
    ("rejects", LongType(), False),
    ("write_ms", LongType(), False),
)
INGESTED = {
    "telemetry": (INGESTED_READINGS, "dt", "date"),
    "events": (INGESTED_EVENTS, "dt", "date"),
    "commands": (INGESTED_COMMANDS, "dt", "date"),
    "rejects": (REJECTS, "dt", "date"),
    "metrics": (INGEST_METRICS, "dt", "date"),
    "message_ids": (MESSAGE_IDS, "slot", "long"),
}

FLEET_ANALYTICS = _struct(
    ("fleet_health_trend", ArrayType(_struct(("timestamp", StringType(), True), ("health_score", DoubleType(), True))), False),
    ("battery_distribution", ArrayType(_struct(("range", StringType(), True), ("count", LongType(), True))), False),
    ("temperature_distribution", ArrayType(_struct(("range", StringType(), True), ("count", LongType(), True))), False),
    ("mission_completion_count", ArrayType(_struct(("mission_type", StringType(), True), ("count", LongType(), True))), False),
    ("robot_status_breakdown", ArrayType(_struct(("status", StringType(), True), ("count", LongType(), True))), False),
)
