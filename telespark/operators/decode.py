"""From raw messages to typed rows: decode, validate, normalise, stamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark.constants import READING_DEFAULTS
from telespark.functions import payload as P
from telespark.operators.latest import as_of_column

REQUIRED_READING = {"robot_id": P.integer, "battery": P.number, "temperature": P.number, "speed": P.number}
OPTIONAL_TEXT = ("status", "mission_id", "mission_type")
OPTIONAL_NUMBERS = ("mission_progress", "battery_health", "motor_health", "sensor_health", "network_health", "x", "y")


def decode_messages(df: DataFrame) -> DataFrame:
    """Adds the parsed fields and the `kind`: telemetry, event, command, other or corrupt.

    A message is telemetry exactly when the key `battery` is present, whatever its value.
    """
    kind_text = F.coalesce(P.text("type"), F.lit(""))
    return P.with_fields(df).withColumn(
        "kind",
        F.when(~P.is_json(), "corrupt")
        .when(P.has_key("battery"), "telemetry")
        .when(kind_text == "EVENT", "event")
        .when(kind_text.startswith("COMMAND"), "command")
        .otherwise("other"),
    )


def telemetry_messages(df: DataFrame) -> DataFrame:
    return decode_messages(df).filter(F.col("kind") == "telemetry").drop("kind")


def _or_default(key: str, value: Column) -> Column:
    return F.when(P.has_key(key), value).otherwise(F.lit(READING_DEFAULTS[key]))


def normalize_telemetry(messages: DataFrame, as_of=None) -> DataFrame:
    """Typed readings with defaults for absent keys; an unusable timestamp becomes the query time.

    An explicit null in a required field stays NULL, so that it can be told apart and quarantined.
    """
    columns = {key: _or_default(key, read(key)) for key, read in REQUIRED_READING.items()}
    columns["status"] = _or_default("status", P.text("status"))
    columns |= {key: P.text(key) for key in ("mission_id", "mission_type")}
    columns["mission_progress"] = P.number("mission_progress")
    columns["mission_start_time"] = F.when(P.is_text("mission_start_time"), P.parse_timestamp(P.text("mission_start_time")))
    columns |= {key: P.number(key) for key in OPTIONAL_NUMBERS if key != "mission_progress"}
    columns["timestamp"] = F.coalesce(P.parse_timestamp(P.text("timestamp")), as_of_column(as_of).cast("timestamp"))
    kept = [c for c in messages.columns if c not in (*P.PARSED, "payload", "kind", "reason") and c not in columns]
    return P.with_fields(messages).select(*kept, *[c.alias(name) for name, c in columns.items()])


def _split(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    rejected = F.col("reason").isNotNull()
    return marked.filter(~rejected).drop("reason"), marked.filter(rejected)


def missing_value() -> Column:
    """Why a normalised reading cannot be stored; NULL for one that can."""
    return F.coalesce(*[F.when(F.col(key).isNull(), F.lit(f"{key}: no usable value")) for key in REQUIRED_READING])


def quarantine_nulls(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(storable, rejected with `reason`): required columns must hold a value."""
    return _split(readings.withColumn("reason", missing_value()))


def _required(key: str, accepted: Column) -> list[Column]:
    return [F.when(~P.has_key(key), F.lit(f"{key}: missing")), F.when(~F.coalesce(accepted, F.lit(False)), F.lit(f"{key}: invalid"))]


def _optional(key: str, accepted: Column) -> Column:
    return F.when(P.has_value(key) & ~F.coalesce(accepted, F.lit(False)), F.lit(f"{key}: invalid"))


def _judge(df: DataFrame, reasons: list[Column]) -> DataFrame:
    not_object = F.when(~P.is_object(), F.lit("payload: not an object"))
    return P.with_fields(df).withColumn("reason", F.coalesce(not_object, *reasons))


def _validate(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid, rejected = _split(judged)
    return valid, rejected.drop(*P.PARSED)


def judge_telemetry(df: DataFrame) -> DataFrame:
    """Adds the parsed fields and `reason`, NULL for a valid telemetry payload.

    Persist or store this when both the valid and the rejected rows are wanted, so that payloads are parsed once.
    """
    reasons = [r for key, read in REQUIRED_READING.items() for r in _required(key, read(key).isNotNull())]
    reasons += [_optional(key, P.is_text(key)) for key in OPTIONAL_TEXT]
    reasons += [_optional(key, P.number(key).isNotNull()) for key in OPTIONAL_NUMBERS]
    reasons.append(_optional("mission_start_time", P.parse_timestamp(P.text("mission_start_time")).isNotNull()))
    return _judge(df, reasons)


def judge_events(df: DataFrame) -> DataFrame:
    return _judge(df, [*_required("robot_id", P.integer("robot_id").isNotNull()), *_required("message", P.is_text("message"))])


def judge_commands(df: DataFrame) -> DataFrame:
    return _judge(
        df,
        [
            *_required("command_type", P.is_text("command_type")),
            _optional("payload", P.holds_object("payload")),
            _optional("timeout_seconds", P.integer("timeout_seconds").isNotNull()),
            _optional("idempotency_key", P.is_text("idempotency_key")),
        ],
    )


def validate_telemetry(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with `reason`) for telemetry payloads."""
    return _validate(judge_telemetry(df))


def validate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _validate(judge_events(df))


def validate_commands(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _validate(judge_commands(df))


def stamp_ingest_time(df: DataFrame, as_of=None, column: str = "timestamp") -> DataFrame:
    """One server-side instant shared by the whole batch."""
    return df.withColumn(column, as_of_column(as_of).cast("timestamp"))


def dedupe_messages(df: DataFrame, key: str = "msg_id", order: str = "received_at") -> DataFrame:
    """First delivery of every message; repeats are merged before the shuffle. At one instant the smallest row counts."""
    columns = [order, *[c for c in df.columns if c not in (key, order)]]
    return df.groupBy(key).agg(F.min(F.struct(*columns)).alias("first")).select(key, "first.*")
