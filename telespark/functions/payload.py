"""JSON payloads, parsed once into typed fields, with absent keys and explicit nulls told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark.session import prepare

# Every key that any accepted message may carry.
NUMBERS = (
    "robot_id", "battery", "temperature", "speed", "mission_progress", "battery_health", "motor_health", "sensor_health",
    "network_health", "x", "y", "timeout_seconds",
)
TEXTS = (
    "type", "status", "mission_id", "mission_type", "mission_start_time", "timestamp", "message", "command_type", "command_id", "idempotency_key",
)
OBJECTS = ("payload",)

SEEN, TYPED, IS_JSON = "_seen", "_typed", "_is_json"
PARSED = (SEEN, TYPED, IS_JSON)

_SEEN_TYPE = ", ".join(f"{k}: variant" for k in NUMBERS + TEXTS + OBJECTS)
_TYPED_TYPE = ", ".join([f"{k}: double" for k in NUMBERS] + [f"{k}: string" for k in TEXTS])


def with_fields(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the parsed fields of a JSON column: as found, as typed values, and whether it is JSON at all.

    The text is parsed as the only element of an array, so anything after the first value is an error.
    Results go through one-element generators: filters on them cannot be moved below, where the
    optimizer would repeat the parsing for every use of a field.
    """
    if SEEN in df.columns:
        return df
    prepare(df.sparkSession)
    wrapped = df.withColumn("_wrapped", F.try_parse_json(F.concat(F.lit("["), payload, F.lit("]"))))
    single = F.try_variant_get("_wrapped", "$[1]", "variant").isNull()
    value = F.when(single, F.try_variant_get("_wrapped", "$[0]", "variant"))
    valued = wrapped.select(*df.columns, F.explode(F.array(value)).alias("_value"))
    fields = F.struct(
        F.try_variant_get("_value", "$", f"struct<{_SEEN_TYPE}>").alias(SEEN),
        F.try_variant_get("_value", "$", f"struct<{_TYPED_TYPE}>").alias(TYPED),
        F.col("_value").isNotNull().alias(IS_JSON),
    )
    return valued.select(*df.columns, F.inline(F.array(fields)))


def is_json() -> Column:
    return F.col(IS_JSON)


def is_object() -> Column:
    return F.col(SEEN).isNotNull()


def found(key: str) -> Column:
    return F.col(f"{SEEN}.{key}")


def has_key(key: str) -> Column:
    """Key presence, also for an explicit null."""
    return found(key).isNotNull()


def has_value(key: str) -> Column:
    return has_key(key) & ~F.is_variant_null(found(key))


def is_text(key: str) -> Column:
    return F.coalesce(F.schema_of_variant(found(key)) == "STRING", F.lit(False))


def holds_object(key: str) -> Column:
    return F.coalesce(F.schema_of_variant(found(key)).startswith("OBJECT"), F.lit(False))


def text(key: str) -> Column:
    return F.col(f"{TYPED}.{key}")


def number(key: str) -> Column:
    return F.col(f"{TYPED}.{key}")


def integer(key: str) -> Column:
    """Whole numbers only; a fraction is not silently cut off."""
    return F.when(number(key) == F.floor(number(key)), number(key).try_cast("int"))


def parse_timestamp(value: Column) -> Column:
    """ISO timestamp, NULL when malformed. A bare year or month is not a timestamp."""
    dated = (F.substring(value, 5, 1) == "-") & (F.substring(value, 8, 1) == "-")
    return F.when(dated, F.try_to_timestamp(value))
