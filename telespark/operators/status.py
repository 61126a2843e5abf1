"""The per-robot status table and the views a dashboard derives from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark import constants as K
from telespark.functions import scalars as S
from telespark.operators.latest import as_of_column, fold_history, recent_per_robot
from telespark.schemas import HEALTH_COLUMNS

STATUS_COLUMNS = (
    "robot_id", "battery", "temperature", "speed", "status", "mission_id", "mission_type", "mission_progress",
    "mission_start_time", "last_seen", "runtime_remaining_minutes", "x", "y", *HEALTH_COLUMNS,
)


def round_status_columns(df: DataFrame) -> DataFrame:
    """Display rounding and the fallbacks for missing position and health."""
    rounded = {c: F.bround(c, 2) for c in ("battery", "temperature", "speed")}
    rounded["mission_progress"] = F.bround("mission_progress", 1)
    rounded |= {c: S.position_or_origin(F.col(c)) for c in ("x", "y")}
    rounded |= {c: S.health_or_full(F.col(c)) for c in HEALTH_COLUMNS}
    return df.withColumns(rounded)


def fleet_snapshot(df: DataFrame, as_of=None, n: int = 30, minutes: int = 15) -> DataFrame:
    """One summary row per robot that reported inside the window."""
    now = as_of_column(as_of)
    folded = fold_history(recent_per_robot(df, as_of, n, minutes))
    flat = folded.select("robot_id", "latest.*", "runtime_remaining_minutes")
    described = flat.withColumns(
        {
            "status": S.derive_status(F.col("status"), S.age_seconds(F.col("timestamp"), now)),
            "mission_start_time": S.iso_utc(F.col("mission_start_time")),
            "last_seen": S.iso_utc(F.col("timestamp")),
        }
    )
    return round_status_columns(described).select(*STATUS_COLUMNS, "timestamp")


def page(df: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """A slice of an already ordered result; all rows after `skip` without a limit."""
    if skip < 0 or (limit is not None and limit < 0):
        raise ValueError("skip and limit must not be negative")
    rest = df.offset(skip) if skip else df
    return rest if limit is None else rest.limit(limit)


def fleet_status(df: DataFrame, as_of=None, limit: int | None = None, skip: int = 0) -> DataFrame:
    """The status table by robot: every robot, or one page of them."""
    return page(fleet_snapshot(df, as_of).drop("timestamp").orderBy("robot_id"), skip, limit)


def fleet_stats(snapshot: DataFrame) -> DataFrame:
    """Fleet totals in one row."""
    shown = ("ACTIVE", "CHARGING", "LOW POWER", "OVERHEATING", "OFFLINE", "DEAD")
    counts = [F.count_if(F.col("status") == s).alias(s.lower().replace(" ", "_")) for s in shown]
    mean = F.coalesce(F.format_string("%.1f", F.avg("battery")), F.lit("0.0"))
    empty = F.count(F.lit(1)) == 0
    return snapshot.agg(
        F.count(F.lit(1)).alias("total"), *counts, F.when(empty, "0.0").otherwise(mean).alias("average_battery")
    )


def status_counts(snapshot: DataFrame) -> DataFrame:
    status = F.when(S.is_blank(F.col("status")), "UNKNOWN").otherwise(F.col("status"))
    return snapshot.groupBy(status.alias("name")).agg(F.count(F.lit(1)).alias("value"))


def search_robots(snapshot: DataFrame, query: str | None) -> DataFrame:
    """Case-insensitive substring search over id, status and mission."""
    if not query:
        return snapshot
    haystack = F.concat_ws(
        " ",
        F.col("robot_id").cast("string"),
        F.coalesce("status", F.lit("null")),
        F.coalesce("mission_type", F.lit("")),
        F.coalesce("mission_id", F.lit("")),
    )
    return snapshot.filter(F.lower(haystack).contains(query.lower()))


def alert_robots(snapshot: DataFrame) -> DataFrame:
    return snapshot.filter(F.col("status").isin(*K.ALERT_STATUSES))


def map_positions(snapshot: DataFrame) -> DataFrame:
    """Map coordinates of every robot with a usable position."""
    usable = snapshot.filter(S.is_finite(F.col("x")) & S.is_finite(F.col("y")))
    return usable.select("robot_id", S.map_latitude(F.col("y")).alias("lat"), S.map_longitude(F.col("x")).alias("lng"))


def chart_series(snapshot: DataFrame) -> DataFrame:
    return snapshot.select(
        F.concat(F.lit("R"), F.col("robot_id").cast("string")).alias("name"), "battery", "temperature", "speed"
    )


def robot_cards(snapshot: DataFrame, as_of=None) -> DataFrame:
    """The text and gauges shown on one card per robot."""
    now = as_of_column(as_of)
    tones = [S.health_tone(F.col(c)).alias(f"{c}_tone") for c in HEALTH_COLUMNS]
    return snapshot.select(
        "robot_id",
        "status",
        S.format_mission(F.col("mission_id"), F.col("mission_type"), F.col("mission_progress")).alias("mission"),
        S.format_runtime(F.col("runtime_remaining_minutes")).alias("runtime"),
        S.format_last_seen(F.col("timestamp"), now).alias("last_seen"),
        S.format_relative(F.col("timestamp"), now).alias("relative"),
        S.clamp_pct(F.col("battery")).alias("battery_pct"),
        *tones,
    )
