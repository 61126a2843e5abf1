"""Scalar rules on readings. Built-in expressions only, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telespark import constants as K

MICROS_PER_SECOND = 1_000_000


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with a trailing Z; the fraction is written only when there is one."""
    whole = F.unix_micros(ts) % MICROS_PER_SECOND == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )


def age_seconds(ts: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(float(MICROS_PER_SECOND))


def is_blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def derive_status(status: Column, age_s: Column) -> Column:
    """Reported status while it is fresh; silence turns into OFFLINE."""
    return (
        F.when(age_s > K.STALE_ROBOT_SECONDS, F.lit("OFFLINE"))
        .when(is_blank(status), F.lit("ACTIVE"))
        .when(age_s > K.STALE_STATUS_SECONDS, F.lit("OFFLINE"))
        .otherwise(F.upper(status))
    )


def reported_status(status: Column) -> Column:
    return F.when(is_blank(status), F.lit("UNKNOWN")).otherwise(F.upper(status))


def health_score(battery, temperature, battery_health, motor_health, sensor_health, network_health) -> Column:
    """Weighted score in 0..100, one decimal; NULL when any input is NULL."""
    components = (battery_health + motor_health + sensor_health + network_health) / F.lit(4.0)
    heat_penalty = F.greatest(F.lit(0.0), temperature - F.lit(K.SCORE_FREE_DEGREES)) * F.lit(K.SCORE_DEGREE_COST)
    raw = components * F.lit(K.SCORE_HEALTH_WEIGHT) + battery * F.lit(K.SCORE_BATTERY_WEIGHT) - heat_penalty
    known = components.isNotNull() & battery.isNotNull() & temperature.isNotNull()
    return F.when(known, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1))


def bucket_label(value: Column, buckets) -> Column:
    """Label of the half-open bucket that holds the value, NULL outside all of them."""
    label = F.lit(None).cast("string")
    for low, high, name in reversed(buckets):
        label = F.when((value >= low) & (value < high), F.lit(name)).otherwise(label)
    return label


def health_or_full(health: Column) -> Column:
    """Missing and zero both read as full health."""
    return F.when(health.isNull() | (health == 0), F.lit(100.0)).otherwise(F.bround(health, 2))


def position_or_origin(coordinate: Column) -> Column:
    return F.coalesce(F.bround(coordinate, 2), F.lit(0.0))


def clamp_pct(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))
    )


def health_tone(value: Column) -> Column:
    return F.when(value <= K.TONE_BAD, "bad").when(value <= K.TONE_WARN, "warn").otherwise("good")


def format_runtime(minutes: Column) -> Column:
    return (
        F.when(minutes.isNull(), "n/a")
        .when(minutes < 60, F.format_string("%.1f min", minutes))
        .otherwise(F.format_string("%.1f h", minutes / F.lit(60.0)))
    )


def _whole_seconds(ts: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.floor(age_seconds(ts, as_of)))


def _ago(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s ago")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
    )


def format_last_seen(ts: Column, as_of: Column) -> Column:
    return F.when(ts.isNull(), "n/a").otherwise(_ago(_whole_seconds(ts, as_of)))


def format_relative(ts: Column, as_of: Column) -> Column:
    seconds = _whole_seconds(ts, as_of)
    return F.when(ts.isNull(), "--").when(seconds < 5, "just now").otherwise(_ago(seconds))


def format_mission(mission_id: Column, mission_type: Column, progress: Column) -> Column:
    detail = F.when(progress.isNull(), "in progress").otherwise(F.format_string("%.0f%%", progress))
    return F.when(is_blank(mission_id) | is_blank(mission_type), "Idle").otherwise(
        F.concat(mission_type, F.lit(" · "), detail)
    )


def classify_event(event_type: Column, message: Column) -> Column:
    text = F.coalesce(message, F.lit(""))
    return (
        F.when(text.rlike(K.WARN_PATTERN), "warn")
        .when(text.rlike(K.GOOD_PATTERN), "good")
        .when(F.coalesce(event_type.startswith("COMMAND"), F.lit(False)), "command")
        .otherwise("info")
    )


def planar_distance(x: Column, y: Column, centre_x, centre_y) -> Column:
    return F.hypot(x - centre_x, y - centre_y)


def map_latitude(y: Column) -> Column:
    return F.lit(K.MAP_LATITUDE) + y * F.lit(K.DEGREES_PER_METRE)


def map_longitude(x: Column) -> Column:
    return F.lit(K.MAP_LONGITUDE) + x * F.lit(K.DEGREES_PER_METRE)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def is_dead(battery, temperature, battery_health, motor_health) -> Column:
    """Missing component health does not condemn a robot."""
    flags = (
        battery <= K.DEAD_BATTERY, temperature >= K.DEAD_TEMPERATURE, battery_health < K.DEAD_HEALTH, motor_health < K.DEAD_HEALTH,
    )
    dead = F.lit(False)
    for flag in flags:
        dead = dead | F.coalesce(flag, F.lit(False))
    return dead
