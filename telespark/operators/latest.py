"""Latest readings per robot and what follows from a short history of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark import constants as K
from telespark.functions import scalars as S
from telespark.operators.slices import top_n_per_key

LATEST_MINUTES = 15


def as_of_column(as_of: datetime | Column | None) -> Column:
    """An explicit instant, or the time of the query."""
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def recent_since(df: DataFrame, as_of, seconds: int, ts: str = "timestamp") -> DataFrame:
    """Rows strictly newer than `as_of - seconds`; day partitions are pruned where the table has them."""
    cutoff = as_of_column(as_of) - F.expr(f"INTERVAL '{int(seconds)}' SECOND")
    if "dt" in df.columns:
        df = df.filter(F.col("dt") >= cutoff.cast("date"))
    return df.filter(F.col(ts) > cutoff)


def recent_per_robot(df: DataFrame, as_of=None, n: int = 30, minutes: int | None = 15) -> DataFrame:
    """Newest n rows per robot, optionally inside a window; `rn` = 1 marks the newest."""
    if minutes is not None:
        df = recent_since(df, as_of, minutes * 60)
    return top_n_per_key(df, ["robot_id"], [F.desc("timestamp"), F.desc("id")], n)


def is_active(last_seen: Column, as_of=None, max_age_seconds: int = K.STALE_ROBOT_SECONDS) -> Column:
    return S.age_seconds(last_seen, as_of_column(as_of)) <= max_age_seconds


def active_latest(df: DataFrame, as_of=None, window_minutes: int = LATEST_MINUTES, max_age_seconds: int = K.STALE_ROBOT_SECONDS) -> DataFrame:
    latest = recent_per_robot(df, as_of, 1, window_minutes).drop("rn")
    return latest.filter(is_active(F.col("timestamp"), as_of, max_age_seconds))


def _runtime(battery, battery_health, oldest_battery, minutes, rows) -> Column:
    drop = oldest_battery - battery
    draining = (rows >= 2) & (minutes > 0) & (drop > 0)
    effective = battery * (battery_health / F.lit(100.0))
    return F.when(draining, F.bround(effective / (drop / minutes), 1))


def runtime_remaining(history: DataFrame) -> DataFrame:
    """Minutes of battery left per robot, from the drain between its oldest and newest kept row."""
    folded = fold_history(history)
    return folded.select("robot_id", "runtime_remaining_minutes")


def fold_history(history: DataFrame) -> DataFrame:
    """One row per robot: its latest reading (`latest`) and the runtime estimate."""
    columns = [c for c in history.columns if c not in ("robot_id", "rn", "dt")]
    position = F.struct("timestamp", "id")
    folded = history.groupBy("robot_id").agg(
        F.max_by(F.struct(*columns), position).alias("latest"),
        F.min_by(F.struct("battery", "timestamp"), position).alias("oldest"),
        F.count(F.lit(1)).alias("rows"),
    )
    minutes = (F.unix_micros("latest.timestamp") - F.unix_micros("oldest.timestamp")) / F.lit(60_000_000.0)
    return folded.select(
        "robot_id",
        "latest",
        _runtime(
            F.col("latest.battery"), F.col("latest.battery_health"), F.col("oldest.battery"), minutes, F.col("rows")
        ).alias("runtime_remaining_minutes"),
    )
