"""The live feed: envelopes, routing, coalescing and overlay on a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark.functions import payload as P
from telespark.functions import scalars as S
from telespark.schemas import READING_COLUMNS


def _json(*columns):
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _outgoing(df, kind, body):
    return df.select("robot_id", "timestamp", F.lit(kind).alias("kind"), body.alias("payload"))


def telemetry_feed(df: DataFrame) -> DataFrame:
    """Outgoing telemetry messages: (robot_id, timestamp, kind, payload)."""
    shown = [S.iso_utc(F.col(c)).alias(c) if c == "mission_start_time" else F.col(c) for c in READING_COLUMNS]
    return _outgoing(df, "telemetry", _json(*shown, S.iso_utc(F.col("timestamp")).alias("timestamp")))


def event_feed(df: DataFrame) -> DataFrame:
    body = _json(F.lit("EVENT").alias("type"), "robot_id", "message", S.iso_utc(F.col("timestamp")).alias("timestamp"))
    return _outgoing(df, "event", body)


def command_feed(changes: DataFrame) -> DataFrame:
    """Envelopes of a command change log (see commands.command_change_feed)."""
    body = _json(
        "type", "robot_id", "command_type", "status", "command_id", S.iso_utc(F.col("timestamp")).alias("timestamp")
    )
    return _outgoing(changes, "command", body)


FEEDS = {"telemetry": telemetry_feed, "event": event_feed, "command": command_feed}


def to_feed(df: DataFrame, kind: str) -> DataFrame:
    return FEEDS[kind](df)


def unified_feed(telemetry: DataFrame, events: DataFrame, command_changes: DataFrame) -> DataFrame:
    """All producers in one feed."""
    return (
        telemetry_feed(telemetry)
        .unionByName(event_feed(events))
        .unionByName(command_feed(command_changes))
    )


def route_feed(feed: DataFrame) -> DataFrame:
    """Adds `route`: event_log, telemetry or dropped. Robot 0 has no live view."""
    kind = F.coalesce(P.text("type"), F.lit(""))
    robot = P.number("robot_id")
    has_robot = F.coalesce(robot != 0, F.lit(False))
    return P.with_fields(feed).withColumn(
        "route",
        F.when(kind != "", F.when(kind.startswith("COMMAND") | (kind == "EVENT"), "event_log").otherwise("dropped"))
        .when(has_robot & P.has_key("battery"), "telemetry")
        .otherwise("dropped"),
    ).drop(*P.PARSED)


def split_feed(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event log messages, live telemetry messages)."""
    routed = route_feed(feed)
    return (
        routed.filter(F.col("route") == "event_log").drop("route"),
        routed.filter(F.col("route") == "telemetry").drop("route"),
    )


def event_log_tail(feed: DataFrame, n: int = 50) -> DataFrame:
    """Newest n event-log messages, newest first. A feed that names each message's kind is not parsed."""
    log = feed.filter(F.col("kind").isin("event", "command")) if "kind" in feed.columns else split_feed(feed)[0]
    return log.orderBy(F.desc("timestamp"), F.desc("robot_id"), F.desc("payload")).limit(n)


def coalesce_live(feed: DataFrame, interval: str = "100 milliseconds") -> DataFrame:
    """Last reading per robot in every flush interval; works on batch and streaming input."""
    columns = [c for c in feed.columns if c not in ("robot_id",)]
    return (
        feed.groupBy(F.window("timestamp", interval).alias("flush"), "robot_id")
        .agg(F.max_by(F.struct(*columns), F.struct("timestamp", "id")).alias("last"))
        .select(F.col("flush.end").alias("flushed_at"), "robot_id", "last.*")
    )


def overlay_live(snapshot: DataFrame, live: DataFrame, present: str = "present_keys") -> DataFrame:
    """Upsert of live messages (one per robot) over a snapshot.

    `present` lists the keys each message carries: those overwrite, even with NULL; other columns
    keep the snapshot's value. Robots missing from the snapshot are added.
    """
    shared = [c for c in snapshot.columns if c != "robot_id"]
    carried = [c for c in shared if c in live.columns]
    update = live.select("robot_id", F.col(present).alias("_keys"), *[F.col(c).alias(f"_live_{c}") for c in carried])
    joined = snapshot.join(update, "robot_id", "full_outer")

    def pick(c):
        if c not in carried:
            return F.col(c)
        overwritten = F.coalesce(F.array_contains("_keys", c), F.lit(False))
        return F.when(overwritten, F.col(f"_live_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select("robot_id", *[pick(c) for c in shared])
