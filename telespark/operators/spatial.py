"""Geofence detection with hysteresis, and nearest-robot dispatch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark import constants as K
from telespark.functions import scalars as S
from telespark.operators.slices import carry_forward, time_slice
from telespark.session import write_and_read

HOUR_SECONDS, SIX_HOURS = 3_600, 21_600


def hysteresis_state(df: DataFrame, on: Column, off: Column, slice_seconds: int = HOUR_SECONDS) -> DataFrame:
    """Adds `state` and `previous_state` per robot: set by `on`, cleared by `off`, else unchanged; starts cleared."""
    marked = df.withColumns(
        {"_decisive": F.when(on, True).when(off, False), "_slice": time_slice(F.col("timestamp"), slice_seconds)}
    )
    carried = carry_forward(marked, "robot_id", ["timestamp", "id"], "_slice", "_decisive", "state", "previous_state", F.lit(False))
    return carried.drop("_decisive", "_slice")


def thermal_state(df: DataFrame, slice_seconds: int = HOUR_SECONDS) -> DataFrame:
    """Charging-suspension state from reported temperature."""
    temperature = F.col("temperature")
    return hysteresis_state(df, temperature >= K.THERMAL_SUSPEND, temperature <= K.THERMAL_RESUME, slice_seconds)


def geofence_state(df: DataFrame, slice_seconds: int = HOUR_SECONDS) -> DataFrame:
    distance = S.planar_distance(F.col("x"), F.col("y"), F.lit(K.FENCE_X), F.lit(K.FENCE_Y))
    return hysteresis_state(df, distance < K.FENCE_ENTER, distance > K.FENCE_EXIT, slice_seconds)


def geofence_entries(df: DataFrame, slice_seconds: int = HOUR_SECONDS) -> DataFrame:
    """Readings at which a robot comes to be inside the fence."""
    narrow = df.select("id", "robot_id", "x", "y", "timestamp")
    state = geofence_state(narrow, slice_seconds)
    return state.filter(F.col("state") & ~F.col("previous_state")).select("id", "robot_id", "timestamp")


def cooldown_filter(entries: DataFrame, cooldown_seconds: int, slice_seconds: int = SIX_HOURS) -> DataFrame:
    """Entries that alert: each at least `cooldown` after the previous alert of its robot.

    The chain of alerts inside a slice depends on earlier slices only through which entry of the
    slice alerts first, and that one lies within a cooldown of the slice's start or is the first
    after it. Each slice is folded once per such candidate, the slices are chained per robot, and
    every slice is replayed from its true start.
    """
    if cooldown_seconds <= 0:
        return entries
    slice_seconds = max(slice_seconds, cooldown_seconds)
    cooldown = F.lit(cooldown_seconds * 1_000_000)
    timed = entries.select(
        "robot_id", "id", F.unix_micros("timestamp").alias("us"), time_slice(F.col("timestamp"), slice_seconds).alias("slice")
    )
    slices = timed.groupBy("robot_id", "slice").agg(F.array_sort(F.collect_list(F.struct("us", "id"))).alias("times"))

    def last_alert_from(first: Column) -> Column:
        return F.aggregate("times", first, lambda acc, t: F.when(t["us"] >= acc + cooldown, t["us"]).otherwise(acc))

    window_end = F.col("slice") * F.lit(slice_seconds * 1_000_000) + cooldown
    after = F.filter("times", lambda t: t["us"] >= window_end)
    candidates = F.concat(F.filter("times", lambda t: t["us"] < window_end), F.slice(after, 1, 1))
    mapped = slices.select(
        "robot_id",
        "slice",
        F.transform(candidates, lambda c: F.struct(c["us"].alias("first"), last_alert_from(c["us"]).alias("last"))).alias("starts"),
    )
    robots = mapped.groupBy("robot_id").agg(F.array_sort(F.collect_list(F.struct("slice", "starts"))).alias("parts"))

    def chain(acc, part):
        usable = F.filter(part["starts"], lambda s: acc["last"].isNull() | (s["first"] >= acc["last"] + cooldown))
        return F.struct(
            F.coalesce(F.get(usable, F.lit(0))["last"], acc["last"]).alias("last"),
            F.concat(acc["entered"], F.array(F.struct(part["slice"].alias("slice"), acc["last"].alias("last")))).alias("entered"),
        )

    empty = F.struct(
        F.lit(None).cast("bigint").alias("last"), F.array().cast("array<struct<slice:bigint,last:bigint>>").alias("entered")
    )
    entered = robots.select("robot_id", F.inline(F.aggregate("parts", empty, chain)["entered"]))

    def replay(acc, t):
        alerts = acc["last"].isNull() | (t["us"] >= acc["last"] + cooldown)
        return F.struct(
            F.when(alerts, t["us"]).otherwise(acc["last"]).alias("last"),
            F.when(alerts, F.concat(acc["alerts"], F.array(t))).otherwise(acc["alerts"]).alias("alerts"),
        )

    begin = F.struct(F.col("last"), F.array().cast(slices.schema["times"].dataType).alias("alerts"))
    replayed = slices.join(entered, ["robot_id", "slice"]).select(
        "robot_id", F.inline(F.aggregate("times", begin, replay)["alerts"])
    )
    return replayed.select("id", "robot_id", F.timestamp_micros("us").alias("timestamp"))


def geofence_alerts(df: DataFrame, cooldown_seconds: int = K.FENCE_COOLDOWN_SECONDS) -> DataFrame:
    """Fence entries that raise an event; suppressed entries still change the state."""
    alerts = cooldown_filter(geofence_entries(df), cooldown_seconds)
    return alerts.withColumn("message", F.lit(K.FENCE_MESSAGE))


def flag_dead(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "is_dead", S.is_dead(F.col("battery"), F.col("temperature"), F.col("battery_health"), F.col("motor_health"))
    )


def flag_power_thermal(df: DataFrame) -> DataFrame:
    """Power and heat conditions of each reading."""
    battery, status = F.col("battery"), F.coalesce(F.upper("status"), F.lit(""))
    idle = S.is_blank(F.col("mission_id"))
    low = (battery <= K.LOW_POWER_BATTERY) & ~status.isin(*K.NOT_LOW_POWER_STATUSES)
    return df.withColumns(
        {
            "is_low_power": low,
            "aborts_mission": low & (battery <= K.ABORT_BATTERY) & ~idle,
            "needs_top_up": idle & (battery <= K.TOP_UP_BATTERY) & (status != "CHARGING"),
            "is_hot": F.col("temperature") >= K.THERMAL_SUSPEND,
        }
    )


def assignable_robots(snapshot: DataFrame) -> DataFrame:
    """Robots that may take a mission: reachable, idle, in a workable state, with charge left.

    A boolean `returning_to_charge` column is honoured where the snapshot has one.
    """
    status = F.col("status")
    free = snapshot.filter(
        ~status.isin(*K.UNASSIGNABLE_STATUSES, "OFFLINE") & S.is_blank(F.col("mission_id")) & (F.col("battery") > K.MISSION_BATTERY)
    )
    if "returning_to_charge" in snapshot.columns:
        free = free.filter(~F.coalesce("returning_to_charge", F.lit(False)))
    return free


# The pyramid of square cells: side of the smallest in metres, and sides per parent.
LEAF_METRES, FANOUT = 0.01, 8


def _cell(coordinate: Column, level: int) -> Column:
    return F.floor(coordinate / F.lit(LEAF_METRES * FANOUT**level)).cast("bigint")


def _levels(spots: DataFrame) -> int:
    """Levels needed for four cells around the origin to cover every robot."""
    reach = spots.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0.0
    return max(1, math.ceil(math.log(max(reach, LEAF_METRES) / LEAF_METRES, FANOUT) + 1e-6) + 1)


def nearest_robot(missions: DataFrame, robots: DataFrame) -> DataFrame:
    """For each mission the nearest robot (lowest id among equals) and its distance.

    A search down a pyramid of grid cells: a mission holds a set of occupied cells, each step
    replaces them by their occupied children and drops those that are farther than the farthest
    point of another. No step pairs all missions with all robots.
    """
    found = robots.filter(S.is_finite(F.col("x")) & S.is_finite(F.col("y"))).groupBy("x", "y").agg(F.min("robot_id").alias("robot_id"))
    spots = write_and_read(found, "robot-spots")
    levels = _levels(spots)
    corners = F.array(*[F.struct(F.lit(i).cast("bigint").alias("cx"), F.lit(j).cast("bigint").alias("cy")) for i in (-1, 0) for j in (-1, 0)])
    search = missions.select("mission_id", "first_x", "first_y", F.inline(corners))
    for level in range(levels - 1, -1, -1):
        side = LEAF_METRES * FANOUT**level
        children = spots.select(
            _cell(F.col("x"), level + 1).alias("cx"), _cell(F.col("y"), level + 1).alias("cy"),
            _cell(F.col("x"), level).alias("nx"), _cell(F.col("y"), level).alias("ny"),
        ).distinct()
        low_x, low_y = F.col("nx") * side - F.col("first_x"), F.col("ny") * side - F.col("first_y")
        near = F.hypot(
            F.greatest(F.lit(0.0), low_x, -(low_x + side)), F.greatest(F.lit(0.0), low_y, -(low_y + side))
        )
        far = F.hypot(F.greatest(F.abs(low_x), F.abs(low_x + side)), F.greatest(F.abs(low_y), F.abs(low_y + side)))
        # The slack absorbs rounding at cell borders, so that a tie is never lost.
        bound = F.min("_far").over(Window.partitionBy("mission_id")) * (1 + 1e-9) + 1e-6
        search = (
            search.join(children, ["cx", "cy"])
            .withColumns({"_near": near, "_far": far})
            .withColumn("_bound", bound)
            .filter(F.col("_near") <= F.col("_bound"))
            .select("mission_id", "first_x", "first_y", F.col("nx").alias("cx"), F.col("ny").alias("cy"))
        )
    leaves = spots.withColumns({"cx": _cell(F.col("x"), 0), "cy": _cell(F.col("y"), 0)})
    distance = S.planar_distance(F.col("first_x"), F.col("first_y"), F.col("x"), F.col("y"))
    return (
        search.join(leaves, ["cx", "cy"])
        .groupBy("mission_id")
        .agg(F.min(F.struct(distance.alias("distance"), "robot_id")).alias("pick"))
        .select("mission_id", "pick.robot_id", "pick.distance")
    )


def pick_dispatch_candidates(missions: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The robot each mission would be given, independently of the others."""
    return nearest_robot(missions, assignable_robots(snapshot))
