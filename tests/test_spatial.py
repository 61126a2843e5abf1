"""Hysteresis, cooldown and nearest robot against sequential replays, with one hot robot."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from telespark.operators import spatial

T0 = datetime(2026, 7, 22, tzinfo=timezone.utc)


def tracks(spark, n=3000, seconds=4000, seed=3):
    """Every third reading belongs to robot 1."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        robot = 1 if i % 3 == 0 else rng.randrange(2, 12)
        distance = rng.choice([3.0, 4.99, 5.0, 6.0, 7.0, 7.01, 9.0])
        rows.append((i, robot, 15.0 + distance, 10.0, float(rng.choice([50, 60, 61, 70, 80, 90])), T0 + timedelta(seconds=rng.randrange(seconds))))
    return rows, spark.createDataFrame(rows, "id int, robot_id int, x double, y double, temperature double, timestamp timestamp")


def by_robot(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups


def replay_fence(rows, cooldown):
    entries, alerts = set(), set()
    for track in by_robot(rows).values():
        inside, last = False, None
        for r in track:
            distance = math.hypot(r[2] - 15.0, r[3] - 10.0)
            if not inside and distance < 5.0:
                inside = True
                entries.add(r[0])
                if last is None or r[5] >= last + timedelta(seconds=cooldown):
                    last = r[5]
                    alerts.add(r[0])
            elif inside and distance > 7.0:
                inside = False
    return entries, alerts


@pytest.mark.parametrize("slice_seconds", [13, 300, 100_000])
def test_entries(spark, slice_seconds):
    rows, df = tracks(spark)
    assert {r.id for r in spatial.geofence_entries(df, slice_seconds).collect()} == replay_fence(rows, 0)[0]


@pytest.mark.parametrize("cooldown, slice_seconds", [(45, 45), (45, 200), (45, 86_400), (300, 310), (1, 1), (0, 60)])
def test_cooldown(spark, cooldown, slice_seconds):
    rows, df = tracks(spark)
    got = spatial.cooldown_filter(spatial.geofence_entries(df, 300), cooldown, slice_seconds)
    assert {r.id for r in got.collect()} == replay_fence(rows, cooldown)[1]


def test_alert_message(spark):
    rows, df = tracks(spark, n=300)
    got = spatial.geofence_alerts(df).collect()
    assert {r.id for r in got} == replay_fence(rows, 45)[1] and {r.message for r in got} == {"Entered Restricted Zone!"}


@pytest.mark.parametrize("slice_seconds", [29, 100_000])
def test_thermal_hysteresis(spark, slice_seconds):
    rows, df = tracks(spark)
    want = {}
    for track in by_robot(rows).values():
        state = False
        for r in track:
            state = True if r[4] >= 80 else False if r[4] <= 60 else state
            want[r[0]] = state
    assert {r.id: r.state for r in spatial.thermal_state(df, slice_seconds).collect()} == want


@pytest.mark.parametrize("spread", [0.004, 3.0, 5000.0])
def test_nearest_robot(spark, spread):
    rng = random.Random(5)

    def spot():
        return round(rng.uniform(-spread, spread), 3)

    robots = [(i, spot(), spot()) for i in range(300)] + [(1000 + i, 1.0, 1.0) for i in range(50)]
    missions = [(f"M-{i}", spot(), spot()) for i in range(120)] + [("far", spread * 9, -spread * 7), ("on", 1.0, 1.0)]
    fleet = spark.createDataFrame([*robots, (5000, None, 1.0)], "robot_id int, x double, y double")
    open_missions = spark.createDataFrame(missions, "mission_id string, first_x double, first_y double")
    want = {}
    for m, x, y in missions:
        want[m] = min((math.hypot(x - rx, y - ry), r) for r, rx, ry in robots)
    got = {r.mission_id: (r.distance, r.robot_id) for r in spatial.nearest_robot(open_missions, fleet).collect()}
    assert got.keys() == want.keys()
    for m in want:
        assert got[m][0] == pytest.approx(want[m][0], abs=1e-9)
    assert got["on"] == (0.0, 1000)
    assert sum(got[m][1] == want[m][1] for m in want) == len(want)


def test_no_robot_means_no_pick(spark):
    fleet = spark.createDataFrame([], "robot_id int, x double, y double")
    missions = spark.createDataFrame([("M", 1.0, 1.0)], "mission_id string, first_x double, first_y double")
    assert spatial.nearest_robot(missions, fleet).count() == 0


def test_assignable(spark):
    rows = [
        (1, "ACTIVE", None, 20.1), (2, "ACTIVE", "M", 90.0), (3, "STOPPED", None, 90.0), (4, "ACTIVE", None, 20.0), (5, "OFFLINE", None, 90.0),
        (6, "LOW POWER", "", 25.0),
    ]
    df = spark.createDataFrame(rows, "robot_id int, status string, mission_id string, battery double")
    assert sorted(r.robot_id for r in spatial.assignable_robots(df).collect()) == [1, 6]
    busy = df.withColumn("returning_to_charge", F.col("robot_id") == 6)
    assert [r.robot_id for r in spatial.assignable_robots(busy).collect()] == [1]
