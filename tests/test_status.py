"""Latest rows, runtime estimate and the status table."""

from datetime import datetime, timedelta, timezone

import pytest

from telespark import schemas
from telespark.operators import analytics, latest, live, status

NOW = datetime(2026, 7, 22, 12, 0, tzinfo=timezone.utc)
BASE = {
    "robot_id": 1, "battery": 72.25, "temperature": 41.5, "speed": 0.75, "x": -8.5, "y": 12.25, "status": "ACTIVE", "mission_type": "DELIVERY", "mission_id": "M-40213",
    "mission_progress": 100.0, "mission_start_time": None, "sensor_health": 71.0, "network_health": 64.0, "motor_health": 83.0, "battery_health": 77.0,
}


def readings(spark, rows):
    full = [BASE | {"id": i, "timestamp": NOW} | r for i, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.TELEMETRY) for r in full], schemas.TELEMETRY)


def ago(**kw):
    return NOW - timedelta(**kw)


def test_no_history(spark):
    assert status.fleet_status(readings(spark, []), NOW).count() == 0


def test_single_row_has_no_runtime(spark):
    row = status.fleet_status(readings(spark, [{}]), NOW).first()
    assert (row.status, row.battery, row.runtime_remaining_minutes, row.last_seen) == ("ACTIVE", 72.25, None, "2026-07-22T12:00:00Z")


def test_drain_gives_runtime(spark):
    rows = [{"battery": 100.0, "battery_health": 100.0, "timestamp": ago(minutes=10)}, {"battery": 90.0, "battery_health": 100.0}]
    assert status.fleet_status(readings(spark, rows), NOW).first().runtime_remaining_minutes == 90.0


@pytest.mark.parametrize("first, second", [(80.0, 90.0), (90.0, 90.0)])
def test_charging_has_no_runtime(spark, first, second):
    rows = [{"battery": first, "timestamp": ago(minutes=10)}, {"battery": second}]
    assert status.fleet_status(readings(spark, rows), NOW).first().runtime_remaining_minutes is None


def test_unknown_battery_health_has_no_runtime(spark):
    rows = [{"battery": 95.0, "timestamp": ago(minutes=10)}, {"battery": 90.0, "battery_health": None}]
    row = status.fleet_status(readings(spark, rows), NOW).first()
    assert (row.runtime_remaining_minutes, row.battery_health) == (None, 100.0)


def test_silence_turns_offline_and_then_out_of_the_table(spark):
    rows = [{"robot_id": 1, "timestamp": ago(minutes=10)}, {"robot_id": 2, "timestamp": ago(minutes=15)}, {"robot_id": 3, "timestamp": ago(seconds=899)}]
    got = {r.robot_id: r.status for r in status.fleet_status(readings(spark, rows), NOW).collect()}
    assert got == {1: "OFFLINE", 3: "OFFLINE"}


def test_two_robots_keep_their_status(spark):
    rows = [{"robot_id": 2, "status": "low power", "battery": 8.0}, {"robot_id": 1}, {"robot_id": 3, "status": "OVERHEATING"}]
    got = [(r.robot_id, r.status) for r in status.fleet_status(readings(spark, rows), NOW).collect()]
    assert got == [(1, "ACTIVE"), (2, "LOW POWER"), (3, "OVERHEATING")]


def test_paging(spark):
    df = readings(spark, [{"robot_id": i} for i in range(1, 8)])
    assert [r.robot_id for r in status.fleet_status(df, NOW, limit=3, skip=2).collect()] == [3, 4, 5]
    with pytest.raises(ValueError):
        status.fleet_status(df, NOW, limit=3, skip=-1)
    assert status.fleet_status(df, NOW, limit=1001).count() == status.fleet_status(df, NOW).count()


def test_equal_timestamps_are_ordered_by_id(spark):
    rows = [{"id": 5, "battery": 1.0}, {"id": 9, "battery": 2.0}, {"id": 7, "battery": 3.0}]
    newest = latest.recent_per_robot(readings(spark, rows), NOW, n=2).orderBy("rn").collect()
    assert [(r.id, r.rn) for r in newest] == [(9, 1), (7, 2)]


def test_large_n_matches_plain_ranking(spark):
    df = readings(spark, [{"robot_id": i % 2, "timestamp": ago(seconds=i % 700)} for i in range(4000)])
    got = {(r.robot_id, r.id) for r in latest.recent_per_robot(df, NOW, n=1500).collect()}
    rows = df.collect()
    want = set()
    for robot in (0, 1):
        mine = sorted((r for r in rows if r.robot_id == robot), key=lambda r: (r.timestamp, r.id), reverse=True)
        want |= {(robot, r.id) for r in mine[:1500]}
    assert got == want


def test_active_latest_age_is_inclusive(spark):
    df = readings(spark, [{"robot_id": 1, "timestamp": ago(seconds=180)}, {"robot_id": 2, "timestamp": ago(seconds=180, microseconds=1)}])
    assert [r.robot_id for r in latest.active_latest(df, NOW).collect()] == [1]


def test_empty_analytics_is_zero_filled(spark):
    row = analytics.fleet_analytics(readings(spark, []), NOW).first()
    assert row.fleet_health_trend == []
    assert [(b["range"], b["count"]) for b in row.battery_distribution] == [("0-19%", 0), ("20-39%", 0), ("40-59%", 0), ("60-79%", 0), ("80-100%", 0)]
    assert [b["range"] for b in row.temperature_distribution] == ["0-39C", "40-54C", "55-69C", "70-84C", "85-95C+"]
    assert [(m["mission_type"], m["count"]) for m in row.mission_completion_count] == [("PATROL", 0), ("DELIVERY", 0), ("INSPECTION", 0)]
    assert [s["status"] for s in row.robot_status_breakdown] == ["ACTIVE", "LOW POWER", "OVERHEATING", "OFFLINE", "CHARGING", "DEAD"]


def test_analytics_shape_matches_the_schema(spark):
    shape = analytics.fleet_analytics(readings(spark, [{}]), NOW).schema
    assert [(f.name, f.dataType.simpleString()) for f in shape] == [(f.name, f.dataType.simpleString()) for f in schemas.FLEET_ANALYTICS]


def test_analytics_uses_the_reported_status(spark):
    rows = [{"robot_id": 1, "timestamp": ago(seconds=100)}, {"robot_id": 2, "status": "STOPPED"}, {"robot_id": 3, "status": None}, {"robot_id": 4, "battery": 101.0}]
    row = analytics.fleet_analytics(readings(spark, rows), NOW).first()
    assert {s["status"]: s["count"] for s in row.robot_status_breakdown if s["count"]} == {"ACTIVE": 2}
    assert sum(b["count"] for b in row.battery_distribution) == 3
    assert sum(m["count"] for m in row.mission_completion_count) == 1  # one mission, many readings


def test_trend_keeps_the_newest_minutes(spark):
    df = readings(spark, [{"timestamp": NOW - timedelta(minutes=m, seconds=-1)} for m in range(1, 30)])
    trend = analytics.fleet_health_trend(df, NOW).collect()
    assert len(trend) == 20 and trend[-1].timestamp == "2026-07-22T11:59:00Z" and trend == sorted(trend)


def test_stats_of_an_empty_fleet(spark):
    row = status.fleet_stats(status.fleet_snapshot(readings(spark, []), NOW)).first()
    assert (row.total, row.active, row.average_battery) == (0, 0, "0.0")


def test_search_treats_the_query_as_text(spark):
    snapshot = status.fleet_snapshot(readings(spark, [{"mission_type": "100%_a"}, {"robot_id": 2}]), NOW)
    assert [r.robot_id for r in status.search_robots(snapshot, "0%_A").collect()] == [1]
    assert status.search_robots(snapshot, "").count() == 2


def test_map_drops_unusable_positions(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, float("nan"), 2.0), (4, 1.0, float("inf"))], "robot_id int, x double, y double")
    row = status.map_positions(df).collect()
    assert [r.robot_id for r in row] == [1] and row[0].lat == pytest.approx(37.7751) and row[0].lng == pytest.approx(-122.4193)


def test_overlay_overwrites_present_keys_only(spark):
    snapshot = spark.createDataFrame([(1, 10.0, "ACTIVE"), (2, 20.0, "CHARGING")], "robot_id int, battery double, status string")
    messages = spark.createDataFrame(
        [(1, None, "X", ["battery"]), (3, 5.0, "NEW", ["battery", "status"])],
        "robot_id int, battery double, status string, present_keys array<string>",
    )
    got = {r.robot_id: (r.battery, r.status) for r in live.overlay_live(snapshot, messages).collect()}
    assert got == {1: (None, "ACTIVE"), 2: (20.0, "CHARGING"), 3: (5.0, "NEW")}


def test_routing(spark):
    cases = {
        '{"type":"EVENT","battery":1}': "event_log", '{"type":"COMMAND_UPDATE"}': "event_log", '{"type":"OTHER","robot_id":1,"battery":1}': "dropped",
        '{"robot_id":0,"battery":1}': "dropped", '{"robot_id":4,"battery":null}': "telemetry", '{"robot_id":4}': "dropped", "junk": "dropped",
    }
    df = spark.createDataFrame([(p,) for p in cases], "payload string")
    assert {r.payload: r.route for r in live.route_feed(df).collect()} == cases


def test_event_log_of_a_raw_feed(spark):
    rows = [(i, f'{{"type":"{t}","robot_id":1}}', NOW + timedelta(seconds=i)) for i, t in enumerate(["EVENT", "OTHER", "COMMAND_CREATED", "EVENT"])]
    raw = spark.createDataFrame(rows, "robot_id int, payload string, timestamp timestamp")
    assert [r.robot_id for r in live.event_log_tail(raw, 2).collect()] == [3, 2]
