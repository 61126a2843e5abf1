"""Message decoding, validation and normalisation."""

import json
from datetime import datetime, timezone

import pytest

from telespark.operators import decode

AS_OF = datetime(2026, 7, 22, 12, 0, tzinfo=timezone.utc)
READING = {
    "battery": 61.25, "temperature": 44.5, "robot_id": 7, "speed": 0.75, "x": -8.5, "y": 12.25, "status": "ACTIVE", "mission_type": "DELIVERY",
    "mission_id": "M-40213", "mission_progress": 37.5, "sensor_health": 71, "network_health": 64, "motor_health": 83, "battery_health": 77,
}


def messages(spark, payloads):
    rows = [(str(i), p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "msg_id string, payload string")


def by_id(df, column):
    return [r[column] for r in sorted(df.collect(), key=lambda r: int(r.msg_id))]


def test_kinds(spark):
    cases = {
        '{"battery": 1}': "telemetry", '{"battery": null}': "telemetry", '{"type": "EVENT", "battery": 3}': "telemetry",
        '{"type": "EVENT", "robot_id": 5, "message": "Entered zone"}': "event", '{"type": "COMMAND_UPDATE"}': "command",
        '{"x": 1}': "other", "[1, 2]": "other", "5": "other", "<no json>": "corrupt", '{"battery": 1} tail': "corrupt",
        '{"battery": 1}, {"battery": 2}': "corrupt", "": "corrupt", '{"battery": 1, "battery": 2}': "telemetry",
    }
    got = by_id(decode.decode_messages(messages(spark, [*cases, None])), "kind")
    assert got == [*cases.values(), "corrupt"]


def test_defaults_apply_to_absent_keys_only(spark):
    payloads = [{"battery": 1.5}, {"battery": None, "status": None, "robot_id": 3, "speed": 1, "temperature": 2}]
    rows = sorted(decode.normalize_telemetry(messages(spark, payloads), AS_OF).collect(), key=lambda r: r.msg_id)
    assert (rows[0].robot_id, rows[0].battery, rows[0].temperature, rows[0].speed, rows[0].status) == (0, 1.5, 0.0, 0.0, "UNKNOWN")
    assert (rows[1].robot_id, rows[1].battery, rows[1].status) == (3, None, None)
    good, bad = decode.quarantine_nulls(decode.normalize_telemetry(messages(spark, payloads), AS_OF))
    assert [r.msg_id for r in good.collect()] == ["0"]
    assert [(r.msg_id, r.reason) for r in bad.collect()] == [("1", "battery: no usable value")]


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2026-07-22T00:00:00Z", datetime(2026, 7, 22)), ("2026-07-22T02:00:00+02:00", datetime(2026, 7, 22)),
        ("2026-07-22 00:00:00.5", datetime(2026, 7, 22, 0, 0, 0, 500000)), ("2026-07-22", datetime(2026, 7, 22)),
        ("2026", datetime(2026, 7, 22, 12)), ("soon", datetime(2026, 7, 22, 12)), ("", datetime(2026, 7, 22, 12)),
        (None, datetime(2026, 7, 22, 12)), (1234, datetime(2026, 7, 22, 12)),
    ],
)
def test_timestamps(spark, value, expected):
    row = decode.normalize_telemetry(messages(spark, [{"battery": 1, "timestamp": value}]), AS_OF).selectExpr(
        "cast(timestamp AS string) AS t"
    ).first()
    assert row.t == expected.isoformat(sep=" ").rstrip("0").rstrip(".") if expected.microsecond else row.t == str(expected)


def test_mission_start_time_must_be_text(spark):
    values = ["2026-07-22T00:00:00Z", 20260722, "bad", None]
    df = decode.normalize_telemetry(messages(spark, [{"battery": 1, "mission_start_time": v} for v in values]), AS_OF)
    assert [r is not None for r in by_id(df, "mission_start_time")] == [True, False, False, False]


def reasons(split):
    valid, rejected = split
    found = {r.msg_id: r.reason for r in rejected.collect()}
    assert not found.keys() & {r.msg_id for r in valid.collect()}
    return found


def test_telemetry_validation(spark):
    payloads = [
        READING, {k: v for k, v in READING.items() if k != "robot_id"}, READING | {"battery": None}, READING | {"speed": "fast"},
        READING | {"robot_id": 1.5}, READING | {"status": 7}, READING | {"x": "left"}, READING | {"extra": 1}, "[]", "<no json>",
        READING | {"mission_start_time": "never"}, READING | {"battery": "61.25"}, {"robot_id": 1, "battery": 1, "temperature": 1, "speed": 1},
    ]
    assert reasons(decode.validate_telemetry(messages(spark, payloads))) == {
        "1": "robot_id: missing", "2": "battery: invalid", "3": "speed: invalid", "4": "robot_id: invalid", "5": "status: invalid",
        "6": "x: invalid", "8": "payload: not an object", "9": "payload: not an object", "10": "mission_start_time: invalid",
    }


def test_event_and_command_validation(spark):
    events = [{"robot_id": 5, "message": "Entered zone"}, {"robot_id": 5}, {"robot_id": "x", "message": "m"}, {"robot_id": 5, "message": 3}]
    assert reasons(decode.validate_events(messages(spark, events))) == {
        "1": "message: missing", "2": "robot_id: invalid", "3": "message: invalid"
    }
    commands = [
        {"command_type": "RESUME", "payload": {"delay": 3}, "idempotency_key": "again-7f"}, {"payload": {}},
        {"command_type": "A", "payload": [1]}, {"command_type": "A", "timeout_seconds": 1.5}, {"command_type": "A", "idempotency_key": 4},
        {"command_type": "A", "payload": None, "timeout_seconds": None, "idempotency_key": None}, {"command_type": None},
    ]
    assert reasons(decode.validate_commands(messages(spark, commands))) == {
        "1": "command_type: missing", "2": "payload: invalid", "3": "timeout_seconds: invalid", "4": "idempotency_key: invalid",
        "6": "command_type: invalid",
    }


def test_dedupe_keeps_the_first_delivery(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 'second', timestamp'2024-01-01 00:00:02'), ('a', 'first', timestamp'2024-01-01 00:00:01'), "
                   "('b', 'only', timestamp'2024-01-01 00:00:03') AS t(msg_id, payload, received_at)")
    assert sorted((r.msg_id, r.payload) for r in decode.dedupe_messages(df).collect()) == [("a", "first"), ("b", "only")]
