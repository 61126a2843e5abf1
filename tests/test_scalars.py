"""Boundaries of the scalar rules."""

import math

import pytest
from pyspark.sql import functions as F

from telespark import constants as K
from telespark.functions import scalars as S


def evaluate(spark, schema, rows, column):
    indexed = [(i, *r) for i, r in enumerate(rows)]
    out = spark.createDataFrame(indexed, "i int, " + schema).select("i", column.alias("v")).collect()
    return [r.v for r in sorted(out, key=lambda r: r.i)]


@pytest.mark.parametrize(
    "status, age, expected",
    [
        ("active", 60.0, "ACTIVE"), ("active", 60.000001, "OFFLINE"), ("active", 180.0, "OFFLINE"), ("active", 301.0, "OFFLINE"),
        (None, 60.0, "ACTIVE"), (None, 180.0, "ACTIVE"), (None, 180.5, "OFFLINE"), ("", 100.0, "ACTIVE"), ("", 300.0, "OFFLINE"),
        ("low power", 0.0, "LOW POWER"),
    ],
)
def test_derive_status(spark, status, age, expected):
    assert evaluate(spark, "s string, a double", [(status, age)], S.derive_status(F.col("s"), F.col("a"))) == [expected]


def test_buckets_are_half_open(spark):
    values = [(-0.1,), (0.0,), (19.999,), (20.0,), (40.0,), (55.0,), (79.99,), (80.0,), (100.5,), (101.0,), (None,)]
    got = evaluate(spark, "v double", values, S.bucket_label(F.col("v"), K.BATTERY_BUCKETS))
    assert got == [None, "0-19%", "0-19%", "20-39%", "40-59%", "40-59%", "60-79%", "80-100%", "80-100%", None, None]
    hot = evaluate(spark, "v double", [(39.99,), (40.0,), (55.0,), (84.9,), (85.0,), (199.9,), (200.0,)], S.bucket_label(F.col("v"), K.TEMPERATURE_BUCKETS))
    assert hot == ["0-39C", "40-54C", "55-69C", "70-84C", "85-95C+", "85-95C+", None]


def test_health_score(spark):
    args = [F.col(c) for c in ("b", "t", "h", "m", "s", "n")]
    rows = [(100.0, 50.0, 100.0, 100.0, 100.0, 100.0), (50.0, 65.0, 80.0, 60.0, 70.0, 90.0), (0.0, 300.0, 1.0, 1.0, 1.0, 1.0), (50.0, 65.0, None, 60.0, 70.0, 90.0)]
    got = evaluate(spark, "b double, t double, h double, m double, s double, n double", rows, S.health_score(*args))
    assert got == [85.0, 45.2, 0.0, None]  # 75*.55 + 50*.3 - 10*1.1 = 45.25, half-even


def test_iso_omits_an_empty_fraction(spark):
    rows = [("2024-01-01 00:00:05",), ("2024-01-01 00:00:05.000120",), (None,)]
    got = evaluate(spark, "t string", rows, S.iso_utc(F.col("t").cast("timestamp")))
    assert got == ["2024-01-01T00:00:05Z", "2024-01-01T00:00:05.000120Z", None]


def test_missing_and_zero_health_read_as_full(spark):
    assert evaluate(spark, "h double", [(None,), (0.0,), (12.345,)], S.health_or_full(F.col("h"))) == [100.0, 100.0, 12.34]
    assert evaluate(spark, "x double", [(None,), (-3.14159,)], S.position_or_origin(F.col("x"))) == [0.0, -3.14]


def test_texts(spark):
    assert evaluate(spark, "m double", [(None,), (0.0,), (59.94,), (60.0,), (150.0,)], S.format_runtime(F.col("m"))) == [
        "n/a", "0.0 min", "59.9 min", "1.0 h", "2.5 h"
    ]
    rows = [("M-1", "PATROL", 62.5), ("M-1", "PATROL", None), (None, "PATROL", 3.0), ("M-1", "", 3.0)]
    mission = S.format_mission(F.col("i_"), F.col("t"), F.col("p"))
    assert evaluate(spark, "i_ string, t string, p double", rows, mission) == ["PATROL · 63%", "PATROL · in progress", "Idle", "Idle"]
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    times = [("2024-01-01 01:00:09",), ("2024-01-01 00:59:55.1",), ("2024-01-01 00:59:01",), ("2024-01-01 00:59:00",), ("2023-12-31 23:00:01",), (None,)]
    ts = F.col("t").cast("timestamp")
    assert evaluate(spark, "t string", times, S.format_last_seen(ts, now)) == ["0s ago", "4s ago", "59s ago", "1m ago", "1h ago", "n/a"]
    assert evaluate(spark, "t string", times, S.format_relative(ts, now)) == ["just now", "just now", "59s ago", "1m ago", "1h ago", "--"]


def test_event_tones(spark):
    rows = [("EVENT", "Entered RESTRICTED area"), ("EVENT", "Zone completed"), ("EVENT", "Mission Completed"), ("COMMAND_UPDATE", None), ("EVENT", None), (None, "hi")]
    got = evaluate(spark, "t string, m string", rows, S.classify_event(F.col("t"), F.col("m")))
    assert got == ["warn", "warn", "good", "command", "info", "info"]


def test_clamps_tones_and_flags(spark):
    assert evaluate(spark, "v double", [(-1.0,), (50.0,), (101.0,), (None,), (math.nan,)], S.clamp_pct(F.col("v"))) == [0.0, 50.0, 100.0, 0.0, 0.0]
    assert evaluate(spark, "v double", [(60.0,), (60.1,), (80.0,), (80.1,), (None,)], S.health_tone(F.col("v"))) == ["bad", "warn", "warn", "good", "good"]
    rows = [(5.0, 20.0, 50.0, 50.0), (5.1, 95.0, 50.0, 50.0), (50.0, 20.0, 9.9, None), (50.0, 20.0, None, None), (50.0, 94.9, 10.0, 10.0)]
    dead = S.is_dead(F.col("b"), F.col("t"), F.col("h"), F.col("m"))
    assert evaluate(spark, "b double, t double, h double, m double", rows, dead) == [True, True, True, False, False]
