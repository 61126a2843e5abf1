"""Exact order statistics, summaries and rate limits against brute force."""

import math
import random
import statistics
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from telespark.operators import opslog

T0 = datetime(2026, 7, 22, tzinfo=timezone.utc)
LOG = "test_name string, latency_ms double, status_code int, requested_at timestamp, request_id int, error string"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for i in range(4000):
        name = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "d"])
        latency = rng.choice([round(rng.expovariate(1 / 40), 2), 12.0, 12.5])
        ok = rng.random() > 0.1
        out.append((name, latency, 200 if ok else 500, T0 + timedelta(seconds=rng.randrange(3600)), i, None if ok else f"HTTP 500 {i % 7}"))
    return [*out, ("single", 5.0, 200, T0, 9001, None), ("broken", 5.0, 500, T0, 9002, "down")]


def successes(rows, name):
    return sorted(r[1] for r in rows if r[0] == name and r[2] == 200)


def test_summary(spark, rows):
    got = {r.test_name: r for r in opslog.request_summary(log(spark, rows)).collect()}
    assert got.keys() == {r[0] for r in rows}
    for name, row in got.items():
        s = successes(rows, name)
        total = sum(r[0] == name for r in rows)
        assert (row.total, row.ok, row.failed) == (total, len(s), total - len(s))
        assert row.p50 == (statistics.median(s) if s else 0)
        for p, value in ((0.95, row.p95), (0.99, row.p99)):
            assert value == (s[min(int(len(s) * p), len(s) - 1)] if s else 0)
        assert row.mean == pytest.approx(statistics.mean(s) if s else 0)
    assert (got["single"].rps, got["broken"].error_pct) == (0.0, 100.0)


def test_interpolated_percentiles(spark, rows):
    def interpolate(s, p):
        k = (len(s) - 1) * p
        low, high = math.floor(k), math.ceil(k)
        return s[low] + (s[high] - s[low]) * (k - low)

    for row in opslog.latency_percentiles(log(spark, rows)).collect():
        s = successes(rows, row.test_name)
        want = [interpolate(s, p) for p in (0.5, 0.95, 0.99)] if s else [0.0] * 3
        assert [row.p50, row.p95, row.p99] == pytest.approx(want)


def test_nearest_rank_of_twenty(spark):
    data = [("t", float(i), 200, T0 + timedelta(seconds=i), i, None) for i in range(20)]
    row = opslog.request_summary(log(spark, data)).first()
    assert (row.p50, row.p95, row.p99) == (9.5, 19.0, 19.0)


def test_error_samples_and_ranking(spark, rows):
    got = [r.error for r in opslog.error_samples(log(spark, rows), ["request_id"]).collect()]
    want = set()
    for name in {r[0] for r in rows}:
        want |= {r[5] for r in sorted((r for r in rows if r[0] == name and r[5]), key=lambda r: r[4])[:5]}
    assert got == sorted(want)[:10]
    summary = spark.createDataFrame([("WebSocket x", 9.0), ("a", 1.0), ("b", 3.0), ("Verification", 8.0), ("idle", 0.0)], "test_name string, rps double")
    assert [r.test_name for r in opslog.top_throughput(summary, 5).collect()] == ["b", "a"]


@pytest.mark.parametrize("limit, window", [(3, 60), (10, 7)])
def test_rate_limit(spark, limit, window):
    rng = random.Random(4)
    rows = []
    for i in range(2500):
        client = "hot" if i % 3 == 0 else f"c{rng.randrange(9)}"
        # Whole seconds give equal instants and gaps of exactly one window.
        rows.append((client, T0 + timedelta(seconds=rng.randrange(1500), microseconds=rng.choice([0, 0, 0, 1])), i))
    df = spark.createDataFrame(rows, "client string, requested_at timestamp, id int")
    got = {r.id: (r.prior, r.allowed) for r in opslog.rate_limit_decisions(df, limit, window).collect()}
    want = {}
    for client in {r[0] for r in rows}:
        seen = set()
        for _, at, i in sorted((r for r in rows if r[0] == client), key=lambda r: (r[1], r[2])):
            seen = {t for t in seen if t > at - timedelta(seconds=window)}
            want[i] = (len(seen), len(seen) < limit)
            seen.add(at)
    assert got == want


def test_rate_limit_of_one_busy_client(spark):
    """A client with very many requests in one window is counted in linear time."""
    log = spark.range(300_000).select(F.lit("c").alias("client"), F.timestamp_micros(F.col("id") * 150).alias("requested_at"), "id")
    out = opslog.rate_limit_decisions(log, max_requests=600)
    row = out.agg(F.max("prior").alias("most"), F.count_if("allowed").alias("allowed")).first()
    assert (row.most, row.allowed) == (299_999, 600)
