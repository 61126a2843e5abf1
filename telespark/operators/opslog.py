"""Request-log statistics and sliding-window rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telespark.constants import UNRANKED_TESTS
from telespark.operators.slices import order_statistics, top_n_per_key

OK_STATUS = 200


def _is_ok() -> Column:
    return F.col("status_code") == OK_STATUS


def _nearest_rank(p: float) -> Column:
    return F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1)


def request_summary(log: DataFrame) -> DataFrame:
    """Per test: counts, latency of successful requests, throughput and error share.

    p50 is the median; p95 and p99 are nearest-rank values.
    """
    counts = log.groupBy("test_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_is_ok()).alias("ok"),
        F.count_if(~_is_ok()).alias("failed"),
        F.avg(F.when(_is_ok(), F.col("latency_ms"))).alias("mean"),
        F.max(F.when(_is_ok(), F.col("latency_ms"))).alias("max"),
        ((F.max(F.unix_micros("requested_at")) - F.min(F.unix_micros("requested_at"))) / F.lit(1e6)).alias("duration_s"),
    )
    ranks = {
        "_low": F.floor((F.col("n") - 1) / 2),
        "_high": F.floor(F.col("n") / 2),
        "p95": _nearest_rank(0.95),
        "p99": _nearest_rank(0.99),
    }
    points = order_statistics(log.filter(_is_ok()), "test_name", "latency_ms", ranks)
    zero = F.lit(0.0)
    return counts.join(points, "test_name", "left").select(
        "test_name",
        "total",
        "ok",
        "failed",
        F.coalesce("mean", zero).alias("mean"),
        F.coalesce((F.col("_low") + F.col("_high")) / 2, zero).alias("p50"),
        F.coalesce("p95", zero).alias("p95"),
        F.coalesce("p99", zero).alias("p99"),
        F.coalesce("max", zero).alias("max"),
        "duration_s",
        F.when(F.col("duration_s") > 0, F.col("ok") / F.col("duration_s")).otherwise(zero).alias("rps"),
        (F.lit(100.0) * F.col("failed") / F.col("total")).alias("error_pct"),
    )


def latency_percentiles(log: DataFrame) -> DataFrame:
    """Linearly interpolated p50, p95, p99 with mean and max of successful requests; zeros when there are none."""
    wanted = {"p50": 0.50, "p95": 0.95, "p99": 0.99}

    def place(p):
        return (F.col("n") - 1) * F.lit(p)

    ranks = {f"{name}_{end}": fn(place(p)) for name, p in wanted.items() for end, fn in (("low", F.floor), ("high", F.ceil))}
    ok = log.filter(_is_ok())
    points = order_statistics(ok, "test_name", "latency_ms", ranks)
    counts = log.groupBy("test_name").agg(
        F.count_if(_is_ok()).alias("n"),
        F.avg(F.when(_is_ok(), F.col("latency_ms"))).alias("mean"),
        F.max(F.when(_is_ok(), F.col("latency_ms"))).alias("max"),
    )

    def between(name, p):
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return F.coalesce(low + (high - low) * (place(p) - F.floor(place(p))), F.lit(0.0)).alias(name)

    return counts.join(points, "test_name", "left").select(
        "test_name",
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        *[between(name, p) for name, p in wanted.items()],
        F.coalesce("max", F.lit(0.0)).alias("max"),
    )


def error_samples(log: DataFrame, order: list[str], per_test: int = 5, n: int = 10) -> DataFrame:
    """Distinct messages among the first errors of every test, at most n in all."""
    errors = log.filter(F.col("error").isNotNull())
    first = top_n_per_key(errors, ["test_name"], [F.asc(c) for c in order], per_test)
    return first.select("error").distinct().orderBy("error").limit(n)


def top_throughput(summary: DataFrame, n: int = 5) -> DataFrame:
    """Fastest tests, leaving out socket and verification runs."""
    counted = summary.filter(F.col("rps") > 0)
    for word in UNRANKED_TESTS:
        counted = counted.filter(~F.col("test_name").contains(word))
    return counted.orderBy(F.desc("rps"), F.asc("test_name")).limit(n)


def rate_limit_decisions(
    log: DataFrame, max_requests: int = 600, window_seconds: int = 60,
    client: str = "client", ts: str = "requested_at", id_column: str = "id",
) -> DataFrame:
    """Each request with `prior` (requests of its client in the open window before it) and `allowed`.

    Rejected requests count too; requests at one instant are one entry of the window, which the
    later ones of them already see. An instant enters the count right after itself and leaves it a window later: a running
    sum of these steps counts what the window holds, in time that grows with the requests, however many a window has. Time is cut
    into window-long slices, whose sums are carried on, so a client is never handled by one task as a whole.
    """
    micros = window_seconds * 1_000_000
    requests = log.select(client, F.unix_micros(ts).alias("_us"), F.lit(1).alias("_kind"), F.lit(0).alias("_step"), ts, id_column)
    instants = requests.select(client, "_us").distinct()
    none = [F.lit(None).cast(log.schema[c].dataType).alias(c) for c in (ts, id_column)]
    # At one time, leaving comes before the requests and entering after them.
    leaving = instants.select(client, F.col("_us") + micros, F.lit(0), F.lit(-1), *none)
    entering = instants.select(client, "_us", F.lit(2), F.lit(1), *none)
    steps = requests.union(leaving).union(entering).withColumn("_slice", F.floor(F.col("_us") / micros))
    in_order = Window.partitionBy(client, "_slice").orderBy("_us", "_kind", id_column)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    repeat = F.coalesce((F.lag("_us").over(in_order) == F.col("_us")) & (F.lag("_kind").over(in_order) == 1), F.lit(False))
    counted = steps.withColumn("_seen", F.sum("_step").over(so_far)).withColumn("_repeat", repeat).where("_kind = 1")
    earlier = Window.partitionBy(client).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.groupBy(client, "_slice").agg(F.sum("_step").alias("_sum"))
    carried = sums.select(F.col(client).alias("_client"), F.col("_slice").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    joined = counted.join(carried, F.col(client).eqNullSafe(F.col("_client")) & (F.col("_slice") == F.col("_at")))
    prior = (F.col("_seen") + F.col("_carried") + F.col("_repeat").cast("int")).cast("bigint")
    return joined.withColumn("prior", prior).select(client, ts, id_column, "prior", (F.col("prior") < max_requests).alias("allowed"))
