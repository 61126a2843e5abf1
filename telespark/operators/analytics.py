"""Fleet analytics: health trend, distributions, mission counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telespark import constants as K
from telespark.functions import scalars as S
from telespark.operators.latest import LATEST_MINUTES, as_of_column, is_active, recent_since
from telespark.schemas import HEALTH_COLUMNS

DAY_SECONDS = 86_400
TREND_MINUTES = 20


def minute_averages(df: DataFrame, minute) -> DataFrame:
    metrics = ("battery", "temperature", *HEALTH_COLUMNS)
    return df.groupBy(minute.alias("minute")).agg(*[F.avg(c).alias(c) for c in metrics])


def score_minutes(averages: DataFrame) -> DataFrame:
    score = S.health_score(F.col("battery"), F.col("temperature"), *[F.col(c) for c in HEALTH_COLUMNS])
    return averages.select("minute", score.alias("health_score"))


def fleet_health_trend(df: DataFrame, as_of=None, minutes: int = TREND_MINUTES) -> DataFrame:
    """Health score of the newest `minutes` minutes, oldest first."""
    recent = recent_since(df, as_of, minutes * 60)
    scored = score_minutes(minute_averages(recent, F.date_trunc("minute", "timestamp")))
    newest = scored.orderBy(F.desc("minute")).limit(minutes)
    return newest.orderBy("minute").select(S.iso_utc(F.col("minute")).alias("timestamp"), "health_score")


def zero_fill(counts: DataFrame, key: str, categories, value: str = "count") -> DataFrame:
    """Counts for exactly the given categories: missing ones are 0, unknown ones are dropped."""
    entries = [F.struct(F.lit(i).alias("position"), F.lit(c).alias(key)) for i, c in enumerate(categories)]
    wanted = counts.sparkSession.range(1).select(F.inline(F.array(*entries)))
    known = counts.filter(F.col(key).isin(*categories)).select(key, value)
    return wanted.join(known, key, "left").select("position", key, F.coalesce(value, F.lit(0)).alias(value))


def mission_completions(df: DataFrame, as_of=None) -> DataFrame:
    """Distinct completed missions per type over the last day."""
    done = recent_since(df, as_of, DAY_SECONDS).filter(
        (F.col("mission_progress") >= 100.0) & F.col("mission_type").isin(*K.MISSION_TYPES)
    )
    counts = done.groupBy("mission_type").agg(F.count_distinct("mission_id").alias("count"))
    return zero_fill(counts, "mission_type", K.MISSION_TYPES)


def _tally(section: str, pairs):
    """An array of (section, position, label, count) built from boolean conditions."""
    return [
        F.struct(F.lit(section).alias("section"), F.lit(i).alias("position"), F.lit(label).alias("label"), F.count_if(test).alias("count"))
        for i, (label, test) in enumerate(pairs)
    ]


def _bucket_tests(column: str, buckets):
    value = F.col(column)
    return [(label, (value >= low) & (value < high)) for low, high, label in buckets]


def distributions(latest: DataFrame) -> DataFrame:
    """Battery, temperature and status counts of the latest rows, in one pass and already zero-filled."""
    status = S.reported_status(F.col("status"))
    tallies = (
        _tally("battery_distribution", _bucket_tests("battery", K.BATTERY_BUCKETS))
        + _tally("temperature_distribution", _bucket_tests("temperature", K.TEMPERATURE_BUCKETS))
        + _tally("robot_status_breakdown", [(s, status == s) for s in K.STATUS_CATEGORIES])
    )
    return latest.agg(F.array(*tallies).alias("tallies")).select(F.inline("tallies"))


def _section(latest: DataFrame, name: str, label: str) -> DataFrame:
    rows = distributions(latest).filter(F.col("section") == name)
    return rows.select("position", F.col("label").alias(label), "count")


def battery_distribution(latest: DataFrame) -> DataFrame:
    return _section(latest, "battery_distribution", "range")


def temperature_distribution(latest: DataFrame) -> DataFrame:
    return _section(latest, "temperature_distribution", "range")


def status_breakdown(latest: DataFrame) -> DataFrame:
    return _section(latest, "robot_status_breakdown", "status")


#: Grains of the one aggregation behind fleet_analytics.
_MINUTE, _ROBOT, _MISSION = 0, 1, 2


def _grains(df: DataFrame, as_of=None) -> DataFrame:
    """One row for each minute of the trend, each robot of the latest window and each completed mission of the day, from one scan and one exchange.

    A reading counts in the grains that it belongs to. All states of the aggregation have a fixed width, so it stays a hash aggregation, combined before the
    exchange: the latest reading of a robot is chosen by one number made of its time and id, and its status is a position in the list of categories.
    """
    tag, time = F.col("grain"), F.col("timestamp")
    now = as_of_column(as_of).cast("timestamp")
    newer = lambda seconds: time > now - F.expr(f"INTERVAL {seconds} SECONDS")
    done = (F.col("mission_progress") >= 100.0) & F.col("mission_type").isin(*K.MISSION_TYPES) & F.col("mission_id").isNotNull()
    member = ((tag == _MINUTE) & newer(TREND_MINUTES * 60)) | ((tag == _ROBOT) & newer(LATEST_MINUTES * 60)) | ((tag == _MISSION) & done)
    kind = F.coalesce(*[F.when(F.col("mission_type") == t, i) for i, t in enumerate(K.MISSION_TYPES)]).cast("bigint")
    of = F.when(tag == _MINUTE, F.unix_micros(F.date_trunc("minute", time))).when(tag == _ROBOT, F.col("robot_id").cast("bigint")).otherwise(kind)
    name = F.when(tag == _MISSION, F.col("mission_id")).otherwise(F.lit(""))
    status = S.reported_status(F.col("status"))
    place = F.coalesce(*[F.when(status == s, i) for i, s in enumerate(K.STATUS_CATEGORIES)], F.lit(-1))
    metrics = ("battery", "temperature", *HEALTH_COLUMNS)
    order = F.expr(f"CAST(unix_micros(timestamp) AS decimal(18,0)) * {1 << 63}BD + CAST(id AS decimal(19,0))")
    tags = F.explode(F.array(*[F.lit(t) for t in (_MINUTE, _ROBOT, _MISSION)])).alias("grain")
    rows = recent_since(df, as_of, DAY_SECONDS).select("id", "robot_id", "status", "mission_id", "mission_type", "mission_progress", time, *metrics, tags).where(member)
    rows = rows.select("grain", of.alias("of"), name.alias("name"), time, *metrics, place.alias("status"), F.when(tag == _ROBOT, order).alias("order"))
    last = [F.max_by(c, "order").alias(f"last_{c}") for c in ("battery", "temperature", "status")]
    return rows.groupBy("grain", "of", "name").agg(*[F.avg(c).alias(c) for c in metrics], *last, F.max("timestamp").alias("last_seen"))


def fleet_analytics(df: DataFrame, as_of=None) -> DataFrame:
    """The whole analytics response as one row of arrays (at most 20 + 3 + 16 entries in all)."""
    grains = _grains(df, as_of)
    of = F.col("grain")
    score = S.health_score(F.col("battery"), F.col("temperature"), *[F.col(c) for c in HEALTH_COLUMNS])
    minutes = F.array_sort(F.collect_list(F.when(of == _MINUTE, F.struct(F.col("of").alias("minute"), score.alias("health_score")))))
    newest = F.when(F.size("minutes") > TREND_MINUTES, F.slice("minutes", -TREND_MINUTES, TREND_MINUTES)).otherwise(F.col("minutes"))
    trend = F.transform(newest, lambda m: F.struct(S.iso_utc(F.timestamp_micros(m["minute"])).alias("timestamp"), m["health_score"].alias("health_score")))
    active = (of == _ROBOT) & is_active(F.col("last_seen"), as_of)

    def counts(label, pairs):
        return F.array(*[F.struct(F.lit(name).alias(label), F.count_if(test).alias("count")) for name, test in pairs])

    buckets = lambda column, ranges: [(name, active & test) for name, test in _bucket_tests(column, ranges)]
    return grains.agg(
        minutes.alias("minutes"),
        counts("range", buckets("last_battery", K.BATTERY_BUCKETS)).alias("battery_distribution"),
        counts("range", buckets("last_temperature", K.TEMPERATURE_BUCKETS)).alias("temperature_distribution"),
        counts("mission_type", [(t, (of == _MISSION) & (F.col("of") == i)) for i, t in enumerate(K.MISSION_TYPES)]).alias("mission_completion_count"),
        counts("status", [(s, active & (F.col("last_status") == i)) for i, s in enumerate(K.STATUS_CATEGORIES)]).alias("robot_status_breakdown"),
    ).select(trend.alias("fleet_health_trend"), "battery_distribution", "temperature_distribution", "mission_completion_count", "robot_status_breakdown")


def explode_analytics(response: DataFrame) -> DataFrame:
    """The response as rows of (section, position, label, value)."""

    def rows(section, label, value):
        return F.transform(
            section,
            lambda e, i: F.struct(
                F.lit(section).alias("section"), i.alias("position"), e[label].alias("label"), e[value].cast("double").alias("value")
            ),
        )

    return response.select(
        F.inline(
            F.concat(
                rows("fleet_health_trend", "timestamp", "health_score"),
                rows("battery_distribution", "range", "count"),
                rows("temperature_distribution", "range", "count"),
                rows("mission_completion_count", "mission_type", "count"),
                rows("robot_status_breakdown", "status", "count"),
            )
        )
    )


def distinct_robot_ids(df: DataFrame) -> DataFrame:
    return df.select("robot_id").distinct()
