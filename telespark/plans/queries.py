"""Every operator as a named query over the given tables: name -> f(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from telespark import constants as K
from telespark.functions import scalars as S
from telespark.operators import analytics, commands, decode, latest, live, opslog, spatial, status
from telespark.plans import stream_queries
from telespark.schemas import HEALTH_COLUMNS
from telespark.session import scratch_dir
from telespark.sources import fixtures as fx
from telespark.sources import tables

AS_OF = fx.AS_OF
RETENTION_AS_OF = AS_OF + timedelta(hours=23, minutes=30)  # cutoff in the middle of the data


def _now():
    return F.lit(AS_OF)


def _iso(*names):
    return {n: S.iso_utc(F.col(n)) for n in names}


def _telemetry(spark, sf):
    return fx.telemetry(spark, sf)


def _snapshot(spark, sf):
    return status.fleet_snapshot(fx.telemetry(spark, sf), AS_OF)


def _latest(spark, sf):
    return latest.active_latest(fx.telemetry(spark, sf), AS_OF)


# ── sources, decoding, sinks ──

def read_telemetry(spark, sf):
    path = scratch_dir(spark, "telemetry")
    tables.append_telemetry(_telemetry(spark, sf), path)
    return tables.read_telemetry(spark, path).drop("dt").withColumns(_iso("timestamp", "mission_start_time"))


def read_events(spark, sf):
    path = scratch_dir(spark, "events")
    tables.append_events(fx.robot_events(spark, sf), path)
    return tables.read_events(spark, path).drop("dt").withColumns(_iso("timestamp"))


def read_commands(spark, sf):
    path = scratch_dir(spark, "commands")
    fx.commands(spark, sf).write.json(path)
    read = tables.read_commands(spark, path, "json")
    return read.select("id", "robot_id", "command_type", "status", "idempotency_key", "timeout_seconds", "created_at").withColumns(
        _iso("created_at")
    )


def decode_messages(spark, sf):
    return decode.decode_messages(fx.feed(spark, sf)).select("msg_id", "kind")


def normalize_telemetry(spark, sf):
    rows = decode.normalize_telemetry(decode.telemetry_messages(fx.feed(spark, sf)), AS_OF)
    return rows.drop("received_at").withColumns(_iso("timestamp", "mission_start_time"))


def _verdicts(key, judged):
    return judged.select(key, F.coalesce("reason", F.lit("ok")).alias("reason"))


def validate_telemetry(spark, sf):
    return _verdicts("msg_id", decode.judge_telemetry(fx.feed(spark, sf)))


def validate_telemetry_rejected(spark, sf):
    return decode.validate_telemetry(fx.feed(spark, sf))[1].select("msg_id", "reason")


def validate_events(spark, sf):
    return _verdicts("msg_id", decode.judge_events(fx.feed(spark, sf)))


def validate_commands(spark, sf):
    return _verdicts("request_id", decode.judge_commands(fx.command_requests(spark, sf)))


def stamp_ingest_time(spark, sf):
    stamped = decode.stamp_ingest_time(_telemetry(spark, sf).drop("timestamp"), AS_OF)
    return stamped.select("id", S.iso_utc(F.col("timestamp")).alias("timestamp"))


def to_feed_telemetry(spark, sf):
    return live.to_feed(_telemetry(spark, sf), "telemetry").select("robot_id", "payload")


def to_feed_event(spark, sf):
    return live.to_feed(fx.robot_events(spark, sf), "event").select("robot_id", "payload")


def to_feed_command(spark, sf):
    return live.to_feed(_command_changes(spark, sf), "command").select("robot_id", "payload")


# ── projections and scalar rules ──

def recent_since(spark, sf):
    return latest.recent_since(_telemetry(spark, sf), AS_OF, 15 * 60).select("id", "robot_id", S.iso_utc(F.col("timestamp")).alias("timestamp"))


def derive_status(spark, sf):
    age = S.age_seconds(F.col("timestamp"), _now())
    return _telemetry(spark, sf).select("id", S.derive_status(F.col("status"), age).alias("status"))


def health_score(spark, sf):
    score = S.health_score(F.col("battery"), F.col("temperature"), *[F.col(c) for c in HEALTH_COLUMNS])
    return _telemetry(spark, sf).select("id", score.alias("health_score"))


def bucket_label(spark, sf):
    return _telemetry(spark, sf).select(
        "id",
        S.bucket_label(F.col("battery"), K.BATTERY_BUCKETS).alias("battery_range"),
        S.bucket_label(F.col("temperature"), K.TEMPERATURE_BUCKETS).alias("temperature_range"),
    )


def iso_utc(spark, sf):
    whole = F.date_trunc("second", "timestamp")
    return _telemetry(spark, sf).select(
        "id", S.iso_utc(F.col("timestamp")).alias("timestamp"), S.iso_utc(whole).alias("whole_second"),
        S.iso_utc(F.col("mission_start_time")).alias("mission_start_time"),
    )


def round_status_columns(spark, sf):
    return status.round_status_columns(_telemetry(spark, sf)).select(
        "id", "battery", "temperature", "speed", "mission_progress", "x", "y", *HEALTH_COLUMNS
    )


def search_robots(spark, sf):
    return status.search_robots(_snapshot(spark, sf), "aCtIvE pat").select("robot_id", "status", "mission_type", "mission_id")


def map_positions(spark, sf):
    mapped = status.map_positions(_snapshot(spark, sf))
    return mapped.select("robot_id", F.round("lat", 7).alias("lat"), F.round("lng", 7).alias("lng"))


def health_tone(spark, sf):
    return _telemetry(spark, sf).select("id", *[S.health_tone(F.col(c)).alias(f"{c}_tone") for c in HEALTH_COLUMNS])


def format_runtime(spark, sf):
    return _snapshot(spark, sf).select("robot_id", S.format_runtime(F.col("runtime_remaining_minutes")).alias("runtime"))


def format_last_seen(spark, sf):
    ts = F.col("timestamp")
    return _telemetry(spark, sf).select(
        "id", S.format_last_seen(ts, _now()).alias("last_seen"), S.format_relative(ts, _now()).alias("relative")
    )


def format_mission(spark, sf):
    text = S.format_mission(F.col("mission_id"), F.col("mission_type"), F.col("mission_progress"))
    return _telemetry(spark, sf).select("id", text.alias("mission"))


def robot_cards(spark, sf):
    return status.robot_cards(_snapshot(spark, sf), AS_OF)


def classify_event(spark, sf):
    return fx.robot_events(spark, sf).select("id", S.classify_event(F.lit("EVENT"), F.col("message")).alias("tone"))


def alert_robots(spark, sf):
    return status.alert_robots(_snapshot(spark, sf)).select("robot_id", "status")


def clamp_pct(spark, sf):
    shifted = F.col("battery") * 2 - 50
    return _telemetry(spark, sf).select("id", F.round(S.clamp_pct(shifted), 2).alias("pct"))


def planar_distance(spark, sf):
    distance = S.planar_distance(F.col("x"), F.col("y"), F.lit(K.FENCE_X), F.lit(K.FENCE_Y))
    return _telemetry(spark, sf).select("id", F.round(distance, 6).alias("distance"))


def flag_dead(spark, sf):
    return spatial.flag_dead(_telemetry(spark, sf)).select("id", "is_dead")


def flag_power_thermal(spark, sf):
    flags = ("is_low_power", "aborts_mission", "needs_top_up", "is_hot")
    return spatial.flag_power_thermal(_telemetry(spark, sf)).select("id", *flags)


def chart_series(spark, sf):
    return status.chart_series(_snapshot(spark, sf))


def _command_columns(df):
    return df.select("id", "robot_id", "command_type", "status", "idempotency_key", S.iso_utc(F.col("created_at")).alias("created_at"))


def find_command(spark, sf):
    return _command_columns(commands.find_command(fx.commands(spark, sf), "C-42"))


def find_by_idempotency_key(spark, sf):
    return _command_columns(commands.find_by_idempotency_key(fx.commands(spark, sf), 0, "key-318"))


# ── joins and key matching ──

def prune_telemetry(spark, sf):
    kept, _ = tables.prune_telemetry(_telemetry(spark, sf), RETENTION_AS_OF)
    return kept.select("id", "robot_id", S.iso_utc(F.col("timestamp")).alias("timestamp"))


def prune_telemetry_deleted(spark, sf):
    return tables.prune_telemetry(_telemetry(spark, sf), RETENTION_AS_OF)[1]


def retention_job(spark, sf):
    path = scratch_dir(spark, "telemetry")
    rows = _telemetry(spark, sf)
    older = rows.withColumns({"id": -F.col("id") - 1, "timestamp": F.col("timestamp") - F.expr("INTERVAL 2 DAYS")})
    tables.append_telemetry(rows.unionByName(older), path)
    tables.retention_job(spark, path, RETENTION_AS_OF)
    return tables.read_telemetry(spark, path).select("id", "robot_id", S.iso_utc(F.col("timestamp")).alias("timestamp"))


def overlay_live(spark, sf):
    readings = _telemetry(spark, sf)
    cut = AS_OF - timedelta(minutes=10)
    snapshot = status.fleet_snapshot(readings.filter(F.col("timestamp") <= F.lit(cut)), cut)
    base = snapshot.select("robot_id", "battery", "status", "mission_id", "runtime_remaining_minutes")
    newest = latest.recent_per_robot(readings, AS_OF, 1, 10)
    keys = F.array(F.lit("battery"), F.lit("mission_id"))
    # Every third message leaves the status out.
    keys = F.when(F.col("id") % 3 == 0, keys).otherwise(F.array_append(keys, F.lit("status")))
    messages = newest.select("robot_id", "battery", "status", "mission_id", keys.alias("present_keys"))
    return live.overlay_live(base, messages)


def pick_dispatch_candidates(spark, sf):
    picks = spatial.pick_dispatch_candidates(fx.missions(spark, sf), _snapshot(spark, sf))
    return picks.select("mission_id", "robot_id", F.round("distance", 6).alias("distance"))


def zero_fill(spark, sf):
    counts = _telemetry(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("count"))
    return analytics.zero_fill(counts, "status", K.STATUS_CATEGORIES)


# ── aggregations ──

def fleet_health_trend(spark, sf):
    return analytics.fleet_health_trend(_telemetry(spark, sf), AS_OF)


def mission_completions(spark, sf):
    return analytics.mission_completions(_telemetry(spark, sf), AS_OF)


def active_latest(spark, sf):
    return _latest(spark, sf).select("id", "robot_id", "battery", "temperature", "status")


def battery_distribution(spark, sf):
    return analytics.battery_distribution(_latest(spark, sf))


def temperature_distribution(spark, sf):
    return analytics.temperature_distribution(_latest(spark, sf))


def status_breakdown(spark, sf):
    return analytics.status_breakdown(_latest(spark, sf))


def fleet_analytics(spark, sf):
    return analytics.explode_analytics(analytics.fleet_analytics(_telemetry(spark, sf), AS_OF))


def fleet_stats(spark, sf):
    return status.fleet_stats(_snapshot(spark, sf))


def status_counts(spark, sf):
    return status.status_counts(_telemetry(spark, sf))


def distinct_robot_ids(spark, sf):
    return analytics.distinct_robot_ids(_telemetry(spark, sf))


def _rounded(df, **digits):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _request_summary(spark, sf):
    return opslog.request_summary(fx.request_log(spark, sf))


def request_summary(spark, sf):
    return _rounded(_request_summary(spark, sf), mean=4, p50=6, p95=6, p99=6, max=6, duration_s=3, rps=6, error_pct=6)


def latency_percentiles(spark, sf):
    return _rounded(opslog.latency_percentiles(fx.request_log(spark, sf)), mean=4, p50=6, p95=6, p99=6, max=6)


def error_samples(spark, sf):
    return opslog.error_samples(fx.request_log(spark, sf), ["request_id", "attempt"])


def top_throughput(spark, sf):
    return _rounded(opslog.top_throughput(_request_summary(spark, sf)).select("test_name", "rps", "p99"), rps=6, p99=6)


# ── windows ──

def recent_per_robot(spark, sf):
    rows = latest.recent_per_robot(_telemetry(spark, sf), AS_OF, 10, 15)
    return rows.select("robot_id", "rn", "id", "battery", S.iso_utc(F.col("timestamp")).alias("timestamp"))


def recent_per_robot_unbounded(spark, sf):
    rows = latest.recent_per_robot(_telemetry(spark, sf), AS_OF, 30, None)
    return rows.select("robot_id", "rn", "id", "battery", S.iso_utc(F.col("timestamp")).alias("timestamp"))


def runtime_remaining(spark, sf):
    return latest.runtime_remaining(latest.recent_per_robot(_telemetry(spark, sf), AS_OF, 30, 15))


def fleet_snapshot(spark, sf):
    return _snapshot(spark, sf).drop("timestamp")


def fleet_status(spark, sf):
    return status.fleet_status(_telemetry(spark, sf), AS_OF)


def fleet_status_page(spark, sf):
    return status.fleet_status(_telemetry(spark, sf), AS_OF, limit=5, skip=5)


def rate_limit_decisions(spark, sf):
    log = _telemetry(spark, sf).selectExpr("robot_id AS client", "timestamp AS requested_at", "id")
    return opslog.rate_limit_decisions(log, max_requests=3).select("client", "id", "prior", "allowed")


# ── sorts, limits ──

def recent_telemetry(spark, sf):
    return tables.recent_telemetry(_telemetry(spark, sf), limit=50, skip=10).withColumns(_iso("timestamp", "mission_start_time"))


def recent_events(spark, sf):
    return tables.recent_events(fx.robot_events(spark, sf), limit=50).withColumns(_iso("timestamp"))


def telemetry_ordered_page(spark, sf):
    """The first 5,000 rows."""
    ordered = tables.telemetry_ordered(_telemetry(spark, sf), K.ORDERED_LIMIT)
    return ordered.select("id", "robot_id", S.iso_utc(F.col("timestamp")).alias("timestamp"))


def telemetry_ordered(spark, sf):
    return tables.telemetry_ordered(_telemetry(spark, sf)).select("id", "robot_id", S.iso_utc(F.col("timestamp")).alias("timestamp"))


def _outgoing(spark, sf):
    return live.unified_feed(_telemetry(spark, sf), fx.robot_events(spark, sf), _command_changes(spark, sf))


def event_log_tail(spark, sf):
    return live.event_log_tail(_outgoing(spark, sf)).select("robot_id", "payload")


# ── feeds ──

def unified_feed(spark, sf):
    return _outgoing(spark, sf).select("robot_id", "payload")


def split_feed(spark, sf):
    return live.route_feed(fx.feed(spark, sf)).select("msg_id", "route")


def dedupe_messages(spark, sf):
    return decode.dedupe_messages(fx.feed(spark, sf)).select("msg_id", S.iso_utc(F.col("received_at")).alias("received_at"))


def coalesce_live(spark, sf):
    flushed = live.coalesce_live(_telemetry(spark, sf))
    return flushed.select("robot_id", S.iso_utc(F.col("flushed_at")).alias("flushed_at"), "id", "battery")


def coalesce_live_minute(spark, sf):
    flushed = live.coalesce_live(_telemetry(spark, sf), "1 minute")
    return flushed.select("robot_id", S.iso_utc(F.col("flushed_at")).alias("flushed_at"), "id", "battery")


# ── command lifecycle ──

def create_commands(spark, sf):
    return commands.create_commands(fx.commands(spark, sf)).select("id", "robot_id", "command_id", "created")


def create_commands_existing(spark, sf):
    """Requests of one type resolved against the stored commands of the other types."""
    rows = fx.commands(spark, sf)
    stored = rows.filter("command_type <> 'MOVE_TO'")
    return commands.create_commands(rows.filter("command_type = 'MOVE_TO'"), stored).select("id", "robot_id", "command_id", "created")


def new_commands(spark, sf):
    created = commands.new_commands(commands.create_commands(fx.commands(spark, sf)))
    return created.select("id", "status", S.iso_utc(F.col("expires_at")).alias("expires_at"))


def with_expiry(spark, sf):
    return commands.with_expiry(fx.commands(spark, sf)).select("id", S.iso_utc(F.col("expires_at")).alias("expires_at"))


def next_pending(spark, sf):
    return commands.next_pending(fx.commands(spark, sf)).select("robot_id", "id", "command_type")


def dispatch_pending(spark, sf):
    sent = commands.dispatch_pending(fx.commands(spark, sf), AS_OF, slice_seconds=600)
    return sent.select("id", "robot_id", "position", "status", S.iso_utc(F.col("dispatched_at")).alias("dispatched_at"))


def dispatch_pending_one_robot(spark, sf):
    return commands.dispatch_pending(fx.commands(spark, sf), AS_OF, robot_id=7).select("id", "position")


def _fresh_commands(spark, sf):
    return fx.commands(spark, sf).withColumn("status", F.lit("PENDING"))


def apply_status_updates(spark, sf):
    after, _ = commands.apply_status_updates(_fresh_commands(spark, sf), fx.command_updates(spark, sf), slice_seconds=600)
    times = ("dispatched_at", "acknowledged_at", "started_at", "completed_at")
    return after.select("id", "status", *[S.iso_utc(F.col(t)).alias(t) for t in times])


def update_outcomes(spark, sf):
    return commands.apply_status_updates(_fresh_commands(spark, sf), fx.command_updates(spark, sf), slice_seconds=600)[1]


def _expired(spark, sf):
    return commands.expire_commands(commands.with_expiry(fx.commands(spark, sf)), AS_OF)


def expire_commands(spark, sf):
    return _expired(spark, sf).select("id", "status", S.iso_utc(F.col("completed_at")).alias("completed_at"), "error_code", "error_message")


def _command_changes(spark, sf):
    """Half of the commands are new; the others may have expired."""
    before = fx.commands(spark, sf).filter("command_type IN ('RETURN_TO_BASE', 'RESUME')")
    return commands.command_change_feed(before, _expired(spark, sf), AS_OF)


def command_change_feed(spark, sf):
    return _command_changes(spark, sf).withColumns(_iso("timestamp"))


def dedupe_deliveries(spark, sf):
    return commands.dedupe_deliveries(fx.deliveries(spark, sf)).select("delivery_id", "robot_id", "command_id")


# ── geofence ──

def hysteresis_thermal(spark, sf):
    return spatial.thermal_state(_telemetry(spark, sf), 600).select("id", "state")


def geofence_state(spark, sf):
    return spatial.geofence_state(_telemetry(spark, sf), 600).select("id", "state", "previous_state")


def geofence_entries(spark, sf):
    return spatial.geofence_entries(_telemetry(spark, sf), 600).select("id", "robot_id", S.iso_utc(F.col("timestamp")).alias("timestamp"))


def geofence_alerts(spark, sf):
    return spatial.geofence_alerts(_telemetry(spark, sf)).select("id", "robot_id", "message", S.iso_utc(F.col("timestamp")).alias("timestamp"))


def geofence_alerts_cooldown(spark, sf):
    entries = spatial.geofence_entries(_telemetry(spark, sf), 600)
    return spatial.cooldown_filter(entries, 900, 1200).select("id", "robot_id")


def all_queries():
    """Public functions of this module, and the streaming ones, by name."""
    here = {
        name: f for name, f in globals().items()
        if callable(f) and not name.startswith("_") and name != "all_queries" and f.__module__ == __name__
    }
    return here | stream_queries.all_queries()
