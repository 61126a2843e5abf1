"""Equivalent SQL for the named queries, over the same tables."""

from __future__ import annotations

from telespark.sources.fixtures import COMPRESSION, EPOCH_MICROS

_T = f"make_timestamp({EPOCH_MICROS} + (epoch_us(ts) - {EPOCH_MICROS}) // {COMPRESSION})"
_CENTS = "cast(round(value * 100) AS bigint)"
_K = "cast(props->>'$.k' AS bigint)"
_NOW = "TIMESTAMP '2024-01-01 01:00:00'"
_CUTOFF = "TIMESTAMP '2024-01-01 00:30:00'"


def _iso(ts: str) -> str:
    return (
        f"CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%SZ') "
        f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ') END"
    )


def _even(value: str, digits: int) -> str:
    """Half-even rounding of the decimal spelling; on doubles, round_even itself is off by one at near-ties."""
    return f"cast(round_even(cast(cast({value} AS varchar) AS decimal(38, 18)), {digits}) AS double)"


def _blank(text: str) -> str:
    return f"({text} IS NULL OR {text} = '')"


def _derive(status: str, age: str) -> str:
    return (
        f"CASE WHEN {age} > 180 THEN 'OFFLINE' WHEN {_blank(status)} THEN 'ACTIVE' "
        f"WHEN {age} > 60 THEN 'OFFLINE' ELSE upper({status}) END"
    )


def _age(ts: str, now: str = _NOW) -> str:
    return f"((epoch_us({now}) - epoch_us({ts})) / 1000000.0::double)"


def _score(b, t, bh, mh, sh, nh) -> str:
    raw = (
        f"greatest(0::double, least(100::double, (({bh} + {mh} + {sh} + {nh}) / 4.0::double) * 0.55::double "
        f"+ {b} * 0.30::double - greatest(0::double, {t} - 55.0::double) * 1.1::double))"
    )
    return f"CASE WHEN {b} + {t} + {bh} + {mh} + {sh} + {nh} IS NOT NULL THEN {_even(raw, 1)} END"


def _buckets(column: str, buckets) -> str:
    arms = " ".join(f"WHEN {column} >= {lo} AND {column} < {hi} THEN '{label}'" for lo, hi, label in buckets)
    return f"CASE {arms} END"


_BATTERY = ((0, 20, "0-19%"), (20, 40, "20-39%"), (40, 60, "40-59%"), (60, 80, "60-79%"), (80, 101, "80-100%"))
_TEMPERATURE = ((0, 40, "0-39C"), (40, 55, "40-54C"), (55, 70, "55-69C"), (70, 85, "70-84C"), (85, 200, "85-95C+"))
_STATUSES = ("ACTIVE", "LOW POWER", "OVERHEATING", "OFFLINE", "CHARGING", "DEAD")
_MISSIONS = ("PATROL", "DELIVERY", "INSPECTION")
_HEALTHS = ("battery_health", "motor_health", "sensor_health", "network_health")
_TERMINAL = "('COMPLETED', 'FAILED', 'TIMEOUT', 'CANCELLED')"
_READING = (
    "robot_id", "battery", "temperature", "speed", "status", "mission_id", "mission_type", "mission_progress",
    "mission_start_time", "battery_health", "motor_health", "sensor_health", "network_health", "x", "y",
)


def _values(rows, *names) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(names)})"


def _runtime(battery, health, oldest, minutes, rows) -> str:
    return (
        f"CASE WHEN {rows} >= 2 AND {minutes} > 0 AND {oldest} - {battery} > 0 "
        f"THEN {_even(f'{battery} * ({health} / 100.0::double) / (({oldest} - {battery}) / {minutes})', 1)} END"
    )


def _newest(source: str, now: str, n: int, minutes: int | None) -> str:
    where = f"WHERE timestamp > {now} - INTERVAL '{minutes} minutes'" if minutes else ""
    return (
        f"SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY timestamp DESC, id DESC) AS rn "
        f"FROM {source} {where} QUALIFY rn <= {n}"
    )


def _snapshot(history: str, now: str) -> str:
    """Status rows from a CTE of ranked history."""
    health = ", ".join(
        f"CASE WHEN l.{c} IS NULL OR l.{c} = 0 THEN 100.0::double ELSE {_even(f'l.{c}', 2)} END AS {c}" for c in _HEALTHS
    )
    minutes = "((epoch_us(l.timestamp) - epoch_us(o.timestamp)) / 60000000.0::double)"
    return f"""
      SELECT l.robot_id, {_even('l.battery', 2)} AS battery, {_even('l.temperature', 2)} AS temperature,
             {_even('l.speed', 2)} AS speed, {_derive('l.status', _age('l.timestamp', now))} AS status,
             l.mission_id, l.mission_type, {_even('l.mission_progress', 1)} AS mission_progress,
             cast(NULL AS varchar) AS mission_start_time, {_iso('l.timestamp')} AS last_seen,
             {_runtime('l.battery', 'l.battery_health', 'o.battery', minutes, 'o.rn')} AS runtime_remaining_minutes,
             coalesce({_even('l.x', 2)}, 0) AS x, coalesce({_even('l.y', 2)}, 0) AS y, {health}, l.timestamp
      FROM {history} l
      JOIN (SELECT * FROM {history} QUALIFY row_number() OVER (PARTITION BY robot_id ORDER BY rn DESC) = 1) o
        ON o.robot_id = l.robot_id
      WHERE l.rn = 1"""


_CTES = {
    "telemetry": f"""
      SELECT cast(event_id AS int) AS id, cast(user_id AS int) AS robot_id,
             cast({_CENTS} % 10001 AS double) / 100::double AS battery,
             22 + cast({_CENTS} % 7801 AS double) / 100::double AS temperature,
             cast(event_id % 221 AS double) / 100::double AS speed,
             CASE event_type WHEN 'view' THEN 'ACTIVE' WHEN 'click' THEN 'CHARGING' WHEN 'signup' THEN 'low power'
                  WHEN 'error' THEN 'OVERHEATING' END AS status,
             CASE WHEN event_id % 4 < 3 THEN concat('M-', lpad(cast(event_id % 500 AS varchar), 5, '0')) END AS mission_id,
             CASE event_id % 4 WHEN 0 THEN 'PATROL' WHEN 1 THEN 'DELIVERY' WHEN 2 THEN 'INSPECTION' END AS mission_type,
             CASE WHEN event_id % 4 < 3 THEN least(100::double, cast({_K} AS double) * 1.25::double) END AS mission_progress,
             cast(NULL AS timestamp) AS mission_start_time,
             cast(10 + (event_id * 7) % 91 AS double) AS battery_health,
             cast(10 + (event_id * 11) % 91 AS double) AS motor_health,
             CASE WHEN event_id % 17 <> 0 THEN cast(10 + (event_id * 13) % 91 AS double) END AS sensor_health,
             cast(10 + (event_id * 17) % 91 AS double) AS network_health,
             cast((event_id * 13) % 4001 AS double) / 100::double - 20 AS x,
             cast((event_id * 29) % 4001 AS double) / 100::double - 20 AS y,
             {_T} AS timestamp
      FROM events""",
    "robot_events": f"""
      SELECT cast(event_id AS int) AS id, cast(user_id AS int) AS robot_id,
             CASE event_type WHEN 'error' THEN 'Entered Restricted Zone!'
                  ELSE concat('Completed PATROL mission M-', lpad(cast(event_id % 500 AS varchar), 5, '0')) END AS message,
             {_T} AS timestamp
      FROM events WHERE event_type IN ('error', 'signup')""",
    "commands": f"""
      SELECT concat('C-', cast(o_orderkey AS varchar)) AS id, cast(o_custkey % 50 AS int) AS robot_id,
             CASE o_orderkey % 4 WHEN 0 THEN 'RETURN_TO_BASE' WHEN 1 THEN 'EMERGENCY_STOP' WHEN 2 THEN 'RESUME'
                  ELSE 'MOVE_TO' END AS command_type,
             CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'DISPATCHED' ELSE 'COMPLETED' END AS status,
             CASE WHEN o_orderkey % 5 < 4 THEN concat('key-', cast(o_orderkey % 997 AS varchar)) END AS idempotency_key,
             CASE WHEN o_orderkey % 3 <> 0 THEN cast((o_orderkey % 7 - 1) * 30 AS int) END AS timeout_seconds,
             make_timestamp({EPOCH_MICROS} + ((o_orderkey * 7919) % 3600) * 1000000) AS created_at
      FROM orders""",
    "expiring": "SELECT *, CASE WHEN timeout_seconds <> 0 THEN created_at + timeout_seconds * INTERVAL '1 second' END AS expires_at FROM commands",
    "expired": f"""
      SELECT *, (expires_at < {_NOW} AND status NOT IN {_TERMINAL}) IS TRUE AS overdue FROM expiring""",
    "changes": f"""
      SELECT CASE WHEN command_type IN ('RETURN_TO_BASE', 'RESUME') THEN 'COMMAND_UPDATE' ELSE 'COMMAND_CREATED' END AS type,
             robot_id, command_type, CASE WHEN overdue THEN 'TIMEOUT' ELSE status END AS status, id AS command_id,
             {_NOW} AS timestamp
      FROM expired WHERE overdue OR command_type NOT IN ('RETURN_TO_BASE', 'RESUME')""",
    "updates": f"""
      SELECT event_id AS update_id, concat('C-', cast(event_id // 6 AS varchar)) AS command_id,
             CASE WHEN {_K} < 80 THEN
               CASE event_id % 6 WHEN 0 THEN 'DISPATCHED' WHEN 1 THEN 'ACKNOWLEDGED' WHEN 2 THEN 'EXECUTING'
                 WHEN 3 THEN 'COMPLETED' WHEN 4 THEN 'COMPLETED' ELSE 'FAILED' END
             ELSE CASE {_K} % 5 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'ACKNOWLEDGED'
                 WHEN 3 THEN 'COMPLETED' ELSE 'BOGUS' END END AS requested_status,
             {_T} AS requested_at
      FROM events""",
    "requests": f"""
      SELECT concat(l_returnflag, l_linestatus) AS test_name, l_extendedprice / 100::double AS latency_ms,
             CASE WHEN l_quantity <= 2 THEN 500 ELSE 200 END AS status_code,
             CASE WHEN l_quantity <= 2 THEN concat('HTTP 500: shard ', cast(l_linenumber AS varchar)) END AS error,
             make_timestamp({EPOCH_MICROS} + ((l_orderkey * 7919) % 3600) * 1000000) AS requested_at,
             l_orderkey AS request_id, l_linenumber AS attempt
      FROM lineitem""",
    "missions": """
      SELECT concat('M-', cast(p_partkey AS varchar)) AS mission_id,
             cast((p_partkey * 37) % 4001 AS double) / 100::double - 20 AS first_x,
             cast((p_partkey * 53) % 4001 AS double) / 100::double - 20 AS first_y
      FROM part""",
    "deliveries_twice": """
      SELECT t.* FROM telemetry t, (VALUES (1), (2)) AS d(delivery) WHERE d.delivery = 1 OR t.id % 50 = 0""",
    "classified": """
      SELECT *, CASE WHEN id % 97 = 0 THEN 'corrupt' WHEN id % 89 = 0 THEN 'event' WHEN id % 83 = 0 THEN 'null_battery'
                     WHEN id % 79 = 0 THEN 'no_robot' ELSE 'ok' END AS class FROM deliveries_twice""",
    "history": _newest("telemetry", _NOW, 30, 15),
    "latest1": _newest("telemetry", _NOW, 1, 15),
    "active": f"SELECT * FROM latest1 WHERE {_age('timestamp')} <= 180",
    "snapshot": _snapshot("history", _NOW),
    "trend": f"""
      SELECT minute, {_score('b', 't', 'bh', 'mh', 'sh', 'nh')} AS health_score FROM (
        SELECT date_trunc('minute', timestamp) AS minute, avg(battery) AS b, avg(temperature) AS t, avg(battery_health) AS bh,
               avg(motor_health) AS mh, avg(sensor_health) AS sh, avg(network_health) AS nh
        FROM telemetry WHERE timestamp > {_NOW} - INTERVAL '20 minutes' GROUP BY 1 ORDER BY 1 DESC LIMIT 20)""",
    "completed": f"""
      SELECT v.position, v.mission_type, count(DISTINCT t.mission_id) AS count
      FROM {_values(list(enumerate(_MISSIONS)), 'position', 'mission_type')}
      LEFT JOIN telemetry t ON t.mission_type = v.mission_type AND t.mission_progress >= 100
           AND t.timestamp > {_NOW} - INTERVAL '1 day'
      GROUP BY ALL""",
    "battery_d": f"""
      SELECT v.position, v.range, count(a.id) AS count
      FROM {_values([(i, lo, hi, name) for i, (lo, hi, name) in enumerate(_BATTERY)], 'position', 'lo', 'hi', 'range')}
      LEFT JOIN active a ON a.battery >= v.lo AND a.battery < v.hi GROUP BY ALL""",
    "temperature_d": f"""
      SELECT v.position, v.range, count(a.id) AS count
      FROM {_values([(i, lo, hi, name) for i, (lo, hi, name) in enumerate(_TEMPERATURE)], 'position', 'lo', 'hi', 'range')}
      LEFT JOIN active a ON a.temperature >= v.lo AND a.temperature < v.hi GROUP BY ALL""",
    "status_d": f"""
      SELECT v.position, v.status, count(a.id) AS count
      FROM {_values(list(enumerate(_STATUSES)), 'position', 'status')}
      LEFT JOIN active a ON CASE WHEN {_blank('a.status')} THEN 'UNKNOWN' ELSE upper(a.status) END = v.status GROUP BY ALL""",
    "ok_ranked": """
      SELECT test_name, latency_ms, row_number() OVER (PARTITION BY test_name ORDER BY latency_ms) - 1 AS k,
             count(*) OVER (PARTITION BY test_name) AS n
      FROM requests WHERE status_code = 200""",
    "summary": """
      SELECT r.test_name, count(*) AS total, count(*) FILTER (status_code = 200) AS ok,
             count(*) FILTER (status_code <> 200) AS failed,
             round(avg(latency_ms) FILTER (status_code = 200), 4) AS mean,
             round(any_value(q.p50), 6) AS p50, round(any_value(q.p95), 6) AS p95, round(any_value(q.p99), 6) AS p99,
             round(max(latency_ms) FILTER (status_code = 200), 6) AS max,
             round((epoch_us(max(requested_at)) - epoch_us(min(requested_at))) / 1000000.0::double, 3) AS duration_s,
             round(count(*) FILTER (status_code = 200) / ((epoch_us(max(requested_at)) - epoch_us(min(requested_at))) / 1000000.0::double), 6) AS rps,
             round(100.0::double * count(*) FILTER (status_code <> 200) / count(*), 6) AS error_pct
      FROM requests r JOIN (
        SELECT test_name, median(latency_ms) AS p50,
               max(latency_ms) FILTER (k = least(floor(n * 0.95::double), n - 1)) AS p95,
               max(latency_ms) FILTER (k = least(floor(n * 0.99::double), n - 1)) AS p99
        FROM ok_ranked GROUP BY 1) q ON q.test_name = r.test_name
      GROUP BY r.test_name""",
    "decisive_fence": """
      SELECT id, robot_id, timestamp, CASE WHEN d < 5 THEN true WHEN d > 7 THEN false END AS decisive
      FROM (SELECT *, sqrt((x - 15) * (x - 15) + (y - 10) * (y - 10)) AS d FROM telemetry)""",
    "fence": """
      SELECT *, coalesce(last_value(decisive IGNORE NULLS) OVER w, false) AS state,
             coalesce(last_value(decisive IGNORE NULLS) OVER (PARTITION BY robot_id ORDER BY timestamp, id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS previous_state
      FROM decisive_fence
      WINDOW w AS (PARTITION BY robot_id ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "entries": "SELECT id, robot_id, timestamp, row_number() OVER (PARTITION BY robot_id ORDER BY timestamp, id) AS n FROM fence WHERE state AND NOT previous_state",
    "steps": """
      SELECT command_id, update_id, requested_status, requested_at,
             row_number() OVER (PARTITION BY command_id ORDER BY requested_at, update_id) AS n
      FROM updates""",
}

_DEPENDS = {
    "expiring": ["commands"], "expired": ["expiring"], "changes": ["expired"], "deliveries_twice": ["telemetry"],
    "classified": ["deliveries_twice"], "history": ["telemetry"], "latest1": ["telemetry"], "active": ["latest1"],
    "snapshot": ["history"], "trend": ["telemetry"], "completed": ["telemetry"], "battery_d": ["active"],
    "temperature_d": ["active"], "status_d": ["active"], "ok_ranked": ["requests"], "summary": ["ok_ranked"],
    "decisive_fence": ["telemetry"], "fence": ["decisive_fence"], "entries": ["fence"], "steps": ["updates"],
}


def _with(body: str, *roots: str, extra: str = "", recursive: bool = False) -> str:
    order: list[str] = []

    def add(name):
        for parent in _DEPENDS.get(name, []):
            add(parent)
        if name not in order:
            order.append(name)

    for root in roots:
        add(root)
    parts = [f"{name} AS ({_CTES[name]})" for name in order] + ([extra] if extra else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"


def _json(pairs) -> str:
    """JSON text the way both engines print it: doubles with at least one decimal, nulls kept."""
    parts = []
    for name, kind, expr in pairs:
        if kind == "text":
            shown = f"coalesce('\"' || {expr} || '\"', 'null')"
        else:
            shown = f"coalesce(cast({expr} AS varchar), 'null')"
        parts.append(f"'\"{name}\":' || {shown}")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


_TEXT = ("status", "mission_id", "mission_type", "mission_start_time")
_TELEMETRY_JSON = _json([(c, "text" if c in _TEXT else "number", c) for c in _READING] + [("timestamp", "text", f"({_iso('timestamp')})")])
_EVENT_JSON = _json(
    [("type", "text", "'EVENT'"), ("robot_id", "number", "robot_id"), ("message", "text", "message"), ("timestamp", "text", f"({_iso('timestamp')})")]
)
_COMMAND_JSON = _json(
    [("type", "text", "type"), ("robot_id", "number", "robot_id"), ("command_type", "text", "command_type"),
     ("status", "text", "status"), ("command_id", "text", "command_id"), ("timestamp", "text", f"({_iso('timestamp')})")]
)
_OUTGOING = f"""
  SELECT robot_id, timestamp, {_TELEMETRY_JSON} AS payload, false AS logged FROM telemetry
  UNION ALL SELECT robot_id, timestamp, {_EVENT_JSON}, true FROM robot_events
  UNION ALL SELECT robot_id, timestamp, {_COMMAND_JSON}, true FROM changes"""

_NORMAL = ", ".join(
    {
        "robot_id": "CASE WHEN class = 'no_robot' THEN 0 ELSE robot_id END AS robot_id",
        "battery": "CASE WHEN class <> 'null_battery' THEN battery END AS battery",
        "mission_start_time": "cast(NULL AS varchar) AS mission_start_time",
    }.get(c, c)
    for c in _READING
)

_ALLOWED = """
  CASE state WHEN 'PENDING' THEN s.requested_status IN ('DISPATCHED', 'CANCELLED', 'TIMEOUT')
             WHEN 'DISPATCHED' THEN s.requested_status IN ('ACKNOWLEDGED', 'FAILED', 'CANCELLED', 'TIMEOUT')
             WHEN 'ACKNOWLEDGED' THEN s.requested_status IN ('EXECUTING', 'FAILED', 'TIMEOUT', 'COMPLETED')
             WHEN 'EXECUTING' THEN s.requested_status IN ('COMPLETED', 'FAILED', 'TIMEOUT')
             ELSE false END"""
_FOLD = f"""
  fold AS (
    SELECT id AS command_id, 0::bigint AS n, 'PENDING' AS state, cast(NULL AS varchar) AS met, cast(NULL AS bigint) AS update_id,
           cast(NULL AS varchar) AS requested_status, cast(NULL AS timestamp) AS moved_at, false AS accepted
    FROM commands
    UNION ALL
    SELECT f.command_id, s.n, CASE WHEN {_ALLOWED} THEN s.requested_status ELSE state END, state, s.update_id,
           s.requested_status, s.requested_at, {_ALLOWED}
    FROM fold f JOIN steps s ON s.command_id = f.command_id AND s.n = f.n + 1)"""
_ALERTS = """
  alerts AS (
    SELECT id, robot_id, timestamp, n, timestamp AS last_alert, true AS alerted FROM entries WHERE n = 1
    UNION ALL
    SELECT e.id, e.robot_id, e.timestamp, e.n,
           CASE WHEN e.timestamp >= a.last_alert + INTERVAL '{0} seconds' THEN e.timestamp ELSE a.last_alert END,
           e.timestamp >= a.last_alert + INTERVAL '{0} seconds'
    FROM alerts a JOIN entries e ON e.robot_id = a.robot_id AND e.n = a.n + 1)"""


def _ago(seconds: str) -> str:
    return (
        f"CASE WHEN {seconds} < 60 THEN concat({seconds}, 's ago') WHEN {seconds} < 3600 THEN concat({seconds} // 60, 'm ago') "
        f"ELSE concat({seconds} // 3600, 'h ago') END"
    )


_SECONDS = f"greatest(0, cast(floor({_age('timestamp')}) AS bigint))"
_RUNTIME_TEXT = (
    "CASE WHEN runtime_remaining_minutes IS NULL THEN 'n/a' WHEN runtime_remaining_minutes < 60 "
    "THEN printf('%.1f min', round(runtime_remaining_minutes, 1)) ELSE printf('%.1f h', round(runtime_remaining_minutes / 60.0::double, 1)) END"
)
_MISSION_TEXT = (
    f"CASE WHEN {_blank('mission_id')} OR {_blank('mission_type')} THEN 'Idle' ELSE concat(mission_type, ' · ', "
    "CASE WHEN mission_progress IS NULL THEN 'in progress' ELSE concat(cast(round(mission_progress) AS bigint), '%') END) END"
)


def _tone(column: str) -> str:
    return f"CASE WHEN {column} <= 60 THEN 'bad' WHEN {column} <= 80 THEN 'warn' ELSE 'good' END AS {column}_tone"


_TONES = ", ".join(_tone(c) for c in _HEALTHS)
_STATUS_LIST = (
    "robot_id, battery, temperature, speed, status, mission_id, mission_type, mission_progress, mission_start_time, last_seen, "
    "runtime_remaining_minutes, x, y, battery_health, motor_health, sensor_health, network_health"
)
_COMMAND_LIST = f"id, robot_id, command_type, status, idempotency_key, {_iso('created_at')} AS created_at"
_ANALYTICS = f"""
  SELECT 'fleet_health_trend' AS section, cast(row_number() OVER (ORDER BY minute) - 1 AS int) AS position,
         {_iso('minute')} AS label, health_score AS value FROM trend
  UNION ALL SELECT 'battery_distribution', position, range, count::double FROM battery_d
  UNION ALL SELECT 'temperature_distribution', position, range, count::double FROM temperature_d
  UNION ALL SELECT 'mission_completion_count', position, mission_type, count::double FROM completed
  UNION ALL SELECT 'robot_status_breakdown', position, status, count::double FROM status_d"""
_PERCENTILES = ", ".join(f"round(quantile_cont(latency_ms, {p}) FILTER (status_code = 200), 6) AS {name}" for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))


def _flush(micros: int) -> str:
    return f"make_timestamp((epoch_us(timestamp) // {micros} + 1) * {micros})"


def _coalesce(micros: int) -> str:
    return _with(
        f"SELECT robot_id, {_iso('flushed')} AS flushed_at, id, battery FROM (SELECT *, {_flush(micros)} AS flushed FROM telemetry) "
        "QUALIFY row_number() OVER (PARTITION BY robot_id, flushed ORDER BY timestamp DESC, id DESC) = 1",
        "telemetry",
    )


def _alerts(cooldown: int, columns: str) -> str:
    return _with(f"SELECT {columns} FROM alerts WHERE alerted", "entries", extra=_ALERTS.format(cooldown), recursive=True)


def all_oracles() -> dict[str, str]:
    iso_ts = f"{_iso('timestamp')} AS timestamp"
    stored = f"* REPLACE ({_iso('timestamp')} AS timestamp, cast(NULL AS varchar) AS mission_start_time)"
    oracles = {
        # sources, decoding, sinks
        "read_telemetry": _with(f"SELECT {stored} FROM telemetry", "telemetry"),
        "read_events": _with(f"SELECT * REPLACE ({_iso('timestamp')} AS timestamp) FROM robot_events", "robot_events"),
        "read_commands": _with(
            f"SELECT id, robot_id, command_type, status, idempotency_key, timeout_seconds, {_iso('created_at')} AS created_at FROM commands", "commands"
        ),
        "decode_messages": _with(
            "SELECT cast(id AS varchar) AS msg_id, CASE WHEN class IN ('corrupt', 'event') THEN class ELSE 'telemetry' END AS kind FROM classified",
            "classified",
        ),
        "normalize_telemetry": _with(
            f"SELECT cast(id AS varchar) AS msg_id, {_NORMAL}, {_iso('timestamp')} AS timestamp FROM classified WHERE class NOT IN ('corrupt', 'event')",
            "classified",
        ),
        "validate_telemetry": _with(
            "SELECT cast(id AS varchar) AS msg_id, CASE class WHEN 'corrupt' THEN 'payload: not an object' WHEN 'event' THEN 'battery: missing' "
            "WHEN 'null_battery' THEN 'battery: invalid' WHEN 'no_robot' THEN 'robot_id: missing' ELSE 'ok' END AS reason FROM classified",
            "classified",
        ),
        "validate_events": _with(
            "SELECT cast(id AS varchar) AS msg_id, CASE class WHEN 'corrupt' THEN 'payload: not an object' WHEN 'event' THEN 'ok' "
            "WHEN 'no_robot' THEN 'robot_id: missing' ELSE 'message: missing' END AS reason FROM classified",
            "classified",
        ),
        "validate_commands": "SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 11 = 0 THEN 'command_type: missing' "
        "WHEN o_orderkey % 13 = 0 THEN 'timeout_seconds: invalid' ELSE 'ok' END AS reason FROM orders",
        "stamp_ingest_time": _with(f"SELECT id, {_iso(_NOW)} AS timestamp FROM telemetry", "telemetry"),
        "to_feed_telemetry": _with(f"SELECT robot_id, {_TELEMETRY_JSON} AS payload FROM telemetry", "telemetry"),
        "to_feed_event": _with(f"SELECT robot_id, {_EVENT_JSON} AS payload FROM robot_events", "robot_events"),
        "to_feed_command": _with(f"SELECT robot_id, {_COMMAND_JSON} AS payload FROM changes", "changes"),
        # projections and scalar rules
        "recent_since": _with(f"SELECT id, robot_id, {iso_ts} FROM telemetry WHERE timestamp > {_NOW} - INTERVAL '15 minutes'", "telemetry"),
        "derive_status": _with(f"SELECT id, {_derive('status', _age('timestamp'))} AS status FROM telemetry", "telemetry"),
        "health_score": _with(f"SELECT id, {_score('battery', 'temperature', *_HEALTHS)} AS health_score FROM telemetry", "telemetry"),
        "bucket_label": _with(
            f"SELECT id, {_buckets('battery', _BATTERY)} AS battery_range, {_buckets('temperature', _TEMPERATURE)} AS temperature_range FROM telemetry",
            "telemetry",
        ),
        "iso_utc": _with(
            f"SELECT id, {iso_ts}, strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS whole_second, cast(NULL AS varchar) AS mission_start_time FROM telemetry",
            "telemetry",
        ),
        "round_status_columns": _with(
            f"SELECT id, {_even('battery', 2)} AS battery, {_even('temperature', 2)} AS temperature, {_even('speed', 2)} AS speed, "
            f"{_even('mission_progress', 1)} AS mission_progress, coalesce({_even('x', 2)}, 0) AS x, coalesce({_even('y', 2)}, 0) AS y, "
            + ", ".join(f"CASE WHEN coalesce({c}, 0) = 0 THEN 100.0::double ELSE {_even(c, 2)} END AS {c}" for c in _HEALTHS)
            + " FROM telemetry",
            "telemetry",
        ),
        "search_robots": _with(
            "SELECT robot_id, status, mission_type, mission_id FROM snapshot WHERE contains(lower(concat(robot_id, ' ', status, ' ', "
            "coalesce(mission_type, ''), ' ', coalesce(mission_id, ''))), 'active pat')",
            "snapshot",
        ),
        "map_positions": _with(
            "SELECT robot_id, round(37.7749::double + y * 0.0001::double, 7) AS lat, round(-122.4194::double + x * 0.0001::double, 7) AS lng FROM snapshot",
            "snapshot",
        ),
        "health_tone": _with(f"SELECT id, {_TONES} FROM telemetry", "telemetry"),
        "format_runtime": _with(f"SELECT robot_id, {_RUNTIME_TEXT} AS runtime FROM snapshot", "snapshot"),
        "format_last_seen": _with(
            f"SELECT id, {_ago(_SECONDS)} AS last_seen, CASE WHEN {_SECONDS} < 5 THEN 'just now' ELSE {_ago(_SECONDS)} END AS relative FROM telemetry",
            "telemetry",
        ),
        "format_mission": _with(f"SELECT id, {_MISSION_TEXT} AS mission FROM telemetry", "telemetry"),
        "robot_cards": _with(
            f"SELECT robot_id, status, {_MISSION_TEXT} AS mission, {_RUNTIME_TEXT} AS runtime, {_ago(_SECONDS)} AS last_seen, "
            f"CASE WHEN {_SECONDS} < 5 THEN 'just now' ELSE {_ago(_SECONDS)} END AS relative, "
            f"greatest(0::double, least(100::double, battery)) AS battery_pct, {_TONES} FROM snapshot",
            "snapshot",
        ),
        "classify_event": _with(
            "SELECT id, CASE WHEN regexp_matches(message, 'restricted|zone', 'i') THEN 'warn' WHEN regexp_matches(message, 'completed', 'i') "
            "THEN 'good' ELSE 'info' END AS tone FROM robot_events",
            "robot_events",
        ),
        "alert_robots": _with(
            "SELECT robot_id, status FROM snapshot WHERE status IN ('LOW POWER', 'OVERHEATING', 'OFFLINE', 'CHARGING', 'DEAD')", "snapshot"
        ),
        "clamp_pct": _with("SELECT id, round(greatest(0::double, least(100::double, battery * 2 - 50)), 2) AS pct FROM telemetry", "telemetry"),
        "planar_distance": _with(
            "SELECT id, round(sqrt((x - 15) * (x - 15) + (y - 10) * (y - 10)), 6) AS distance FROM telemetry", "telemetry"
        ),
        "flag_dead": _with("SELECT id, battery <= 5 OR temperature >= 95 OR battery_health < 10 OR motor_health < 10 AS is_dead FROM telemetry", "telemetry"),
        "flag_power_thermal": _with(
            "SELECT id, low AS is_low_power, low AND battery <= 25 AND NOT idle AS aborts_mission, "
            "idle AND battery <= 50 AND s <> 'CHARGING' AS needs_top_up, temperature >= 80 AS is_hot FROM ("
            "SELECT *, mission_id IS NULL AS idle, battery <= 30 AND s NOT IN ('CHARGING', 'RETURNING_TO_CHARGE') AS low "
            "FROM (SELECT *, coalesce(upper(status), '') AS s FROM telemetry))",
            "telemetry",
        ),
        "chart_series": _with("SELECT concat('R', robot_id) AS name, battery, temperature, speed FROM snapshot", "snapshot"),
        "find_command": _with(f"SELECT {_COMMAND_LIST} FROM commands WHERE id = 'C-42'", "commands"),
        "find_by_idempotency_key": _with(f"SELECT {_COMMAND_LIST} FROM commands WHERE robot_id = 0 AND idempotency_key = 'key-318'", "commands"),
        # joins and key matching
        "prune_telemetry": _with(f"SELECT id, robot_id, {iso_ts} FROM telemetry WHERE timestamp >= {_CUTOFF}", "telemetry"),
        "prune_telemetry_deleted": _with(f"SELECT count(*) AS deleted FROM telemetry WHERE timestamp < {_CUTOFF}", "telemetry"),
        "retention_job": _with(f"SELECT id, robot_id, {iso_ts} FROM telemetry WHERE timestamp >= {_CUTOFF}", "telemetry"),
        "overlay_live": _with(
            "SELECT coalesce(s.robot_id, m.robot_id) AS robot_id, CASE WHEN m.robot_id IS NULL THEN s.battery ELSE m.battery END AS battery, "
            "CASE WHEN m.robot_id IS NULL OR m.id % 3 = 0 THEN s.status ELSE m.status END AS status, "
            "CASE WHEN m.robot_id IS NULL THEN s.mission_id ELSE m.mission_id END AS mission_id, s.runtime_remaining_minutes "
            f"FROM ({_snapshot('old_history', _NOW + " - INTERVAL '10 minutes'")}) s FULL JOIN ({_newest('telemetry', _NOW, 1, 10)}) m ON m.robot_id = s.robot_id",
            "telemetry",
            extra="old_history AS (SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY timestamp DESC, id DESC) AS rn FROM telemetry "
            f"WHERE timestamp > {_NOW} - INTERVAL '25 minutes' AND timestamp <= {_NOW} - INTERVAL '10 minutes' QUALIFY rn <= 30)",
        ),
        "pick_dispatch_candidates": _with(
            "SELECT mission_id, robot_id, round(d, 6) AS distance FROM (SELECT m.mission_id, r.robot_id, "
            "sqrt((m.first_x - r.x) * (m.first_x - r.x) + (m.first_y - r.y) * (m.first_y - r.y)) AS d FROM missions m, snapshot r "
            f"WHERE r.status NOT IN ('DEAD', 'CHARGING', 'OVERHEATING', 'STOPPED', 'OFFLINE') AND {_blank('r.mission_id')} AND r.battery > 20) "
            "QUALIFY row_number() OVER (PARTITION BY mission_id ORDER BY d, robot_id) = 1",
            "missions", "snapshot",
        ),
        "zero_fill": _with(
            f"SELECT v.position, v.status, count(t.id) AS count FROM {_values(list(enumerate(_STATUSES)), 'position', 'status')} "
            "LEFT JOIN telemetry t ON t.status = v.status GROUP BY ALL",
            "telemetry",
        ),
        # aggregations
        "fleet_health_trend": _with(f"SELECT {_iso('minute')} AS timestamp, health_score FROM trend", "trend"),
        "mission_completions": _with("SELECT * FROM completed", "completed"),
        "active_latest": _with("SELECT id, robot_id, battery, temperature, status FROM active", "active"),
        "battery_distribution": _with("SELECT * FROM battery_d", "battery_d"),
        "temperature_distribution": _with("SELECT * FROM temperature_d", "temperature_d"),
        "status_breakdown": _with("SELECT * FROM status_d", "status_d"),
        "fleet_analytics": _with(_ANALYTICS, "trend", "completed", "battery_d", "temperature_d", "status_d"),
        "fleet_stats": _with(
            "SELECT count(*) AS total, "
            + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower().replace(' ', '_')}" for s in ("ACTIVE", "CHARGING", "LOW POWER", "OVERHEATING", "OFFLINE", "DEAD"))
            + ", coalesce(printf('%.1f', round(avg(battery), 1)), '0.0') AS average_battery FROM snapshot",
            "snapshot",
        ),
        "status_counts": _with(f"SELECT CASE WHEN {_blank('status')} THEN 'UNKNOWN' ELSE status END AS name, count(*) AS value FROM telemetry GROUP BY 1", "telemetry"),
        "distinct_robot_ids": _with("SELECT DISTINCT robot_id FROM telemetry", "telemetry"),
        "request_summary": _with("SELECT * FROM summary", "summary"),
        "latency_percentiles": _with(
            f"SELECT test_name, round(avg(latency_ms) FILTER (status_code = 200), 4) AS mean, {_PERCENTILES}, "
            "round(max(latency_ms) FILTER (status_code = 200), 6) AS max FROM requests GROUP BY 1",
            "requests",
        ),
        "error_samples": _with(
            "SELECT DISTINCT error FROM (SELECT * FROM requests WHERE error IS NOT NULL "
            "QUALIFY row_number() OVER (PARTITION BY test_name ORDER BY request_id, attempt) <= 5) ORDER BY error LIMIT 10",
            "requests",
        ),
        "top_throughput": _with("SELECT test_name, rps, p99 FROM summary WHERE rps > 0 ORDER BY rps DESC, test_name LIMIT 5", "summary"),
        # windows
        "recent_per_robot": _with(f"SELECT robot_id, rn, id, battery, {iso_ts} FROM ({_newest('telemetry', _NOW, 10, 15)})", "telemetry"),
        "recent_per_robot_unbounded": _with(f"SELECT robot_id, rn, id, battery, {iso_ts} FROM ({_newest('telemetry', _NOW, 30, None)})", "telemetry"),
        "runtime_remaining": _with("SELECT robot_id, runtime_remaining_minutes FROM snapshot", "snapshot"),
        "fleet_snapshot": _with(f"SELECT {_STATUS_LIST} FROM snapshot", "snapshot"),
        "fleet_status": _with(f"SELECT {_STATUS_LIST} FROM snapshot ORDER BY robot_id", "snapshot"),
        "fleet_status_page": _with(f"SELECT {_STATUS_LIST} FROM snapshot ORDER BY robot_id LIMIT 5 OFFSET 5", "snapshot"),
        "rate_limit_decisions": _with(
            "SELECT client, id, prior, prior < 3 AS allowed FROM (SELECT t.robot_id AS client, t.id, "
            "count(DISTINCT u.timestamp) + max(CASE WHEN s.id IS NOT NULL THEN 1 ELSE 0 END) AS prior FROM telemetry t "
            "LEFT JOIN telemetry u ON u.robot_id = t.robot_id AND u.timestamp < t.timestamp AND u.timestamp > t.timestamp - INTERVAL '60 seconds' "
            "LEFT JOIN telemetry s ON s.robot_id = t.robot_id AND s.timestamp = t.timestamp AND s.id < t.id GROUP BY 1, 2)",
            "telemetry",
        ),
        # sorts, limits
        "recent_telemetry": _with(f"SELECT {stored} FROM (SELECT * FROM telemetry ORDER BY id DESC LIMIT 50 OFFSET 10)", "telemetry"),
        "recent_events": _with(f"SELECT id, robot_id, message, {iso_ts} FROM (SELECT * FROM robot_events ORDER BY timestamp DESC, id DESC LIMIT 50)", "robot_events"),
        "telemetry_ordered_page": _with(f"SELECT id, robot_id, {iso_ts} FROM (SELECT * FROM telemetry ORDER BY timestamp, id LIMIT 5000)", "telemetry"),
        "telemetry_ordered": _with(f"SELECT id, robot_id, {iso_ts} FROM (SELECT * FROM telemetry ORDER BY timestamp, id)", "telemetry"),
        "event_log_tail": _with(
            f"SELECT robot_id, payload FROM ({_OUTGOING}) WHERE logged ORDER BY timestamp DESC, robot_id DESC, payload DESC LIMIT 50",
            "telemetry", "robot_events", "changes",
        ),
        # feeds
        "unified_feed": _with(f"SELECT robot_id, payload FROM ({_OUTGOING})", "telemetry", "robot_events", "changes"),
        "split_feed": _with(
            "SELECT cast(id AS varchar) AS msg_id, CASE WHEN class = 'event' THEN 'event_log' WHEN class IN ('corrupt', 'no_robot') OR robot_id = 0 "
            "THEN 'dropped' ELSE 'telemetry' END AS route FROM classified",
            "classified",
        ),
        "dedupe_messages": _with(f"SELECT cast(id AS varchar) AS msg_id, {_iso('timestamp')} AS received_at FROM telemetry", "telemetry"),
        "coalesce_live": _coalesce(100_000),
        "coalesce_live_minute": _coalesce(60_000_000),
        # command lifecycle
        "create_commands": _with(
            "SELECT id, robot_id, CASE WHEN idempotency_key IS NULL THEN id ELSE first_value(id) OVER w END AS command_id, "
            "idempotency_key IS NULL OR first_value(id) OVER w = id AS created FROM commands "
            "WINDOW w AS (PARTITION BY robot_id, idempotency_key ORDER BY created_at, id)",
            "commands",
        ),
        "create_commands_existing": _with(
            "SELECT id, robot_id, command_id, created FROM (SELECT *, CASE WHEN idempotency_key IS NULL THEN id ELSE first_value(id) OVER w END AS command_id, "
            "idempotency_key IS NULL OR first_value(id) OVER w = id AS created FROM (SELECT *, command_type = 'MOVE_TO' AS is_request FROM commands) "
            "WINDOW w AS (PARTITION BY robot_id, idempotency_key ORDER BY is_request, created_at, id)) WHERE is_request",
            "commands",
        ),
        "new_commands": _with(
            f"SELECT id, 'PENDING' AS status, {_iso('expires_at')} AS expires_at FROM expiring "
            "QUALIFY idempotency_key IS NULL OR row_number() OVER (PARTITION BY robot_id, idempotency_key ORDER BY created_at, id) = 1",
            "expiring",
        ),
        "with_expiry": _with(f"SELECT id, {_iso('expires_at')} AS expires_at FROM expiring", "expiring"),
        "next_pending": _with(
            "SELECT robot_id, id, command_type FROM commands WHERE status = 'PENDING' QUALIFY row_number() OVER (PARTITION BY robot_id ORDER BY created_at, id) = 1",
            "commands",
        ),
        "dispatch_pending": _with(
            f"SELECT id, robot_id, row_number() OVER (PARTITION BY robot_id ORDER BY created_at, id) AS position, 'DISPATCHED' AS status, "
            f"{_iso(_NOW)} AS dispatched_at FROM commands WHERE status = 'PENDING'",
            "commands",
        ),
        "dispatch_pending_one_robot": _with(
            "SELECT id, row_number() OVER (ORDER BY created_at, id) AS position FROM commands WHERE status = 'PENDING' AND robot_id = 7", "commands"
        ),
        "apply_status_updates": _with(
            "SELECT id, coalesce(max_by(state, n), 'PENDING') AS status, "
            + ", ".join(
                f"{_iso(f'max(CASE WHEN accepted AND {test} THEN moved_at END)')} AS {name}"
                for name, test in (
                    ("dispatched_at", "requested_status = 'DISPATCHED'"), ("acknowledged_at", "requested_status = 'ACKNOWLEDGED'"),
                    ("started_at", "requested_status = 'EXECUTING'"), ("completed_at", f"requested_status IN {_TERMINAL}"),
                )
            )
            + " FROM commands c JOIN fold f ON f.command_id = c.id GROUP BY id",
            "commands", "steps", extra=_FOLD, recursive=True,
        ),
        "update_outcomes": _with(
            "SELECT u.update_id, u.command_id, CASE WHEN f.update_id IS NULL THEN 'Command not found' WHEN met = u.requested_status THEN 'unchanged' "
            f"WHEN met IN {_TERMINAL} THEN concat('Cannot transition from terminal state ', met) WHEN accepted THEN 'accepted' "
            "ELSE concat('Invalid transition from ', met, ' to ', u.requested_status) END AS outcome "
            "FROM updates u LEFT JOIN fold f ON f.update_id = u.update_id",
            "commands", "steps", extra=_FOLD, recursive=True,
        ),
        "expire_commands": _with(
            f"SELECT id, CASE WHEN overdue THEN 'TIMEOUT' ELSE status END AS status, CASE WHEN overdue THEN {_iso(_NOW)} END AS completed_at, "
            "CASE WHEN overdue THEN 'TIMEOUT' END AS error_code, "
            "CASE WHEN overdue THEN concat('Command did not complete within ', timeout_seconds, ' seconds') END AS error_message FROM expired",
            "expired",
        ),
        "command_change_feed": _with(f"SELECT type, robot_id, command_type, status, command_id, {iso_ts} FROM changes", "changes"),
        "dedupe_deliveries": _with(
            "SELECT update_id AS delivery_id, cast(update_id % 3 AS int) AS robot_id, command_id FROM updates "
            "QUALIFY row_number() OVER (PARTITION BY update_id % 3, command_id ORDER BY requested_at, update_id) = 1",
            "updates",
        ),
        # geofence
        "hysteresis_thermal": _with(
            "SELECT id, coalesce(last_value(CASE WHEN temperature >= 80 THEN true WHEN temperature <= 60 THEN false END IGNORE NULLS) "
            "OVER (PARTITION BY robot_id ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS state FROM telemetry",
            "telemetry",
        ),
        "geofence_state": _with("SELECT id, state, previous_state FROM fence", "fence"),
        "geofence_entries": _with(f"SELECT id, robot_id, {iso_ts} FROM entries", "entries"),
        "geofence_alerts": _alerts(45, f"id, robot_id, 'Entered Restricted Zone!' AS message, {iso_ts}"),
        "geofence_alerts_cooldown": _alerts(900, "id, robot_id"),
    }
    oracles["validate_telemetry_rejected"] = f"SELECT * FROM ({oracles['validate_telemetry']}) WHERE reason <> 'ok'"
    return oracles | _stream_oracles(oracles)


def _stream_oracles(batch: dict[str, str]) -> dict[str, str]:
    """What a drained stream must have written."""
    iso_ts = f"{_iso('timestamp')} AS timestamp"
    stored = "SELECT DISTINCT * FROM classified WHERE class IN ('ok', 'no_robot')"
    readings = _with(
        f"SELECT cast(id AS varchar) AS msg_id, CASE WHEN class = 'no_robot' THEN 0 ELSE robot_id END AS robot_id, battery, status, {iso_ts} FROM ({stored})", "classified"
    )
    all_minutes = _CTES["trend"].replace(f"WHERE timestamp > {_NOW} - INTERVAL '20 minutes' GROUP BY 1 ORDER BY 1 DESC LIMIT 20", "GROUP BY 1")
    return {
        "ingest_stream": readings,
        "ingest_then_compact": readings,
        "ingest_stream_rejects": _with(
            "SELECT DISTINCT cast(id AS varchar) AS msg_id, CASE class WHEN 'null_battery' THEN 'battery: no usable value' ELSE 'not a reading: ' || class END AS reason "
            "FROM classified WHERE class IN ('null_battery', 'corrupt')", "classified"
        ),
        "ingest_events": _with(
            f"SELECT DISTINCT cast(id AS varchar) AS msg_id, robot_id, 'Entered zone' AS message, {iso_ts} FROM classified WHERE class = 'event'", "classified"
        ),
        "ingest_metrics": _with(f"SELECT count(*) AS readings_ingested FROM ({stored})", "classified"),
        "dedupe_stream": "SELECT cast(event_id AS varchar) AS msg_id FROM events",
        "health_trend_stream": _with(f"SELECT {_iso('minute')} AS timestamp, health_score FROM all_minutes", "telemetry", extra=f"all_minutes AS ({all_minutes})"),
        "mission_completions_stream": batch["mission_completions"],
        "coalesce_live_stream": batch["coalesce_live"],
        "replace_snapshot": _with("SELECT robot_id, battery, status, runtime_remaining_minutes FROM snapshot", "snapshot"),
        "live_status_stream": _with(
            "SELECT robot_id, 'OFFLINE' AS status, epoch_us(max(timestamp)) AS last_seen_us FROM telemetry GROUP BY 1", "telemetry"
        ),
        "geofence_stream": _alerts(45, "id, robot_id"),
        "status_changes_stream": _with(
            "SELECT robot_id, status, since_us FROM (SELECT *, lag(status) OVER (PARTITION BY robot_id ORDER BY since_us, id, late) AS before FROM shown) "
            "WHERE before IS NULL OR before <> status",
            "telemetry",
            extra="reported AS (SELECT id, robot_id, status, epoch_us(timestamp) AS us, "
            "epoch_us(timestamp) + CASE WHEN coalesce(status, '') = '' THEN 180000000 ELSE 60000000 END AS until, "
            "lead(epoch_us(timestamp)) OVER (PARTITION BY robot_id ORDER BY timestamp, id) AS next_us FROM telemetry), "
            "shown AS (SELECT id, robot_id, CASE WHEN coalesce(status, '') = '' THEN 'ACTIVE' ELSE upper(status) END AS status, us AS since_us, 0 AS late FROM reported "
            "UNION ALL SELECT id, robot_id, 'OFFLINE', until, 1 FROM reported WHERE next_us IS NULL OR next_us > until)",
        ),
        "feed_stream": f"SELECT payload FROM ({batch['to_feed_telemetry']})",
        "command_stream": batch["update_outcomes"],
        "command_table_stream": batch["apply_status_updates"].replace("c JOIN fold", "c LEFT JOIN fold"),
    }
