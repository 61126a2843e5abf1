"""The telemetry data model over the given star-schema tables.

Thirty days of `events` are compressed 720-fold into one hour, so that the default windows
(60 s, 180 s, 15 min, 20 min, 1 day) all have an effect at AS_OF.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telespark.session import prepare

AS_OF = datetime(2024, 1, 1, 1, 0, 0, tzinfo=timezone.utc)
EPOCH_MICROS = 1_704_067_200_000_000
COMPRESSION = 720

_TIME = f"timestamp_micros({EPOCH_MICROS} + (unix_micros(cast(ts as timestamp)) - {EPOCH_MICROS}) div {COMPRESSION})"
_CENTS = "cast(round(value * 100) as bigint)"
_K = "cast(get_json_object(props, '$.k') as bigint)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry_from(events: DataFrame) -> DataFrame:
    """Readings derived from rows of `events`, batch or streaming."""
    mission = "event_id % 4 < 3"
    return events.selectExpr(
        "cast(event_id as int) AS id",
        "cast(user_id as int) AS robot_id",
        f"cast({_CENTS} % 10001 as double) / 100D AS battery",
        f"22 + cast({_CENTS} % 7801 as double) / 100D AS temperature",
        "cast(event_id % 221 as double) / 100D AS speed",
        "CASE event_type WHEN 'view' THEN 'ACTIVE' WHEN 'click' THEN 'CHARGING' WHEN 'signup' THEN 'low power' "
        "WHEN 'error' THEN 'OVERHEATING' END AS status",
        f"CASE WHEN {mission} THEN concat('M-', lpad(cast(event_id % 500 as string), 5, '0')) END AS mission_id",
        "CASE event_id % 4 WHEN 0 THEN 'PATROL' WHEN 1 THEN 'DELIVERY' WHEN 2 THEN 'INSPECTION' END AS mission_type",
        f"CASE WHEN {mission} THEN least(100D, cast({_K} as double) * 1.25D) END AS mission_progress",
        "cast(NULL as timestamp) AS mission_start_time",
        "cast(10 + (event_id * 7) % 91 as double) AS battery_health",
        "cast(10 + (event_id * 11) % 91 as double) AS motor_health",
        "CASE WHEN event_id % 17 <> 0 THEN cast(10 + (event_id * 13) % 91 as double) END AS sensor_health",
        "cast(10 + (event_id * 17) % 91 as double) AS network_health",
        "cast((event_id * 13) % 4001 as double) / 100D - 20 AS x",
        "cast((event_id * 29) % 4001 as double) / 100D - 20 AS y",
        f"{_TIME} AS timestamp",
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from(table(spark, sf_dir, "events"))


def robot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type IN ('error', 'signup')").selectExpr(
        "cast(event_id as int) AS id",
        "cast(user_id as int) AS robot_id",
        "CASE event_type WHEN 'error' THEN 'Entered Restricted Zone!' "
        "ELSE concat('Completed PATROL mission M-', lpad(cast(event_id % 500 as string), 5, '0')) END AS message",
        f"{_TIME} AS timestamp",
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands_from(table(spark, sf_dir, "orders"))


def commands_from(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "concat('C-', cast(o_orderkey as string)) AS id",
        "cast(o_custkey % 50 as int) AS robot_id",
        "CASE o_orderkey % 4 WHEN 0 THEN 'RETURN_TO_BASE' WHEN 1 THEN 'EMERGENCY_STOP' WHEN 2 THEN 'RESUME' ELSE 'MOVE_TO' END AS command_type",
        "CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'DISPATCHED' ELSE 'COMPLETED' END AS status",
        "CASE WHEN o_orderkey % 5 < 4 THEN concat('key-', cast(o_orderkey % 997 as string)) END AS idempotency_key",
        "CASE WHEN o_orderkey % 3 <> 0 THEN cast((o_orderkey % 7 - 1) * 30 as int) END AS timeout_seconds",
        f"timestamp_micros({EPOCH_MICROS} + ((o_orderkey * 7919) % 3600) * 1000000) AS created_at",
    )


def command_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return command_updates_from(table(spark, sf_dir, "events"))


def command_updates_from(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS update_id",
        "concat('C-', cast(event_id div 6 as string)) AS command_id",
        f"""CASE WHEN {_K} < 80 THEN
              CASE event_id % 6 WHEN 0 THEN 'DISPATCHED' WHEN 1 THEN 'ACKNOWLEDGED' WHEN 2 THEN 'EXECUTING'
                WHEN 3 THEN 'COMPLETED' WHEN 4 THEN 'COMPLETED' ELSE 'FAILED' END
            ELSE CASE {_K} % 5 WHEN 0 THEN 'CANCELLED' WHEN 1 THEN 'TIMEOUT' WHEN 2 THEN 'ACKNOWLEDGED'
                WHEN 3 THEN 'COMPLETED' ELSE 'BOGUS' END END AS requested_status""",
        f"{_TIME} AS requested_at",
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = "l_quantity <= 2"
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat(l_returnflag, l_linestatus) AS test_name",
        "concat('10.0.0.', cast(l_suppkey % 250 as string)) AS client_ip",
        "l_extendedprice / 100D AS latency_ms",
        f"CASE WHEN {failed} THEN 500 ELSE 200 END AS status_code",
        f"CASE WHEN {failed} THEN concat('HTTP 500: shard ', cast(l_linenumber as string)) END AS error",
        f"timestamp_micros({EPOCH_MICROS} + ((l_orderkey * 7919) % 3600) * 1000000) AS requested_at",
        "l_orderkey AS request_id",
        "l_linenumber AS attempt",
    )


def missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('M-', cast(p_partkey as string)) AS mission_id",
        "CASE p_partkey % 3 WHEN 0 THEN 'PATROL' WHEN 1 THEN 'DELIVERY' ELSE 'INSPECTION' END AS mission_type",
        "cast((p_partkey * 37) % 4001 as double) / 100D - 20 AS first_x",
        "cast((p_partkey * 53) % 4001 as double) / 100D - 20 AS first_y",
    )


def _to_json(fields):
    # named_struct: inside a conditional, aliases of nested columns are lost.
    pairs = [part for name, value in fields.items() for part in (F.lit(name), value)]
    return F.to_json(F.named_struct(*pairs), {"ignoreNullFields": "false"})


def feed_from(events: DataFrame) -> DataFrame:
    """Raw JSON messages: readings, events, corrupt and incomplete payloads, some delivered twice."""
    readings = telemetry_from(events).withColumn("received_at", F.col("timestamp"))
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    names = [c for c in readings.columns if c not in ("id", "timestamp", "received_at", "mission_start_time")]
    whole = _to_json({name: F.col(name) for name in names} | {"timestamp": iso})
    event = _to_json({"type": F.lit("EVENT"), "robot_id": F.col("robot_id"), "message": F.lit("Entered zone"), "timestamp": iso})
    staged = readings.select("id", "received_at", whole.alias("whole"), event.alias("event"))
    event_id = F.col("id")
    payload = (
        F.when(event_id % 97 == 0, F.lit("not-json{"))
        .when(event_id % 89 == 0, F.col("event"))
        .when(event_id % 83 == 0, F.regexp_replace("whole", '"battery":[^,]*', '"battery":null'))
        .when(event_id % 79 == 0, F.regexp_replace("whole", '"robot_id":[^,]*,', ""))
        .otherwise(F.col("whole"))
    )
    deliveries = F.when(event_id % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    messages = staged.select(event_id.cast("string").alias("msg_id"), payload.alias("payload"), "received_at", deliveries.alias("deliveries"))
    return messages.withColumn("delivery", F.explode("deliveries")).drop("deliveries", "delivery")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_from(table(spark, sf_dir, "events"))


def command_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies of command requests, some of them malformed."""
    key = F.col("o_orderkey")
    timeout = F.when(key % 13 == 0, F.lit("soon")).otherwise((key % 7 * 30).cast("string"))
    target = F.named_struct(F.lit("x"), key % 50, F.lit("y"), key % 70)
    body = F.to_json(
        F.struct(
            F.when(key % 11 != 0, F.lit("MOVE_TO")).alias("command_type"),
            F.when(key % 3 == 0, target).alias("payload"),
            timeout.alias("timeout_seconds"),
            F.concat(F.lit("key-"), (key % 997).cast("string")).alias("idempotency_key"),
        )
    )
    return table(spark, sf_dir, "orders").select(key.alias("request_id"), body.alias("payload"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command deliveries with repeats: every status request is taken as one delivery of its command."""
    return command_updates(spark, sf_dir).selectExpr(
        "update_id AS delivery_id", "cast(update_id % 3 as int) AS robot_id", "command_id", "requested_at AS delivered_at"
    )
