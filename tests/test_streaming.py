"""Streams over several files and batches: equality with the batch operators, repeats, timers."""

import json
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F

from telespark import constants as K
from telespark import schemas
from telespark.operators import commands, live, spatial
from telespark.session import prepare_streaming
from telespark.sources import fixtures, tables
from telespark.sources.versions import Versions
from telespark.streaming import ingest, stateful, views


def write_messages(spark, path, rows):
    spark.createDataFrame(rows, schemas.MESSAGES).coalesce(1).write.mode("append").parquet(str(path))


def reading(robot, battery, at):
    return json.dumps({"robot_id": robot, "battery": battery, "temperature": 30, "speed": 1, "timestamp": at.isoformat()})


T0 = datetime(2026, 7, 22, tzinfo=timezone.utc)


def test_ingest_keeps_typed_columns_of_a_batch_on_disk(spark, tmp_path, monkeypatch):
    kind, kept = type(spark.range(0)), []
    persist = kind.persist
    monkeypatch.setattr(kind, "persist", lambda df, *level: kept.append((df.schema.simpleString(), *level)) or persist(df, *level))
    rows = [(f"m{i}", reading(i, 50.0, T0), T0) for i in range(4)]
    write, root = ingest.store_batch(str(tmp_path)), str(tmp_path)
    write(spark.createDataFrame(rows, schemas.MESSAGES), 0)
    assert len(kept) == 1  # nothing is filed yet, so that all messages are unseen as they stand
    write(spark.createDataFrame([*rows, ("m9", reading(9, 40.0, T0), T0)], schemas.MESSAGES), 1)
    assert not any("variant" in columns for columns, *_ in kept)
    assert not any(x.useMemory for _, *level in kept for x in level or [StorageLevel.MEMORY_AND_DISK_DESER])
    assert sorted(r.msg_id for r in tables.read_ingested(spark, root).collect()) == ["m0", "m1", "m2", "m3", "m9"]


def test_ingest_over_batches(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / n) for n in ("source", "root", "checkpoint"))
    event = json.dumps({"type": "EVENT", "robot_id": 4, "message": "Entered zone", "timestamp": T0.isoformat()})
    command = json.dumps({"type": "COMMAND_UPDATE", "robot_id": 4, "command_id": "c1", "command_type": "RESUME", "status": "COMPLETED", "timestamp": T0.isoformat()})
    first = [(f"m{i}", reading(i, 50.0, T0), T0 + timedelta(seconds=i)) for i in range(5)]
    first += [("bad", "junk{", T0), ("null", '{"battery":null}', T0), ("event", event, T0), ("no-robot", '{"type":"EVENT"}', T0), ("command", command, T0), ("other", "[1]", T0)]
    write_messages(spark, source, first)
    counts = {}

    def run():
        messages = ingest.read_messages(spark, source, max_files=1)
        ingest.ingest_stream(messages, root, checkpoint, on_metrics=counts.__setitem__).awaitTermination()

    run()
    # Redeliveries of all kinds and one new message arrive later.
    again = [(i, p, at + timedelta(days=3)) for i, p, at in first if i in ("m4", "event", "command", "bad", "null")]
    write_messages(spark, source, [*again, ("m5", reading(5, 50.0, T0), T0 + timedelta(seconds=61))])
    run()
    read = lambda table: tables.read_ingested(spark, root, table).collect()
    assert sorted(r.msg_id for r in read("telemetry")) == [f"m{i}" for i in range(6)]
    aside = sorted((r.msg_id, r.payload, r.reason) for r in read("rejects"))
    assert aside == [
        ("bad", "junk{", "not a reading: corrupt"), ("no-robot", '{"type":"EVENT"}', "event: no usable fields"),
        ("null", '{"battery":null}', "battery: no usable value"), ("other", "[1]", "not a reading: other"),
    ]
    assert [(r.robot_id, r.message, r.msg_id, str(r.dt)) for r in read("events")] == [(4, "Entered zone", "event", "2026-07-22")]
    assert [(r.type, r.command_id, r.robot_id, r.command_type, r.status, r.payload) for r in read("commands")] == [("COMMAND_UPDATE", "c1", 4, "RESUME", "COMPLETED", command)]
    assert sum(counts.values()) == 6
    assert sorted((r.batch_id, r.readings, r.events, r.commands, r.rejects) for r in read("metrics")) == [(0, 5, 1, 1, 4), (1, 1, 0, 0, 0)]
    assert all(r.write_ms > 0 for r in read("metrics"))
    assert tables.read_ingested(spark, root).orderBy(F.desc("id")).first().robot_id == 5


def test_repeated_and_crashed_batches(spark, tmp_path, monkeypatch):
    prepare_streaming(spark)
    root = str(tmp_path / "root")
    rows = [(f"m{i}", reading(i, 50.0, T0), T0) for i in range(4)]
    batch = spark.createDataFrame(rows, schemas.MESSAGES)
    write = ingest.store_batch(root)
    with monkeypatch.context() as patch:  # all files are written, the commit is lost
        patch.setattr(Versions, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            write(batch, 0)
    assert tables.read_ingested(spark, root).count() == 0
    write(batch, 0)
    write(batch, 0)
    write(spark.createDataFrame([("m9", reading(9, 1.0, T0), T0)], schemas.MESSAGES), 1)
    write(spark.createDataFrame([], schemas.MESSAGES), 2)
    assert sorted(r.msg_id for r in tables.read_ingested(spark, root).collect()) == ["m0", "m1", "m2", "m3", "m9"]
    assert Versions(spark, root).vacuum(keep_versions=1, min_age_seconds=0) >= 2
    assert tables.read_ingested(spark, root).count() == 5


def test_late_messages_stay_and_late_repeats_go(spark, tmp_path):
    prepare_streaming(spark)
    root = str(tmp_path / "root")
    write = ingest.store_batch(root)
    batches = [
        [(f"m{i}", reading(i, 50.0, T0), T0 + timedelta(minutes=30)) for i in range(5)] + [("bad", "junk{", T0)],
        [(f"late{i}", reading(i, 40.0, T0 - timedelta(days=2)), T0 - timedelta(hours=1)) for i in range(5)],
        [("m3", reading(3, 50.0, T0), T0 + timedelta(hours=3)), ("bad", "junk{", T0 + timedelta(hours=3)), ("new", reading(7, 1.0, T0), T0)] * 2,
    ]
    for i, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schemas.MESSAGES), i)
    stored = tables.read_ingested(spark, root)
    assert stored.count() == 11 and tables.read_ingested(spark, root, "rejects").count() == 1
    assert stored.select("id").distinct().count() == 11
    # Retention on the table that ingest writes, then more ingest.
    assert tables.retention_job(spark, root, T0 + timedelta(hours=12), table="telemetry") == 5
    write(spark.createDataFrame([("after", reading(8, 1.0, T0), T0)], schemas.MESSAGES), 3)
    assert sorted(r.robot_id for r in tables.read_ingested(spark, root).collect()) == [0, 1, 2, 3, 4, 7, 8]
    assert tables.drop_days(spark, root, "message_ids", (T0 + timedelta(days=1)).date()) > 0
    assert tables.read_ingested(spark, root, "message_ids").count() == 0
    alerts = stateful.geofence_stream(spark.readStream.schema(stored.schema).option("recursiveFileLookup", "true").parquet(f"{root}/telemetry"), 900)
    assert run_to_memory(alerts, "ingested_alerts").count() == 0


def test_a_batch_reads_the_ids_of_its_slots_only(spark, tmp_path, monkeypatch):
    """Batches through a day: what one of them looks up does not grow with the day."""
    prepare_streaming(spark)
    root, read = str(tmp_path / "root"), []
    write = ingest.store_batch(root)
    for i in range(12):
        at = T0 + timedelta(hours=2 * i)
        write(spark.createDataFrame([(f"m{i}-{k}", reading(k, 50.0, at), at) for k in range(5)] + [(f"bad{i}", "junk{", at)], schemas.MESSAGES), i)
    real = Versions.read
    monkeypatch.setattr(Versions, "read", lambda self, table, *a, **k: read.append(real(self, table, *a, **k)) or read[-1])
    write(spark.createDataFrame([("m3-1", reading(1, 50.0, T0 + timedelta(hours=6)), T0), ("more", reading(1, 5.0, T0 + timedelta(hours=6)), T0)], schemas.MESSAGES), 99)
    assert [len(df.inputFiles()) for df in read] == [1]
    assert tables.read_ingested(spark, root).count() == 61
    assert tables.compact(spark, root, (T0 + timedelta(days=9)).date(), "message_ids") > 0
    assert tables.read_ingested(spark, root, "message_ids").count() == 12 * 6 + 1


def test_ids_of_one_instant_are_unique_and_repeat(spark):
    messages = spark.range(100_000).select(F.concat(F.lit("m"), "id").alias("msg_id"), F.lit(T0).alias("received_at"))
    first, again = ingest.numbered(messages, 7), ingest.numbered(messages.repartition(5), 7)
    assert first.select("id").distinct().count() == 100_000
    assert first.join(again, ["msg_id", "id"]).count() == 100_000


def run_to_memory(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


LAST = datetime(2100, 1, 1, tzinfo=timezone.utc)


def shuffled(spark, df, time_column, path, triggers=20, minutes=9):
    """A stream of the rows in 20 triggers, dealt out by a random delay of up to `minutes`, and of a last row far in the future. Returns its files' schema."""
    late = F.unix_micros(time_column) + (F.rand(5) * minutes * 60_000_000).cast("bigint")
    dealt = df.withColumn("_late", late).withColumn("_file", F.ntile(triggers).over(Window.orderBy("_late"))).persist()
    for i in range(1, triggers + 1):
        dealt.where(F.col("_file") == i).drop("_late", "_file").coalesce(1).write.mode("append").parquet(path)
    dealt.unpersist()
    return df.schema


def stream_of(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def close(spark, schema, path, **values):
    row = {f.name: None for f in schema.fields} | values
    spark.createDataFrame([tuple(row.values())], schema).coalesce(1).write.mode("append").parquet(path)


def test_geofence_in_any_order_of_arrival(spark, sf, tmp_path):
    prepare_streaming(spark)
    rows, path = fixtures.telemetry(spark, sf).select("id", "robot_id", "x", "y", "timestamp"), str(tmp_path / "readings")
    schema = shuffled(spark, rows, "timestamp", path)
    close(spark, schema, path, id=-1, robot_id=-1, x=0.0, y=0.0, timestamp=LAST)
    got = run_to_memory(stateful.geofence_stream(stream_of(spark, schema, path), 900), "fence_alerts")
    want = spatial.geofence_alerts(rows, 900)
    assert {r.id for r in got.collect()} == {r.id for r in want.collect()}


def test_status_changes_by_event_time(spark, tmp_path):
    prepare_streaming(spark)
    at = lambda seconds: T0 + timedelta(seconds=seconds)
    seen = [(1, 1, "active", at(0)), (2, 1, "charging", at(60)), (3, 1, None, at(200)), (4, 1, "", at(380)), (5, 1, "dead", at(561)), (6, 2, "low power", at(5)), (7, 2, "low power", at(6))]
    path, schema = str(tmp_path / "readings"), "id int, robot_id int, status string, timestamp timestamp"
    for row in (seen[4], seen[1], seen[6], seen[0], seen[5], seen[3], seen[2]):  # a file each
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
    close(spark, spark.createDataFrame([], schema).schema, path, id=0, robot_id=-1, timestamp=LAST)
    stream = stateful.status_changes_stream(stream_of(spark, schema, path))
    got = run_to_memory(stream, "status_changes").where("robot_id > 0").collect()
    since = lambda r: (r.since_us - int(T0.timestamp() * 1_000_000)) / 1e6
    assert sorted((r.robot_id, since(r), r.status) for r in got) == [
        (1, 0, "ACTIVE"), (1, 60, "CHARGING"), (1, 120, "OFFLINE"), (1, 200, "ACTIVE"), (1, 560, "OFFLINE"), (1, 561, "DEAD"), (1, 621, "OFFLINE"),
        (2, 5, "LOW POWER"), (2, 66, "OFFLINE"),
    ]


#: What the last row keeps in the state, since event time never passes it: itself and its timer.
OF_LAST_ROW = 4


def drained(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_commands_in_any_order_of_arrival(spark, sf, tmp_path):
    """The stream leaves the table of the batch operator, and the state of live commands only."""
    prepare_streaming(spark)
    updates = fixtures.command_updates(spark, sf).withColumns({
        "result": F.when(F.col("update_id") % 3 == 0, F.lit('{"ok":1}')), "error_code": F.lit("E7"), "error_message": F.concat(F.lit("m"), "update_id"),
    })
    begin = F.lit(datetime(2023, 12, 31, 23, 55, tzinfo=timezone.utc))
    stored = fixtures.commands(spark, sf).select("id", "robot_id", F.lit("PENDING").alias("status"), begin.alias("created_at"), F.lit(None).cast("int").alias("timeout_seconds"))
    log = stateful.command_log(stored.where("robot_id % 2 = 0"), updates)
    path = str(tmp_path / "log")
    schema = shuffled(spark, log, "at", path)
    close(spark, schema, path, command_id="last", kind=1, update_id=-1, requested_status="DISPATCHED", at=LAST, us=int(LAST.timestamp() * 1_000_000))
    outcomes, state = drained(stateful.command_stream(stream_of(spark, schema, path), stored.where("robot_id % 2 = 1")), "any_order")
    got = outcomes.where("update_id >= 0")
    want_table, want_outcomes = commands.apply_status_updates(stored, updates)
    key = ["update_id", "command_id", "outcome"]
    assert sorted(map(tuple, got.select(key).collect()), key=str) == sorted(map(tuple, want_outcomes.select(key).collect()), key=str)
    live = want_table.where(~F.col("status").isin(*K.TERMINAL_STATES)).count()
    assert live <= state <= live + OF_LAST_ROW
    columns = ["id", "status", "dispatched_at", "acknowledged_at", "started_at", "completed_at", "result", "error_code", "error_message"]
    after = stateful.command_table(stored, got)
    assert sorted(map(str, after.select(columns).collect())) == sorted(map(str, want_table.select(columns).collect()))


def test_expiry_by_event_time(spark, tmp_path):
    """A command times out at its expiry if event time passes it first, and is forgotten after its keeping time."""
    prepare_streaming(spark)
    at = lambda seconds: T0 + timedelta(seconds=seconds)
    created = spark.createDataFrame([("late", 1, at(0), 30), ("done", 1, at(0), 30), ("edge", 1, at(0), 30)], "id string, robot_id int, created_at timestamp, timeout_seconds int")
    requests = [(1, "late", "DISPATCHED", at(10)), (2, "late", "ACKNOWLEDGED", at(31)), (3, "done", "DISPATCHED", at(29)), (4, "done", "FAILED", at(29)), (5, "edge", "CANCELLED", at(30))]
    requests += [(6, "done", "COMPLETED", at(100)), (7, "done", "COMPLETED", at(5000)), (8, "CREATED", "CREATED", at(3))]
    path = str(tmp_path / "log")
    log = stateful.command_log(created, spark.createDataFrame(requests, "update_id long, command_id string, requested_status string, requested_at timestamp"))
    log.orderBy(F.desc("at")).coalesce(1).write.parquet(path)
    close(spark, log.schema, path, command_id="last", kind=1, update_id=-1, requested_status="X", at=LAST, us=int(LAST.timestamp() * 1_000_000))
    outcomes, state = drained(stateful.command_stream(stream_of(spark, log.schema, path), keep_seconds=600), "expiry")
    assert state <= OF_LAST_ROW
    got = outcomes.where("update_id IS NULL OR update_id > 0").collect()
    second = lambda us: None if us is None else (us - int(T0.timestamp() * 1_000_000)) / 1e6
    assert sorted(((r.update_id or 0, r.command_id, r.outcome, r.status, second(r.completed_us), r.error_code, r.error_message) for r in got)) == [
        (0, "late", "accepted", "TIMEOUT", 30, "TIMEOUT", "Command did not complete within 30 seconds"),
        (1, "late", "accepted", "DISPATCHED", None, None, None),
        (2, "late", "Cannot transition from terminal state TIMEOUT", "TIMEOUT", 30, "TIMEOUT", "Command did not complete within 30 seconds"),
        (3, "done", "accepted", "DISPATCHED", None, None, None),
        (4, "done", "accepted", "FAILED", 29, None, None),
        (5, "edge", "accepted", "CANCELLED", 30, None, None),
        (6, "done", "Cannot transition from terminal state FAILED", "FAILED", 29, None, None),
        (7, "done", "Command not found", None, None, None, None),
        (8, "CREATED", "Command not found", None, None, None, None),
    ]


@pytest.mark.parametrize("ended", [290, 300])
def test_crowded_bucket_is_kept_in_pages(spark, tmp_path, ended):
    """300 commands of one bucket take a page for many, over several triggers; nothing is left when all are forgotten."""
    prepare_streaming(spark)
    at = lambda seconds: T0 + timedelta(seconds=seconds)
    kinds = "id string, robot_id int, status string, created_at timestamp, timeout_seconds int"
    stored = spark.createDataFrame([(f"c{i}", 1, "PENDING", at(0), None) for i in range(0, 300, 2)], kinds)
    created = spark.createDataFrame([(f"c{i}", 1, "PENDING", at(i / 100), None) for i in range(1, 300, 2)], kinds)
    requests = [(i, f"c{i}", "DISPATCHED", at(20 + i)) for i in range(300)] + [(300 + i, f"c{i}", "CANCELLED", at(400 + i)) for i in range(ended)]
    log = stateful.command_log(created, spark.createDataFrame(requests, "update_id long, command_id string, requested_status string, requested_at timestamp"))
    path = str(tmp_path / "log")
    schema = shuffled(spark, log, "at", path, triggers=3)
    close(spark, schema, path, command_id="last", kind=1, update_id=-1, requested_status="X", at=LAST, us=int(LAST.timestamp() * 1_000_000))
    outcomes, state = drained(stateful.command_stream(stream_of(spark, schema, path), stored, keep_seconds=600, buckets=1), f"pages_{ended}")
    got = sorted((r.update_id, r.command_id, r.outcome) for r in outcomes.where("update_id >= 0").collect())
    assert got == [(i, c, "accepted") for i, c, _, _ in requests]
    after = stateful.command_table(stored.union(created), outcomes).collect()
    assert {r.id: r.status for r in after} == {f"c{i}": "CANCELLED" if i < ended else "DISPATCHED" for i in range(300)}
    assert state <= OF_LAST_ROW + (stateful._PAGES + 1 if ended < 300 else 0)

@pytest.mark.parametrize("buckets", [1, 50])
def test_commands_share_buckets(spark, tmp_path, buckets):
    """Commands of one group don't touch each other: stored and new ones, null ids, expiries, over several triggers; requests without a time never apply."""
    prepare_streaming(spark)
    at = lambda seconds: T0 + timedelta(seconds=seconds)
    kinds = "id string, robot_id int, status string, created_at timestamp, timeout_seconds int"
    stored = spark.createDataFrame([(f"s{i}", 1, "PENDING", at(0), 30 if i % 3 == 0 else None) for i in range(30)] + [(None, 1, "PENDING", at(0), None)], kinds)
    created = spark.createDataFrame([(f"n{i}", 1, "PENDING", at(i), None) for i in range(30)], kinds)
    requests = [(i, f"{'sn'[i % 2]}{i // 2}", "DISPATCHED", at(20 + i)) for i in range(60)] + [(60, None, "DISPATCHED", at(5)), (61, "n29", "COMPLETED", at(900)), (62, "n3", "CANCELLED", None)]
    log = stateful.command_log(created, spark.createDataFrame(requests, "update_id long, command_id string, requested_status string, requested_at timestamp"))
    path = str(tmp_path / "log")
    schema = shuffled(spark, log, "at", path, triggers=3)
    close(spark, schema, path, command_id="last", kind=1, update_id=-1, requested_status="X", at=LAST, us=int(LAST.timestamp() * 1_000_000))
    stream = stateful.command_stream(stream_of(spark, schema, path), stored, keep_seconds=600, buckets=buckets)
    outcomes, state = drained(stream, f"buckets_{buckets}")
    got = sorted((-1 if r.update_id is None else r.update_id, r.command_id or "", r.outcome) for r in outcomes.where("update_id IS NULL OR update_id >= 0").collect())
    ended = "Cannot transition from terminal state TIMEOUT"
    moved = [(i, c, ended if c[0] == "s" and i // 2 % 3 == 0 and i > 10 else "accepted") for i, c, _, _ in requests[:60]]
    timeouts = [(-1, f"s{i}", "accepted") for i in range(0, 30, 3)]
    assert got == sorted([*moved, *timeouts, (60, "", "accepted"), (61, "n29", "Invalid transition from DISPATCHED to COMPLETED")])
    after = stateful.command_table(stored.where("id IS NOT NULL").union(created), outcomes).collect()
    assert {r.id: r.status for r in after} == {f"n{i}": "DISPATCHED" for i in range(30)} | {f"s{i}": "DISPATCHED" if i % 3 else "TIMEOUT" for i in range(30)}
    assert 51 <= state <= 51 + OF_LAST_ROW  # 20 stored ones, 30 new ones and that without an id


def test_silence_emits_offline(spark, tmp_path):
    prepare_streaming(spark)
    now = datetime.now(timezone.utc)
    path = str(tmp_path / "readings")
    schema = "id int, robot_id int, status string, timestamp timestamp"
    seen = [(1, 1, "active", now), (2, 2, None, now), (3, 3, "charging", now - timedelta(seconds=400))]
    spark.createDataFrame(seen, schema).coalesce(1).write.parquet(path)
    stream = stateful.live_status_stream(spark.readStream.schema(schema).parquet(path), stale_seconds=30, gone_seconds=300)
    query = stream.writeStream.format("memory").queryName("live_status").outputMode("append").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline:
            changes = {}
            for r in spark.table("live_status").collect():
                changes.setdefault(r.robot_id, []).append(r.status)
            if changes.get(1) == ["ACTIVE", "OFFLINE"]:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert changes == {1: ["ACTIVE", "OFFLINE"], 2: ["ACTIVE"], 3: ["OFFLINE"]}


def test_expired_command_times_out(spark, tmp_path):
    """By the wall clock: no further row is needed."""
    prepare_streaming(spark)
    past = datetime(2024, 1, 1, tzinfo=timezone.utc)
    created = spark.createDataFrame([(i, past, t) for i, t in (("late", 30), ("done", 30), ("open", None))], "id string, created_at timestamp, timeout_seconds int")
    moves = [(i, "done", s, past + timedelta(microseconds=i)) for i, s in enumerate(["DISPATCHED", "ACKNOWLEDGED", "COMPLETED"], 1)]
    log = stateful.command_log(created, spark.createDataFrame(moves, "update_id long, command_id string, requested_status string, requested_at timestamp"))
    path = str(tmp_path / "log")
    log.coalesce(1).write.parquet(path)
    stream = stateful.command_stream(spark.readStream.schema(log.schema).parquet(path), event_time=False)
    query = stream.writeStream.format("memory").queryName("command_outcomes").outputMode("append").start()
    try:
        deadline = time.time() + 60
        while time.time() < deadline:
            final = {r.command_id: r.status for r in spark.table("command_outcomes").orderBy("us").collect()}
            if "late" in final and "done" in final:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert final == {"late": "TIMEOUT", "done": "COMPLETED"}


def test_kafka_records_and_outgoing_feed(spark, sf, tmp_path):
    records = spark.sql("SELECT 'telemetry' AS topic, 3 AS partition, 17L AS offset, encode('{\"battery\":1}', 'utf-8') AS value, timestamp'2026-07-22' AS timestamp")
    row = ingest.from_kafka(records).first()
    assert (row.msg_id, row.payload) == ("telemetry-3-17", '{"battery":1}')
    prepare_streaming(spark)
    source = fixtures.robot_events(spark, sf)
    source.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "events"))
    views.feed_stream(live.to_feed(stream, "event"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    published = {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert published == {r.payload for r in live.to_feed(source, "event").collect()}
