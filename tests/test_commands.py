"""Command lifecycle."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from telespark import constants as K
from telespark.operators import commands

T0 = datetime(2026, 7, 22, tzinfo=timezone.utc)
COMMAND = "id string, robot_id int, command_type string, status string, idempotency_key string, timeout_seconds int, created_at timestamp"
UPDATE = "update_id long, command_id string, requested_status string, requested_at timestamp, result string, error_code string, error_message string"


def command(spark, *rows):
    defaults = {"robot_id": 100, "command_type": "TEST", "status": "PENDING", "idempotency_key": None, "timeout_seconds": None, "created_at": T0}
    names = [f.split()[0] for f in COMMAND.split(", ")]
    return spark.createDataFrame([tuple((defaults | r)[n] for n in names) for r in rows], COMMAND)


def updates(spark, command_id, statuses, **extra):
    rows = [
        (i, command_id, s, T0 + timedelta(seconds=i), extra.get("result"), extra.get("error_code"), extra.get("error_message"))
        for i, s in enumerate(statuses, 1)
    ]
    return spark.createDataFrame(rows, UPDATE)


def run(spark, statuses, slice_seconds=86_400, **extra):
    after, outcomes = commands.apply_status_updates(command(spark, {"id": "c"}), updates(spark, "c", statuses, **extra), slice_seconds)
    return after.first(), [r.outcome for r in outcomes.orderBy("update_id").collect()]


@pytest.mark.parametrize("slice_seconds", [1, 86_400])
def test_full_path(spark, slice_seconds):
    row, outcomes = run(spark, ["DISPATCHED", "ACKNOWLEDGED", "EXECUTING", "COMPLETED"], slice_seconds, result='{"success":true}')
    assert outcomes == ["accepted"] * 4
    assert (row.status, row.result, row.error_code) == ("COMPLETED", '{"success":true}', None)
    times = (row.dispatched_at, row.acknowledged_at, row.started_at, row.completed_at)
    assert [t.second for t in times] == [1, 2, 3, 4]


def test_illegal_move(spark):
    row, outcomes = run(spark, ["COMPLETED"])
    assert (row.status, outcomes) == ("PENDING", ["Invalid transition from PENDING to COMPLETED"])


def test_terminal_state_stays(spark):
    row, outcomes = run(spark, ["CANCELLED", "EXECUTING", "CANCELLED"], error_code="USER")
    assert (row.status, row.error_code) == ("CANCELLED", "USER")
    assert outcomes == ["accepted", "Cannot transition from terminal state CANCELLED", "unchanged"]


def test_repeated_state_is_unchanged(spark):
    _, outcomes = run(spark, ["DISPATCHED", "ACKNOWLEDGED", "ACKNOWLEDGED"])
    assert outcomes == ["accepted", "accepted", "unchanged"]


def test_failure_keeps_a_given_result_only(spark):
    row, _ = run(spark, ["DISPATCHED", "FAILED"], result="{}", error_code="E", error_message="m")
    assert (row.status, row.result, row.error_code, row.error_message) == ("FAILED", None, "E", "m")


def test_unknown_command(spark):
    _, outcomes = commands.apply_status_updates(command(spark, {"id": "c"}), updates(spark, "ghost", ["DISPATCHED"]))
    assert [r.outcome for r in outcomes.collect()] == ["Command not found"]


def replay(initial, requests):
    state, outcomes = initial, {}
    for update_id, requested in requests:
        if requested == state:
            outcomes[update_id] = "unchanged"
        elif state in K.TERMINAL_STATES:
            outcomes[update_id] = f"Cannot transition from terminal state {state}"
        elif requested in K.COMMAND_MOVES[state]:
            state, outcomes[update_id] = requested, "accepted"
        else:
            outcomes[update_id] = f"Invalid transition from {state} to {requested}"
    return state, outcomes


@pytest.mark.parametrize("slice_seconds", [7, 100, 100_000])
def test_random_histories_with_one_hot_command(spark, slice_seconds):
    rng = random.Random(slice_seconds)
    states = ["PENDING", *K.COMMAND_MOVES, *K.TERMINAL_STATES, "BOGUS"]
    rows, histories = [], {f"c{i}": [] for i in range(40)}
    for update_id in range(1500):
        owner = "c0" if update_id % 3 == 0 else f"c{rng.randrange(40)}"
        # The hot command mostly gets requests that change nothing.
        status = rng.choice(["PENDING", "BOGUS", "EXECUTING"] * 30 + states) if owner == "c0" else rng.choice(states)
        at = T0 + timedelta(seconds=rng.randrange(500))
        rows.append((update_id, owner, status, at, None, None, None))
        histories[owner].append((at, update_id, status))
    existing = command(spark, *[{"id": c} for c in histories])
    after, outcomes = commands.apply_status_updates(existing, spark.createDataFrame(rows, UPDATE), slice_seconds)
    want_state, want_outcomes = {}, {}
    for c, history in histories.items():
        want_state[c], judged = replay("PENDING", [(u, s) for _, u, s in sorted(history)])
        want_outcomes |= judged
    assert {r.id: r.status for r in after.collect()} == want_state
    assert {r.update_id: r.outcome for r in outcomes.collect()} == want_outcomes


def test_idempotent_creation(spark):
    requests = command(
        spark, {"id": "a", "idempotency_key": "k", "created_at": T0 + timedelta(seconds=1)}, {"id": "b", "idempotency_key": "k"},
        {"id": "c", "idempotency_key": "k", "robot_id": 7}, {"id": "d"}, {"id": "e"},
    )
    got = {r.id: (r.command_id, r.created) for r in commands.create_commands(requests).collect()}
    assert got == {"a": ("b", False), "b": ("b", True), "c": ("c", True), "d": ("d", True), "e": ("e", True)}
    stored = command(spark, {"id": "old", "idempotency_key": "k", "created_at": T0 + timedelta(days=1)})
    got = {r.id: (r.command_id, r.created) for r in commands.create_commands(requests, stored).collect()}
    assert got["a"] == got["b"] == ("old", False) and got["c"] == ("c", True)
    assert {r.status for r in commands.new_commands(commands.create_commands(requests)).collect()} == {"PENDING"}


def test_expiry(spark):
    df = command(spark, *[{"id": str(t), "timeout_seconds": t} for t in (None, 0, -1, 30)])
    got = {r.id: r.e for r in commands.with_expiry(df).select("id", F.unix_seconds("expires_at").alias("e")).collect()}
    base = int(T0.timestamp())
    assert got == {"None": None, "0": None, "-1": base - 1, "30": base + 30}


def test_timeout_scan_then_late_update(spark):
    df = commands.with_expiry(command(spark, {"id": "late", "timeout_seconds": -1}, {"id": "done", "timeout_seconds": -1, "status": "COMPLETED"}, {"id": "due", "timeout_seconds": 0}))
    after = commands.expire_commands(df, T0)
    rows = {r.id: r for r in after.collect()}
    assert (rows["late"].status, rows["late"].error_code) == ("TIMEOUT", "TIMEOUT")
    assert rows["late"].error_message == "Command did not complete within -1 seconds"
    assert (rows["done"].status, rows["due"].status) == ("COMPLETED", "PENDING")
    _, outcomes = commands.apply_status_updates(after, updates(spark, "late", ["ACKNOWLEDGED"]))
    assert outcomes.first().outcome == "Cannot transition from terminal state TIMEOUT"
    feed = commands.command_change_feed(df, after, T0).collect()
    assert [(r.command_id, r.type, r.status) for r in feed] == [("late", "COMMAND_UPDATE", "TIMEOUT")]


def test_expiry_is_strict(spark):
    df = commands.with_expiry(command(spark, {"id": "c", "timeout_seconds": 30}))
    assert commands.expire_commands(df, T0 + timedelta(seconds=30)).first().status == "PENDING"
    assert commands.expire_commands(df, T0 + timedelta(seconds=31)).first().status == "TIMEOUT"


def test_dispatch_is_fifo_and_only_once(spark):
    rng = random.Random(1)
    rows = [{"id": f"c{i:04}", "robot_id": 1 if i % 3 else 2, "created_at": T0 + timedelta(seconds=rng.randrange(300))} for i in range(600)]
    df = command(spark, *rows, {"id": "sent", "status": "DISPATCHED"})
    sent = commands.dispatch_pending(df, T0, slice_seconds=60).collect()
    for robot in (1, 2):
        want = [r["id"] for r in sorted((r for r in rows if r["robot_id"] == robot), key=lambda r: (r["created_at"], r["id"]))]
        assert [r.id for r in sorted((r for r in sent if r.robot_id == robot), key=lambda r: r.position)] == want
    after = df.join(spark.createDataFrame([(r.id,) for r in sent], "id string"), "id", "left_anti")
    assert commands.dispatch_pending(after, T0).count() == 0
    assert {r.robot_id: r.id for r in commands.next_pending(df).collect()} == {
        robot: min((r for r in rows if r["robot_id"] == robot), key=lambda r: (r["created_at"], r["id"]))["id"] for robot in (1, 2)
    }
