"""Command lifecycle over append-only logs: creation, dispatch, state machine, expiry, change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telespark import constants as K
from telespark.operators.latest import as_of_column
from telespark.operators.slices import first_per_key, running_position, time_slice

DAY_SECONDS, TEN_MINUTES = 86_400, 600
REACHABLE = sorted({target for targets in K.COMMAND_MOVES.values() for target in targets})
STAMPS = {"DISPATCHED": "dispatched_at", "ACKNOWLEDGED": "acknowledged_at", "EXECUTING": "started_at"}


def with_expiry(df: DataFrame) -> DataFrame:
    """expires_at = created_at + timeout; no timeout or zero means never."""
    timeout = F.col("timeout_seconds")
    expiry = F.col("created_at") + F.make_dt_interval(secs=timeout)
    return df.withColumn("expires_at", F.when(timeout != 0, expiry))


def create_commands(requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Maps each request to the command it resolves to: `command_id`, and `created` for new ones.

    The first request per (robot, idempotency key) wins, an already stored one before all others;
    requests without a key are always new. Requests without a key never enter the shuffle.
    """
    keyed = requests.filter(F.col("idempotency_key").isNotNull())
    unkeyed = requests.filter(F.col("idempotency_key").isNull())
    claims = keyed.select("robot_id", "idempotency_key", F.struct(F.lit(1).alias("stored"), "created_at", "id").alias("claim"))
    if existing is not None:
        held = existing.filter(F.col("idempotency_key").isNotNull())
        claims = claims.unionByName(
            held.select("robot_id", "idempotency_key", F.struct(F.lit(0).alias("stored"), "created_at", "id").alias("claim"))
        )
    winners = claims.groupBy("robot_id", "idempotency_key").agg(F.min("claim").alias("winner"))
    resolved = keyed.join(winners, ["robot_id", "idempotency_key"]).select(
        *requests.columns,
        F.col("winner.id").alias("command_id"),
        ((F.col("winner.stored") == 1) & (F.col("winner.id") == F.col("id"))).alias("created"),
    )
    fresh = unkeyed.select(*requests.columns, F.col("id").alias("command_id"), F.lit(True).alias("created"))
    return resolved.unionByName(fresh)


def new_commands(resolved: DataFrame) -> DataFrame:
    """Rows to store for the requests that created a command."""
    return with_expiry(resolved.filter("created").drop("created", "command_id").withColumn("status", F.lit("PENDING")))


def find_command(df: DataFrame, command_id: str) -> DataFrame:
    return df.filter(F.col("id") == command_id)


def find_by_idempotency_key(df: DataFrame, robot_id: int, key: str) -> DataFrame:
    return df.filter((F.col("robot_id") == robot_id) & (F.col("idempotency_key") == key))


def next_pending(df: DataFrame) -> DataFrame:
    """Oldest PENDING command of every robot."""
    return first_per_key(df.filter(F.col("status") == "PENDING"), ["robot_id"], [F.asc("created_at"), F.asc("id")])


def dispatch_pending(df: DataFrame, as_of=None, robot_id: int | None = None, slice_seconds: int = DAY_SECONDS) -> DataFrame:
    """All PENDING commands (of one robot or all), moved to DISPATCHED, with their FIFO `position`.

    One call sees one snapshot; exactly-once hand-out follows from a single writer per snapshot.
    """
    pending = df.filter(F.col("status") == "PENDING")
    if robot_id is not None:
        pending = pending.filter(F.col("robot_id") == robot_id)
    sliced = pending.withColumn("_slice", time_slice(F.col("created_at"), slice_seconds))
    ordered = running_position(sliced, ["robot_id"], ["created_at", "id"], "_slice", "position")
    return ordered.withColumns({"status": F.lit("DISPATCHED"), "dispatched_at": as_of_column(as_of).cast("timestamp")})


def expire_commands(df: DataFrame, as_of=None) -> DataFrame:
    """The command table after one timeout scan."""
    now = as_of_column(as_of).cast("timestamp")
    overdue = F.coalesce((F.col("expires_at") < now) & ~F.col("status").isin(*K.TERMINAL_STATES), F.lit(False))
    message = F.concat(F.lit("Command did not complete within "), F.col("timeout_seconds").cast("string"), F.lit(" seconds"))

    def when_overdue(value: Column, column: str):
        kept = F.col(column) if column in df.columns else F.lit(None)
        return F.when(overdue, value).otherwise(kept)

    return df.withColumns(
        {
            "status": when_overdue(F.lit("TIMEOUT"), "status"),
            "completed_at": when_overdue(now, "completed_at"),
            "error_code": when_overdue(F.lit("TIMEOUT"), "error_code"),
            "error_message": when_overdue(message, "error_message"),
        }
    )


def command_change_feed(before: DataFrame, after: DataFrame, as_of=None) -> DataFrame:
    """COMMAND_CREATED and COMMAND_UPDATE rows between two versions of the command table."""
    old = before.select(F.col("id"), F.col("status").alias("_old_status"))
    changed = after.join(old, "id", "left").filter(F.col("_old_status").isNull() | (F.col("_old_status") != F.col("status")))
    return changed.select(
        F.when(F.col("_old_status").isNull(), "COMMAND_CREATED").otherwise("COMMAND_UPDATE").alias("type"),
        "robot_id",
        "command_type",
        "status",
        F.col("id").alias("command_id"),
        as_of_column(as_of).cast("timestamp").alias("timestamp"),
    )


def dedupe_deliveries(df: DataFrame, order: tuple[str, ...] = ("delivered_at", "delivery_id")) -> DataFrame:
    """First delivery of each command to each robot; repeats are answered, not executed again."""
    return first_per_key(df, ["robot_id", "command_id"], [F.asc(c) for c in order])


def is_allowed(current: Column, requested: Column) -> Column:
    allowed = F.lit(False)
    for state, targets in K.COMMAND_MOVES.items():
        allowed = allowed | ((current == state) & requested.isin(*targets))
    return allowed


MOVE_FIELDS = ("requested_status", "requested_at", "update_id", "result", "error_code", "error_message")


def accepted_moves(commands: DataFrame, updates: DataFrame, slice_seconds: int = TEN_MINUTES) -> DataFrame:
    """Per command: its `initial` state and the ordered `moves` that were accepted.

    A command takes at most one move per live state, so `moves` stays short however many updates
    there are. Updates are folded per (command, time slice) for every possible starting state; the
    slices are then chained, which keeps any one task to a slice of a command.
    """
    updates = _with_optional(updates).filter(F.col("requested_status").isin(*REACHABLE))
    move = F.struct(F.col("requested_at"), F.col("update_id"), *[F.col(c) for c in MOVE_FIELDS if c not in ("requested_at", "update_id")])
    sliced = updates.withColumn("_slice", time_slice(F.col("requested_at"), slice_seconds))
    per_slice = sliced.groupBy("command_id", "_slice").agg(F.array_sort(F.collect_list(move)).alias("_requests"))

    element = "struct<requested_at:timestamp,update_id:bigint,requested_status:string,result:string,error_code:string,error_message:string>"

    def start(state: Column):
        return F.struct(state.alias("state"), F.array().cast(f"array<{element}>").alias("moves"))

    def step(acc, request):
        accepted = is_allowed(acc["state"], request["requested_status"])
        return F.struct(
            F.when(accepted, request["requested_status"]).otherwise(acc["state"]).alias("state"),
            F.when(accepted, F.concat(acc["moves"], F.array(request))).otherwise(acc["moves"]).alias("moves"),
        )

    live_states = F.array(*[F.lit(s) for s in K.COMMAND_MOVES])
    outcomes = F.transform(
        live_states,
        lambda s: F.struct(s.alias("from_state"), F.aggregate("_requests", start(s), step).alias("outcome")),
    )
    mapped = per_slice.select("command_id", "_slice", outcomes.alias("_outcomes"))
    chained = mapped.groupBy("command_id").agg(F.array_sort(F.collect_list(F.struct("_slice", "_outcomes"))).alias("_slices"))

    def chain(acc, part):
        hit = F.filter(part["_outcomes"], lambda o: o["from_state"] == acc["state"])
        ended = F.size(hit) == 0
        outcome = F.get(hit, F.lit(0))["outcome"]
        return F.struct(
            F.when(ended, acc["state"]).otherwise(outcome["state"]).alias("state"),
            F.when(ended, acc["moves"]).otherwise(F.concat(acc["moves"], outcome["moves"])).alias("moves"),
        )

    begun = commands.select(F.col("id").alias("command_id"), F.col("status").alias("initial"))
    joined = begun.join(chained, "command_id", "left")
    moves = F.aggregate(F.coalesce("_slices", F.array().cast(chained.schema["_slices"].dataType)), start(F.col("initial")), chain)["moves"]
    return joined.select("command_id", "initial", moves.alias("moves"))


def _with_optional(updates: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in ("result", "error_code", "error_message") if c not in updates.columns}
    return updates.withColumns(missing) if missing else updates


def apply_status_updates(commands: DataFrame, updates: DataFrame, slice_seconds: int = TEN_MINUTES) -> tuple[DataFrame, DataFrame]:
    """(commands after all updates in order, one outcome row per update)."""
    moves = accepted_moves(commands, updates, slice_seconds)
    return stamp_transitions(commands, moves), update_outcomes(moves, updates)


def stamp_transitions(commands: DataFrame, moves: DataFrame) -> DataFrame:
    """Commands with the status, times, result and error fields their accepted moves imply."""

    def kept(column):
        return F.col(column) if column in commands.columns else F.lit(None).cast(_STAMP_TYPES[column])

    last = F.get("moves", F.size("moves") - 1)
    ended = F.coalesce(last["requested_status"].isin(*K.TERMINAL_STATES), F.lit(False))
    failed = ended & (last["requested_status"] != "COMPLETED")

    def time_of(status):
        return F.get(F.filter("moves", lambda m: m["requested_status"] == status), F.lit(0))["requested_at"]

    changed = {"status": F.coalesce(last["requested_status"], F.col("status"))}
    changed |= {column: F.coalesce(time_of(status), kept(column)) for status, column in STAMPS.items()}
    changed["completed_at"] = F.when(ended, last["requested_at"]).otherwise(kept("completed_at"))
    completed = ended & (last["requested_status"] == "COMPLETED")
    has_result = last["result"].isNotNull() & ~last["result"].isin("", "{}", "null")
    changed["result"] = F.when(completed | (failed & has_result), last["result"]).otherwise(kept("result"))
    for column in ("error_code", "error_message"):
        changed[column] = F.when(failed, last[column]).otherwise(kept(column))
    keyed = moves.select(F.col("command_id").alias("id"), "moves")
    return commands.join(keyed, "id", "left").withColumns(changed).drop("moves")


_STAMP_TYPES = {
    "dispatched_at": "timestamp", "acknowledged_at": "timestamp", "started_at": "timestamp", "completed_at": "timestamp",
    "result": "string", "error_code": "string", "error_message": "string",
}


def update_outcomes(moves: DataFrame, updates: DataFrame) -> DataFrame:
    """(update_id, command_id, outcome): accepted, unchanged or the reason for the rejection.

    The state an update met follows from the few accepted moves before it, so each row is judged on its own.
    """
    judged = updates.select("update_id", "command_id", "requested_status", "requested_at").join(moves, "command_id", "left")
    earlier = F.filter(
        "moves",
        lambda m: (m["requested_at"] < F.col("requested_at"))
        | ((m["requested_at"] == F.col("requested_at")) & (m["update_id"] < F.col("update_id"))),
    )
    met = F.coalesce(F.get(earlier, F.size(earlier) - 1)["requested_status"], F.col("initial"))
    return judged.withColumn("_met", met).select(
        "update_id",
        "command_id",
        F.when(F.col("initial").isNull(), "Command not found")
        .when(F.col("_met") == F.col("requested_status"), "unchanged")
        .when(F.col("_met").isin(*K.TERMINAL_STATES), F.concat(F.lit("Cannot transition from terminal state "), "_met"))
        .when(is_allowed(F.col("_met"), F.col("requested_status")), "accepted")
        .otherwise(F.concat(F.lit("Invalid transition from "), "_met", F.lit(" to "), "requested_status"))
        .alias("outcome"),
    )
