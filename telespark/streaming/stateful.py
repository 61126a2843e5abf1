"""Per-key stream state: live status with timers, geofence alerts, command lifecycle.

State per key is a handful of scalars and, where order matters, the rows that the watermark has not passed yet. Each trigger's
share of a key is bounded by the source's rate limit, and rows arrive as Arrow batches.
"""

from __future__ import annotations

import json
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telespark import constants as K
from telespark.operators import commands
from telespark.streaming.ingest import WATERMARK


def _rows(batches, *columns: str) -> list[tuple]:
    """The key's new rows as tuples of the given columns, ordered by the first two."""
    tuples = (t for batch in batches for t in zip(*(batch[c] for c in columns)))
    return sorted(tuples, key=lambda t: t[:2])


class LiveStatus(StatefulProcessor):
    """Emits a robot's status when it reports and again when silence makes it OFFLINE."""

    def __init__(self, stale_seconds: int, gone_seconds: int) -> None:
        self.stale, self.gone = stale_seconds, gone_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "us bigint, id bigint, status string, shown string")

    def handleInputRows(self, key, rows, timerValues):
        us, id_, status = _rows(rows, "us", "id", "status")[-1]
        if self.latest.exists() and self.latest.get()[:2] >= (us, id_):
            return
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        yield self._show(key, int(us), int(id_), None if pd.isna(status) else str(status), now_ms)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for limit in (self.stale, self.gone):
            due = int(us) // 1000 + limit * 1000 + 1
            if due > now_ms:
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        us, id_, status, shown = self.latest.get()
        row = self._show(key, us, id_, status, expiredTimerInfo.getExpiryTimeInMs())
        if row.status[0] != shown:
            yield row

    def _show(self, key, us, id_, status, now_ms):
        age = now_ms / 1000.0 - us / 1_000_000.0
        if age > self.gone:
            shown = "OFFLINE"
        elif not status:
            shown = "ACTIVE"
        else:
            shown = "OFFLINE" if age > self.stale else status.upper()
        self.latest.update((us, id_, status, shown))
        return pd.DataFrame({"robot_id": [key[0]], "status": [shown], "last_seen_us": [us]})

    def close(self) -> None:
        pass


def live_status_stream(
    readings: DataFrame, stale_seconds: int = K.STALE_STATUS_SECONDS, gone_seconds: int = K.STALE_ROBOT_SECONDS
) -> DataFrame:
    """(robot_id, status, last_seen_us) changes, driven by data and by processing time."""
    keyed = readings.select("robot_id", F.unix_micros("timestamp").alias("us"), "id", "status")
    return keyed.groupBy("robot_id").transformWithStateInPandas(
        LiveStatus(stale_seconds, gone_seconds), "robot_id int, status string, last_seen_us bigint", "Append", "ProcessingTime"
    )


class InOrder(StatefulProcessor):
    """Hands a key's rows to `advance` in order of time, whatever order they arrive in.

    By event time, rows wait in the state until the watermark has passed them, so that no earlier one can come any more; a timer releases them. By
    processing time they are handed on as they arrive, those of a trigger in order. `advance` also learns how far the clock has come, and `due` when it wants to be called again.
    """

    COLUMNS: tuple[str, ...]  # the first is the time in microseconds, and the first ORDER are the order
    TYPES: str
    ORDER = 2

    def __init__(self, event_time: bool) -> None:
        self.event_time = event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.TYPES)
        self.timer = handle.getValueState("timer", "ms bigint")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def advance(self, key, rows: list[tuple], now_us: int) -> list[tuple]:
        raise NotImplementedError

    def due(self) -> int | None:
        """Microseconds at which the state changes without new rows."""
        return None

    def frame(self, out: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        whole = [t.split()[1] in ("bigint", "int") for t in self.TYPES.split(", ")]
        cells = ((map(_plain, t) for t in zip(*(batch[c] for c in self.COLUMNS))) for batch in rows)
        # A column of integers with missing ones comes as doubles.
        new = [tuple(int(v) if v is not None and w else v for v, w in zip(t, whole)) for batch in cells for t in batch]
        if self.event_time:
            if new:
                self.waiting.appendList(new)
                self._wake(min(t[0] for t in new))
            return
        out = self.advance(key, self._sorted(new), timerValues.getCurrentProcessingTimeInMs() * 1000)
        self._wake(self.due())
        if out:
            yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.timer.clear()
        now_us = 1000 * (timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs())
        rows = self._sorted(self.waiting.get()) if self.event_time and self.waiting.exists() else []
        ready, later = [t for t in rows if t[0] <= now_us], [t for t in rows if t[0] > now_us]
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        out = self.advance(key, ready, now_us)
        times = [t for t in (self.due(), later[0][0] if later else None) if t is not None]
        self._wake(min(times, default=None))
        if out:
            yield self.frame(out)

    def _sorted(self, rows) -> list[tuple]:
        return sorted(rows, key=lambda t: t[: self.ORDER])

    def _wake(self, us: int | None) -> None:
        """One timer a key, the earliest; none where nothing is due."""
        wanted = None if us is None else us // 1000 + 1
        known = self.timer.get()[0] if self.timer.exists() else None
        if self.event_time and known is not None and (wanted is None or known <= wanted):
            return
        if known is not None and known != wanted:
            self.handle.deleteTimer(known)
        if wanted is None:
            self.timer.clear()
        elif known != wanted:
            self.handle.registerTimer(wanted)
            self.timer.update((wanted,))

    def close(self) -> None:
        pass


def _plain(value):
    """A Python value of a cell; None for all that is missing."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


def _least(*times: int | None) -> int | None:
    return min((t for t in times if t is not None), default=None)


class FenceAlerts(InOrder):
    """Hysteresis state and cooldown per robot."""

    COLUMNS, TYPES = ("us", "id", "distance"), "us bigint, id bigint, distance double"

    def __init__(self, cooldown_seconds: int) -> None:
        super().__init__(event_time=True)
        self.cooldown = cooldown_seconds * 1_000_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.fence = handle.getValueState("fence", "inside boolean, last_alert bigint")

    def advance(self, key, rows, now_us):
        inside, last_alert = self.fence.get() if self.fence.exists() else (False, None)
        alerts = []
        for us, id_, distance in rows:
            if not inside and distance < K.FENCE_ENTER:
                inside = True
                if last_alert is None or us >= last_alert + self.cooldown:
                    last_alert = us
                    alerts.append((id_, key[0], us))
            elif inside and distance > K.FENCE_EXIT:
                inside = False
        if rows:
            self.fence.update((inside, last_alert))
        return alerts

    def frame(self, out):
        return pd.DataFrame(out, columns=["id", "robot_id", "us"])


def geofence_stream(readings: DataFrame, cooldown_seconds: int = K.FENCE_COOLDOWN_SECONDS, delay: str = WATERMARK) -> DataFrame:
    """(id, robot_id, us) of fence alerts, those of the batch operator for any order of arrival within `delay`.

    An alert comes when the watermark has passed it. Only rows that can change a state reach the processor.
    """
    distance = F.hypot(F.col("x") - F.lit(K.FENCE_X), F.col("y") - F.lit(K.FENCE_Y))
    timed = readings.withWatermark("timestamp", delay)
    narrow = timed.select("robot_id", "id", "timestamp", F.unix_micros("timestamp").alias("us"), distance.alias("distance"))
    decisive = narrow.filter((F.col("distance") < K.FENCE_ENTER) | (F.col("distance") > K.FENCE_EXIT))
    return decisive.groupBy("robot_id").transformWithStateInPandas(
        FenceAlerts(cooldown_seconds), "id bigint, robot_id int, us bigint", "Append", "EventTime"
    )


class StatusChanges(InOrder):
    """The status a robot shows as event time goes on: what it reports, and OFFLINE once its last report is too old."""

    COLUMNS, TYPES = ("us", "id", "status"), "us bigint, id bigint, status string"

    def __init__(self, stale_seconds: int, gone_seconds: int) -> None:
        super().__init__(event_time=True)
        self.stale, self.gone = stale_seconds * 1_000_000, gone_seconds * 1_000_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getValueState("shown", "us bigint, reported string, shown string")

    def due(self):
        if not self.shown.exists():
            return None
        us, reported, shown = self.shown.get()
        return None if shown == "OFFLINE" else us + (self.stale if reported else self.gone)

    def advance(self, key, rows, now_us):
        last, out = self.shown.get() if self.shown.exists() else None, []

        def pass_time(until):
            nonlocal last
            if last is not None and last[2] != "OFFLINE":
                limit = last[0] + (self.stale if last[1] else self.gone)
                if until > limit:  # at the limit itself a report is not too old
                    last = (*last[:2], "OFFLINE")
                    out.append((key[0], "OFFLINE", limit))

        for us, _, reported in rows:
            pass_time(us)
            shown = reported.upper() if reported else "ACTIVE"
            if last is None or last[2] != shown:
                out.append((key[0], shown, us))
            last = (us, reported, shown)
        pass_time(now_us)
        if last is not None:
            self.shown.update(last)
        return out

    def frame(self, out):
        return pd.DataFrame(out, columns=["robot_id", "status", "since_us"])


def status_changes_stream(
    readings: DataFrame, stale_seconds: int = K.STALE_STATUS_SECONDS, gone_seconds: int = K.STALE_ROBOT_SECONDS, delay: str = WATERMARK
) -> DataFrame:
    """(robot_id, status, since_us): each change of the status a robot shows, by the clock of the events; for any order of arrival within `delay`."""
    timed = readings.withWatermark("timestamp", delay).select("robot_id", "timestamp", F.unix_micros("timestamp").alias("us"), "id", "status")
    return timed.groupBy("robot_id").transformWithStateInPandas(
        StatusChanges(stale_seconds, gone_seconds), "robot_id int, status string, since_us bigint", "Append", "EventTime"
    )


_STATE = (
    "status string, expires_us bigint, timeout_seconds bigint, forget_us bigint, dispatched_us bigint, acknowledged_us bigint, "
    "started_us bigint, completed_us bigint, result string, error_code string, error_message string"
)
_FIELDS, _KINDS = (list(x) for x in zip(*(c.split() for c in _STATE.split(", "))))
_SHOWN = ["dispatched_us", "acknowledged_us", "started_us", "completed_us", "result", "error_code", "error_message"]
_STAMPED = {"DISPATCHED": "dispatched_us", "ACKNOWLEDGED": "acknowledged_us", "EXECUTING": "started_us"}


#: A bucket of more than _FEW commands keeps them in _PAGES pages, by a hash of the id. Of these, up to _ONE_BY_ONE are read by themselves, more in one go.
_FEW, _PAGES, _ONE_BY_ONE = 64, 16, 4
#: The entry that tells that a bucket is in pages.
_PAGED = -1


def _page(command_id: str | None, paged: bool) -> int:
    """The entry of a command: a page, or one that is practically its own."""
    code = zlib.crc32((command_id or "").encode())
    return code % _PAGES if paged else code


def _tuples(batches, columns, kinds: list[str]):
    """Rows of the given columns as tuples of Python values, None for all that is missing."""
    for batch in batches:
        cells = []
        for column, kind in zip(columns, kinds, strict=True):
            values = batch[column].tolist()
            if batch[column].dtype.kind not in "iu":
                # A column of integers with missing ones comes as doubles.
                plain = int if kind in ("bigint", "int") else lambda v: v
                values = [None if v is None or v is pd.NaT or v != v else plain(v) for v in values]
            cells.append(values)
        yield from zip(*cells, strict=True)


class CommandState(StatefulProcessor):
    """Applies status requests in order, and times a command out when its expiry passes; ended commands are forgotten after a while.

    A group is a bucket of commands, so that the cost of a group (its call, its batches, its timer) is shared. Few commands are an entry each of the bucket's
    map; more share pages, since the state takes as long for an entry as for a page, and a page is read and written only when something happens to a command of it. By event time, rows wait in the state until the watermark has passed them, so that no earlier
    one can come any more, and the bucket's timer releases them; rows without a time are never passed and don't wait. By processing time they apply as they arrive, those of a trigger in order.
    """

    COLUMNS = ("command_id", "us", "kind", "update_id", "requested_status", "expires_us", "timeout_seconds", "result", "error_code", "error_message")
    TYPES = "command_id string, us bigint, kind int, update_id bigint, requested_status string, expires_us bigint, timeout_seconds bigint, result string, error_code string, error_message string"
    ORDER = 3

    def __init__(self, event_time: bool, keep_seconds: int) -> None:
        self.event_time, self.keep = event_time, keep_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # An entry is a page's commands, in JSON.
        self.pages = handle.getMapState("pages", "page bigint", "commands string")
        # The rows of a trigger are one entry, in JSON: the state takes as long for an entry as for a row.
        self.waiting = handle.getListState("waiting", "rows string")
        # The bucket's one timer, and a time before which none of its commands ends or is forgotten.
        self.timer = handle.getValueState("timer", "ms bigint, due_us bigint")

    def handleInitialState(self, key, initialState, timerValues):
        held = {}
        for command_id, *values in _tuples([initialState], ("command_id", *_FIELDS), ["string", *_KINDS]):
            stored = dict(zip(_FIELDS, values))
            if stored["status"] in K.TERMINAL_STATES and stored["forget_us"] is None:
                stored["forget_us"] = (stored["completed_us"] or 0) + self.keep
            held.setdefault(command_id, stored)
        paged, kept = self._read(None)
        fresh = {command_id: tuple(stored[c] for c in _FIELDS) for command_id, stored in held.items()}
        self._write(paged, kept | fresh, fresh)
        known, due = self._timer()
        due = _least(due, *map(self._due, held.values()))
        self._wake(known, due, due)

    def handleInputRows(self, key, rows, timerValues):
        new = list(_tuples(rows, self.COLUMNS, [t.split()[1] for t in self.TYPES.split(", ")]))
        known, due = self._timer()
        if self.event_time:
            new = [t for t in new if t[1] is not None]
            if new:
                self.waiting.appendValue((json.dumps(new),))
                self._wake(known, _least(due, *(t[1] for t in new)), due)
            return
        out, due = self._apply(new, due, timerValues.getCurrentProcessingTimeInMs() * 1000)
        self._wake(known, due, due)
        if out:
            yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _, due = self._timer()
        now_us = 1000 * (timerValues.getCurrentWatermarkInMs() if self.event_time else timerValues.getCurrentProcessingTimeInMs())
        entries = list(self.waiting.get()) if self.event_time and self.waiting.exists() else []
        rows = [t for (text,) in entries for t in json.loads(text)]
        ready, later = [t for t in rows if t[1] <= now_us], [t for t in rows if t[1] > now_us]
        if ready:
            self.waiting.put([(json.dumps(later),)]) if later else self.waiting.clear()
        out, due = self._apply(ready, due, now_us)
        self.timer.clear()
        self._wake(None, _least(due, *(t[1] for t in later)), due)
        if out:
            yield self.frame(out)

    def close(self) -> None:
        pass

    def _timer(self) -> tuple:
        return tuple(self.timer.get()) if self.timer.exists() else (None, None)

    def _wake(self, known: int | None, us: int | None, due: int | None) -> None:
        """The timer at `us`, where `known` is the one there is; by event time an earlier one stays."""
        wanted = None if us is None else us // 1000 + 1
        if self.event_time and known is not None and (wanted is None or known <= wanted):
            wanted = known
        if known is not None and known != wanted:
            self.handle.deleteTimer(known)
        if wanted is None:
            self.timer.clear()
            return
        if known != wanted:
            self.handle.registerTimer(wanted)
        self.timer.update((wanted, due))

    def _read(self, wanted) -> tuple[bool, dict]:
        """Whether the bucket is in pages, and {command_id: its state} of all commands of the entries of the `wanted` ones; of all entries for None, or where there are no pages."""
        paged = self.pages.containsKey((_PAGED,))
        pages = {_page(c, True) for c in wanted} if paged and wanted is not None else None
        if pages is not None and len(pages) <= _ONE_BY_ONE:
            entries = ((page, self.pages.getValue((page,))) for page in pages)
        else:
            entries = ((k[0], v) for k, v in self.pages.iterator()) if self.pages.exists() else ()
        texts = [v[0] for page, v in entries if v is not None and page != _PAGED and (pages is None or page in pages)]
        return paged, {command_id: tuple(state) for text in texts for command_id, *state in json.loads(text)}

    def _write(self, paged: bool, kept: dict, changed, whole: bool = True) -> None:
        """`kept`: what _read gave (`whole`: of all entries), with the changes to the `changed` commands."""
        if whole and not kept:
            self.pages.clear()
            return
        if not paged and len(kept) > _FEW:
            self.pages.clear()
            self.pages.updateValue((_PAGED,), ("[]",))
            paged, changed = True, kept
        entries: dict = {page: [] for page in {_page(c, paged) for c in changed}}
        for command_id, state in kept.items():
            page = _page(command_id, paged)
            if page in entries:
                entries[page].append((command_id, *state))
        for page, rows in entries.items():
            if rows:
                self.pages.updateValue((page,), (json.dumps(rows),))
            else:
                self.pages.removeKey((page,))

    def _due(self, stored: dict) -> int | None:
        """Microseconds at which a command changes without new rows."""
        return stored["forget_us"] if stored["status"] in K.TERMINAL_STATES else stored["expires_us"]

    def _apply(self, rows: list[tuple], due: int | None, now_us: int) -> tuple[list[tuple], int | None]:
        """What the rows, and the time until now, do to the bucket's commands; and when the next of them may be due."""
        given: dict = {}
        for command_id, *row in rows:
            given.setdefault(command_id, []).append(tuple(row))
        passed = due is not None and due < now_us
        paged, held = self._read(None if passed else given)
        out, times, changed = [], [] if passed else [due], {}
        for command_id in dict.fromkeys((*held, *given)):
            before = held.get(command_id)
            stored = None if before is None else dict(zip(_FIELDS, before))
            if command_id in given or (stored is not None and self._due(stored) is not None and self._due(stored) < now_us):
                stored, shown = self._advance(command_id, stored, sorted(given.get(command_id, ()), key=lambda t: t[: self.ORDER]), now_us)
                out += shown
                after = None if stored is None else tuple(stored[c] for c in _FIELDS)
                if after != before:
                    changed[command_id] = after
            times.append(None if stored is None else self._due(stored))
        if changed:
            kept = {c: state for c, state in (held | changed).items() if state is not None}
            self._write(paged, kept, changed, passed or not paged)
        return out, _least(*times)

    def _advance(self, command_id, stored: dict | None, rows: list[tuple], now_us: int) -> tuple[dict | None, list[tuple]]:
        key, out = (command_id,), []

        def end(at_us):
            stored["completed_us"] = at_us
            stored["forget_us"] = (at_us if self.event_time else max(at_us, now_us)) + self.keep

        def pass_time(until):
            nonlocal stored
            if stored is None:
                return
            if stored["status"] not in K.TERMINAL_STATES and stored["expires_us"] is not None and stored["expires_us"] < until:
                seconds = stored["timeout_seconds"]
                text = None if seconds is None else f"Command did not complete within {seconds} seconds"
                stored |= {"status": "TIMEOUT", "error_code": "TIMEOUT", "error_message": text}
                end(stored["expires_us"])
                out.append(self._row(None, key, "accepted", stored, stored["expires_us"]))
            if stored["status"] in K.TERMINAL_STATES and stored["forget_us"] < until:
                stored = None

        for us, kind, update_id, requested, expires_us, timeout, *more in rows:
            pass_time(us)
            if kind == 0:
                if stored is None:
                    stored = dict.fromkeys(_FIELDS) | {"status": "PENDING", "expires_us": expires_us, "timeout_seconds": timeout}
                continue
            outcome = self._judge(stored, requested)
            if outcome == "accepted":
                self._move(stored, requested, us, *more)
                if requested in K.TERMINAL_STATES:
                    end(us)
            out.append(self._row(update_id, key, outcome, stored, us))
        pass_time(now_us)
        return stored, out

    @staticmethod
    def _judge(stored, requested):
        if stored is None:
            return "Command not found"
        status = stored["status"]
        if status == requested:
            return "unchanged"
        if status in K.TERMINAL_STATES:
            return f"Cannot transition from terminal state {status}"
        if requested in K.COMMAND_MOVES[status]:
            return "accepted"
        return f"Invalid transition from {status} to {requested}"

    @staticmethod
    def _move(stored, requested, us, result, error_code, error_message):
        stored["status"] = requested
        if requested in _STAMPED:
            stored[_STAMPED[requested]] = us
        elif requested == "COMPLETED":
            stored["result"] = result
        else:
            stored |= {"error_code": error_code, "error_message": error_message}
            if result not in (None, "", "{}", "null"):
                stored["result"] = result

    @staticmethod
    def _row(update_id, key, outcome, stored, us):
        shown = [None] * (1 + len(_SHOWN)) if stored is None else [stored[c] for c in ("status", *_SHOWN)]
        return (update_id, key[0], outcome, us, *shown)

    def frame(self, out):
        whole = pd.DataFrame(out, columns=["update_id", "command_id", "outcome", "us", "status", *_SHOWN])
        return whole.astype({c: "Int64" for c in ("update_id", "us", *(c for c in _SHOWN if c.endswith("_us")))})


OUTCOME_SCHEMA = (
    "update_id bigint, command_id string, outcome string, us bigint, status string, dispatched_us bigint, acknowledged_us bigint, "
    "started_us bigint, completed_us bigint, result string, error_code string, error_message string"
)


def command_log(created: DataFrame, updates: DataFrame) -> DataFrame:
    """Creations (`kind` 0) and status requests (1) as one log for command_stream; `at` is the event time."""
    with_expiry = created if "expires_at" in created.columns else commands.with_expiry(created)
    nothing = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    creations = with_expiry.select(
        F.col("id").alias("command_id"), F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("update_id"), *nothing("requested_status"),
        F.col("created_at").alias("at"), F.unix_micros("created_at").alias("us"), F.unix_micros("expires_at").alias("expires_us"),
        F.col("timeout_seconds").cast("bigint").alias("timeout_seconds"), *nothing("result", "error_code", "error_message"),
    )
    given = [F.col(c) if c in updates.columns else nothing(c)[0] for c in ("result", "error_code", "error_message")]
    requests = updates.select(
        "command_id", F.lit(1).alias("kind"), "update_id", "requested_status", F.col("requested_at").alias("at"), F.unix_micros("requested_at").alias("us"),
        F.lit(None).cast("bigint").alias("expires_us"), F.lit(None).cast("bigint").alias("timeout_seconds"), *given,
    )
    return creations.unionByName(requests)


def command_state(stored: DataFrame) -> DataFrame:
    """Rows of a command table as command_stream starts from them."""
    have = stored if "expires_at" in stored.columns else commands.with_expiry(stored)
    times = {"expires_us": "expires_at", "dispatched_us": "dispatched_at", "acknowledged_us": "acknowledged_at", "started_us": "started_at", "completed_us": "completed_at"}
    kinds = dict(c.split() for c in _STATE.split(", "))

    def value(name):
        source = times.get(name, name)
        if source not in have.columns:
            return F.lit(None).cast(kinds[name]).alias(name)
        return (F.unix_micros(source) if name in times else F.col(source).cast(kinds[name])).alias(name)

    return have.select(F.col("id").alias("command_id"), *[value(c) for c in _FIELDS])


def command_stream(log: DataFrame, stored: DataFrame | None = None, event_time: bool = True, delay: str = WATERMARK, keep_seconds: int = 86_400, buckets: int = 1024) -> DataFrame:
    """One row for each status request and one for every command whose expiry passes: the outcome, and the command's status, times, result and error after it.

    By event time, requests apply in their order whatever order they arrive in within `delay`, and expiries pass with the watermark; else both
    follow the wall clock. `stored`: a command table from before the stream. A command's state goes `keep_seconds` after its end; requests after that are not found.

    Commands are dealt to `buckets` groups, whose number stays with a checkpoint; the result doesn't depend on it. One for every few hundred commands that live at once is enough.
    """
    bucket = F.pmod(F.xxhash64("command_id"), F.lit(buckets)).alias("bucket")
    timed = (log.withWatermark("at", delay) if event_time else log).select("*", bucket)
    start = None if stored is None else command_state(stored).select("*", bucket).groupBy("bucket")
    mode = "EventTime" if event_time else "ProcessingTime"
    return timed.groupBy("bucket").transformWithStateInPandas(CommandState(event_time, keep_seconds), OUTCOME_SCHEMA, "Append", mode, start)


def command_table(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The command table after what a drained command_stream has accepted."""
    changed = outcomes.where("outcome = 'accepted'")
    fields = ["status", *_SHOWN]
    last = changed.groupBy("command_id").agg(F.max_by(F.struct(*fields), F.struct("us", F.coalesce("update_id", F.lit((1 << 63) - 1)))).alias("new"))
    named = {c: (F.timestamp_micros(F.col(f"new.{c}")), c.removesuffix("_us") + "_at") if c.endswith("_us") else (F.col(f"new.{c}"), c) for c in fields}
    joined = stored.join(last.withColumnRenamed("command_id", "id"), "id", "left")
    kept = lambda c: F.col(c) if c in stored.columns else F.lit(None)
    return joined.withColumns({c: F.when(F.col("new").isNotNull(), value).otherwise(kept(c)) for value, c in named.values()}).drop("new")
