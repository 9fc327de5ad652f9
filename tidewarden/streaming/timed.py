"""Keyed state machines in event time: retention, recovery, use-once mappings, rate limits.

``TimedState`` is the base: the events of a key wait until the watermark has passed
them and are then taken in order of time and of ``id``, whatever micro-batches they
came in. A state may have a deadline; it is met by a timer, and before any event
that isn't earlier. A key whose state ends has nothing left in the store.

Defined results: events without key, time or ``id`` are void; of events with one
time and id the first that came counts; a key's events that the watermark passes at
once are held in memory together; events older than the watermark are dropped
by Spark; events that the watermark hasn't passed when the stream ends stay in the
state. Times are in milliseconds inside, timestamps outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewarden.streaming.ordered import use_rocksdb

#: Least and usual seconds that a mapping is kept, seconds that it may be restored from, placeholders of a response.
LEAST_AGE, AGE, RESTORE_AGE, RESTORE_MOST = 300, 86_400, 1800, 20
#: Most events of a key in one value of the store, a fixed value.
BLOCK = 4096
#: Fixed value: least seconds that something may be executing.
LEAST_EXECUTING = 5


def _plain(v):
    """A value of a pandas row as the state store takes it."""
    if isinstance(v, float) and v != v or v is pd.NaT:
        return None
    if isinstance(v, np.bool_):
        return bool(v)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, np.ndarray):
        return [_plain(x) for x in v]
    return v


class TimedState(StatefulProcessor):
    """One machine; subclasses say what events and deadlines do."""

    #: Columns of the state, of an event besides key, time and id, and of the rows besides the key.
    state_schema: str
    event_schema: str
    out_schema: str

    def take(self, state: tuple | None, at: int, event_id: int, event: tuple) -> tuple[tuple | None, list[tuple]]:
        """State and rows after an event; no state: the key is dropped."""
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        """When something happens to this state without an event."""
        raise NotImplementedError

    def due(self, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        """State and rows after its deadline ``at``."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = self.event_schema.split("; ")
        self.names = [c.split()[0] for c in columns]
        self.whole = [c.split()[1] in ("long", "bigint") for c in columns]  # with nulls they come as floats
        event = ",".join(c.strip().replace(" ", ":", 1) for c in ["at long", "id long", *columns])
        self.state = handle.getValueState("state", self.state_schema.replace("; ", ", "))
        # each call to the store costs more than an event: events wait in blocks, in the order that they came in
        self.waiting = handle.getListState("waiting", f"events array<struct<{event}>>")

    def _wait(self, events: list[tuple]) -> None:
        for at in range(0, len(events), BLOCK):
            self.waiting.appendValue((events[at : at + BLOCK],))

    def _values(self, batch: pd.DataFrame) -> Iterator[tuple]:
        """Values of the rows' events."""
        of_columns = [[int(v) if whole and v is not None else v for v in map(_plain, batch[n])] for n, whole in zip(self.names, self.whole, strict=True)]
        return zip(*of_columns, strict=True)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            batch = batch[batch["at"].notna() & batch["id"].notna()]
            if key[0] is not None and len(batch):
                times = [int(t) for t in batch["at"]]
                self._wait([(at, int(i), *e) for at, i, e in zip(times, batch["id"], self._values(batch), strict=True)])
                first = min(times) if first is None else min(first, *times)
        if first is not None:
            self._set_timer(first)
        return iter(())

    def _set_timer(self, at: int) -> None:
        """A key has one timer: for its first event that waits, or its deadline if that is earlier."""
        held = list(self.handle.listTimers())
        if not held or at < min(held):
            for t in held:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def _due(self, state: tuple | None, upto: int, out: list[tuple]) -> tuple | None:
        while state is not None and (at := self.deadline(state)) is not None and at <= upto:
            state, rows = self.due(state, at)
            out += rows
        return state

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # one timer does all that the watermark has passed, in order of time
        passed = timerValues.getCurrentWatermarkInMs()
        before = state = self.state.get()
        came: dict[tuple[int, int], tuple] = {}
        later: list[tuple] = []
        any_waited = False
        for (events,) in self.waiting.get():
            any_waited = True
            for e in map(tuple, events):
                if e[0] > passed:
                    later.append(e)
                else:
                    came.setdefault(e[:2], e)
        out: list[tuple] = []
        for at, event_id in sorted(came):
            state = self._due(state, at, out)
            state, rows = self.take(state, at, event_id, came[at, event_id][2:])
            out += rows
        state = self._due(state, passed, out)
        if came:
            self.waiting.clear()
            self._wait(later)
        elif not any_waited and state is None and before is None:
            return
        nexts = [e[0] for e in later]
        if state is not None:
            if state != before:
                self.state.update(state)
            if (at := self.deadline(state)) is not None:
                nexts.append(at)
        elif before is not None:
            self.state.clear()
        if nexts:
            self.handle.registerTimer(min(nexts))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", *(c.split()[0] for c in self.out_schema.split("; "))])

    def close(self) -> None:
        pass


def run_timed(events: DataFrame, machine: TimedState, late: str = "10 seconds") -> DataFrame:
    """The rows of ``machine`` over a stream of ``key string, ts timestamp, id long`` and its event columns."""
    use_rocksdb(events.sparkSession)
    names = [c.split()[0] for c in machine.event_schema.split("; ") if c]
    rows = events.withWatermark("ts", late).selectExpr("key", "unix_millis(ts) AS at", "id", *names, "ts")
    return rows.groupBy("key").transformWithStateInPandas(machine, f"key string, {machine.out_schema.replace('; ', ', ')}", "Append", "EventTime")


class RateLimit(TimedState):
    """``id, allowed``: at most ``most`` allowed events of a key within ``seconds``; rejected ones don't count, idle keys are dropped."""

    state_schema = "held array<bigint>"
    event_schema = "kind string"
    out_schema = "id long; allowed boolean"

    def __init__(self, most: int, seconds: int) -> None:
        self.most, self.span = most, seconds * 1000

    def take(self, state: tuple | None, at: int, event_id: int, event: tuple) -> tuple[tuple | None, list[tuple]]:
        held = [x for x in (state[0] if state else []) if x > at - self.span]
        allowed = len(held) < self.most
        held = [*held, at] if allowed else held
        return ((held,) if held else None), [(event_id, allowed)]

    def deadline(self, state: tuple) -> int:
        return max(state[0]) + self.span

    def due(self, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        return None, []


class MappingStore(TimedState):
    """Placeholder mappings with an age, each used once: ``id, outcome, restored``.

    Events: ``kind`` ``mapping`` with ``names`` (placeholder to value), or ``response``
    with the placeholders ``found`` in it and whether it is ``suspicious``. A newer
    mapping replaces the older one. Outcomes, in this order: ``missing`` (none, used
    up or expired), ``stale_mapping``, ``too_many_placeholders``, ``partial_restore``,
    ``exfiltration``, ``restored`` with the values of ``found`` in order; each but
    ``missing`` uses the mapping up. After ``age`` seconds (LEAST_AGE at least) a
    mapping is dropped.
    """

    state_schema = "created bigint; names map<string,string>"
    event_schema = "kind string; names map<string,string>; found array<string>; suspicious boolean"
    out_schema = "id long; outcome string; restored array<string>"

    def __init__(self, age: int = AGE, restore_age: int = RESTORE_AGE, most: int = RESTORE_MOST) -> None:
        self.age, self.restore_age, self.most = max(LEAST_AGE, age) * 1000, restore_age * 1000, most

    def take(self, state: tuple | None, at: int, event_id: int, event: tuple) -> tuple[tuple | None, list[tuple]]:
        kind, names, found, suspicious = event
        if kind == "mapping":
            return (at, dict(names)) if names is not None and len(names) else state, []
        found = [] if found is None else list(found)
        if state is None:
            return None, [(event_id, "missing", None)]
        created, names = state[0], dict(state[1])
        if at - created > self.restore_age:
            why = "stale_mapping"
        elif len(found) > self.most:
            why = "too_many_placeholders"
        elif any(p not in names for p in found):
            why = "partial_restore"
        else:
            why = "exfiltration" if found and suspicious else "restored"
        return None, [(event_id, why, [names[p] for p in found] if why == "restored" else None)]

    def deadline(self, state: tuple) -> int:
        return state[0] + self.age + 1

    def due(self, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        return None, []


class PendingStore(TimedState):
    """Pending confirmations: ``at, status, why`` for each change of a key's state.

    Events set a ``status`` and how long the record is ``kept`` (milliseconds from
    then). A record that is ``executing`` for ``executing_seconds`` (LEAST_EXECUTING
    at least) goes back to ``pending``; at the end of its time a record is ``dropped``.
    A null or not positive ``kept`` leaves an older record's end as it is, and sets none
    for a new one, which is then void.
    """

    state_schema = "status string; updated bigint; until bigint"
    event_schema = "status string; kept bigint"
    out_schema = "at bigint; status string; why string"

    def __init__(self, executing_seconds: int) -> None:
        self.executing = max(LEAST_EXECUTING, executing_seconds) * 1000

    def take(self, state: tuple | None, at: int, event_id: int, event: tuple) -> tuple[tuple | None, list[tuple]]:
        status, kept = event
        until = at + int(kept) if kept is not None and kept > 0 else state[2] if state else None
        if until is None:
            return None, []
        return (status, at, until), [(at, status, "set")]

    def deadline(self, state: tuple) -> int:
        status, updated, until = state
        return min(until, updated + self.executing) if status == "executing" else until

    def due(self, state: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        status, updated, until = state
        if at >= until:
            return None, [(at, "dropped", "retention")]
        return ("pending", at, until), [(at, "pending", "recovered")]
