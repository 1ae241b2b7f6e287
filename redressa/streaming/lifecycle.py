"""Ticket life cycles as keyed state, from events that come in any order and more than once."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from redressa.functions.status import DELEGATED, NEW, PENDING, RESOLVED
from redressa.sources.tables import read_batches, write_batch
from redressa.streaming.late import beside, put_late_aside

STATES = [None, NEW, DELEGATED, PENDING, RESOLVED]
#: What each event makes of each state, by their numbers in ``STATES``; other events change nothing.
STAY = "01234"
MOVES = {"submit": "11111", "delegate": "02234", "advance": "04344", "resolve": "04444"}
_KINDS = [*MOVES]
_SUBMIT, _DELEGATE, _ADVANCE, _RESOLVE = range(4)
_PACKED = struct.Struct("<qqb")
HOUR_MS = 3_600_000

#: An event that moves a state: its time in microseconds, its id, its kind by the number in ``MOVES``. Events are in this order.
Event = tuple[int, int, int]


def then(first: str, second: str) -> str:
    """Both moves, one after the other."""
    return "".join(second[int(state)] for state in first)


def state_after(state: int, events: Iterable[Event]) -> int:
    """The state, by its number, that events in their order make of ``state``."""
    for _, _, kind in events:
        state = int(MOVES[_KINDS[kind]][state])
    return state


def needed(events: Iterable[Event]) -> list[Event]:
    """Those of the events, in order and each once, that can still matter whatever other events come, before or after them.

    A resolve, or an advance that another one follows, leaves a ticket resolved, whatever is before it: of that only the
    last submit matters. Of what follows, nothing before the last submit matters. A ticket has few such events
    unless it is delegated again and again and never moves on.
    """
    ordered = sorted(set(events))
    submit = done = -1
    advances = 0
    for i in range(len(ordered) - 1, -1, -1):
        kind = ordered[i][2]
        if kind == _SUBMIT and submit < 0:
            submit = i
        elif kind == _ADVANCE:
            advances += 1
        if done < 0 and (kind == _RESOLVE or advances == 2):
            done = i
        if submit >= 0:
            break
    if submit > done:
        return ordered[submit:]
    return (ordered[submit : submit + 1] if submit >= 0 else []) + ordered[max(done, 0) :]


#: A task looks for events that cannot matter when it has read so many.
HELD = 500_000


def _kept(rows: pa.Table) -> pa.Table:
    """Of (key, ts, at, event_id, kind): what :func:`needed` keeps of each key's events, and each key's newest row."""
    rows = rows.combine_chunks()
    own = rows["key"].combine_chunks().dictionary_encode("encode")
    key = (own.chunk(0) if isinstance(own, pa.ChunkedArray) else own).indices.to_numpy(zero_copy_only=False)
    kind = rows["kind"].fill_null(len(_KINDS)).to_numpy()
    at, event_id = rows["at"].to_numpy(), rows["event_id"].to_numpy()
    order = np.lexsort((kind, event_id, at, key))
    columns = [c[order] for c in (key, at, event_id, kind)]
    again = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    once = np.concatenate([[True], ~again])
    order, key, kind = order[once], columns[0][once], columns[3][once]
    place = np.arange(len(order))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    last_of = lambda found: np.maximum.reduceat(np.where(found, place, -1), first)
    advances = np.flatnonzero(kind == _ADVANCE)
    # The last advance but one of each key.
    same = np.concatenate([key[advances[1:]] == key[advances[:-1]], [False, False]])
    before = np.zeros(len(order), bool)
    before[advances] = same[: len(advances)] & ~same[1 : len(advances) + 1]
    submit = last_of(kind == _SUBMIT)
    from_here = np.maximum(submit, last_of(before | (kind == _RESOLVE)))
    keep = (place >= np.repeat(from_here, np.diff(first, append=len(order)))) & (kind < len(_KINDS))
    keep[submit[submit >= 0]] = True
    keep[np.append(first[1:], len(order)) - 1] = True
    return rows.take(pa.array(order[keep]))


def drop_needless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leave out events that cannot matter beside others of their key in the same task; see :func:`needed`.

    What is left out is older than what is kept for it, so what Spark drops behind the watermark makes no difference,
    and the newest row of each key stays, so the watermark and the keys that a batch has are the same.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD:
            kept = _kept(pa.Table.from_batches(held))
            held, rows = kept.to_batches(), kept.num_rows
            if rows > HELD // 2:
                yield from held
                held, rows = [], 0
    if held:
        yield from _kept(pa.Table.from_batches(held)).to_batches()


class Lifecycle(StatefulProcessor):
    """State of one key: the events that can still matter, see :func:`needed`, and the state before them.

    An event that comes late finds its place among them, and one that comes twice is known by its time and id or
    was without effect. When the watermark has passed the newest event of a batch, a timer replaces the
    events up to there by the state they make. A key takes one read and one write a batch, however many events it has.
    """

    #: Events are looked through when so many are waiting, so a key with most of all events takes no more memory.
    WAITING = 1000

    def __init__(self, span_ms: int = HOUR_MS) -> None:
        self.span_ms = span_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "closed int, events binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        closed, events = self._held()
        newest, limit = None, len(events) + self.WAITING
        for row in rows:
            if row.kind is None:
                continue
            events.append((row.at, row.event_id, row.kind))
            newest = row.at if newest is None else max(newest, row.at)
            if len(events) >= limit:
                events = needed(events)
                limit = 2 * len(events) + self.WAITING
        if newest is not None:
            events = needed(events)
            self._hold(closed, events)
            # Timers stand at the ends of spans, so keys and batches share them.
            self.handle.registerTimer((newest // (1000 * self.span_ms) + 1) * self.span_ms)
        yield Row(key=key[0], state=STATES[state_after(closed, events)])

    def _held(self) -> tuple[int, list[Event]]:
        held = self.held.get()
        return (0, []) if held is None else (held[0], list(_PACKED.iter_unpack(held[1])))

    def _hold(self, closed: int, events: list[Event]) -> None:
        self.held.update((closed, b"".join(_PACKED.pack(*event) for event in events)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = 1000 * expiredTimerInfo.getExpiryTimeInMs()
        closed, events = self._held()
        if events and events[0][0] < passed:
            self._hold(state_after(closed, [e for e in events if e[0] < passed]), [e for e in events if e[0] >= passed])
        return iter([])

    def close(self) -> None:
        pass


def _kind(event: Column) -> Column:
    return F.coalesce(*[F.when(event == name, F.lit(i)) for i, name in enumerate(_KINDS)])


def lifecycle_changes(log: DataFrame, horizon: str, span_ms: int = HOUR_MS) -> DataFrame:
    """Stream of the state of every key that a batch has events of, beside the events themselves.

    Takes a stream (key, ts, event_id, event); an event may come ``horizon`` behind the newest one.
    """
    events = log.select("key", "ts", F.unix_micros("ts").alias("at"), F.coalesce("event_id", F.lit(0)).alias("event_id"), _kind(F.col("event")).alias("kind"))
    kind = log.schema["key"].dataType.simpleString()
    few = events.filter("ts IS NOT NULL").mapInArrow(drop_needless, f"key {kind}, ts timestamp, at long, event_id long, kind int")
    timed = few.withWatermark("ts", horizon)
    states = timed.groupBy("key").transformWithState(Lifecycle(span_ms), f"key {kind}, state string", "update", "eventTime")
    return beside(states, log.select("key", "ts", "event_id", "event"))


def store_changes(folder: str, horizon: str):
    """Handler of :func:`lifecycle_changes`: states to ``folder``/changes, events that come too late to ``folder``/late."""
    return put_late_aside(folder, "ts", horizon, lambda states, batch_id: write_batch(states, f"{folder}/changes", batch_id))


def read_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of every key."""
    newest = F.max(F.struct("batch_id", "state")).alias("newest")
    return read_batches(spark, f"{folder}/changes").groupBy("key").agg(newest).select("key", "newest.state")
