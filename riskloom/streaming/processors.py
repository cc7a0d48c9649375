"""Keyed state for the streaming form: duplicate ids, and per-customer evaluation in event-time order."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right, insort_right
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import partial
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom import model as m
from riskloom.streaming.messages import Messages

_ZERO = Decimal(0)
_FOUR_PLACES = Decimal("0.0001")
_CHUNK_ROWS = 256

CARRIED = [*m.TRANSACTION_COLUMNS, "ts_ms", *m.COORDINATES]
CARRIED_SCHEMA = T.StructType(
    [
        *m.TRANSACTION_FIELDS,
        T.StructField("ts_ms", T.LongType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)
# Time as microseconds since 1970, for any year.
CARRIED_ROW = T.StructType(
    [T.StructField(f.name, T.LongType() if f.name == "timestamp" else f.dataType) for f in CARRIED_SCHEMA]
)
# A carried row goes through Python and the state as one JSON text, as each value costs there what a whole text does.
UNIQUE_SCHEMA = T.StructType([f for f in CARRIED_ROW if f.name in ("transaction_id", *m.COORDINATES)] + [T.StructField("row", T.StringType())])
WAITING_SCHEMA = T.StructType([T.StructField("rows", T.ArrayType(T.StringType()))])
HISTORY_SCHEMA = T.StructType([T.StructField("entries", T.StringType())])
SCHEDULE_SCHEMA = T.StructType(
    [
        T.StructField("wakes_at", T.LongType()),
        T.StructField("firsts", T.ArrayType(T.LongType())),
        T.StructField("chunks", T.ArrayType(T.LongType())),
    ]
)
EVALUATED_SCHEMA = T.StructType(
    [*CARRIED_ROW.fields, *m.CONTEXT_FIELDS, T.StructField("lateness", T.StringType())]
)
# What the evaluation gives out, and what the text in it holds.
EVALUATED_TEXT = T.StructType([T.StructField("evaluated", T.StringType())])
EVALUATED_PARTS = T.StructType(
    [T.StructField("row", CARRIED_ROW), T.StructField("context", m.CONTEXT_SCHEMA), T.StructField("lateness", T.StringType())]
)


class FirstOccurrence(StatefulProcessor):
    """Passes the first row of an id on and drops the rest until the retention has passed in processing time.

    A duplicate does not renew the retention.  The key is a bucket of ids, as a call for each id costs several times what its
    state does; each id has an entry of its own, with its own expiry.
    """

    def __init__(self, retention_ms: int) -> None:
        self._retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        transaction_id = T.StructType([T.StructField("transaction_id", T.StringType())])
        seen = T.StructType([T.StructField("seen", T.BooleanType())])
        self._seen = handle.getMapState("seen", transaction_id, seen, ttlDurationMs=self._retention_ms)
        self._messages = Messages(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        firsts = None
        for frame in rows:
            both = frame if firsts is None else pd.concat([firsts, frame])
            firsts = both.sort_values(list(m.COORDINATES), kind="stable").drop_duplicates("transaction_id")
        if firsts is None:
            return
        known = self._messages.which(self._seen.containsKey, [((i,),) for i in firsts["transaction_id"]])
        firsts = firsts[[not k for k in known]]
        self._messages.each(self._seen.updateValue, [((i,), (True,)) for i in firsts["transaction_id"]])
        if len(firsts):
            yield firsts.drop(columns="bucket")

    def close(self) -> None:
        pass


class Carried(NamedTuple):
    """What the evaluation needs of a row, and its text."""

    ts: int
    id: str | None
    amount: Decimal
    country: str | None
    declined: bool
    place: tuple
    text: str


def _carried(text: str) -> Carried:
    row = json.loads(text, parse_float=Decimal)
    place = tuple(row.get(c) for c in m.COORDINATES)
    declined = row.get("payment_status") == m.DECLINED
    return Carried(row["ts_ms"], row.get("transaction_id"), Decimal(row.get("amount") or 0), row.get("country"), declined, place, text)


class _Waiting:
    """A customer's waiting rows, in chunks that follow each other in time; ``firsts`` has the first instant of each.

    A chunk is read when it is needed and written, if it has changed, by ``store``. Rows of one instant share a chunk.
    """

    def __init__(self, state, firsts: list[int], chunks: list[int], first_chunk: tuple | None) -> None:
        """``first_chunk``: what the state holds for the first number, if anything."""
        self._state, self.firsts, self.chunks = state, list(firsts), list(chunks)
        self._stored = set(self.chunks)
        self._first_chunk = first_chunk
        self._read: dict[int, list[Carried]] = {}
        self._changed: set[int] = set()

    def _rows(self, at: int) -> list[Carried]:
        number = self.chunks[at]
        if number not in self._read:
            kept = self._first_chunk if number == 0 else self._state.getValue((number,))
            self._read[number] = [_carried(text) for text in kept[0]]
        return self._read[number]

    def take(self, until: int) -> list[Carried]:
        """Takes the rows of the first chunk up to an instant that it has reached."""
        rows, number = self._rows(0), self.chunks[0]
        rest = [r for r in rows if r.ts > until]
        if rest:
            self._read[number], self.firsts[0] = rest, min(r.ts for r in rest)
            self._changed.add(number)
        else:
            del self._read[number], self.firsts[0], self.chunks[0]
            self._changed.discard(number)
        return [r for r in rows if r.ts <= until]

    def add(self, rows: list[Carried]) -> None:
        if not self.firsts:
            self._place(0, 0, rows)
            return
        at: dict[int, list[Carried]] = {}
        for row in rows:
            at.setdefault(max(bisect_right(self.firsts, row.ts) - 1, 0), []).append(row)
        for i in sorted(at, reverse=True):
            self._place(i, i + 1, self._rows(i) + at[i])

    def _place(self, start: int, end: int, rows: list[Carried]) -> None:
        """Puts rows in the place of chunks, as one chunk or, if they are many, as several."""
        pieces = [rows] if len(rows) <= _CHUNK_ROWS else list(_pieces(sorted(rows, key=_instant)))
        fresh = max((*self._stored, *self.chunks), default=-1) + 1
        numbers = [*self.chunks[start:end], *range(fresh, fresh + len(pieces))][: len(pieces)]
        self.firsts[start:end] = [min(r.ts for r in piece) for piece in pieces]
        self.chunks[start:end] = numbers
        self._read.update(zip(numbers, pieces, strict=True))
        self._changed.update(numbers)

    def store(self) -> None:
        for number in self._changed:
            self._state.updateValue((number,), ([r.text for r in self._read[number]],))
        for number in self._stored.difference(self.chunks):
            self._state.removeKey((number,))


def _pieces(rows: list[Carried]) -> Iterator[list[Carried]]:
    """Half as many rows as a chunk may have, so that it can grow, and all of an instant."""
    start = 0
    while start < len(rows):
        end = start + _CHUNK_ROWS // 2
        while end < len(rows) and rows[end].ts == rows[end - 1].ts:
            end += 1
        yield rows[start:end]
        start = end


class InEventOrder(StatefulProcessor):
    """Holds a customer's rows until the watermark reaches them, then emits each with its history context.

    Rows of one instant are ordered by id.  A row at or behind the watermark is emitted at once: as TOLERATED with the
    history of that moment when the allowed lateness covers it, otherwise as LATE without context.  Tolerated rows of one
    batch follow the order of their coordinates.

    Whatever the watermark has reached is evaluated before new rows are looked at, as if the watermark had moved just
    before they arrived.  Results therefore depend on the batches alone, not on when timers run.

    Waiting rows are kept in chunks.  ``schedule`` holds the first instant of each chunk, in order, so that a call reads the
    due chunks only.  A call costs what it asks of the state: each question is a message to the JVM and back.
    """

    def __init__(self, allowed_lateness_ms: int, retention_ms: int, max_entries: int) -> None:
        self._allowed_ms = allowed_lateness_ms
        self._retention_ms = retention_ms
        self._max_entries = max_entries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._history = handle.getValueState("history", HISTORY_SCHEMA)
        self._waiting = handle.getMapState("waiting", T.StructType([T.StructField("chunk", T.LongType())]), WAITING_SCHEMA)
        self._schedule = handle.getValueState("schedule", SCHEDULE_SCHEMA)
        self._messages = Messages(handle)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        scheduled, waiting, entries = self._kept()
        history = None
        if waiting.firsts and waiting.firsts[0] <= watermark:
            history = entries
            for done, history in self._reached(waiting, watermark, history):
                yield done
        tolerated: list[Carried] = []
        arrived: list[Carried] = []
        for given in rows:
            row = _carried(given["row"])
            if row.ts > watermark:
                arrived.append(row)
            elif row.ts <= watermark - self._allowed_ms:
                yield _evaluated(row, None, m.STATUS_LATE)
            else:
                tolerated.append(row)
        if tolerated:
            history = entries if history is None else history
            for row in sorted(tolerated, key=lambda r: r.place):
                alive = history[bisect_left(history, watermark - self._retention_ms, key=_instant) : bisect_right(history, row.ts, key=_instant)]
                yield _evaluated(row, _context(row, alive), "TOLERATED")
                history = self._appended(history, row)
        wakes_at = scheduled[0]
        if history is not None:
            if wakes_at is not None and wakes_at <= watermark:
                history = self._unexpired(history, watermark)
        if arrived:
            waiting.add(arrived)
        with self._messages.writes():
            if history is not None:
                self._store(history)
            waiting.store()
            self._wake(watermark, scheduled, waiting, history)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        _, waiting, history = self._kept()
        for done, history in self._reached(waiting, watermark, history):
            yield done
        history = self._unexpired(history, watermark)
        with self._messages.writes():
            self._store(history)
            waiting.store()
            self._wake(watermark, None, waiting, history)

    def _reached(self, waiting: _Waiting, watermark: int, history: list[tuple]) -> Iterator[tuple[Row, list[tuple]]]:
        """Evaluates the rows up to the watermark, chunk by chunk, and takes them out of ``waiting``."""
        while waiting.firsts and waiting.firsts[0] <= watermark:
            for row in sorted(waiting.take(watermark), key=lambda r: (r.ts, r.id)):
                first_of_instant = not history or history[-1][0] < row.ts
                oldest = row.ts - self._retention_ms - (1 if first_of_instant else 0)
                alive = history[bisect_left(history, oldest, key=_instant) : bisect_right(history, row.ts, key=_instant)]
                history = self._appended(history, row)
                yield _evaluated(row, _context(row, alive), "ON_TIME"), history

    def _kept(self) -> tuple[tuple[int | None, list[int], list[int]], _Waiting, list[tuple]]:
        """What the state has of the customer: when its timer is set, the first instant of each chunk and its number; the
        waiting rows; the history.

        Most customers have one chunk, so the first is asked for before it is known whether it is needed.
        """
        schedule, first_chunk, entries = self._messages.together(
            self._schedule.get, partial(self._waiting.getValue, (0,)), self._history.get
        )
        scheduled = (schedule[0], list(schedule[1]), list(schedule[2])) if schedule else (None, [], [])
        history = [_entry(e) for e in json.loads(entries[0])] if entries else []
        return scheduled, _Waiting(self._waiting, *scheduled[1:], first_chunk), history

    def _store(self, history: list[tuple]) -> None:
        if history:
            self._history.update((f"[{','.join(e[-1] for e in history)}]",))
        else:
            self._history.clear()

    def _unexpired(self, history: list[tuple], watermark: int) -> list[tuple]:
        return history[bisect_left(history, watermark - self._retention_ms, key=_instant) :]

    def _appended(self, history: list[tuple], row: Carried) -> list[tuple]:
        """Inserts after entries of the same instant; keeps the newest entries within the retention of the newest."""
        entries = list(history)
        values = (row.ts, row.amount, row.country, row.declined)
        insort_right(entries, (*values, json.dumps(values, default=str)), key=_instant)
        # One more millisecond than the retention: the first row of a later instant may still see it.
        expired = bisect_left(entries, _instant(entries[-1]) - self._retention_ms - 1, key=_instant)
        return entries[max(expired, len(entries) - self._max_entries) :]

    def _wake(self, watermark: int, scheduled: tuple | None, waiting: _Waiting, history: list[tuple] | None) -> None:
        """One timer per customer: at the first waiting instant, else when the newest entry expires.

        ``scheduled`` is what was stored, None where the timer has run.  A timer that is due although all that it would do has
        just been done is moved, which costs less than its call.
        """
        current = scheduled[0] if scheduled else None
        wanted = waiting.firsts[0] if waiting.firsts else None
        if wanted is None and history:
            wanted = history[-1][0] + self._retention_ms + 1
        done = current is not None and current <= watermark and history is not None
        if current is not None and (wanted is None or current <= wanted and not done):
            wanted = current
        elif wanted is not None:
            if current is not None:
                self._handle.deleteTimer(current)
            self._handle.registerTimer(wanted)
        if wanted is None and not waiting.firsts:
            self._schedule.clear()
        elif scheduled != (now := (wanted, waiting.firsts, waiting.chunks)):
            self._schedule.update(now)


_instant = itemgetter(0)
_OUT = Row("evaluated")


def _entry(values: list) -> tuple:
    """An entry of the history, (ts, spent, country, declined), and its text."""
    ts, spent, country, declined = values
    return ts, Decimal(spent), country, declined, json.dumps(values)


def _evaluated(row: Carried, context: tuple | None, lateness: str) -> Row:
    """An evaluated row as a text of ``EVALUATED_PARTS``; decimals as strings, which lose no digit."""
    if context is None:
        return _OUT(f'{{"row":{row.text},"lateness":"{lateness}"}}')
    named = json.dumps(dict(zip(m.CONTEXT_COLUMNS, context, strict=True)), default=str)
    return _OUT(f'{{"row":{row.text},"context":{named},"lateness":"{lateness}"}}')


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Evaluated rows by the names of ``EVALUATED_SCHEMA``, as one column; for tests."""
    names = EVALUATED_SCHEMA.names
    return pd.DataFrame({"rows": [[dict(zip(names, row, strict=True)) for row in rows]]})


def _context(row: Carried, past: list[tuple]) -> tuple:
    """The nine context values, in the order of ``model.CONTEXT_FIELDS``.

    Entries are (ts, spent, country, declined, text), in order and none after the row.
    """
    ts = row.ts

    def since(span: int) -> int:
        return bisect_right(past, ts - span, key=_instant)

    ten, five = past[since(m.TEN_MINUTES_MS) :], past[since(m.FIVE_MINUTES_MS) :]
    approved = [e[1] for e in past if not e[3]]
    average = None
    if approved:
        average = (sum(approved, _ZERO) / len(approved)).quantize(_FOUR_PLACES, ROUND_HALF_UP)
    last = past[-1] if past else None
    return (
        1 + len(past) - since(m.MINUTE_MS),
        (_ZERO if row.declined else row.amount) + sum((e[1] for e in ten if not e[3]), _ZERO),
        last[2] if last else None,
        [e[2] for e in ten if e[2] is not None],
        average,
        len(approved),
        ts - last[0] if last else None,
        sorted({e[2] for e in past if e[2] is not None}),
        sum(1 for e in five if e[3]),
    )
