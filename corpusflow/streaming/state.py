"""Streams that keep state: rows of a key in the order of event time, with bounded lateness and expiry.

A row waits until the watermark (the latest time seen less ``lateness``) has passed it. Then no row that is on time can come
before it any more, so what is done with it is final, and equal to the batch result whatever the order of arrival within the
lateness. The state of a key is its waiting rows, which are at most as old as the lateness, and what its steps remember, which is
cleared once the key has been idle for long enough. Rows that come later than that aren't dropped: they leave whole, marked as late. Keys share buckets of state, so a bucket's rows are read and
written in a few calls, however many keys it has.

Expiry goes by timers of event time, not by the clock, so a stream that is run again gives the same rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AT = "_at"          # event time in microseconds
BUCKET = "_bucket"
BUCKETS = 1024      # a stream keeps the number it was started with
CHUNK = 10_000      # rows of one element of a list state

Step = Callable[[tuple, Row], tuple[tuple, tuple | None]]


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _identity(v):
    """A key's value such that values Spark groups are equal and can be looked up."""
    if isinstance(v, dict):  # a struct
        return tuple(_identity(x) for x in v.values())
    if isinstance(v, (tuple, list)):
        return tuple(_identity(x) for x in v)
    if isinstance(v, bytearray):
        return bytes(v)
    return "nan" if isinstance(v, float) and v != v else v


def _packed(rows: Iterable) -> list[tuple[bytes]]:
    rows = list(rows)
    return [(pickle.dumps(rows[i:i + CHUNK], pickle.HIGHEST_PROTOCOL),) for i in range(0, len(rows), CHUNK)]


def _unpacked(chunks) -> list:
    return [r for (chunk,) in chunks.get() for r in pickle.loads(chunk)] if chunks.exists() else []


class InTimeOrder(StatefulProcessor):
    """Give the rows of a key to ``step`` in the order of (time, ``order``) once the watermark has passed them.

    ``step`` takes what the key remembers and a row, and returns what it remembers now and a row to emit or None. Spark's group is a
    bucket of keys, whose rows and memories are read and written together: a call of the state costs more than many rows do.
    """

    def __init__(self, step: Step, start: tuple, row: T.StructType, out: T.StructType, keys: list[str], order: list[str], idle: timedelta):
        self.step, self.start, self.names, self.out, self.keys = step, start, row.names, out.names, keys
        # rows of the same time and order go by their other columns
        order = [AT, *order, *(f.name for f in row.fields if f.name not in (AT, *order) and isinstance(f.dataType, T.AtomicType))]
        self.order, self.at = [row.names.index(c) for c in order], row.names.index(AT)
        self.idle = _micros(idle)

    def _sort_key(self, r: tuple) -> tuple:
        return tuple((r[c] is not None, r[c]) for c in self.order)

    def _rows(self) -> Callable[..., Row]:
        return Row(*self.keys, AT, *self.out, "late")

    def init(self, handle) -> None:
        self.handle = handle
        chunk = T.StructType([T.StructField("rows", T.BinaryType())])
        self.waiting = handle.getListState("waiting", chunk)    # (key, row)
        self.memory = handle.getListState("memory", chunk)      # (key, memory, time of its last row)

    def _wake(self, timerValues) -> None:
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)  # whenever the watermark moves

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        emit, make, fresh = self._rows(), Row(*self.names), []
        for r in rows:
            at, own, row = r[AT], tuple(r[c] for c in self.keys), tuple(r[c] for c in self.names)
            if at is None or at // 1000 * 1000 < passed:
                yield emit(*own, at, *(None for _ in self.out), make(*row))
            else:
                fresh.append((own, row))
        if fresh:
            self.waiting.appendList(_packed(fresh))
            self._wake(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        emit, make, at = self._rows(), Row(*self.names), self.at
        ready, rest = {}, []
        for own, r in _unpacked(self.waiting):
            if r[at] // 1000 * 1000 < passed:
                ready.setdefault(_identity(own), (own, []))[1].append(r)
            else:
                rest.append((own, r))
        memories = {_identity(own): (own, memory, last) for own, memory, last in _unpacked(self.memory)}
        for name, (own, rows) in ready.items():
            _, memory, last = memories.get(name, (own, self.start, None))
            for r in sorted(rows, key=self._sort_key):
                if last is not None and r[at] > last + self.idle:
                    memory = self.start
                memory, found = self.step(memory, make(*r))
                last = r[at]
                if found is not None:
                    yield emit(*own, last, *found, None)
            memories[name] = own, memory, last
        # a row that is on time is at least as late as the watermark, so beyond this it starts anew anyway
        kept = [m for m in memories.values() if (m[2] + self.idle) // 1000 * 1000 >= passed]
        if ready:
            self._keep(self.waiting, rest)
        if ready or len(kept) < len(memories):
            self._keep(self.memory, kept)
        if rest or kept:
            self._wake(timerValues)

    @staticmethod
    def _keep(state, rows: list) -> None:
        if rows:
            state.put(_packed(rows))
        else:
            state.clear()

    def close(self) -> None:
        pass


def in_time_order(rows: DataFrame, keys: list[str], time: str, lateness: timedelta, idle: timedelta, step: Step, start: tuple, out: T.StructType,
                  order: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(keys, ``_at``, ``out``, late): the stream of what ``step`` emits for rows in time order, and rows that came too late.

    ``rows`` is a stream; its columns reach ``step``, with ``_at`` the time in microseconds. What a key remembers starts as ``start``
    and does so again after more than ``idle`` without rows. ``late`` is null, or the columns of a row that came after
    the watermark had passed it or has no time: such rows aren't given to ``step`` and their ``out`` columns are null. Null keys are a key
    like any other; repeated rows are rows of their own; an empty stream gives nothing. Columns named ``_at``, ``_bucket`` or ``_time`` are taken.

    Rows of a bucket of keys that are younger than the lateness are in one task at a time, those of one key are sorted there.
    """
    # the column that bears the watermark is left behind: Spark would drop late rows by it before they can be told apart
    timed = rows.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", f"{_micros(lateness)} microseconds")
    plain = timed.withColumn(AT, F.unix_micros("_time")).drop("_time")
    dealt = plain.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    row = T.StructType([f for f in plain.schema.fields if f.name not in keys])
    emitted = T.StructType([*(plain.schema[k] for k in keys), T.StructField(AT, T.LongType()), *out.fields, T.StructField("late", row)])
    worker = InTimeOrder(step, start, row, out, keys, order or [], idle)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return dealt.groupBy(BUCKET).transformWithState(worker, emitted, "append", "EventTime")


def spaced_rows(events: DataFrame, keys: list[str], ttl: timedelta, lateness: timedelta, time: str = "ts", buckets: int = BUCKETS) -> DataFrame:
    """Of every key the rows that follow the last one kept by more than ``ttl``, as the batch ``jobs.spaced`` has them: (keys, ``_at``, late)."""
    span = _micros(ttl)

    def step(memory, row):
        until = memory[0]
        return ((row[AT] + span,), ()) if until is None or row[AT] > until else (memory, None)

    return in_time_order(events.select(*keys, time), keys, time, lateness, ttl, step, (None,), T.StructType([]), buckets=buckets)


def answer_rows(events: DataFrame, lateness: timedelta, idle: timedelta, time: str = "ts") -> DataFrame:
    """The pieces of every run's answer up to its first ``complete`` event: (run_id, ``_at``, ordinal, part, late).

    ``events``: run_id, seq, type, data and a time; the order is by time, then ``seq``. A piece is a row, so answers may be of any length.
    A run that goes on after more than ``idle`` is a new answer.
    """
    def step(memory, row):
        n, done = memory
        if done or row["type"] not in ("content", "complete"):
            return memory, None
        if row["type"] == "complete":
            return (n, True), None
        return (n + 1, False), (n + 1, row["data"] or "")

    out = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("part", T.StringType())])
    return in_time_order(events.select("run_id", "seq", "type", "data", time), ["run_id"], time, lateness, idle, step, (0, False), out, ["seq"])


def split_late(table: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """A table of what :func:`in_time_order` gave as (what was emitted, the rows that came too late)."""
    return table.where("late is null").drop("late"), table.where("late is not null").select(*keys, "late.*").drop(AT)
