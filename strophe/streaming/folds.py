"""Order-dependent folds over streams: greedy boundaries, gap merges with a running confidence, compaction of sections.

Rows of a key wait in a list until the watermark has passed them; then they are taken in order of their time, whatever
batch each came with, and folded into a value that is kept between batches. A timer wakes a key when its next row is due or
when what is open has to be closed. So the results are those of the batch operators over the same rows.

A row that comes after the watermark has passed its time is left out, as it is in windowed aggregations, and so is one without
a time; a null key is a key. Rows of one time are ordered by all their columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.events import SEVERITIES

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold:
    """What becomes of a key's rows in order. The state is plain values, kept as JSON."""

    #: The columns it takes besides the time, and those that it gives besides the key.
    takes: tuple[str, ...]
    gives: str

    def start(self) -> Any:
        return None

    def step(self, state: Any, t: int, row: tuple) -> tuple[Any, list[tuple]]:
        """The state after a row, and what is complete by then."""
        raise NotImplementedError

    def closes(self, state: Any) -> int | None:
        """The time (in microseconds) after which what is open can't change any more, null if nothing is or nothing does."""
        return None

    def close(self, state: Any) -> tuple[Any, list[tuple]]:
        return state, []


class Boundaries(Fold):
    """Positions at which a value jumps by more than ``jump``, at least ``least`` rows after the one before; the first row is one."""

    gives = "at long, value double"

    def __init__(self, value: str, jump: float, least: int):
        self.takes, self.jump, self.least = (value,), jump, least

    def start(self) -> Any:
        return [0, 0, None]  # rows so far, the last cut, the last value

    def step(self, state: Any, t: int, row: tuple) -> tuple[Any, list[tuple]]:
        (n, last, was), v = state, row[0]
        cut = n == 0 or (v is not None and was is not None and abs(v - was) > self.jump and n - last >= self.least)
        return [n + 1, n if cut else last, v], [(n, v)] if cut else []


class Merge(Fold):
    """Events no further apart than ``gap`` seconds as one interval, with the worst severity and the running mean of the confidence."""

    takes = ("severity", "confidence")
    gives = "start_t timestamp, end_t timestamp, samples long, severity string, confidence double"

    def __init__(self, gap: float):
        self.gap = round(gap * 1e6)

    def step(self, state: Any, t: int, row: tuple) -> tuple[Any, list[tuple]]:
        rank, confidence = SEVERITIES.index(row[0]), row[1]
        if state is None or t - state[1] > self.gap:
            return [t, t, 1, rank, round(confidence, 2)], self.told(state)
        a, _, n, worst, mean = state
        return [a, t, n + 1, max(worst, rank), round((mean * n + confidence) / (n + 1), 2)], []

    def told(self, state: Any) -> list[tuple]:
        return [] if state is None else [(Time(state[0]), Time(state[1]), state[2], SEVERITIES[state[3]], state[4])]

    def closes(self, state: Any) -> int | None:
        return None if state is None else state[1] + self.gap

    def close(self, state: Any) -> tuple[Any, list[tuple]]:
        return None, self.told(state)


class Compaction(Fold):
    """Sections (a row each, at the time they end) shorter than ``least`` frames go into the one before; a ``verse`` takes on the label.

    The last section is open until ``idle`` seconds have passed without another.
    """

    takes = ("first_frame", "last_frame", "n", "label", "confidence")
    gives = "first_frame long, last_frame long, n long, label string, confidence double"

    def __init__(self, least: int, idle: float):
        self.least, self.idle = least, round(idle * 1e6)

    def step(self, state: Any, t: int, row: tuple) -> tuple[Any, list[tuple]]:
        a, b, n, label, confidence = row
        if state is not None and n < self.least:
            _, first, _, count, name, mean = state
            return [t, first, b, count + n, label if name == "verse" else name, round((mean + confidence) / 2, 2)], []
        return [t, a, b, n, label, confidence], [] if state is None else [tuple(state[1:])]

    def closes(self, state: Any) -> int | None:
        return None if state is None else state[0] + self.idle

    def close(self, state: Any) -> tuple[Any, list[tuple]]:
        return None, [tuple(state[1:])]


class Time(int):
    """Microseconds since 1970 that are given back as a timestamp."""


class Ordered(StatefulProcessor):
    """Runs a fold over each key's rows in order of their time."""

    def __init__(self, fold: Fold, keys: list[str]):
        self.fold, self.keys = fold, len(keys)
        self.row = Row(*keys, *StructType.fromDDL(fold.gives).names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row string")
        self.folded = handle.getValueState("folded", "state string, wakes long, passed long")

    def load(self) -> tuple[Any, int, int]:
        """The fold's state, the time of the timer that is set (0: none), and the time up to which rows were taken."""
        held = self.folded.get() if self.folded.exists() else None
        return (self.fold.start(), 0, -(2**62)) if held is None else (json.loads(held[0]), held[1], held[2])

    def advance(self, key: tuple, watermark_ms: int, new: list[tuple]) -> Iterator[Row]:
        state, wakes, passed = self.load()
        now = max(passed, watermark_ms * 1000)
        rows = [tuple(json.loads(r[0])) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = sorted([*rows, *(r for r in new if r[0] > passed)], key=lambda r: (r[0], json.dumps(r[1:])))
        out: list[tuple] = []

        def close(until: int) -> None:
            nonlocal state
            due = self.fold.closes(state)
            if due is not None and due < until:
                state, told = self.fold.close(state)
                out.extend(told)

        ready = [r for r in rows if r[0] <= now]
        for t, *row in ready:
            close(t)
            state, told = self.fold.step(state, t, tuple(row))
            out.extend(told)
        close(now)
        left = rows[len(ready) :]
        due = [x for x in (left[0][0] if left else None, self.fold.closes(state)) if x is not None]
        at = min(due) // 1000 + 1 if due else 0
        if at and at != wakes:
            self.handle.registerTimer(at)
        self.waiting.clear()
        if left:
            self.waiting.put([(json.dumps(r),) for r in left])
        self.folded.update((json.dumps(state), at, now))
        for values in out:
            yield self.row(*key, *(_moment(v) if isinstance(v, Time) else v for v in values))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [tuple(r)[self.keys :] for r in rows]
        yield from self.advance(tuple(key), max(0, timerValues.getCurrentWatermarkInMs()), [r for r in new if r[0] is not None])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        yield from self.advance(tuple(key), max(0, timerValues.getCurrentWatermarkInMs()), [])

    def close(self) -> None:
        pass


def _moment(micros: int):
    import datetime as dt

    return dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=micros)


def folded(stream: DataFrame, keys: list[str], ts: str, fold: Fold, late: str) -> DataFrame:
    """The fold's results over a stream, by key; rows that are later than ``late`` are left out."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    told = stream.withWatermark(ts, late).select(*keys, F.unix_micros(ts).alias("_t"), *fold.takes, ts)
    shape = StructType.fromDDL(", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys) + ", " + fold.gives)
    return told.groupBy(*keys).transformWithState(Trimmed(fold, keys), shape, "append", "eventTime")


class Trimmed(Ordered):
    """Rows come with their timestamp as the last column, which the watermark needs and the fold doesn't."""

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        yield from super().handleInputRows(key, (Row(*tuple(r)[:-1]) for r in rows), timerValues)
