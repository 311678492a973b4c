"""Bounded reordering of streams: rows wait in state until nothing earlier can come any more, as far as the bound goes.

Each key's rows are taken in the order of `arrival` and given out with out_seq, their place in the key's output. What waits, at most
what the bound lets wait, is a list state; a row that comes later than the bound allows is passed on at once, out of order.
With idle_ms, what still waits is given out when a key had no rows for so long.
"""

from __future__ import annotations

import heapq
import pickle
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
WARMING_UP = 1000 * SECOND  # the bound of a lifecycle whose window is not full yet


@dataclass
class Fifo:
    """Holds n rows back."""

    n: int

    def add(self, held: deque, row: tuple) -> Iterator[tuple]:
        if len(held) == self.n:
            yield held.popleft()
        held.append(row)

    def rest(self, held: deque) -> Iterator[tuple]:
        yield from held

    def load(self, rows: list[tuple]) -> deque:
        return deque(rows)


@dataclass
class Smallest:
    """Holds n rows and gives out the smallest by (time, arrival) before it takes another one."""

    n: int

    def add(self, held: list, row: tuple) -> Iterator[tuple]:
        if len(held) == self.n:
            yield heapq.heappop(held)
        heapq.heappush(held, row)

    def rest(self, held: list) -> Iterator[tuple]:
        yield from sorted(held)

    def load(self, rows: list[tuple]) -> list:
        heapq.heapify(rows)
        return rows


@dataclass
class Window:
    """The greatest delays of a lifecycle in each of its last seconds with messages."""

    lifecycle: int
    seconds: deque = field(default_factory=deque)  # [first reception, greatest delay]
    greatest: int = 0

    def bound(self, now: int, size: int) -> int:
        return WARMING_UP if self.seconds[0][0] + (size - 1) * SECOND > now else self.greatest


@dataclass
class ByTime:
    """Rows go out in the order of (time, arrival) once their time is more than the bound before the latest reception.

    The bound is `least` and, with a window of so many seconds, the greatest delay that any ECU's lifecycle showed in it.
    """

    least: int = 20 * SECOND
    window: int = 0
    bound: int = -1
    ecus: dict = field(default_factory=dict)

    def _learn(self, ecu: bytes, lifecycle: int, reception: int, delay: int) -> None:
        w = self.ecus.setdefault(ecu, Window(lifecycle))
        again = whole = False
        if w.lifecycle != lifecycle:
            w = self.ecus[ecu] = Window(lifecycle, greatest=delay)
            again = True
        if not w.seconds or w.seconds[-1][0] + SECOND < reception:
            if len(w.seconds) == self.window:
                whole = w.seconds.popleft()[1] == w.greatest
            w.seconds.append([reception, delay])
            again = True
        elif w.seconds[-1][1] < delay:
            w.seconds[-1][1] = delay
            again |= delay > w.greatest
        if delay > w.greatest:
            w.greatest = delay
        elif whole:
            w.greatest = max(d for _, d in w.seconds)
        if again:
            self.bound = self.least + max(x.bound(reception, self.window) for x in self.ecus.values())

    def add(self, held: list, row: tuple) -> Iterator[tuple]:
        time, _, reception, ecu, lifecycle = row[:5]
        if self.window:
            self._learn(bytes(ecu), lifecycle, reception, reception - time)
        else:
            self.bound = self.least
        heapq.heappush(held, row)
        while held and held[0][0] + self.bound < reception:
            yield heapq.heappop(held)

    rest, load = Smallest.rest, Smallest.load


class _Reorder(StatefulProcessor):
    """Rows are (time, arrival, reception, ecu, lifecycle, further columns)."""

    def __init__(self, way: Fifo | Smallest | ByTime, columns: list[str], schema: StructType, idle_ms: int | None):
        self.way, self.columns, self.schema, self.idle_ms = way, columns, schema, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.kept = handle.getValueState("kept", "seq long, way binary")

    def _frame(self, rows: list[tuple], seq: int):
        import pandas as pd

        out = pd.DataFrame(rows, columns=self.columns)
        out["out_seq"] = range(seq, seq + len(rows))
        return out

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        seq, way = self.kept.get() if self.kept.exists() else (0, None)
        way = pickle.loads(way) if way else self.way
        held = way.load([tuple(r) for r in self.held.get()] if self.held.exists() else [])
        new = pd.concat(list(rows)).sort_values(self.columns[1])[self.columns]
        out = [x for row in new.astype(object).itertuples(index=False, name=None) for x in way.add(held, tuple(bytes(v) if isinstance(v, bytearray) else v for v in row))]
        self.held.clear()
        if held:
            self.held.put([tuple(r) for r in held])
        self.kept.update((int(seq) + len(out), pickle.dumps(way)))
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._frame(out, int(seq))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seq, way = self.kept.get()
        way = pickle.loads(way)
        rows = list(way.rest(way.load([tuple(r) for r in self.held.get()] if self.held.exists() else [])))
        self.held.clear()
        self.kept.update((int(seq) + len(rows), pickle.dumps(way)))
        yield self._frame(rows, int(seq))

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def reordered(rows: DataFrame, way: Fifo | Smallest | ByTime, key: str = "src_stream", time: str = "calculated_time_us", arrival: str = "index", idle_ms: int | None = None) -> DataFrame:
    """A stream with the same columns and out_seq, in another order within each key; rows have reception_time_us, ecu and lifecycle too."""
    use_rocksdb(rows.sparkSession)
    first = [time, arrival, "reception_time_us", "ecu", "lifecycle"]
    columns = first + [c for c in rows.columns if c not in first]
    schema = StructType([rows.schema[c] for c in columns])
    out = StructType([*schema.fields, StructField("out_seq", LongType())])
    processor = _Reorder(way, columns, schema, idle_ms)
    return rows.groupBy(key).transformWithStateInPandas(processor, out, "Append", "ProcessingTime" if idle_ms else "None")
