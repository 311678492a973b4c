"""Opening recordings and querying them: windows, searches, statistics, exports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import log_infos, with_text
from ..operators import filters, lifecycle, ordering, stats
from ..operators.plugins import Plugin, chain
from ..operators.plugins.state import State
from ..operators.positions import Cursor, Positions
from ..sources import datasource, planning, splits


class Unknown(KeyError):
    """No message of the session has that index."""


class Paused(RuntimeError):
    """The session is paused: it starts no jobs until it is resumed."""


@dataclass
class Stream:
    """A filtered view of a session's messages with positions of its own (pos)."""

    id: int
    session: Session
    view: Positions
    first: int
    last: int
    is_filtered: bool
    tag: str

    @contextmanager
    def _job(self) -> Iterator[None]:
        """Jobs that run here end when the stream is closed."""
        if self.session.paused:
            raise Paused
        spark = self.view.table.sparkSession
        spark.addTag(self.tag)
        try:
            yield
        finally:
            spark.removeTag(self.tag)

    @property
    def rows(self) -> DataFrame:
        return self.view.rows()

    def window(self) -> DataFrame:
        return self.view.page(self.first, self.last)

    def change_window(self, first: int, last: int) -> DataFrame:
        """Another window, without filtering again."""
        self.first, self.last = first, last
        return self.window()

    def search(self, fs: list[filters.Filter], start: int = 0, max_results: int = 100) -> tuple[list[int], int | None]:
        """Positions of matches from start on, and where the next search begins (None at the end)."""
        with self._job():
            return self.view.search(filters.combined(fs), start, max_results)

    def search_all(self, searches: dict[str, list[filters.Filter]], start: int = 0, max_results: int = 100) -> dict[str, tuple[list[int], int | None]]:
        """Several searches in one pass."""
        with self._job():
            return self.view.search_all({n: filters.combined(fs) for n, fs in searches.items()}, start, max_results)

    def position_of_time(self, us: int) -> int:
        with self._job():
            return self.view.lower_bound("calculated_time_us", us).first()["position"]

    def position_of_index(self, index: int) -> int:
        """Where the message with this index stands, or would stand by its time or place if the stream leaves it out."""
        with self._job():
            table = self.session.table
            here = [r for r in table.ranges if r.keys["index"][0] <= index <= r.keys["index"][1]]
            row = table.read(here).where(F.col("index") == index).select(table.position, "calculated_time_us").first()
            if row is None:
                raise Unknown(index)
            if not self.is_filtered:
                return row[0]
            if self.session.sorted:
                return self.view.lower_bound("calculated_time_us", row[1]).first()["position"]
            return self.view.lower_bound("index", index).first()["position"]

    def chunks(self, size: int = 20) -> Iterator[list]:
        """The rows in pages; each range of the table is read once and let go."""
        page: list = []
        for r in self.view.ranges:
            with self._job():
                for row in self.view.read([r]).orderBy(self.view.position).toLocalIterator():
                    page.append(row)
                    if len(page) == size:
                        yield page
                        page = []
        if page:
            yield page

    def close(self) -> None:
        """Ends the stream and the jobs that still run for it."""
        self.view.table.sparkSession.interruptTag(self.tag)


@dataclass
class Session:
    """Messages of opened recordings in their final order (row_pos), with lifecycles and statistics."""

    table: Positions
    lifecycles: DataFrame
    sorted: bool = True
    plugins: dict[str, Plugin] = field(default_factory=dict)  # those with a state, by name
    paused: bool = False
    streams: dict[int, Stream] = field(default_factory=dict)
    numbers: Iterator[int] = field(default_factory=lambda: count(1))
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def msgs(self) -> DataFrame:
        return self.table.rows()

    def stream(self, fs: list[filters.Filter] = (), first: int = 0, last: int = 20) -> Stream:
        """A view whose rows are all counted, so that windows and searches know their positions."""
        number, fs = next(self.numbers), list(fs)
        tag = f"logweave-{self.name}-{number}"
        if self.paused:
            raise Paused
        view = self.table.filtered(filters.combined(fs), "pos") if fs else Positions(self.table.table, self.table.ranges, "pos")
        s = Stream(number, self, view, first, last, bool(fs), tag)
        self.streams[s.id] = s
        return s

    def query(self, fs: list[filters.Filter] = (), first: int = 0, last: int = 20) -> DataFrame:
        """The matches first to last in order; reading stops with the window."""
        rows, _ = self.continue_query(fs, Cursor(), last)
        return rows.orderBy(self.table.position).offset(first)

    def continue_query(self, fs: list[filters.Filter], cursor: Cursor, most: int) -> tuple[DataFrame, Cursor | None]:
        """The next matches behind a cursor, and the cursor to go on with."""
        if self.paused:
            raise Paused
        return self.table.query(filters.combined(list(fs)), cursor, most)

    def lifecycle_order(self) -> DataFrame:
        """Lifecycles as they are shown: by start, a resumed one behind where it came from."""
        return ordering.resumed_order(self.lifecycles)

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False

    def plugin_states(self, seen: dict[str, int] | None = None) -> dict[str, State]:
        """The states of plugins that changed since the generations that a viewer has seen."""
        states = {n: p.refresh() if hasattr(p, "refresh") else p.state for n, p in self.plugins.items()}
        return {n: s for n, s in states.items() if s.generation > (seen or {}).get(n, 0)}

    def plugin_command(self, name: str, command: str, params: dict) -> bool:
        """Whether the plugin knows the command and did it."""
        found = self.plugins.get(name)
        return found is not None and command in found.state.commands and found.state.commands[command](params)

    def stop(self, number: int) -> None:
        self.streams.pop(number).close()

    def statistics(self) -> DataFrame:
        return stats.with_descriptions(self.msgs, log_infos(self.msgs))

    def close(self) -> None:
        for n in list(self.streams):
            self.stop(n)


def open_logs(spark: SparkSession, paths: list[str], sort: bool = True, plugins: list[Plugin] = (), text: bool = True, limits: lifecycle.Limits = lifecycle.Limits(), kind: str | None = None) -> Session:
    """Reads, merges, detects lifecycles, applies plugins, sorts. Filters come after all of this, as they see rewritten text."""
    groups = planning.streams(planning.resolve(paths))
    tables = []
    for i, group in enumerate(groups):
        large = all(datasource.kind_of(p, kind) == "dlt" for p in group) and any(splits.size_of(spark, p) > datasource.CHUNK for p in group)
        rows = splits.read_splits(spark, group) if large else datasource.read_logs(spark, group, kind)
        rows = ordering.concat([rows]) if len(group) == 1 and not large else ordering.numbered(rows.drop("index"), ["src_stream", "src_seq"])
        tables.append(rows.withColumns({"src_stream": F.lit(i), "src_seq": F.col("index")}))
    msgs = tables[0]
    for t in tables[1:]:
        msgs = msgs.unionByName(t)
    if len(tables) > 1:
        msgs = ordering.merge(msgs)
    return from_messages(msgs, sort, plugins, text, limits)


def from_messages(msgs: DataFrame, sort: bool = True, plugins: list[Plugin] = (), text: bool = True, limits: lifecycle.Limits = lifecycle.Limits()) -> Session:
    msgs, lcs = lifecycle.detect(msgs, limits)
    for p in plugins:
        if hasattr(p, "use_lifecycles"):
            p.use_lifecycles(lcs)
    msgs = chain(msgs, list(plugins))
    if text:
        msgs = with_text(msgs)
    msgs = ordering.with_calculated_time(msgs, lcs, unknown_at_reception=True) if sort else msgs.withColumn("calculated_time_us", F.col("reception_time_us"))
    order = ["calculated_time_us", "index"] if sort else ["index"]
    return Session(Positions.build(msgs, order, ["calculated_time_us", "index"]), lcs, sort, {p.name: p for p in plugins if hasattr(p, "state")})
