"""Ordered tables laid out by position, which are read only where a page, a search or a cursor needs them.

The rows are range-sorted and written as one folder for each range. An index with a row for each range keeps its number of
rows and the least and greatest value of some keys, so that positions are sums over the index, a place in time is found by
reading the one range that it lies in, and searches and queries go through the ranges from where they are and stop with
what they need.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import staged


@dataclass(frozen=True)
class Range:
    """A folder of the table: its place among all, its number of rows, that of its first one, and (least, greatest, how many not null) of the keys."""

    part: int
    first: int
    n: int
    keys: dict[str, tuple]


@dataclass(frozen=True)
class Cursor:
    """Where a query goes on: the position of the next row to look at."""

    position: int = 0


class Positions:
    """The rows of a table in order, with a dense number `position` from 0.

    The index is kept by the driver: it has one entry for each range, of which there are as many as shuffle partitions.
    """

    def __init__(self, table: DataFrame, ranges: list[Range], position: str, keep: Column | None = None):
        self.table, self.ranges, self.position, self.keep = table, ranges, position, keep

    @classmethod
    def build(cls, df: DataFrame, order: list[str], keys: list[str], position: str = "row_pos", parts: int | None = None) -> Positions:
        """Lays df out in the given order (which has to be total); keys: columns that are looked for, in the index."""
        n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        rows = rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))})
        # the partition column comes last when a folder layout is read
        table = staged(rows.select(*df.columns, "_at", "_part"), "positions", by="_part")
        return cls(table, cls._index(table, keys), position)

    @staticmethod
    def _index(table: DataFrame, keys: list[str]) -> list[Range]:
        stats = [f(k).alias(f"{name}_{k}") for k in keys for name, f in (("least", F.min), ("greatest", F.max), ("known", F.count))]
        found, first = [], 0
        for r in table.groupBy("_part").agg(F.count("*").alias("n"), *stats).orderBy("_part").collect():  # a row for each range
            found.append(Range(r["_part"], first, r["n"], {k: (r[f"least_{k}"], r[f"greatest_{k}"], r[f"known_{k}"]) for k in keys}))
            first += r["n"]
        return found

    def filtered(self, keep: Column, position: str) -> Positions:
        """The rows that match, with positions of their own: the table stays as it is, only its index is made anew."""
        keep = keep if self.keep is None else self.keep & keep
        keys = list(self.ranges[0].keys) if self.ranges else []
        return Positions(self.table, self._index(self.table.where(keep), keys), position, keep)

    def __len__(self) -> int:
        return self.ranges[-1].first + self.ranges[-1].n if self.ranges else 0

    def read(self, ranges: list[Range]) -> DataFrame:
        """The rows of some ranges; only their folders are opened."""
        if not ranges:
            return self._placed(self.table.where(F.lit(False)), [])
        some = self.table.where(F.col("_part").isin([r.part for r in ranges]))
        if self.keep is not None:
            place = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1  # within a range
            some = some.where(self.keep).withColumn("_at", place)
        return self._placed(some, ranges)

    def _placed(self, some: DataFrame, ranges: list[Range]) -> DataFrame:
        if not ranges:
            first = F.lit(0)
        elif len(ranges) == 1:
            first = F.lit(ranges[0].first)
        else:
            first = F.element_at(F.map_from_arrays(F.lit([r.part for r in ranges]), F.lit([r.first for r in ranges])), F.col("_part"))
        return some.withColumn(self.position, (first + F.col("_at")).cast("long")).drop("_part", "_at")

    def rows(self) -> DataFrame:
        return self.read(self.ranges)

    def page(self, first: int, last: int) -> DataFrame:
        """Rows at positions first <= position < last."""
        here = [r for r in self.ranges if r.first < last and r.first + r.n > first]
        return self.read(here).where((F.col(self.position) >= first) & (F.col(self.position) < last))

    def lower_bound(self, key: str, value) -> DataFrame:
        """position: how many rows have a key under value, which is where a value of it would stand in a table ordered by key.

        Ranges that lie under value whole are counted by the index; only those that value lies in are read.
        """
        sure = sum(r.keys[key][2] for r in self.ranges if r.keys[key][1] is not None and r.keys[key][1] < value)
        mixed = [r for r in self.ranges if r.keys[key][1] is not None and r.keys[key][0] < value <= r.keys[key][1]]
        return self.read(mixed).agg((F.count_if(F.col(key) < F.lit(value)) + sure).alias("position"))

    def _steps(self, start: int) -> Iterator[list[Range]]:
        """The ranges from a position on, in groups that double, so that a search ends soon or reads with more and more tasks."""
        ahead = [r for r in self.ranges if r.first + r.n > start]
        size = 1
        while ahead:
            yield ahead[:size]
            ahead = ahead[size:]
            size *= 2

    def search(self, hit: Column, start: int = 0, most: int = 100) -> tuple[list[int], int | None]:
        """Positions of the first `most` hits from start on, and where the next search goes on (None at the end)."""
        found: list[int] = []
        for ranges in self._steps(start):
            rows = self.read(ranges).where((F.col(self.position) >= start) & hit)
            found += [r[0] for r in rows.select(self.position).orderBy(self.position).limit(most - len(found)).collect()]
            if len(found) == most:
                return found, found[-1] + 1
        return found, None

    def search_all(self, hits: dict[str, Column], start: int = 0, most: int = 100) -> dict[str, tuple[list[int], int | None]]:
        """search() for several conditions, which read each range once together; each has its own end."""
        found: dict[str, list[int]] = {name: [] for name in hits}
        for ranges in self._steps(start):
            open_ = [n for n in hits if len(found[n]) < most]
            if not open_:
                break
            of = F.explode(F.filter(F.array(*[F.when(hits[n], F.lit(n)) for n in open_]), lambda x: x.isNotNull())).alias("_of")
            rows = self.read(ranges).where(F.col(self.position) >= start).select(self.position, of)
            place = F.row_number().over(Window.partitionBy("_of").orderBy(self.position))  # a limit by group: Spark keeps only the first ones of a task
            for r in rows.where("_of is not null").withColumn("_n", place).where(F.col("_n") <= most).orderBy(self.position).collect():
                if len(found[r["_of"]]) < most:
                    found[r["_of"]].append(r[self.position])
        return {n: (x, x[-1] + 1 if len(x) == most else None) for n, x in found.items()}

    def query(self, keep: Column, cursor: Cursor = Cursor(), most: int = 100) -> tuple[DataFrame, Cursor | None]:
        """The next rows that match, at most `most`, and the cursor that goes on behind them (None at the end).

        A query that is continued gives the rows of one that is not.
        """
        found, then = self.search(keep, cursor.position, most)
        if not found:
            return self.read([]), None
        here = [r for r in self.ranges if r.first <= found[-1] and r.first + r.n > found[0]]
        rows = self.read(here).where(F.col(self.position).between(found[0], found[-1]) & keep)
        return rows, Cursor(then) if then is not None else None
