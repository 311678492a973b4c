"""Concatenation, merge, time sort, paging, search and order checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .scan import BLOCK, running, staged


def numbered(df: DataFrame, order: list, name: str = "index") -> DataFrame:
    """df with a dense number from 0 in the given order, which has to be total.

    A range sort deals the rows out in order, and each partition's first number is the sum of the counts before it: no
    partition sees all rows. The sorted rows are written to the shared folder: counts and numbers must come from the same
    ranges, and a second sort would sample other bounds.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = staged(parts.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}), "numbered")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", before.alias("_before"))  # a row for each partition
    return parts.join(F.broadcast(starts), "_p").withColumn(name, F.col("_i") + F.col("_before")).drop("_p", "_i", "_before")


def concat(streams: list[DataFrame]) -> DataFrame:
    """The streams one after another, renumbered; a single one stays as it is."""
    if len(streams) == 1:
        return streams[0]
    all_ = reduce(DataFrame.unionByName, [s.withColumn("src_stream", F.lit(i)) for i, s in enumerate(streams)])
    return numbered(all_.drop("index"), ["src_stream", "src_seq"])


def merge(msgs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Streams (src_stream, src_seq) merged by reception time as a heap of their heads does it: by each stream's running maximum.

    The maximum runs over blocks of a stream, so that one long stream takes many tasks.
    """
    rows = running(msgs, ["src_stream"], "src_seq", {"_key": ("max", F.col("reception_time_us"))}, block)
    return numbered(rows.drop("index"), ["_key", "src_stream", "src_seq"]).drop("_key")


def calculated_time(start: Column, unknown_at_reception: bool = False) -> Column:
    """When a message was logged: lifecycle start + uptime, at most its reception; control requests at their reception.

    A message of an unknown lifecycle counts from 0, as converting has it, or is placed at its reception, as sessions have it.
    """
    t = F.least(F.coalesce(start, F.lit(0)) + C.timestamp_us(), F.col("reception_time_us"))
    late = C.is_ctrl_request() | start.isNull() if unknown_at_reception else C.is_ctrl_request()
    return F.when(late, F.col("reception_time_us")).otherwise(t)


def with_calculated_time(msgs: DataFrame, lifecycles: DataFrame, unknown_at_reception: bool = False) -> DataFrame:
    starts = lifecycles.select(F.col("id").alias("lifecycle"), "start_time_us")
    time = calculated_time(F.col("start_time_us"), unknown_at_reception)
    return msgs.join(starts, "lifecycle", "left").withColumn("calculated_time_us", time).drop("start_time_us")


def time_sort(msgs: DataFrame, lifecycles: DataFrame, unknown_at_reception: bool = False) -> DataFrame:
    """msgs with calculated_time_us and its place row_pos in the order of (calculated time, index)."""
    return numbered(with_calculated_time(msgs, lifecycles, unknown_at_reception), ["calculated_time_us", "index"], "row_pos")


def page(df: DataFrame, first: int, last: int, position: str = "row_pos") -> DataFrame:
    """Rows at positions first <= position < last."""
    return df.where((F.col(position) >= first) & (F.col(position) < last))


def search(df: DataFrame, hit: Column, start: int, max_results: int = 100, position: str = "row_pos") -> DataFrame:
    """Positions of the first max_results hits from start on."""
    return df.where((F.col(position) >= start) & hit).select(position).orderBy(position).limit(max_results)


def lower_bound(df: DataFrame, key: Column, value) -> DataFrame:
    """position: that of the first row whose key is value or more, in a table ordered by key."""
    return df.agg(F.count_if(key < F.lit(value)).alias("position"))


def resumed_order(lifecycles: DataFrame) -> DataFrame:
    """Lifecycles by start; a resumed one directly after where it came from. order_us is what they are ordered by."""
    start = F.when(F.col("resume").isNotNull(), F.greatest(F.col("start_time_us"), F.col("resume.start_time_us") + 1)).otherwise(F.col("start_time_us"))
    return lifecycles.withColumn("order_us", start).orderBy("order_us", "id")


def order_violations(msgs: DataFrame, max_back_us: int = 100_000) -> DataFrame:
    """Rows whose uptime falls by more than max_back_us within a context of one lifecycle, in the order of row_pos."""
    w = Window.partitionBy("ecu", "lifecycle", "ext.apid", "ext.ctid").orderBy("row_pos")
    back = F.lag(C.timestamp_us()).over(w) - C.timestamp_us()
    return msgs.withColumn("back_us", back).where(F.col("back_us") > max_back_us)


def lifecycle_changes(msgs: DataFrame) -> DataFrame:
    """Rows whose lifecycle is another one than that of the ECU's row before, in the order of row_pos; before: the one left."""
    before = F.lag("lifecycle").over(Window.partitionBy("ecu").orderBy("row_pos"))
    return msgs.withColumn("before", before).where(F.col("lifecycle") != F.col("before"))


def buffering_delay(msgs: DataFrame, lifecycles: DataFrame, seconds: int) -> DataFrame:
    """The largest delay between calculated time and reception over the last seconds, by ECU and lifecycle."""
    starts = lifecycles.select(F.col("id").alias("lifecycle"), "start_time_us")
    out = msgs.join(starts, "lifecycle", "left").withColumn("delay_us", F.col("reception_time_us") - calculated_time(F.col("start_time_us")))
    w = Window.partitionBy("ecu", "lifecycle").orderBy(F.floor(F.col("reception_time_us") / 1_000_000)).rangeBetween(-(seconds - 1), 0)
    return out.withColumn("max_delay_us", F.max("delay_us").over(w)).drop("start_time_us")
