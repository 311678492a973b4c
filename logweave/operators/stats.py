"""Counts by ECU, application and context, with descriptions from log-info responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_context(msgs: DataFrame) -> DataFrame:
    """ecu, apid, ctid, nr_msgs; messages without extended header count for their ECU only (null ids)."""
    return msgs.groupBy("ecu", F.col("ext.apid").alias("apid"), F.col("ext.ctid").alias("ctid")).agg(F.count("*").alias("nr_msgs"))


def by_application(msgs: DataFrame) -> DataFrame:
    return by_context(msgs).where("apid is not null").groupBy("ecu", "apid").agg(F.sum("nr_msgs").alias("nr_msgs"), F.count("*").alias("nr_ctids"))


def by_ecu(msgs: DataFrame) -> DataFrame:
    return by_context(msgs).groupBy("ecu").agg(F.sum("nr_msgs").alias("nr_msgs"))


def descriptions(infos: DataFrame) -> DataFrame:
    """Of rows (index, ecu, apid, ctid, description) the first of each id."""
    return infos.where("description is not null").groupBy("ecu", "apid", "ctid").agg(F.min_by("description", "index").alias("description"))


def with_descriptions(msgs: DataFrame, infos: DataFrame) -> DataFrame:
    """Counts with descriptions; ids that are only described count zero."""
    # counts and descriptions are both one row an id: summed up together they need no join
    a = by_context(msgs).withColumn("description", F.lit(None).cast("string"))
    b = descriptions(infos).withColumn("nr_msgs", F.lit(0).cast("long"))
    return a.unionByName(b).groupBy("ecu", "apid", "ctid").agg(F.sum("nr_msgs").alias("nr_msgs"), F.max("description").alias("description"))


def tree(msgs: DataFrame) -> DataFrame:
    """One row for each ECU with its applications and contexts nested."""
    apps = by_context(msgs).groupBy("ecu", "apid").agg(F.sum("nr_msgs").alias("nr_msgs"), F.array_sort(F.collect_list(F.struct("ctid", "nr_msgs"))).alias("ctids"))
    return apps.groupBy("ecu").agg(
        F.sum("nr_msgs").alias("nr_msgs"), F.array_sort(F.collect_list(F.when(F.col("apid").isNotNull(), F.struct("apid", "nr_msgs", "ctids")))).alias("apids")
    )


def distinct_ecus(msgs: DataFrame) -> DataFrame:
    return msgs.select("ecu").distinct()


def counter_gaps(msgs: DataFrame, key: list[str], counter: str, order: list[str], modulus: int) -> DataFrame:
    """Lost packets by key: gaps of a wrapping counter."""
    from pyspark.sql import Window

    before = F.lag(counter).over(Window.partitionBy(*key).orderBy(*order))
    gap = F.pmod(F.col(counter) - before - 1, F.lit(modulus))
    return msgs.withColumn("gap", F.coalesce(gap, F.lit(0))).groupBy(*key).agg(F.sum("gap").alias("lost"), F.count("*").alias("received"))
