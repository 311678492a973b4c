"""Tables that are written once and read often, and running aggregates whose windows see one block of rows each."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none (tests), a local one is made."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    own = tempfile.mkdtemp(prefix="logweave-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path in any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder and read again, so that several uses read it and a lost executor costs a read. by: a column to lay it out by.

    The files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/logweave-{uuid.uuid4().hex}/{name}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    fs, at = hadoop(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def looked_up(df: DataFrame, table: DataFrame, on: str | list[str], most: int = 100_000) -> DataFrame:
    """df with what the table has for its key, if anything. A table that counts up to `most` rows is sent to all tasks, so that df stays where it is whatever its keys."""
    small = table.limit(most + 1).count() <= most
    return df.join(F.broadcast(table) if small else table, on, "left")


def block_of(at: str, block: int) -> Column:
    return F.expr(f"`{at}` div {block}")


_KINDS = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}


def running(df: DataFrame, by: list[str], at: str, what: dict[str, tuple[str, Column]], block: int = BLOCK, before: bool = False) -> DataFrame:
    """df with running aggregates name: (max, min, sum or last, column) in the order of the number `at` within the keys `by`.

    before: over the rows before each one only. `last` is the last value that is not null. The rows are cut into blocks of
    `block` numbers; what comes before a block is a running aggregate over the blocks' own, so no window sees all rows of a
    key. The keys and `at` are not null; equal numbers are not expected within a key.
    """
    key = [*by, "_of"]
    rows = df.withColumns({"_of": block_of(at, block), **{f"_v_{n}": c for n, (_, c) in what.items()}})
    end = -1 if before else 0
    upto = Window.partitionBy(*key).orderBy(at).rowsBetween(Window.unboundedPreceding, end)
    earlier = Window.partitionBy(*by).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    own, carried, out = [], [F.col(k) for k in key], {}
    for n, (kind, _) in what.items():
        v, c, o = F.col(f"_v_{n}"), f"_c_{n}", F.col(f"_o_{n}")
        if kind == "last":
            own.append(F.max(F.when(v.isNotNull(), F.struct(F.col(at), v.alias("v")))).alias(f"_o_{n}"))
            carried.append(F.last(o["v"], True).over(earlier).alias(c))
            out[n] = F.coalesce(F.last(v, True).over(upto), F.col(c))
        else:
            agg, both = _KINDS[kind]
            own.append(agg(v).alias(f"_o_{n}"))
            carried.append(agg(o).over(earlier).alias(c))
            out[n] = both(agg(v).over(upto), F.col(c))
    heads = rows.groupBy(*key).agg(*own).select(*carried)
    return rows.join(heads, key).withColumns(out).drop("_of", *[f"_{k}_{n}" for n in what for k in "vc"])
