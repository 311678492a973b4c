"""Helpers that the operators share: table access, cutting lineage, vectorised word hashing."""

from __future__ import annotations

import atexit
import gc
import json
import re
import shutil
import tempfile
import uuid
import weakref

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[int, str] = {}  # paths of the tables that cut() returned
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none (tests), a local one is made."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    own = tempfile.mkdtemp(prefix="logweave-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Keeps Arrow batches of whole texts small, by rows and by bytes: what executors hold outside of the heap grows with them.

    A setting of the session, as plans read it when they run; a smaller one of the user's stays.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.sub(r"\D", "", str(spark.conf.get(key, None) or ""))
        if not now or int(now) == 0 or int(now) > most:
            spark.conf.set(key, most)


def cut(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, so that a lost executor costs a read, not the lineage.

    free: have the driver collect its garbage, after which Spark deletes the shuffle files of plans that are done with.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/logweave-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = path
    weakref.finalize(out, _written.pop, id(out), None)
    if free:
        release(spark)
    return out


def release(spark: SparkSession) -> None:
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that cut() wrote and that nothing reads any more."""
    spark = df.sparkSession
    if path := _written.pop(id(df), None):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a literal, so that no Python worker reads it."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- vectorised hashing -------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
MULT = _rng.integers(1, 2**64, 512, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    if len(_powers.get("p", ())) < n:
        for key, base in (("p", _BASE), ("i", _INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[key] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the argument is not changed."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums s such that (s[e] - s[b]) * inverse_power[b] hashes codes[b:e]."""
    s = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes) + 1)[0][:-1], out=s[1:])
    return s


def chunks(lengths: np.ndarray, limit: int = 400_000):
    """Ranges of rows with at most limit bytes together (one row may have more)."""
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def raw_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary array and its n + 1 offsets; a null has none."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def shield(df: DataFrame, names: tuple[str, ...]):
    """df with its columns of these names renamed, and the function that gives them their names back: operators add columns so named."""
    own = {c: f"_own_{c}" for c in df.columns if c in names}
    return df.withColumnsRenamed(own), lambda out: out.drop(*own).withColumnsRenamed({v: k for k, v in own.items()})


# --- joins whose small side is checked ----------------------------------------------------------


def checked(small: DataFrame, max_rows: int) -> DataFrame:
    """small with a broadcast hint if it has at most max_rows rows, else as it is: the join then shuffles. Call on cut tables: it counts."""
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", n: str = "n", parts: int = 1000) -> DataFrame:
    """left joined with right (a cut table of one row a key, with column n: the rows of left that have the key).

    Keys with over 1 / parts of all that n counts, of which there are under `parts`, are broadcast, so that their rows stay
    where they are; the others go through the shuffle, where none of them can fill a task.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = right.where(F.col(n) * parts > total)
    if how == "left":
        rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(n) * parts <= total), keys, "left")
    else:
        rest = left.join(right.where(F.col(n) * parts <= total), keys, how)
    return left.join(F.broadcast(hot), keys).unionByName(rest)
