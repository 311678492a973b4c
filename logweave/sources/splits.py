"""Binary traces of any size on any store that Spark reads, in splits.

Spark's text reader takes the four bytes of the message header as its line separator, so that splits begin at headers and no
file is opened by Python. Each split decodes its own middle. What lies near its ends depends on the neighbours: a message may reach over, or
hold something that looks like a header. So the bytes near the ends are put together again, a few hundred KB for each pair
of neighbours, and decoded there.

A message has at most LONGEST bytes. A decoder that starts in the middle of a file finds its first message by a header whose
message, and the one behind it, can be read; it is given LONGEST bytes to do so before anything it finds counts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.scan import hadoop, staged
from ..schema import MSG_SCHEMA
from . import wire

ZONE = wire.LONGEST + 4
PROBE = 1 << 20
_EDGE = "path string, block long, at long, whole boolean, size long, raw binary"


def head_of(spark: SparkSession, path: str, n: int = PROBE) -> bytes:
    """The first n bytes of a file in any store."""
    fs, at = hadoop(spark, path)
    stream = fs.open(at)
    try:
        size = min(n, fs.getFileStatus(at).getLen())
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) if size else b""
    finally:
        stream.close()


def size_of(spark: SparkSession, path: str) -> int:
    fs, at = hadoop(spark, path)
    return fs.getFileStatus(at).getLen()


class Split:
    """Takes a split's bytes in order, gives the messages of its middle, and keeps its ends."""

    def __init__(self, magic: bytes):
        self.magic, self.buf, self.base, self.head, self.next = magic, bytearray(), 0, b"", None

    @property
    def end(self) -> int:
        return self.base + len(self.buf)

    def feed(self, raw: bytes) -> None:
        if len(self.head) < 3 * ZONE:
            self.head += raw[: 3 * ZONE - len(self.head)]
        self.buf += raw

    def messages(self, last: bool = False) -> Iterator[tuple[int, wire.Message]]:
        """(place, message) of what is certain by now; all of the middle at last."""
        if not last and len(self.buf) < 64 * ZONE or self.end <= 4 * ZONE:
            return
        until = self.end - 2 * ZONE
        if self.next is None:
            found = wire.first_message(self.buf[ZONE - self.base :], self.magic)
            self.next = self.end if found is None else ZONE + found
        for at, msg, then in wire.decode(self.buf, self.next - self.base, until - self.base, self.magic):
            if self.base + at >= 2 * ZONE:
                yield self.base + at, msg
            self.next = self.base + then
        keep = min(self.next, self.end - 3 * ZONE)
        if keep > self.base:
            del self.buf[: keep - self.base]
            self.base = keep

    def edges(self) -> list[tuple[int, bool, int, bytes]]:
        """(place, whether that is all, size of the split, bytes)."""
        if self.end <= 4 * ZONE:
            return [(0, True, self.end, bytes(self.buf))]
        at = self.end - 3 * ZONE
        return [(0, False, self.end, self.head), (at, False, self.end, bytes(self.buf[at - self.base :]))]


def _decode_splits(magic: bytes, place: dict[str, int]):
    import pandas as pd

    names = [*MSG_SCHEMA.fieldNames(), "path", "block", "at", "whole", "size", "raw"]

    def frame(path, block, found):
        rows = []
        for at, msg in found:
            msg.index = block + at
            rows.append((*msg.row(path, place.get(path, 0), msg.index), *[None] * 6))
            if len(rows) >= 20_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    def ends(path, block, split):
        yield from frame(path, block, split.messages(last=True))
        nothing = [None] * len(MSG_SCHEMA)
        yield pd.DataFrame([(*nothing, path, block, *e) for e in split.edges()], columns=names)

    def run(batches):
        now, split = None, None
        for b in batches:
            for path, block, value in zip(b["path"], b["block"], b["value"], strict=True):
                if (path, block) != now:
                    if now:
                        yield from ends(*now, split)
                    now, split = (path, block), Split(magic)
                    split.feed(bytes(value) if block == 0 else magic + bytes(value))  # what is before the first header of a file has none
                else:
                    split.feed(magic + bytes(value))
            if now:
                yield from frame(*now, split.messages())
        if now:
            yield from ends(*now, split)

    return run


def _decode_edges(magic: bytes, place: dict[str, int]):
    """Decodes the bytes around each pair of neighbours, which come as pieces in order."""
    import pandas as pd

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = sorted(zip(pdf["block"], pdf["at"], pdf["size"], pdf["whole"], pdf["raw"], pdf["first"], pdf["last"], strict=True), key=lambda p: p[:2])
        buf, starts = b"", []
        for block, at, size, whole, raw, _, _ in pieces:
            starts.append((len(buf), block + at))
            buf += bytes(raw)
        begin, end = pieces[0], pieces[-1]
        from_start = bool(begin[5]) and begin[1] == 0
        to_end = bool(end[6]) and (bool(end[3]) or end[1] > 0)
        if from_start:
            at, least = 0, 0
        else:
            found = wire.first_message(buf, magic)
            at, least = (len(buf), len(buf)) if found is None else (found, ZONE)
        until = len(buf) if to_end else len(buf) - ZONE
        rows, k = [], 0
        for i, msg, _ in wire.decode(buf, at, until, magic):
            if i < least:
                continue
            while k + 1 < len(starts) and starts[k + 1][0] <= i:
                k += 1
            msg.index = int(starts[k][1] + i - starts[k][0])
            rows.append(msg.row(key[0], place.get(key[0], 0), msg.index))
        return pd.DataFrame(rows, columns=MSG_SCHEMA.fieldNames())

    return run


def read_splits(spark: SparkSession, paths: list[str], magic: bytes | None = None, split_bytes: int | None = None) -> DataFrame:
    """Messages of binary traces; src_seq and index grow with the place in the file, and ordering.numbered() makes them dense.

    magic: of the headers; else it is found in the first megabyte of each file. A file without a message there is read with
    storage headers, and with serial ones if there are none. src_stream is the file's place in paths. split_bytes: of a split, else
    what the session has. Bytes between two headers are one line, of which Spark takes 2 GB.
    """
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    if split_bytes:
        spark.conf.set(key, split_bytes)
    try:
        return _read_all(spark, paths, magic)
    finally:
        spark.conf.set(key, before)


def _read_all(spark: SparkSession, paths: list[str], magic: bytes | None) -> DataFrame:
    uris = {str(fs.makeQualified(at).toString()): i for i, (fs, at) in enumerate(hadoop(spark, p) for p in paths)}
    by_magic: dict[bytes | None, list[str]] = {}
    for p in paths:
        first = None if magic else wire.begin(head_of(spark, p))
        by_magic.setdefault(magic or (first and first[0]), []).append(p)
    out = spark.createDataFrame([], MSG_SCHEMA)
    unknown = by_magic.pop(None, [])
    tables = [_read(spark, ps, m, uris) for m, ps in by_magic.items()]
    for p in unknown:
        found = _read(spark, [p], S.STORAGE_MAGIC, uris)
        tables.append(found if found.limit(1).count() else _read(spark, [p], S.SERIAL_MAGIC, uris))
    for t in tables:
        out = out.unionByName(t)
    return out


def _read(spark: SparkSession, paths: list[str], magic: bytes, uris: dict[str, int]) -> DataFrame:
    # whatever the bytes of a line, Spark keeps them as they are
    text = spark.read.option("lineSep", magic.decode("latin-1")).text(paths)
    text = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MSG_SCHEMA) + ", " + _EDGE
    found = staged(text.mapInPandas(_decode_splits(magic, uris), schema), "splits")
    edges = found.where("raw is not null").select("path", "block", "at", "whole", "size", "raw")
    # a large split ends one group of neighbours and begins the next; small ones lie within a group
    w = Window.partitionBy("path").orderBy("block", "at")
    edges = edges.withColumns({"group": F.coalesce(F.sum(F.when(~F.col("whole") & (F.col("at") > 0), 1).otherwise(0)).over(w), F.lit(0)), "first": F.col("block") == F.min("block").over(Window.partitionBy("path")), "last": F.col("block") == F.max("block").over(Window.partitionBy("path"))})
    near = edges.groupBy("path", "group").applyInPandas(_decode_edges(magic, uris), MSG_SCHEMA)
    return found.where("raw is null").select(*MSG_SCHEMA.fieldNames()).unionByName(near)
