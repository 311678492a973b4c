"""Writing messages: binary files, text styles, reports."""

from __future__ import annotations

import os
import uuid
import zipfile
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import columns as C
from ..functions.payload import decoded_text
from ..sources import wire


def _of(row) -> wire.Message:
    e = row["ext"]
    ext = None if e is None else (e["verb_mstp_mtin"], e["noar"], bytes(e["apid"]), bytes(e["ctid"]))
    return wire.Message(row["reception_time_us"], bytes(row["ecu"]), row["timestamp_dms"], row["htyp"], row["mcnt"], 0, ext, bytes(row["payload"] or b""))


def serialised(msgs: DataFrame) -> DataFrame:
    """msgs with raw: each message in file form."""
    @F.pandas_udf("binary")
    def run(us: pd.Series, ecu: pd.Series, dms: pd.Series, htyp: pd.Series, mcnt: pd.Series, ext: pd.DataFrame, payload: pd.Series) -> pd.Series:
        out = []
        for u, e, d, h, m, v, n, a, c, p in zip(us, ecu, dms, htyp, mcnt, ext["verb_mstp_mtin"], ext["noar"], ext["apid"], ext["ctid"], payload, strict=True):
            x = None if pd.isna(v) else (int(v), int(n), bytes(a), bytes(c))
            out.append(wire.write(wire.Message(int(u), bytes(e), int(d), int(h), int(m), 0, x, bytes(p or b""))))
        return pd.Series(out, dtype=object)

    return msgs.withColumn("raw", run("reception_time_us", "ecu", "timestamp_dms", "htyp", "mcnt", "ext", "payload"))


def write_dlt(msgs: DataFrame, path: str, order: str = "index") -> int:
    """One binary file in the given order: rows are sorted by the cluster and come to the driver partition by partition."""
    n = 0
    with open(path, "wb") as f:
        for row in serialised(msgs).select(order, "raw").orderBy(order).toLocalIterator():
            f.write(row["raw"])
            n += 1
    return n


class Traces(DataSource):
    """`df.write.format("vehicletrace")`: the column raw of each partition as one binary trace, part-NNNNN.dlt, written by its task.

    Files are written where Python writes: local, mounted, or any store that pyarrow opens by its URI. A task writes under a
    name of its own, which the driver changes when the job is done, so that a task that runs twice leaves one file.
    """

    @classmethod
    def name(cls) -> str:
        return "vehicletrace"

    def schema(self):
        return "raw binary"

    def writer(self, schema, overwrite: bool):
        return _TraceWriter(self.options["path"])


@dataclass
class _Written(WriterCommitMessage):
    part: int
    name: str | None


class _TraceWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def _store(self):
        from pyarrow import fs

        if self.path.startswith("file:"):
            return fs.LocalFileSystem(), unquote(urlsplit(self.path).path)
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, iterator):
        from pyspark import TaskContext

        part, name, out = TaskContext.get().partitionId(), f"_{uuid.uuid4().hex}.tmp", None
        store, folder = self._store()
        for row in iterator:
            if out is None:
                store.create_dir(folder)
                out = store.open_output_stream(f"{folder}/{name}")
            out.write(bytes(row["raw"]))
        if out is not None:
            out.close()
        return _Written(part, name if out is not None else None)

    def commit(self, messages):
        store, folder = self._store()
        for m in messages:
            if m is not None and m.name:
                store.move(f"{folder}/{m.name}", f"{folder}/part-{m.part:05d}.dlt")

    def abort(self, messages):
        store, folder = self._store()
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{folder}/{m.name}")


def write_parts(msgs: DataFrame, path: str, order: str | list[str] = "index") -> None:
    """Binary traces in a folder, one for each partition of msgs, in order within each; repartitionByRange(order) before makes them follow one another."""
    msgs.sparkSession.dataSource.register(Traces)
    serialised(msgs.sortWithinPartitions(order)).select("raw").write.format("vehicletrace").mode("append").save(path)


def lines(msgs: DataFrame, style: str = "ascii", zone: str | None = None) -> DataFrame:
    """index and line: 'header', 'ascii' (header and payload text) or 'hex' (header and payload bytes)."""
    head = C.header_line(zone)
    if style == "header":
        line = head
    elif style == "hex":
        line = F.concat(head, F.lit(" ["), C.hex_dump(F.coalesce("payload", F.lit(b""))), F.lit("]"))
    else:
        line = F.concat(head, F.lit(" ["), decoded_text(), F.lit("]"))
    return msgs.select("index", line.alias("line"))


def transfer_report(found: DataFrame) -> DataFrame:
    state = F.when(F.col("state") == "Error", F.concat(F.lit("Error("), F.col("code").cast("string"), F.lit(", "), F.col("errno").cast("string"), F.lit(")"))).otherwise(F.col("state"))
    return found.select("first_index", F.concat_ws(" ", C.id_text(F.col("ecu")), F.concat(F.lit("LC#"), F.col("lifecycle").cast("string")), "name", F.col("size").cast("string"), state).alias("line"))


class RollingFile:
    """Capture files name_001.dlt, name_002.dlt of at most size bytes, optionally zipped when they are full."""

    LEAST = 1_000_000

    def __init__(self, stem: str, size: int, zipped: bool = False):
        self.stem, self.size, self.zipped = stem, max(size, self.LEAST), zipped
        self.number, self.file, self.used, self.paths = 0, None, 0, []

    def write(self, raw: bytes) -> None:
        if self.file is None or self.used + len(raw) > self.size:
            self.close()
            self.number += 1
            self.paths.append(f"{self.stem}_{self.number:03d}.dlt")
            self.file, self.used = open(self.paths[-1], "wb"), 0
        self.file.write(raw)
        self.used += len(raw)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None
            if self.zipped:
                path = self.paths[-1]
                with zipfile.ZipFile(path + ".zip", "w", zipfile.ZIP_DEFLATED) as z:
                    z.write(path, os.path.basename(path))
                os.remove(path)
                self.paths[-1] = path + ".zip"


def forward(msgs: DataFrame, levels: dict[tuple[bytes, bytes], int], default: int = 7) -> DataFrame:
    """What a viewer gets that set levels by (application, context): log messages up to the level, and those without header."""
    level = F.lit(default)
    for (apid, ctid), n in levels.items():
        level = F.when((F.col("ext.apid") == F.lit(apid)) & (F.col("ext.ctid") == F.lit(ctid)), n).otherwise(level)
    return msgs.where(F.col("ext").isNull() | (C.log_level() <= level))
