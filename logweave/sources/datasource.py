"""`spark.read.format("vehiclelog")`: every format as a Spark source, one task for each file.

Options: `format` (dlt, asc, blf, txt, log, pcap; else by the file's extension). Files are listed on the driver and their
bytes come from Spark's own binary reader in read_logs(), so that any store that Spark reads will do; the named source opens
local and mounted paths itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from fnmatch import fnmatchcase
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.scan import hadoop
from ..schema import MSG_SCHEMA
from . import binary_formats, text_formats, wire


def kind_of(path: str, kind: str | None = None) -> str:
    found = kind or PurePosixPath(path).suffix.lower().lstrip(".")
    return found if found in ("asc", "blf", "txt", "log", "pcap") else "dlt"


def read_messages(raw: bytes, path: str, kind: str | None = None, names: text_formats.Namespace | None = None, number: int = 1, reference_us: int | None = None) -> Iterator[wire.Message]:
    """The messages of one file; number: of the file among those of its kind, for ECU names."""
    kind = kind_of(path, kind)
    if kind == "dlt":
        return wire.scan(raw)
    if kind == "blf":
        return binary_formats.read_blf(raw, names)
    if kind == "pcap":
        return binary_formats.read_pcap(raw)
    lines = text_formats.decoded_lines(raw)
    if kind == "asc":
        return text_formats.read_asc(lines, names, reference_us)
    if kind == "txt":
        return text_formats.read_logcat(lines, names, f"LC{number:02d}")
    return text_formats.read_genlog(lines, names, f"GL{number:02d}")


CHUNK = 64 << 20
NAMED = ("asc", "blf", "txt", "log")  # kinds whose files share names within an opening


def numbers(paths: list[str], kind: str | None) -> list[int]:
    """Of each file, its number among those of its kind."""
    seen: Counter = Counter()
    out = []
    for k in (kind_of(p, kind) for p in paths):
        seen[k] += 1
        out.append(seen[k])
    return out


def asked_names(raw: bytes, path: str, kind: str | None) -> list[tuple[str, str | None]]:
    """What a file asks a Namespace for, in order."""
    notes = text_formats.Requests()
    for _ in read_messages(raw, path, kind, notes):
        pass
    return notes.asked


def plain_uri(uri: str) -> str:
    """file:/x and file:///x are one."""
    return re.sub(r"^(\w+):/+(?=[^/])", r"\1:/", uri) if uri.startswith("file:") else uri


def _place(uri: str, wanted: list[str]) -> int:
    """Which of the wanted URIs a file that Spark reports belongs to: the path itself, a folder of it, or a pattern."""
    own, plain = unquote(uri), [unquote(w) for w in wanted]
    for fits in (lambda p: own == p, lambda p: fnmatchcase(own, p), lambda p: own.startswith(p.rstrip("/") + "/")):
        if found := [i for i, p in enumerate(plain) if fits(p)]:
            return found[0]
    return len(wanted)


def read_logs(spark: SparkSession, paths: list[str], kind: str | None = None) -> DataFrame:
    """Messages of the files, with src_file (as Spark names it), src_stream (the file's place in paths) and src_seq; index counts within a file.

    Files of one base name in different folders are streams of their own. Text and BLF files share one Namespace: where there
    are several, a first pass lists the names that each asks for, and the second one reads with those it got.
    """
    import pandas as pd

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    wanted = [plain_uri(str(fs.makeQualified(at).toUri().toString())) for fs, at in (hadoop(spark, p) for p in paths)]
    order = sorted((r["path"] for r in files.select("path").distinct().toLocalIterator()), key=lambda u: (_place(plain_uri(u), wanted), u))  # names of files only
    stream = {u: i for i, u in enumerate(order)}
    number = dict(zip(order, numbers(order, kind), strict=True))
    named = [u for u in order if kind_of(u, kind) in NAMED]
    given: dict[str, tuple] = {}
    if len(named) > 1:

        def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for path, raw in zip(part["path"], part["content"], strict=True):
                    asked = asked_names(bytes(raw), path, kind) if path in number and kind_of(path, kind) in NAMED else []
                    yield pd.DataFrame({"path": [path] * len(asked), "at": range(len(asked)), "what": [w for w, _ in asked], "name": [n for _, n in asked]})

        rows = files.mapInPandas(ask, "path string, at int, what string, name string").orderBy("at").toLocalIterator()  # names of channels and tags only
        asked: dict[str, list] = {u: [] for u in named}
        for r in rows:
            asked[r["path"]].append((r["what"], r["name"]))
        given = dict(zip(named, text_formats.replay([asked[u] for u in named]), strict=True))

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = MSG_SCHEMA.fieldNames()
        for part in parts:
            for path, raw in zip(part["path"], part["content"], strict=True):
                rows = []
                names = text_formats.Answers(*given[path]) if path in given else None
                for msg in read_messages(bytes(raw), path, kind, names, number[path]):
                    rows.append(msg.row(path, stream[path], msg.index))
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(parse, MSG_SCHEMA)


class _Part(InputPartition):
    def __init__(self, stream: int, path: str, number: int, given: tuple | None):
        self.stream, self.path, self.number, self.given = stream, path, number, given


def _bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.kind = options.get("format")

    def partitions(self):
        named = [i for i, p in enumerate(self.paths) if kind_of(p, self.kind) in NAMED]
        given = {}
        if len(named) > 1:
            given = dict(zip(named, text_formats.replay([asked_names(_bytes(self.paths[i]), self.paths[i], self.kind) for i in named]), strict=True))
        return [_Part(i, p, n, given.get(i)) for i, (p, n) in enumerate(zip(self.paths, numbers(self.paths, self.kind), strict=True))]

    def read(self, partition):
        names = text_formats.Answers(*partition.given) if partition.given else None
        for msg in read_messages(_bytes(partition.path), partition.path, self.kind, names, partition.number):
            yield msg.row(partition.path, partition.stream, msg.index)


class VehicleLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vehiclelog"

    def schema(self):
        return MSG_SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VehicleLogs)
