"""`spark.readStream.format("vehiclereceiver")`: bytes of a TCP server as a stream that can be replayed.

What is received lands in numbered files before it counts, so that an offset is the number of files: a trigger that fails, or a query
that starts again, reads the files again. Options: `host`, `port`, `folder` (shared by driver and executors, local or any
store that pyarrow opens), `max_files` (of one trigger, so that a backlog is worked off in steps; default 1,000), `seconds` (a file at least
each so many seconds with data; default 1), `bytes` (at most in a file; default 1 MB). The rows are those that live.messages() takes: sender,
received_us, seq, data.

The connection is opened again whenever it ends. One receiver writes to a folder: it belongs to the query's driver. A receiver that
is stopped lands what it has; what one holds that is killed, up to `seconds` of data, is lost, as TCP has no receipts.
"""

from __future__ import annotations

import socket
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

DATAGRAMS = "sender string, received_us long, seq long, data binary"


def store_of(folder: str):
    """(file system, path) of pyarrow."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlsplit(folder).path)
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


class Landing:
    """Numbered files of chunks in a folder: NNNNNNNNNNNN.arrow, each whole once it has its name."""

    def __init__(self, folder: str):
        self.store, self.folder = store_of(folder)
        self.store.create_dir(self.folder)

    def path(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.arrow"

    def count(self) -> int:
        """How many there are; they are numbered without gaps."""
        from pyarrow import fs

        names = [f.base_name for f in self.store.get_file_info(fs.FileSelector(self.folder)) if f.base_name.endswith(".arrow")]
        return max((int(n.split(".")[0]) + 1 for n in names), default=0)

    def write(self, number: int, rows: list[tuple]) -> None:
        import pyarrow as pa

        table = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("sender", "received_us", "seq", "data"))}, schema=pa.schema([("sender", pa.string()), ("received_us", pa.int64()), ("seq", pa.int64()), ("data", pa.binary())]))
        hidden = f"{self.folder}/.{number:012d}.tmp"
        with self.store.open_output_stream(hidden) as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table)
        self.store.move(hidden, self.path(number))

    def read(self, number: int) -> Iterator[tuple]:
        import pyarrow as pa

        with self.store.open_input_file(self.path(number)) as f:
            for row in pa.ipc.open_file(f).read_all().to_pylist():
                yield row["sender"], row["received_us"], row["seq"], row["data"]


class TcpReceiver(threading.Thread):
    """Lands what a TCP server sends, until stop() is called; the numbers of chunks go on where the folder ends."""

    def __init__(self, host: str, port: int, landing: Landing, seconds: float = 1.0, size: int = 1 << 20, retry: float = 0.5):
        super().__init__(daemon=True)
        self.host, self.port, self.landing, self.seconds, self.size, self.retry = host, port, landing, seconds, size, retry
        self.landed = landing.count()
        self.seq = max((r[2] + 1 for r in landing.read(self.landed - 1)), default=0) if self.landed else 0
        self.ending = threading.Event()

    def stop(self) -> None:
        self.ending.set()

    def _land(self, rows: list[tuple]) -> None:
        if rows:
            self.landing.write(self.landed, rows)
            self.landed += 1

    def run(self) -> None:
        sender = f"{self.host}:{self.port}"
        while not self.ending.is_set():
            rows, held, since = [], 0, time.monotonic()
            try:
                with socket.create_connection((self.host, self.port), timeout=2) as s:
                    s.settimeout(0.1)
                    while not self.ending.is_set():
                        try:
                            data = s.recv(65_536)
                            if not data:
                                break
                            rows.append((sender, int(time.time() * 1e6), self.seq, data))
                            self.seq += 1
                            held += len(data)
                        except TimeoutError:
                            pass
                        if held >= self.size or rows and time.monotonic() - since >= self.seconds:
                            self._land(rows)
                            rows, held, since = [], 0, time.monotonic()
            except OSError:
                pass
            self._land(rows)  # what came before the connection ended
            self.ending.wait(self.retry)


@dataclass
class _File(InputPartition):
    number: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.receiver = options, None
        self.landing = Landing(options["folder"])
        self.most = int(options.get("max_files", 1000))
        self.given = None

    def _receive(self) -> TcpReceiver:
        if self.receiver is None:
            o = self.options
            self.receiver = TcpReceiver(o["host"], int(o["port"]), self.landing, float(o.get("seconds", 1)), int(o.get("bytes", 1 << 20)))
            self.receiver.start()
        return self.receiver

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        there = self._receive().landed
        self.given = there if self.given is None else min(there, self.given + self.most)
        return {"files": self.given}

    def partitions(self, start: dict, end: dict):
        self.given = end["files"]
        return [_File(n) for n in range(start["files"], end["files"])]

    def read(self, partition: _File):
        yield from self.landing.read(partition.number)

    def commit(self, end: dict) -> None:
        pass  # files stay: they are the recording

    def stop(self) -> None:
        if self.receiver is not None:
            self.receiver.stop()

    def __getstate__(self) -> dict:
        return {"options": self.options}  # executors read files only

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["options"])


class VehicleReceiver(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vehiclereceiver"

    def schema(self):
        return DATAGRAMS

    def streamReader(self, schema):
        return _Reader(dict(self.options))
