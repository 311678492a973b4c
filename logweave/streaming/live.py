"""Live ingest: receivers land batches of raw datagrams, Structured Streaming turns them into messages.

Framing per sender and lifecycles per ECU are stateful operators over the same classes that batch uses.
"""

from __future__ import annotations

import os
import pickle
import socket
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import Limits, Machine, Row, detection_input
from ..schema import MSG_SCHEMA
from ..sources import wire
from ..sources.binary_formats import Framing

DATAGRAMS = "sender string, received_us long, seq long, data binary"


def udp_receiver(port: int, folder: str, batches: int | None = None, group: str | None = None, timeout: float = 0.5, batch_seconds: float = 1.0) -> int:
    """Lands datagrams as Parquet files in folder, one for each batch_seconds with data; returns how many datagrams came."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    sock = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    sock.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
    sock.setsockopt(socket.SOL_SOCKET, socket.SO_RCVBUF, 26_000_000)
    sock.bind(("", port))
    if group:
        sock.setsockopt(socket.IPPROTO_IP, socket.IP_ADD_MEMBERSHIP, socket.inet_aton(group) + socket.inet_aton("0.0.0.0"))
    sock.settimeout(timeout)
    n = done = 0
    with sock:
        while batches is None or done < batches:
            rows, until = [], time.monotonic() + batch_seconds
            while time.monotonic() < until:
                try:
                    data, (host, _) = sock.recvfrom(65_536)
                except TimeoutError:
                    continue
                rows.append((host, int(time.time() * 1e6), n, data))
                n += 1
            if rows:
                path = os.path.join(folder, f".{n:012d}.tmp")
                pq.write_table(pa.table({c: [r[i] for r in rows] for i, c in enumerate(("sender", "received_us", "seq", "data"))}), path)
                os.rename(path, os.path.join(folder, f"{n:012d}.parquet"))  # files appear whole
            done += 1
    return n


def tcp_chunks(host: str, port: int, retry_seconds: float = 1.0, stop=lambda: False) -> Iterator[bytes]:
    """Data of a TCP server; connects again when the connection ends."""
    while not stop():
        try:
            with socket.create_connection((host, port), timeout=5) as s:
                while data := s.recv(65_536):
                    yield data
        except OSError:
            pass
        time.sleep(retry_seconds)


def serial_messages(path: str, ecu: bytes = b"SER\0") -> Iterator[wire.Message]:
    """Messages with serial header from a device opened as a plain file."""
    rest = b""
    with open(path, "rb", buffering=0) as f:
        while data := f.read(4096):
            rest += data
            at = 0
            while True:
                try:
                    at, msg = wire.read_serial(rest, at, ecu, now=True)
                    yield msg
                except wire.Invalid:
                    at += 1
                except wire.NotEnough:
                    break
            rest = rest[at:]


def messages(datagrams: DataFrame, ecu: bytes = b"\0\0\0\0") -> DataFrame:
    """Messages of a stream of datagrams: what is left of one waits in the sender's state for the next."""
    import pandas as pd

    columns = MSG_SCHEMA.fieldNames()

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, number = state.get if state.exists else (b"", 0)
        framing = Framing()
        if rest:
            framing.rest[key] = bytes(rest)
        rows = []
        for p in parts:
            p = p.sort_values("seq")
            for us, data in zip(p["received_us"], p["data"], strict=True):
                for msg in framing.add(key, bytes(data), int(us), ecu):
                    msg.index = number
                    number += 1
                    rows.append(msg.row(str(key[0]), 0, msg.index))
        state.update((framing.rest.get(key, b""), number))
        yield pd.DataFrame(rows, columns=columns)

    return datagrams.groupBy("sender").applyInPandasWithState(run, MSG_SCHEMA, "rest binary, number long", "append", GroupStateTimeout.NoTimeout)


def lifecycles(msgs: DataFrame, limits: Limits = Limits(), idle_ms: int | None = None) -> DataFrame:
    """index, ecu, key of a stream's messages once their lifecycle is certain; key numbers an ECU's lifecycles.

    The machine of an ECU, with the rows it holds back, is its state; after idle_ms (if given) without rows all it holds is given out.
    """
    import pandas as pd

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else Machine(limits)
        out = []
        if state.hasTimedOut:
            out += machine.finish()
        for p in parts:
            for x in p.sort_values("index")[["index", "ecu", "reception", "uptime", "has_uptime", "request", "version"]].itertuples(index=False, name=None):
                r = Row(*x)
                r.ecu, r.version = bytes(r.ecu), r.version if isinstance(r.version, str) else None
                out += machine.add(r)
        # only the last two lifecycles of an ECU are looked at again, and what may still be merged with the one before it
        for ecu, lcs in machine.by_ecu.items():
            first = next((i for i, lc in enumerate(lcs) if lc.id in machine.open or not lc.given), len(lcs))
            machine.by_ecu[ecu] = lcs[max(0, min(first - 1, len(lcs) - 2)) :]
        state.update((pickle.dumps(machine),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(r.index, r.ecu, r.lifecycle) for r in out], columns=["index", "ecu", "key"])

    rows = detection_input(msgs)
    return rows.groupBy("ecu").applyInPandasWithState(run, "index long, ecu binary, key long", "machine binary", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def ordered(msgs: DataFrame, window: str = "20 seconds") -> DataFrame:
    """A stream with event time and watermark, for windowed aggregates over it."""
    return msgs.withColumn("reception_ts", F.timestamp_micros("reception_time_us")).withWatermark("reception_ts", window)


def statistics(msgs: DataFrame) -> DataFrame:
    """Running counts by ECU, application and context; write in update mode."""
    return msgs.groupBy("ecu", F.col("ext.apid").alias("apid"), F.col("ext.ctid").alias("ctid")).agg(F.count("*").alias("nr_msgs"))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(DATAGRAMS).parquet(folder)


def send(values: Iterator[wire.Message], host: str, port: int) -> int:
    """Test traffic: messages as UDP datagrams without storage header."""
    n = 0
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for msg in values:
            s.sendto(wire.write(msg)[16:], (host, port))
            n += 1
    return n
