"""SOME/IP traces: segmented messages put together, headers decoded.

Service names come from a table (service id -> name, method id -> name); payload decoding by model is not available
here, so payloads are shown as hex: this text is a format of its own.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.payload import message_of
from ...sources import wire

MAX_BYTES = 1 << 20
KINDS = {0: "request", 1: "request_no_return", 2: "notification", 0x80: "response", 0x81: "error"}


def instance(header: bytes) -> int | None:
    return {9: lambda: header[8], 10: lambda: int.from_bytes(header[8:10], "big"), 12: lambda: int.from_bytes(header[8:12], "big")}.get(len(header), lambda: None)()


def header_text(raw: bytes, inst: int | None, names: dict[int, tuple[str, dict[int, str]]]) -> str:
    if len(raw) < 16:
        return f"SOME/IP message with {len(raw)} bytes"
    service, method, length, client, session, proto, iface, kind, code = struct.unpack(">HHIHHBBBB", raw[:16])
    name, methods = names.get(service, (f"service({service:#06x})", {}))
    what = methods.get(method, f"method({method:#06x})")
    return f"{KINDS.get(kind, f'type({kind})')} {name}[{inst}].{what} ({client:04x}:{session:04x}) v{iface} rc={code} {raw[16:].hex(' ')}".rstrip()


class Segments:
    """Messages in pieces by segment id: start, chunks in order, end."""

    def __init__(self, names: dict | None = None):
        self.names, self.open = names or {}, {}

    # fixed values: the texts of messages about segments
    def add(self, items: list[wire.Arg]) -> str | None:
        tag = items[0].raw[:4] if items else b""
        number = int.from_bytes(items[1].raw, "little") if len(items) > 1 and len(items[1].raw) == 4 else None
        if tag == b"NWST" and len(items) >= 6 and number is not None:
            inst = instance(items[2].raw)
            if inst is None:
                return f"SOME/IP segmented message NWST id: {number} with unknown 2nd arg len of {len(items[2].raw)}!"
            chunks, size = (int.from_bytes(a.raw, "little") for a in items[4:6])
            if size and chunks * size < MAX_BYTES:
                self.open[number] = (inst, chunks, size, bytearray())
            return f"SOME/IP segmented message NWST {number} with {chunks} chunks of {size} bytes"
        if tag == b"NWCH" and len(items) >= 4 and number is not None:
            n = int.from_bytes(items[2].raw, "little")
            if number not in self.open:
                return f"SOME/IP segmented message NWCH {number} ({n}) for unknown id!"
            _, chunks, size, buf = self.open[number]
            have = len(buf) // size
            if n == have and n < chunks and (len(items[3].raw) == size or n + 1 == chunks):
                buf += items[3].raw
                return f"SOME/IP segmented message NWCH {number} ({n})"
            return f"SOME/IP segmented message NWCH {number} ({n}) chunk out-of-sequence! (got chunks={have} / exp {chunks}) or wrong size!"
        if tag == b"NWEN" and number is not None:
            if number not in self.open:
                return f"SOME/IP segmented message NWEN {number} for unknown id!"
            inst, chunks, size, buf = self.open.pop(number)
            least = (chunks - 1) * size
            return header_text(bytes(buf), inst, self.names) if len(buf) > least else f"SOME/IP segmented message NWEN {number} with too little data: {len(buf)} vs: >{least}!"
        if len(items) >= 2 and len(items[0].raw) in (9, 10, 12):
            return header_text(items[1].raw, instance(items[0].raw), self.names)
        return None


def decode(msgs: DataFrame, names: dict | None = None, ctid: str = "TC") -> DataFrame:
    """msgs with the text of SOME/IP traces; pieces are put together within one segment id.

    Pieces come sorted by segment id and index, and pass one after another: only the segment at hand is held. The other
    messages are dealt out by their index, so that all rows are read once and none is joined again. The rows pass as Arrow
    batches, in which only the text is new.
    """
    import pyarrow as pa

    vmm = F.col("ext.verb_mstp_mtin").cast("int")
    mine = F.coalesce((vmm.bitwiseAND(0x0E) == 4) & (F.shiftright(vmm, 4) == 1) & (F.col("ext.ctid") == F.lit(wire.char4(ctid))), F.lit(False))
    # the segment id is the second argument: 4 bytes after the first string and its own type
    p = F.col("payload")
    seg = F.when(F.substring(p, 7, 4).isin([F.lit(t) for t in (b"NWST", b"NWCH", b"NWEN")]), F.hex(F.substring(p, F.lit(7) + F.conv(F.hex(F.concat(F.substring(p, 6, 1), F.substring(p, 5, 1))), 16, 10).cast("int") + 4, F.lit(4))))

    def text_of(state: Segments, h, v, raw) -> str | None:
        return state.add(wire.args(message_of(int(h), int(v), bytes(raw))))

    def read(batches):
        last, state = None, Segments(names)
        for b in batches:
            out, columns = [], [b.column(c).to_pylist() for c in ("_mine", "_seg", "htyp", "_vmm", "payload", "payload_text")]
            for own, s, h, v, raw, text in zip(*columns, strict=True):
                found = None
                if own and s is not None:
                    if s != last:
                        last, state = s, Segments(names)
                    found = text_of(state, h, v, raw)
                elif own and raw is not None:
                    found = text_of(Segments(names), h, v, raw)
                out.append(text if found is None else found)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == "payload_text" else b.column(c) for c in kept], names=kept)

    kept = msgs.columns
    rows = msgs.withColumns({"_mine": mine, "_seg": F.when(mine, seg), "_vmm": vmm})
    n = max(int(msgs.sparkSession.conf.get("spark.sql.shuffle.partitions")), msgs.sparkSession.sparkContext.defaultParallelism)
    rows = rows.withColumn("_to", F.when(F.col("_seg").isNull(), F.xxhash64("index")).otherwise(F.xxhash64("_seg"))).repartition(n, "_to").sortWithinPartitions("_seg", "index")
    return rows.mapInArrow(read, msgs.schema)


def from_config(config: dict):
    names = {int(k): (v["name"], {int(m): n for m, n in v.get("methods", {}).items()}) for k, v in config.get("services", {}).items()}
    return lambda msgs: decode(msgs, names)


def metadata(names: dict) -> list[dict]:
    """The services as a tree for viewers."""
    return [{"label": f"{n} ({s:#06x})", "children": [{"label": f"{x} ({m:#06x})"} for m, x in sorted(ms.items())]} for s, (n, ms) in sorted(names.items())]
