"""Files sent as messages: start, data packages in order, end, error; one group for each (ECU, lifecycle, serial)."""

from __future__ import annotations

import fnmatch
import os
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ... import schema as S
from ...functions.payload import arg_value, message_of
from ...sources import wire

UNKNOWN = 2**63 - 1
HELD = 4 << 20  # bytes of complete files that are given out together
EVENT = "struct<kind:string,serial:long,name:string,size:long,created:string,packages:long,buffer:long,package:long,code:long,errno:long,data:binary>"
COUNTS = {"FLST": 8, "FLDA": 5, "FLFI": 3, "FLER": 10}


def _signed(a: wire.Arg) -> int | None:
    if a.type_info & (S.TI_SINT | S.TI_UINT) and len(a.raw) <= 8:
        return int.from_bytes(a.raw, "big" if a.big_endian else "little", signed=bool(a.type_info & S.TI_SINT))
    return None


def parse_event(htyp: int, vmm: int, noar: int, payload: bytes) -> dict | None:
    """The step of a transfer that a message is, if it is one."""
    if not vmm & 1 or vmm & 0x0E:
        return None
    items = wire.args(message_of(htyp, vmm, payload))
    kind = arg_value(items[0]) if items else None
    level = vmm >> 4
    if COUNTS.get(kind) != noar or level != (2 if kind == "FLER" else 4):
        return None
    v = [arg_value(a) for a in items]
    v += [None] * (10 - len(v))
    out: dict = {"kind": kind}
    if kind == "FLST":
        out |= {"serial": v[1], "name": v[2], "size": v[3], "created": v[4], "packages": v[5], "buffer": v[6]}
    elif kind == "FLDA":
        out |= {"serial": v[1], "package": v[2], "data": items[3].raw if len(items) > 3 else b""}
    elif kind == "FLFI":
        out |= {"serial": v[1]}
    else:
        out |= {"code": _signed(items[1]) if len(items) > 1 else 0, "errno": _signed(items[2]) if len(items) > 2 else 0, "serial": v[3]}
    return out


@dataclass
class Transfer:
    state: str
    name: str
    size: int
    created: str
    packages: int
    buffer: int
    first_index: int
    next: int = 1
    received: int = 0
    code: int | None = None
    errno: int | None = None
    data: bytearray | None = field(default_factory=bytearray)

    def add(self, number: int, raw: bytes) -> None:
        if number == 1 and self.buffer == 0:
            self.buffer = len(raw)
        if self.state not in ("Started", "MissingStart"):
            return
        self.received += 1
        if number == self.next and (len(raw) == self.buffer or (self.next == self.packages and len(raw) < self.buffer)):
            self.next += 1
            self.data += raw
        if self.next > self.packages and (self.size == len(self.data) or (self.size == 0 and self.data)):
            self.size, self.state = len(self.data), "Complete"
        elif self.received >= self.packages:
            self.state, self.data = "Incomplete", None

    def end(self) -> None:
        if self.received == self.next - 1:
            if self.state == "MissingStart":
                self.state, self.size = "Complete", self.size or len(self.data)
        else:
            self.state = self.state if self.state == "Error" else "Incomplete"
            self.data = None


def step(out: list[Transfer], index: int, e: dict) -> None:
    """Adds one event to the transfers of its (ECU, lifecycle, serial)."""
    now = out[-1] if out else None
    if e["kind"] == "FLST":
        if (e["packages"] or 0) > 0 and (e["buffer"] or 0) > 0:
            out.append(Transfer("Started", e["name"] or "", e["size"] or 0, e["created"] or "", e["packages"], e["buffer"], index))
    elif e["kind"] == "FLDA":
        number = -1 if e["package"] is None else e["package"]
        if now is None and number == 1:
            now = Transfer("MissingStart", "<missing_flst>", 0, "", UNKNOWN, 0, index)
            out.append(now)
        if now is not None:
            now.add(number, bytes(e["data"] or b""))
    elif now is not None and e["kind"] == "FLFI":
        now.end()
    elif now is not None:
        now.state, now.code, now.errno, now.data = "Error", e["code"], e["errno"], None


def with_event(msgs: DataFrame, apid: str | None = None, ctid: str | None = None) -> DataFrame:
    @F.pandas_udf(EVENT)
    def parse(htyp: pd.Series, vmm: pd.Series, noar: pd.Series, payload: pd.Series) -> pd.DataFrame:
        names = [f.split(":")[0] for f in EVENT[7:-1].split(",")]
        rows = [parse_event(int(h), int(v), int(n), bytes(p)) or {} for h, v, n, p in zip(htyp, vmm, noar, payload, strict=True)]
        out = pd.DataFrame({n: [r.get(n) for r in rows] for n in names})
        return out.astype({n: "Int64" for n in ("serial", "size", "packages", "buffer", "package", "code", "errno")})

    ok = F.col("ext.noar").isin(list(COUNTS.values())) & (F.col("ext.verb_mstp_mtin").isin(1 | 4 << 4, 1 | 2 << 4))
    for want, c in ((apid, "ext.apid"), (ctid, "ext.ctid")):
        if want:
            ok = ok & (F.col(c) == F.lit(wire.char4(want)))
    ok = F.coalesce(ok, F.lit(False))
    # rows that can be no step are not decoded
    some = msgs.where(ok).withColumn("event", parse("htyp", "ext.verb_mstp_mtin", "ext.noar", "payload"))
    return some.where("event.kind is not null")


def transfers(msgs: DataFrame, apid: str | None = None, ctid: str | None = None) -> DataFrame:
    """ecu, lifecycle, serial, state, name, size, created, code, errno, first_index and data (of complete ones) of each transfer."""
    columns = ["ecu", "lifecycle", "serial", "state", "name", "size", "created", "code", "errno", "first_index", "data"]

    def run(parts):
        # the events of one key come one after another: many keys share a pass, and only one's data is held
        key, own = None, []
        ready = lambda: [(*key, t.state, t.name, t.size, t.created, t.code, t.errno, t.first_index, bytes(t.data) if t.state == "Complete" else None) for t in own]
        for part in parts:
            rows, held = [], 0
            for ecu, lc, serial, index, e in zip(part["ecu"], part["lifecycle"], part["serial"], part["index"], part["event"], strict=True):
                k = (bytes(ecu), lc, serial)
                if k != key:
                    done = ready() if key else []
                    rows += done
                    held += sum(len(r[-1] or b"") for r in done)
                    key, own = k, []
                    if held > HELD:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                step(own, index, e)
            yield pd.DataFrame(rows, columns=columns)
        if key:
            yield pd.DataFrame(ready(), columns=columns)

    e = with_event(msgs, apid, ctid).select("index", "ecu", "lifecycle", F.col("event.serial").alias("serial"), "event").where("serial is not null")
    keys = ["ecu", "lifecycle", "serial"]
    e = e.repartition(*keys).sortWithinPartitions(*keys, "index")
    return e.mapInPandas(run, "ecu binary, lifecycle long, serial long, state string, name string, size long, created string, code long, errno long, first_index long, data binary")


def without_data(msgs: DataFrame) -> DataFrame:
    """msgs without data packages."""
    data = with_event(msgs).where("event.kind = 'FLDA'").select("index")
    return msgs.join(data, "index", "left_anti")


def dropper(config: dict):
    return (lambda msgs: msgs) if config.get("keepFLDA", False) else without_data


def tree(found: DataFrame) -> DataFrame:
    return found.orderBy("ecu", "name", "first_index")


def save(found: DataFrame, folder: str, pattern: str = "*") -> list[str]:
    """Writes complete files that match to folder, by base name, never over an existing one; one file at a time on the driver."""
    out = []
    for r in found.where("state = 'Complete'").toLocalIterator():
        base = os.path.basename(r["name"].replace("\\", "/"))
        path = os.path.join(folder, base)
        if base and fnmatch.fnmatch(r["name"], pattern) and not os.path.exists(path):
            with open(path, "wb") as f:
                f.write(r["data"])
            out.append(path)
    return out
