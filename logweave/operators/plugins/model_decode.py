"""Model-driven decoding: 13-argument messages whose last argument is encoded by an interface model.

Which model an ECU runs is announced in configuration messages; a message is decoded with the latest one before it (a
window over the ECU's messages), or with the default model "0".
"""

from __future__ import annotations

import glob
import json
import os
import struct

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ... import schema as S
from ...functions.payload import arg_text, decoded_text, message_of
from ...sources import wire

CONFIG = r"Version: (.*?),? git: (.*?),? model hash: (\d+)"
NUMBERS = {"Int8": "b", "UInt8": "B", "Int16": "h", "UInt16": "H", "Int32": "i", "UInt32": "I", "Int64": "q", "UInt64": "Q"}


class Model:
    """{interface id: {model hash: interface}} with attributes and methods by id."""

    def __init__(self, documents: list[dict]):
        self.map: dict[str, dict[str, str]] = {}
        self.interfaces: dict[str, dict] = {}
        for d in documents:
            self.interfaces |= d.get("interfaces", {})
            for k, v in d.get("map", {}).items():
                self.map.setdefault(k, {}).update(v)

    def member(self, model: str | None, interface: int, number: int) -> dict | None:
        hashes = self.map.get(str(interface), {})
        found = self.interfaces.get(hashes.get(model or "0") or hashes.get("0") or "", {})
        for kind in ("methods", "attributes"):
            for m in found.get(kind, ()):
                if m.get("id") == number:
                    return m | {"_method": kind == "methods"}
        return None


def value(a: dict, raw: bytes, suffix: str = "") -> tuple[str, bytes] | None:
    """(name(type) = value, the bytes after it); None if the bytes do not suffice."""
    kind, head = a["type"], f"{a['name']}{suffix}({a['type']}) = "
    if kind == "Boolean":
        return (head + ("1" if raw[0] else "0"), raw[1:]) if raw else None
    if kind in NUMBERS:
        n = struct.calcsize(NUMBERS[kind])
        return (head + str(struct.unpack(">" + NUMBERS[kind], raw[:n])[0]), raw[n:]) if len(raw) >= n else None
    if kind == "Float":
        return (head + f"{struct.unpack('>f', raw[:4])[0]:.6f}", raw[4:]) if len(raw) >= 4 else None
    if kind == "struct":
        return _list(head, a.get("elements", ()), raw)
    if kind == "array":
        if not a.get("array_type"):
            return None
        n = a.get("size", 0)
        if a.get("max_size") is not None:
            n = min(struct.unpack(">I", raw[:4])[0], a["max_size"]) if len(raw) >= 4 else 0
            raw = raw[4:] if len(raw) >= 4 else raw
        return _list(head, [a["array_type"]] * n, raw) if n else (head, raw)
    if kind == "enumeration":
        base = a.get("baseType")
        if not base:
            return None
        form = {"uint8": "B", "uint16": "H", "uint32": "I"}.get(base.lower())
        if form is None:
            return head + f"<enum unknown base type {base}>", raw
        n = struct.calcsize(form)
        if len(raw) < n:
            return None
        v = struct.unpack(">" + form, raw[:n])[0]
        if isinstance(names := a.get("values"), dict):
            return head + {x: k for k, x in names.items()}.get(v, ""), raw[n:]
        return head + str(v), raw[n:]
    return head + f"<unknown type {kind}>", raw


def _list(head: str, elements, raw: bytes) -> tuple[str, bytes] | None:
    out = []
    for e in elements:
        if (got := value(e, raw)) is None:
            return None
        out.append(got[0])
        raw = got[1]
    return head + "[" + ", ".join(out) + "]", raw


def method_text(m: dict, raw: bytes, answer: bool = False) -> str | None:
    """name(arguments) of a call, or of its answer."""
    out = []
    for a in m.get("out_args" if answer else "in_args", ()):
        if (got := value(a, raw)) is None:
            return None
        out.append(got[0])
        raw = got[1]
    return f"{m['name']}({', '.join(out)})"


def message_text(model: Model, config: str | None, htyp: int, vmm: int, payload: bytes) -> str | None:
    """The text of a message with its last argument decoded; None leaves it as it is."""
    items = wire.args(message_of(htyp, vmm, payload))
    if len(items) < 13:
        return None
    ids = [int.from_bytes(a.raw, "big" if a.big_endian else "little") for a in items[7:9] if a.type_info & S.TI_UINT and len(a.raw) == 4]
    member = model.member(config, *ids) if len(ids) == 2 else None
    if member is None:
        return None
    if member["_method"]:
        new = method_text(member, items[12].raw)
    else:
        got = value(member, items[12].raw)
        new = got[0] if got else None
    if new is None:
        return None
    head = " ".join(map(arg_text, items[:12]))
    return f"{head} {new}" if new else head


def decode(msgs: DataFrame, model: Model, msg_ctid: str = "MMSG", config_ctid: str = "MDLT") -> DataFrame:
    shared = msgs.sparkSession.sparkContext.broadcast(model)  # as large as the model files

    @F.pandas_udf("string")
    def run(config: pd.Series, htyp: pd.Series, vmm: pd.Series, payload: pd.Series) -> pd.Series:
        return pd.Series([message_text(shared.value, c if isinstance(c, str) else None, int(h), int(v), bytes(p)) for c, h, v, p in zip(config, htyp, vmm, payload, strict=True)], dtype=object)

    verbose = F.coalesce(F.col("ext.verb_mstp_mtin").cast("int").bitwiseAND(1) == 1, F.lit(False))
    named = lambda t: verbose & (F.col("ext.ctid") == F.lit(wire.char4(t)))
    announced = F.when(named(config_ctid), F.regexp_extract(decoded_text(), CONFIG, 3))
    out = msgs.withColumn("_cfg", F.when(announced != "", announced))
    out = out.withColumn("_cfg", F.last("_cfg", True).over(Window.partitionBy("ecu").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)))
    hit = named(msg_ctid) & (F.col("ext.noar") == 13)
    text = F.when(hit, run(F.when(hit, F.col("_cfg")), F.col("htyp"), F.coalesce("ext.verb_mstp_mtin", F.lit(0)), F.coalesce("payload", F.lit(b""))))
    return out.withColumn("payload_text", F.coalesce(text, "payload_text")).drop("_cfg")


def from_dir(folder: str):
    documents = []
    for p in sorted(glob.glob(os.path.join(folder, "*.json"))):
        with open(p, encoding="utf-8") as f:
            documents.append(json.load(f))
    model = Model(documents)
    return lambda msgs: decode(msgs, model)
