"""CAN frames decoded with FIBEX channels: the first channel name that an ECU announces binds it."""

from __future__ import annotations

import glob
import os
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ... import schema as S
from ...functions import columns as C
from ...functions.payload import log_infos
from ...sources.wire import char4
from ..scan import looked_up, staged
from .non_verbose import _local, _text


@dataclass
class Signal:
    """Bits of a frame: counted from the least significant bit of the first byte, or from its most significant one (big_endian)."""

    name: str
    bit: int
    bits: int
    big_endian: bool = False
    signed: bool = False
    factor: float = 1.0
    offset: float = 0.0
    unit: str = ""
    texts: dict[int, str] = field(default_factory=dict)
    invalid: tuple[tuple[float, float], ...] = ()  # spans of raw values that mean nothing

    @property
    def scaled(self) -> bool:
        return (self.factor, self.offset) != (1.0, 0.0)


@dataclass(frozen=True)
class Coding:
    """How raw values are read, from a coding's type and computation methods."""

    signed: bool = False
    factor: float = 1.0
    offset: float = 0.0
    unit: str = ""
    texts: tuple[tuple[int, str], ...] = ()
    invalid: tuple[tuple[float, float], ...] = ()


def _limits(e: ET.Element) -> tuple[float, float] | None:
    low, high = _text(e, "LOWER-LIMIT"), _text(e, "UPPER-LIMIT")
    return (float(low), float(high)) if low and high else None


def _coding(e: ET.Element, units: dict[str, str]) -> Coding:
    kind = next((v for t in e.iter() if _local(t) == "CODED-TYPE" for k, v in t.attrib.items() if k.endswith("BASE-DATA-TYPE")), "")
    factor, offset, unit, texts, invalid = 1.0, 0.0, "", [], []
    for m in (x for x in e.iter() if _local(x) == "COMPU-METHOD"):
        category = _text(m, "CATEGORY")
        unit = next((units.get(r.get("ID-REF", ""), "") for r in m.iter() if _local(r) == "UNIT-REF"), unit)
        for s in (x for x in m.iter() if _local(x) == "COMPU-SCALE"):
            span, const = _limits(s), next((x.text for x in s.iter() if _local(x) == "VT"), None)
            if category == "TEXTTABLE" and span and const and span[0] == span[1]:
                texts.append((int(span[0]), const))
            elif category in ("LINEAR", "SCALE-LINEAR"):
                above = [float(v.text) for n in s.iter() if _local(n) == "COMPU-NUMERATOR" for v in n if v.text]
                below = [float(v.text) for n in s.iter() if _local(n) == "COMPU-DENOMINATOR" for v in n if v.text] or [1.0]
                if len(above) == 2 and below[0]:
                    offset, factor = above[0] / below[0], above[1] / below[0]
        invalid += [span for c in m.iter() if _local(c) == "SCALE-CONSTR" and c.get("VALIDITY") == "NOT-VALID" and (span := _limits(c))]
    return Coding(kind.startswith("A_INT"), factor, offset, unit, tuple(texts), tuple(invalid))


def load(paths: list[str]) -> dict[str, dict[int, tuple[str, list[Signal]]]]:
    """{channel name: {frame id: (name, signals)}}."""
    out: dict[str, dict[int, tuple[str, list[Signal]]]] = {}
    for path in sorted(paths):
        root = ET.parse(path).getroot()
        units = {u.get("ID"): _text(u, "DISPLAY-NAME") or _text(u, "SHORT-NAME") or "" for u in root.iter() if _local(u) == "UNIT"}
        codings = {c.get("ID"): _coding(c, units) for c in root.iter() if _local(c) == "CODING"}
        signals = {}
        for s in (e for e in root.iter() if _local(e) == "SIGNAL"):
            ref = next((r.get("ID-REF") for r in s.iter() if _local(r) == "CODING-REF"), None)
            signals[s.get("ID")] = (_text(s, "SHORT-NAME") or s.get("ID"), codings.get(ref, Coding()))
        pdus = {}
        for p in (e for e in root.iter() if _local(e) == "PDU"):
            own = []
            for i in (e for e in p.iter() if _local(e) == "SIGNAL-INSTANCE"):
                ref = next((r.get("ID-REF") for r in i.iter() if _local(r) == "SIGNAL-REF"), "")
                name, c = signals.get(ref, (ref, Coding()))
                big = _text(i, "IS-HIGH-LOW-BYTE-ORDER") == "true"
                own.append(Signal(name, int(_text(i, "BIT-POSITION") or 0), int(_text(i, "BIT-LENGTH") or 8), big, c.signed, c.factor, c.offset, c.unit, dict(c.texts), c.invalid))
            pdus[p.get("ID")] = own
        frames = {}
        for f in (e for e in root.iter() if _local(e) == "FRAME"):
            refs = [r.get("ID-REF") for r in f.iter() if _local(r) == "PDU-REF"]
            frames[f.get("ID")] = (_text(f, "SHORT-NAME") or f.get("ID"), [s for r in refs for s in pdus.get(r, ())])
        for c in (e for e in root.iter() if _local(e) == "CHANNEL"):
            table = out.setdefault(_text(c, "SHORT-NAME") or c.get("ID") or "", {})
            for t in (e for e in c.iter() if _local(e) == "FRAME-TRIGGERING"):
                number = next((e.text for e in t.iter() if _local(e) == "IDENTIFIER-VALUE"), None)
                ref = next((r.get("ID-REF") for r in t.iter() if _local(r) == "FRAME-REF"), None)
                if number and ref in frames:
                    table[int(number, 0)] = frames[ref]
    return out


SIGNAL = "name string, bit int, bits int, big boolean, signed boolean, factor double, offset double, scaled boolean, unit string, texts map<long,string>, invalid array<struct<low:double,high:double>>"


def frames(spark: SparkSession, channels: dict[str, dict[int, tuple[str, list[Signal]]]]) -> DataFrame:
    """The dictionary as a table: channel, number (of the frame), frame (its name), signals."""
    rows = []
    for c, table in channels.items():
        for number, (name, signals) in table.items():
            rows.append((c, number, name, [(s.name, s.bit, s.bits, s.big_endian, s.signed, float(s.factor), float(s.offset), s.scaled, s.unit, s.texts, [(float(a), float(b)) for a, b in s.invalid]) for s in signals]))
    inner = SIGNAL.replace(", ", ",").replace("name string", "name:string")
    for f in ("bit int", "bits int", "big boolean", "signed boolean", "factor double", "offset double", "scaled boolean", "unit string", "texts map", "invalid array"):
        inner = inner.replace("," + f, "," + f.replace(" ", ":", 1))
    return spark.createDataFrame(rows, f"channel string, number long, frame string, signals array<struct<{inner}>>")


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, -10).cast("long")


def _turned(digits: Column) -> Column:
    """Hex digits with their bytes in the other order."""
    return F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")


def _span(s: Column) -> tuple[Column, Column]:
    """The first byte of a signal (from 0) and how many it touches."""
    first = F.floor(s["bit"] / 8).cast("int")
    return first, F.floor((s["bit"] + s["bits"] - 1) / 8).cast("int") - first + 1


def raw_values(data: Column, signals: Column, digits: Column | None = None, back: Column | None = None) -> Column:
    """The bits of each signal (up to 64, over up to nine bytes) as a number, null where data is too short; 64 bits count as signed. digits, back: data in hex, and with its bytes turned, where these are at hand."""
    digits = F.hex(data) if digits is None else digits
    back = _turned(digits) if back is None else back
    right = lambda c, k: F.call_function("shiftrightunsigned", c, k)
    left = lambda c, k: F.call_function("shiftleft", c, k)

    def own(s: Column) -> Column:
        first, n = _span(s)
        n = F.least(n, F.lit(8))
        return F.when(s["big"], F.substring(digits, first * 2 + 1, n * 2)).otherwise(F.substring(back, F.length(back) - (first + n) * 2 + 1, n * 2))

    def bits(s: Column, number: Column) -> Column:
        first, n = _span(s)
        ninth = F.when(n > 8, _number(F.substring(digits, first * 2 + 17, F.lit(2))))
        low = s["bit"] - first * 8  # bits below it, little endian
        rest = (first + n) * 8 - s["bit"] - s["bits"]  # bits behind it, big endian
        little = F.when(n > 8, right(number, low).bitwiseOR(left(ninth, 64 - low))).otherwise(right(number, low))
        big = F.when(n > 8, left(number, 8 - rest).bitwiseOR(right(ninth, rest))).otherwise(right(number, rest))
        mask = right(F.lit(-1).cast("long"), 64 - s["bits"])
        return F.when(s["bit"] + s["bits"] <= F.length(data) * 8, F.when(s["big"], big).otherwise(little).bitwiseAND(mask))

    def signed(s: Column, value: Column) -> Column:
        under = s["signed"] & (s["bits"] < 64) & (right(value, s["bits"] - 1) == 1)
        return F.when(under, value.bitwiseOR(left(F.lit(-1).cast("long"), s["bits"]))).otherwise(value)

    # step by step, so that a lambda's argument holds what the next one uses several times
    numbers = F.transform(F.transform(signals, own), _number)
    return F.zip_with(signals, F.zip_with(signals, numbers, bits), signed)


def shown(s: Column, raw: Column) -> Column:
    """A signal's value as text: its entry in the text table, else scaled and with its unit; null without a value."""
    bad = F.exists(s["invalid"], lambda x: (raw >= x["low"]) & (raw <= x["high"]))
    number = F.when(s["scaled"], (raw * s["factor"] + s["offset"]).cast("string")).otherwise(raw.cast("string"))
    plain = F.concat(number, F.when(s["unit"] != "", F.concat(F.lit(" "), s["unit"])).otherwise(""))
    return F.when(raw.isNotNull(), F.when(bad, "invalid").otherwise(F.coalesce(F.try_element_at(s["texts"], raw), plain)))


def channel_for(name: Column, channels: list[str]) -> Column:
    """The channel of that name, else the first one whose name begins it or that it begins."""
    known = F.array(*[F.lit(c) for c in sorted(channels) if c]) if any(channels) else F.array().cast("array<string>")
    near = F.filter(known, lambda c: F.startswith(name, c) | F.startswith(c, name))
    return F.when(F.array_contains(known, name), name).otherwise(F.get(near, 0))


def decode(msgs: DataFrame, channels: dict) -> DataFrame:
    """msgs with the text of CAN frames whose channel and number the dictionary knows (number 0 stands for those it does not), in native expressions."""
    spark = msgs.sparkSession
    # an ECU that says the same again is read once
    infos = msgs.where(C.is_ctrl_response()).groupBy("ecu", "htyp", "ext", "payload").agg(F.min("index").alias("index"))
    names = log_infos(staged(infos, "infos")).where("ctid is null").groupBy("ecu").agg(F.min_by("description", "index").alias("_name"))
    names = staged(names.select("ecu", channel_for(F.col("_name"), list(channels)).alias("channel")), "channels")  # a row for each ECU
    known = frames(spark, channels)
    own = known.select("channel", "number", F.struct("frame", "signals").alias("_own"))
    other = known.where("number = 0").select("channel", F.struct("frame", "signals").alias("_other"))
    vmm = F.col("ext.verb_mstp_mtin").cast("int")
    hit = F.coalesce((vmm.bitwiseAND(0x0E) == S.MSTP_NW_TRACE << 1) & (F.shiftright(vmm, 4) == 2) & (F.col("ext.ctid") == F.lit(char4("TC"))) & (F.col("ext.noar") >= 2) & (F.length("payload") >= 4), F.lit(False))
    number = F.when(hit, _number(_turned(F.hex(F.substring("payload", 1, 4)))))
    out = looked_up(msgs, names, "ecu").withColumn("number", number)
    out = looked_up(looked_up(out, own, ["channel", "number"], 10_000), other, "channel", 10_000).withColumn("_f", F.when(hit, F.coalesce("_own", "_other")))
    data = F.expr("substring(payload, 5)")
    # columns of their own, so that they are made once a row and not once a signal
    out = out.withColumn("_digits", F.when(F.col("_f").isNotNull(), F.hex(data))).withColumn("_back", _turned(F.col("_digits")))
    signals = F.col("_f.signals")
    values = F.zip_with(signals, raw_values(data, signals, F.col("_digits"), F.col("_back")), lambda s, raw: F.concat(s["name"], F.lit("="), shown(s, raw)))
    values = F.array_join(F.filter(values, lambda v: v.isNotNull()), ", ")
    text = F.concat(F.col("_f.frame"), F.lit(" [0x"), F.lower(F.hex("number")), F.lit("] "), F.when(values != "", values).otherwise(C.hex_dump(data)))
    return out.withColumn("payload_text", F.coalesce(F.when(hit, text), "payload_text")).select(*msgs.columns)


def from_dir(folder: str):
    found = load(glob.glob(os.path.join(folder, "*.[xX][mM][lL]")))
    return lambda msgs: decode(msgs, found)


def metadata(channels: dict) -> list[dict]:
    """Channels, frames and signals as a tree for viewers."""
    return [{"label": c, "children": [{"label": f"{n} ({i:#x})", "children": [{"label": f"{s.name} {s.bit}:{s.bits}", "unit": s.unit, "texts": s.texts} for s in sig]} for i, (n, sig) in sorted(t.items())]} for c, t in sorted(channels.items())]
