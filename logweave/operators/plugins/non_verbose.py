"""Non-verbose messages decoded with FIBEX dictionaries: of each ECU the newest software version."""

from __future__ import annotations

import glob
import os
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ... import schema as S
from ...functions.payload import arg_text
from ...schema import EXT
from ...sources.wire import Arg, char4

LEVELS = {"DLT_LOG_ERROR": 2, "DLT_LOG_WARN": 3, "DLT_LOG_INFO": 4, "DLT_LOG_DEBUG": 5, "DLT_LOG_VERBOSE": 6}
# fixed values: signals and the argument types they stand for
SIGNALS = {
    "S_UINT64": S.TI_UINT | 4, "S_INT64": S.TI_SINT | 4, "S_SINT64": S.TI_SINT | 4, "S_UINT32": S.TI_UINT | 3, "S_INT32": S.TI_SINT | 3, "S_SINT32": S.TI_SINT | 3,
    "S_UINT16": S.TI_UINT | 2, "S_INT16": S.TI_SINT | 2, "S_SINT16": S.TI_SINT | 2, "S_UINT8": S.TI_UINT | 1, "S_INT8": S.TI_SINT | 1, "S_SINT8": S.TI_SINT | 1,
    "S_BOOL": S.TI_BOOL | 1, "S_FLOA16": S.TI_FLOA | 2, "S_FLOA32": S.TI_FLOA | 3, "S_FLOA64": S.TI_FLOA | 4,
    "S_STRG_UTF8": S.TI_STRG | S.SCOD_UTF8, "S_STRG_ASCII": S.TI_STRG | S.SCOD_ASCII, "S_RAWD": S.TI_RAWD, "S_RAW": S.TI_RAWD,
}


@dataclass
class Frame:
    size: int
    ext: tuple[int, int, bytes, bytes] | None
    parts: list[tuple[int, int, str | None]]  # argument type, bytes, static text

    def text(self, data: bytes, big_endian: bool) -> str:
        out, at = [], 0
        for ti, size, static in self.parts:
            raw = (static + "\0").encode() if size == 0 and static is not None else data[at : at + size]
            if len(raw) == 0 and not ti & (S.TI_STRG | S.TI_RAWD):
                break
            out.append(arg_text(Arg(ti, big_endian, raw)))
            at += size
        return " ".join(out)


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _find(e: ET.Element | None, *names: str) -> ET.Element | None:
    for n in names:
        e = None if e is None else next((c for c in e if _local(c) == n), None)
    return e


def _text(e: ET.Element | None, *names: str) -> str | None:
    found = _find(e, *names)
    return None if found is None or found.text is None else found.text.strip() if _local(found) != "DESC" else found.text


@dataclass
class Dictionary:
    frames: dict[tuple[bytes, int], Frame]
    descriptions: list[tuple[bytes, bytes, bytes | None, str]]
    versions: dict[bytes, str]
    warnings: list[str]


def _version_key(v: str) -> tuple:
    return tuple((int(p), "") if p.isdigit() else (-1, p) for p in v.replace("-", ".").split("."))


def load(paths: list[str]) -> Dictionary:
    """Frames of the newest version of each ECU, merged over its files; the first of equal frame ids stays."""
    by_ecu: dict[bytes, dict[str, dict[int, Frame]]] = {}
    descriptions, warnings = [], []
    for path in sorted(paths):
        root = ET.parse(path).getroot()
        ecu = next((e for e in root.iter() if _local(e) == "ECU"), None)
        if ecu is None:
            continue
        ext = _find(ecu, "MANUFACTURER-EXTENSION")
        name, version = char4(ecu.get("ID", "")), _text(ext, "SW_VERSION") or ""
        for app in (e for e in ecu.iter() if _local(e) == "APPLICATION"):
            apid = char4(_text(app, "APPLICATION_ID") or "")
            if d := _text(app, "APPLICATION_DESCRIPTION"):
                descriptions.append((name, apid, None, d))
            for ctx in (e for e in app.iter() if _local(e) == "CONTEXT"):
                if d := _text(ctx, "CONTEXT_DESCRIPTION"):
                    descriptions.append((name, apid, char4(_text(ctx, "CONTEXT_ID") or ""), d))
        pdus = {}
        for p in (e for e in root.iter() if _local(e) == "PDU"):
            refs = [r.get("ID-REF") for r in p.iter() if _local(r) == "SIGNAL-REF"]
            size = int(_text(p, "BYTE-LENGTH") or 0)
            kind = S.TI_STRG | S.SCOD_UTF8 if size == 0 else SIGNALS.get(refs[0], 0) if len(refs) == 1 else 0
            pdus[p.get("ID")] = (kind, size, _text(p, "DESC") if size == 0 else None)
        frames = by_ecu.setdefault(name, {}).setdefault(version, {})
        for f in (e for e in root.iter() if _local(e) == "FRAME"):
            number = (f.get("ID") or "")[3:]
            if not (f.get("ID") or "").startswith("ID_") or not number.isdigit():
                continue
            refs = [r.get("ID-REF") for r in f.iter() if _local(r) == "PDU-REF"]
            parts = [pdus[r] for r in refs] if all(r in pdus for r in refs) else []
            size = int(_text(f, "BYTE-LENGTH") or 0)
            if size != sum(p[1] for p in parts):
                warnings.append(f"frame {f.get('ID')} has {size} bytes, its parts have {sum(p[1] for p in parts)}")
                continue
            more = _find(f, "MANUFACTURER-EXTENSION")
            apid = _text(more, "APPLICATION_ID")
            level = LEVELS.get(_text(more, "MESSAGE_INFO") or "", 1)
            head = (level << 4, 0, char4(apid), char4(_text(more, "CONTEXT_ID") or "")) if apid else None
            frames.setdefault(int(number), Frame(size, head, parts))
    versions = {e: max(v, key=_version_key) for e, v in by_ecu.items()}
    out = {(e, n): f for e, v in by_ecu.items() for n, f in v[versions[e]].items()}
    return Dictionary(out, descriptions, versions, warnings)


def decode(msgs: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Fills payload_text, and the extended header where it is missing, of known frames."""
    frames = msgs.sparkSession.sparkContext.broadcast(dictionary.frames)  # as large as the dictionary files

    @F.pandas_udf("struct<text:string,ext:struct<verb_mstp_mtin:short,noar:short,apid:binary,ctid:binary>>")
    def run(ecu: pd.Series, htyp: pd.Series, vmm: pd.Series, payload: pd.Series) -> pd.DataFrame:
        known, texts, exts = frames.value, [], []
        for e, h, v, p in zip(ecu, htyp, vmm, payload, strict=True):
            text = ext = None
            if (pd.isna(v) or not int(v) & 1) and p is not None and len(p) >= 4:
                big = bool(int(h) & S.HTYP_BIG_ENDIAN)
                number = int.from_bytes(p[:4], "big" if big else "little")
                if f := known.get((bytes(e), number)):
                    data, ext = bytes(p[4:]), f.ext
                    text = f.text(data, big) if len(data) >= f.size else f"NVP: frame {number} needs {f.size} bytes, has {len(data)}"
                    ext = ext if len(data) >= f.size else None
            texts.append(text)
            exts.append(dict(zip(EXT.fieldNames(), ext, strict=True)) if ext else None)
        return pd.DataFrame({"text": texts, "ext": exts})

    got = run(F.col("ecu"), F.col("htyp"), F.col("ext.verb_mstp_mtin"), F.col("payload"))
    out = msgs.withColumn("_got", got)
    new = {"payload_text": F.coalesce("_got.text", "payload_text"), "ext": F.coalesce("ext", "_got.ext")}
    return out.withColumns(new).drop("_got")


def from_dir(folder: str):
    found = load([p for p in glob.glob(os.path.join(folder, "*.[xX][mM][lL]"))])
    return lambda msgs: decode(msgs, found)
