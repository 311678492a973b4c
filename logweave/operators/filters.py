"""Filters: records that compile to native columns.

A filter is a conjunction of the fields that are set; a disabled one never matches, a negated one matches where the
conjunction fails. Every test is two-valued: a missing id or header fails the test, so negation never sees null.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from functools import cache, reduce

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE, NEGATIVE, MARKER, EVENT = 0, 1, 2, 3
SPECIAL = set("^$*+?()[]{}|.-\\=!<>,")


@cache
def java_pattern(pattern: str) -> str | None:
    """The pattern as Java takes it: scripts and categories that it names with Is are tried so; None if it refuses the pattern still."""
    compiles = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile
    for p in (pattern, re.sub(r"\\([pP])\{(?!Is|In)(\w+)\}", r"\\\1{Is\2}", pattern)):
        try:
            compiles(p)
        except IllegalArgumentException:
            continue
        return p
    return None


def found_in(text: Column, pattern: str) -> Column:
    """Whether a pattern is found in text; one that can't be compiled matches nothing."""
    p = java_pattern(pattern)
    return F.lit(False) if p is None else F.coalesce(text.rlike(p), F.lit(False))


def has_regex_chars(text: str) -> bool:
    return any(c in SPECIAL for c in text)


def regex_chars_in(c: Column) -> Column:
    """has_regex_chars() for a column."""
    return c.rlike("[" + "".join(f"\\{x}" for x in sorted(SPECIAL)) + "]")


@dataclass(frozen=True)
class Id:
    """A 4-byte id, or a pattern searched in the 4 bytes with their NUL padding."""

    text: str
    regex: bool = False

    def match(self, c: Column) -> Column:
        if self.regex:
            return found_in(F.decode(c, "ISO-8859-1"), self.text)
        return F.coalesce(c == F.lit(self.text.encode("ascii", "replace")[:4].ljust(4, b"\0")), F.lit(False))


@dataclass(frozen=True)
class Filter:
    kind: int = POSITIVE
    enabled: bool = True
    negate: bool = False
    at_load_time: bool = False
    ecu: Id | None = None
    apid: Id | None = None
    ctid: Id | None = None
    verb_mstp_mtin: tuple[int, int] | None = None
    level_min: int | None = None
    level_max: int | None = None
    payload: str | None = None
    payload_regex: str | None = None
    ignore_case: bool = False
    lifecycles: tuple[int, ...] = field(default=())

    def __post_init__(self):
        for level in (self.level_min, self.level_max):
            if level is not None and not 0 <= level <= 6:
                raise ValueError(f"log level {level}")

    def needs_text(self) -> bool:
        return self.payload is not None or self.payload_regex is not None

    def header_test(self) -> Column:
        """The tests on native columns."""
        tests = [i.match(F.col(c)) for i, c in ((self.ecu, "ecu"), (self.apid, "ext.apid"), (self.ctid, "ext.ctid")) if i]
        vmm = F.col("ext.verb_mstp_mtin").cast("int")
        if self.verb_mstp_mtin:
            value, mask = self.verb_mstp_mtin
            tests.append(F.coalesce(vmm.bitwiseAND(mask) == value, F.lit(False)))
        level = F.when(vmm.bitwiseAND(0x0E) == 0, F.shiftright(vmm, 4).bitwiseAND(15))
        if self.level_min is not None:
            tests.append(F.coalesce(level >= self.level_min, F.lit(False)))
        if self.level_max is not None:
            tests.append(F.coalesce(level <= self.level_max, F.lit(False)))
        if self.lifecycles:
            tests.append(F.coalesce(F.col("lifecycle").isin(list(self.lifecycles)), F.lit(False)))
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def text_test(self, text: Column) -> Column:
        if self.payload_regex is not None:
            return found_in(text, self.payload_regex)
        if self.payload is not None:
            if self.ignore_case:
                quoted = "\\Q" + self.payload.replace("\\E", "\\E\\\\E\\Q") + "\\E"
                return F.coalesce(text.rlike("(?iu)" + quoted), F.lit(False))
            return F.coalesce(text.contains(self.payload), F.lit(False))
        return F.lit(True)

    def column(self, text: Column | None = None) -> Column:
        """Whether a row matches; text: the payload text, needed by payload tests only."""
        if not self.enabled:
            return F.lit(False)
        test = self.header_test()
        if self.needs_text():
            test = test & self.text_test(F.col("payload_text") if text is None else text)
        return ~test if self.negate else test

    @staticmethod
    def from_json(text: str | dict) -> Filter:
        j = json.loads(text) if isinstance(text, str) else text
        if not isinstance(j, dict) or j.get("type") not in (0, 1, 2, 3):
            raise ValueError("a filter needs a type from 0 to 3")
        ids = {}
        for k in ("ecu", "apid", "ctid"):
            if isinstance(j.get(k), str):
                flag = j.get(f"{k}IsRegex")
                regex = has_regex_chars(j[k]) if flag is None else bool(flag)
                ids[k] = Id(j[k], regex)
        vmm = None
        if isinstance(v := j.get("verb_mstp_mtin"), int):
            vmm = (v & 0xFF, (v >> 8) & 0xFF) if v > 0xFF else (v, 0x0F if v & 0xF0 == 0 else 0xFF)
        elif isinstance(v := j.get("mstp"), int):
            vmm = ((v & 7) << 1, 0x0E)
        payload, regex = j.get("payload"), j.get("payloadRegex")
        fold = bool(j.get("ignoreCasePayload", False))
        if regex is not None and fold:
            regex = f"(?i){regex}"
        return Filter(
            j["type"], bool(j.get("enabled", True)), bool(j.get("not", False)), bool(j.get("atLoadTime", False)), ids.get("ecu"), ids.get("apid"), ids.get("ctid"),
            vmm, j.get("logLevelMin"), j.get("logLevelMax"), payload if regex is None else None, regex, fold, tuple(x for x in j.get("lifecycles", ()) if isinstance(x, int) and x >= 0),
        )

    def to_json(self) -> str:
        out: dict = {"type": self.kind}
        if not self.enabled:
            out["enabled"] = False
        if self.negate:
            out["not"] = True
        if self.at_load_time:
            out["atLoadTime"] = True
        for k in ("ecu", "apid", "ctid"):
            if i := getattr(self, k):
                out |= {k: i.text} | ({f"{k}IsRegex": True} if i.regex else {})
        if self.verb_mstp_mtin:
            value, mask = self.verb_mstp_mtin
            out |= {"mstp": value >> 1} if mask == 0x0E else {"verb_mstp_mtin": value if mask in (0x0F, 0xFF) else value | mask << 8}
        for k, v in (("logLevelMin", self.level_min), ("logLevelMax", self.level_max), ("payload", self.payload)):
            if v is not None:
                out[k] = v
        if self.payload_regex is not None:
            out["payloadRegex"] = self.payload_regex.removeprefix("(?i)") if self.ignore_case else self.payload_regex
        if self.ignore_case:
            out["ignoreCasePayload"] = True
        if self.lifecycles:
            out["lifecycles"] = list(self.lifecycles)
        return json.dumps(out)


def from_dlf(xml: str) -> list[Filter]:
    """The filters of a viewer's XML file; plain payload tests there always ignore case."""
    root = ET.fromstring(xml)
    if root.tag != "dltfilter":
        raise ValueError("no dltfilter element")
    out = []
    for f in root.findall("filter"):
        get = lambda k, f=f: (f.findtext(k) or "")
        on = lambda k, f=f: get(k, f) == "1"
        ids = {}
        for k, enable, regex in (("ecu", "enableecuid", None), ("apid", "enableapplicationid", "enableregexp_Appid"), ("ctid", "enablecontextid", "enableregexp_Context")):
            value = get({"ecu": "ecuid", "apid": "applicationid", "ctid": "contextid"}[k])
            if on(enable) and value:
                ids[k] = Id(value, bool(regex) and on(regex))
        payload = get("payloadtext") if on("enablepayloadtext") else None
        regex = payload if payload and on("enableregexp_Payload") else None
        out.append(
            Filter(
                int(get("type") or 0), on("enablefilter"), False, False, ids.get("ecu"), ids.get("apid"), ids.get("ctid"), (0x06, 0x0E) if on("enablectrlmsgs") else None,
                int(get("logLevelMin") or 0) if on("enableLogLevelMin") else None, int(get("logLevelMax") or 6) if on("enableLogLevelMax") else None, None if regex else payload or None, regex, bool(payload) and not regex,
            )
        )
    return out


def from_records(text: str) -> list[Filter]:
    """10-character records 'APID CTID '; '-' ends an id."""
    out = []
    for i in range(0, len(text.rstrip("\n")) - 8, 10):
        apid, ctid = (text[i + k : i + k + 4].split("-")[0].strip() for k in (0, 5))
        out.append(Filter(apid=Id(apid) if apid else None, ctid=Id(ctid) if ctid else None))
    return out


def from_triples(text: str) -> list[Filter]:
    """'ECU:APID:CTID,...'; empty parts match all, parts with special characters are patterns."""
    out = []
    for part in filter(None, text.split(",")):
        ids = [Id(x, has_regex_chars(x)) if x else None for x in (part.split(":") + ["", ""])[:3]]
        out.append(Filter(ecu=ids[0], apid=ids[1], ctid=ids[2]))
    return out


def combined(filters: list[Filter], text: Column | None = None, events: bool = True) -> Column:
    """(no positive or any) and no negative and (no event or any); events: whether event filters count; markers never do."""
    any_of = lambda kind: reduce(lambda a, b: a | b, [f.column(text) for f in filters if f.kind == kind and f.enabled], F.lit(False))
    have = lambda kind: any(f.kind == kind and f.enabled for f in filters)
    out = ~any_of(NEGATIVE) if have(NEGATIVE) else F.lit(True)
    for kind in (POSITIVE, EVENT) if events else (POSITIVE,):
        if have(kind):
            out = out & any_of(kind)
    return out


def apply(msgs: DataFrame, filters: list[Filter], text: Column | None = None, events: bool = True) -> DataFrame:
    """The rows that match; tests on native columns run before those on decoded text where that is exact."""
    plain = [f for f in filters if not f.needs_text()]
    out = msgs
    if negative := [f for f in plain if f.kind == NEGATIVE]:
        out = out.where(combined(negative))
    if not any(f.needs_text() and f.kind == POSITIVE and f.enabled for f in filters):
        out = out.where(combined([f for f in plain if f.kind == POSITIVE]))
    return out.where(combined(filters, text, events))


def passed_counts(msgs: DataFrame, filters: list[Filter], text: Column | None = None) -> DataFrame:
    hit = combined(filters, text)
    return msgs.agg(F.count("*").alias("processed"), F.count_if(hit).alias("passed"), F.count_if(~hit).alias("filtered"))
