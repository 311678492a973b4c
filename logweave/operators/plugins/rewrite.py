"""Rewriting text and uptime by regular expressions: native columns, configuration after configuration."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..filters import Filter


def _group(pattern: str, name: str) -> int | None:
    """The number of a named group."""
    python = re.sub(r"\(\?<(?![=!])", "(?P<", pattern)
    return re.compile(python).groupindex.get(name)


def apply(msgs: DataFrame, rewrites: list[tuple[Filter, str]]) -> DataFrame:
    """Rows that a filter takes and whose text matches get the group `text` as text and `timeStamp` seconds as uptime."""
    out = msgs
    for f, pattern in rewrites:
        text = F.col("payload_text")
        hit = f.column(text) & F.coalesce(text.rlike(pattern), F.lit(False))
        new = {}
        if n := _group(pattern, "text"):
            new["payload_text"] = F.when(hit, F.regexp_extract(text, pattern, n)).otherwise(text)
        if n := _group(pattern, "timeStamp"):
            seconds = F.regexp_extract(text, pattern, n).try_cast("double")
            dms = F.round(seconds * 10_000).cast("long")
            new["timestamp_dms"] = F.when(hit & dms.isNotNull(), dms).otherwise(F.col("timestamp_dms"))
        out = out.withColumns(new)
    return out


def from_config(config: dict):
    rules = [(Filter.from_json({"type": 0} | r.get("filter", {})), r["payloadRegex"]) for r in config.get("rewrites", ())]
    return lambda msgs: apply(msgs, rules)
