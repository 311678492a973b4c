"""Exporting a selection: filters, lifecycles to keep, a reception range; log-info messages first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import columns as C
from ..filters import Filter, combined

NEAR_US = 1_900_000  # how far resumed lifecycles may lie apart


def same_lifecycles(lcs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id of the lifecycles that meet a wanted one (ecu, start_us, end_us, resume_us or null): inside its span, or resumed within 1.9 s of it."""
    end = F.col("l.start_time_us") + F.col("l.max_timestamp_us")
    inside = (F.col("l.start_time_us") >= F.col("w.start_us")) & (end <= F.col("w.end_us"))
    contains = (F.col("w.start_us") >= F.col("l.start_time_us")) & (F.col("w.end_us") <= end)
    resumed = F.abs(F.col("l.start_time_us") + F.col("l.resume.max_timestamp_us") - F.col("w.resume_us")) <= NEAR_US
    on = (F.col("l.ecu") == F.col("w.ecu")) & F.coalesce(F.when(F.col("w.resume_us").isNotNull(), resumed).otherwise(inside | contains), F.lit(False))
    return lcs.alias("l").join(wanted.alias("w"), on, "left_semi").select("id")


def select(msgs: DataFrame, filters: list[Filter], keep_lifecycles: DataFrame | None = None, first_us: int | None = None, last_us: int | None = None, first_index: int | None = None, last_index: int | None = None) -> DataFrame:
    """The rows to export, with info_first: log-info responses of the kept lifecycles sort ahead. Ranges include both ends; that of index holds after all else."""
    out = msgs
    if keep_lifecycles is not None:
        out = out.join(keep_lifecycles.withColumnRenamed("id", "lifecycle"), "lifecycle", "left_semi")
    info = C.is_ctrl_response() & (C.non_verbose_id(C.has_flag(2)) == 3) if "payload" in msgs.columns else F.lit(False)
    info = F.coalesce(info, F.lit(False))
    hit = combined(filters)
    if first_us is not None:
        hit = hit & (F.col("reception_time_us") >= first_us)
    if last_us is not None:
        hit = hit & (F.col("reception_time_us") <= last_us)
    out = out.where(hit | info).withColumn("info_first", info)
    if first_index is not None:
        out = out.where(F.col("index") >= first_index)
    return out if last_index is None else out.where(F.col("index") <= last_index)
