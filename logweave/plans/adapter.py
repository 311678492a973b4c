"""The events table seen as messages, so that operators can be checked against SQL on public tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = {"error": 2, "purchase": 3, "signup": 4, "click": 5, "view": 6}


def messages(spark: SparkSession, sf_dir: str, uptime: bool = False) -> DataFrame:
    """index, reception_time_us, ecu, timestamp_dms, htyp, mcnt, ext, payload_text, lifecycle.

    Signup rows are boots. With uptime, timestamp_dms counts from the ECU's last boot and lifecycle is the number of its
    boots so far; without, both are 0 and no window runs.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).cast("long")
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("event_type")]
    four = lambda c: F.encode(c, "ISO-8859-1")
    out = e.select(
        F.col("event_id").alias("index"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("reception_time_us"),
        four(F.concat(F.lit("E"), F.lpad((F.col("user_id") % 10).cast("string"), 3, "0"))).alias("ecu"),
        F.lit(0x31).cast("short").alias("htyp"),
        F.pmod(F.col("event_id"), F.lit(256)).cast("short").alias("mcnt"),
        F.struct(
            (level * 16 + 1).cast("short").alias("verb_mstp_mtin"),
            F.lit(1).cast("short").alias("noar"),
            four(F.upper(F.substring("event_type", 1, 4))).alias("apid"),
            four(F.concat(F.lit("C"), F.lpad((k % 7).cast("string"), 3, "0"))).alias("ctid"),
        ).alias("ext"),
        F.col("props").alias("payload_text"),
        (F.col("event_type") == "signup").alias("_boot"),
        F.col("value"),
    )
    if not uptime:
        return out.drop("_boot").withColumns({"timestamp_dms": F.lit(0).cast("long"), "lifecycle": F.lit(0).cast("long")})
    upto = Window.partitionBy("ecu").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    boot = F.max(F.when(F.col("_boot"), F.col("reception_time_us"))).over(upto)
    out = out.withColumn("timestamp_dms", F.coalesce(F.floor((F.col("reception_time_us") - boot) / 100), F.lit(0)))
    return out.withColumn("lifecycle", F.sum(F.col("_boot").cast("long")).over(upto)).drop("_boot")


SQL = """m AS (SELECT event_id AS idx, epoch_us(ts) AS rt, 'E' || lpad((user_id % 10)::VARCHAR, 3, '0') AS ecu, upper(substr(event_type, 1, 4)) AS apid,
  'C' || lpad((regexp_extract(props, '"k": *(\\d+)', 1)::BIGINT % 7)::VARCHAR, 3, '0') AS ctid, event_id % 256 AS mcnt,
  CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 WHEN 'click' THEN 5 WHEN 'view' THEN 6 END AS level,
  props AS txt, event_type = 'signup' AS boot, value FROM events),
u AS (SELECT *, coalesce((rt - max(CASE WHEN boot THEN rt END) OVER w) // 100, 0) AS dms, (sum(boot::BIGINT) OVER w)::BIGINT AS lc FROM m WINDOW w AS (PARTITION BY ecu ORDER BY idx ROWS UNBOUNDED PRECEDING))"""
