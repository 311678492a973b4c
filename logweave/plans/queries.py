"""The engine's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import filters, ordering, stats
from ..operators.filters import EVENT, NEGATIVE, POSITIVE, Filter, Id
from ..operators.plugins import export
from ..operators.positions import Positions
from .adapter import SQL, messages

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {SQL}{'' if sql[0] == ',' else chr(10)}{sql}"
        return f

    return add


def ids(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("index"), C.id_text(F.col("ecu")).alias("ecu"), C.id_text(F.col("ext.apid")).alias("apid"), C.id_text(F.col("ext.ctid")).alias("ctid"), *more)


I = "idx AS index, ecu, apid, ctid"  # noqa: E741


@query(f"SELECT {I} FROM m WHERE (level <= 3 OR contains(txt, '7')) AND NOT (ecu = 'E004') AND (apid = 'ERRO' OR ctid = 'C003')")
def filter_pos_neg_event(spark: SparkSession, sf: str) -> DataFrame:
    fs = [Filter(level_max=3), Filter(payload="7"), Filter(NEGATIVE, ecu=Id("E004")), Filter(EVENT, apid=Id("ERRO")), Filter(EVENT, ctid=Id("C003"))]
    return ids(filters.apply(messages(spark, sf), fs))


@query(f"SELECT {I} FROM m WHERE contains(txt, '7') AND NOT (ecu = 'E004')")
def filter_convert_ignores_events(spark: SparkSession, sf: str) -> DataFrame:
    fs = [Filter(payload="7"), Filter(NEGATIVE, ecu=Id("E004")), Filter(EVENT, apid=Id("ERRO"))]
    return ids(filters.apply(messages(spark, sf), fs, events=False))


@query(f"SELECT {I}, level <> 2 AS has_ext FROM m WHERE NOT coalesce(CASE WHEN level <> 2 THEN apid END = 'VIEW', false)".replace("ecu, apid, ctid", "ecu"))
def filter_not_null_id(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    m = m.withColumn("ext", F.when(F.col("ext.apid") != F.lit(b"ERRO"), F.col("ext")))
    return filters.apply(m, [Filter(negate=True, apid=Id("VIEW"))]).select("index", C.id_text(F.col("ecu")).alias("ecu"), F.col("ext").isNotNull().alias("has_ext"))


@query(f"SELECT {I} FROM m WHERE regexp_matches(txt, '\"k\": *[0-9]*[13]}}')")
def filter_regex_payload(spark: SparkSession, sf: str) -> DataFrame:
    return ids(filters.apply(messages(spark, sf), [Filter(payload_regex='"k": *[0-9]*[13]}')]))


@query(f"SELECT {I} FROM m WHERE contains(lower(txt), '\"k\": 1')")
def filter_payload_ci(spark: SparkSession, sf: str) -> DataFrame:
    return ids(filters.apply(messages(spark, sf), [Filter(payload='"K": 1', ignore_case=True)]))


@query(f"SELECT {I} FROM m WHERE regexp_matches(ecu, '00[1-3]') AND NOT regexp_matches(ctid, '[56]')")
def filter_regex_id(spark: SparkSession, sf: str) -> DataFrame:
    return ids(filters.apply(messages(spark, sf), [Filter(ecu=Id("00[1-3]", True)), Filter(NEGATIVE, ctid=Id("[56]", True))]))


@query(f"SELECT {I}, level::INT AS level FROM m WHERE level BETWEEN 3 AND 5")
def filter_loglevel_range(spark: SparkSession, sf: str) -> DataFrame:
    return ids(filters.apply(messages(spark, sf), [Filter(level_min=3, level_max=5)]), C.log_level().alias("level"))


@query(f"SELECT {I} FROM m WHERE (level * 16 + 1) & 240 = 64")
def filter_type_mask(spark: SparkSession, sf: str) -> DataFrame:
    return ids(filters.apply(messages(spark, sf), [Filter(verb_mstp_mtin=(0x40, 0xF0))]))


@query(f"SELECT {I} FROM u WHERE lc IN (1, 2, 5)")
def filter_lifecycles(spark: SparkSession, sf: str) -> DataFrame:
    return ids(filters.apply(messages(spark, sf, True), [Filter(lifecycles=(1, 2, 5))]))


@query("SELECT count(*) AS processed, count(*) FILTER (WHERE level <= 3) AS passed, count(*) FILTER (WHERE NOT level <= 3) AS filtered FROM m")
def filter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return filters.passed_counts(messages(spark, sf), [Filter(level_max=3)])


@query(f"SELECT {I} FROM m WHERE level <= 4 AND idx BETWEEN 100 AND 2000 AND rt BETWEEN epoch_us(TIMESTAMP '2024-01-02') AND epoch_us(TIMESTAMP '2024-01-20')")
def export_range(spark: SparkSession, sf: str) -> DataFrame:
    day = 86_400_000_000
    new_year = 1_704_067_200_000_000
    return ids(export.select(messages(spark, sf), [Filter(level_max=4)], None, new_year + day, new_year + 19 * day, 100, 2000))


@query("SELECT ecu, apid, ctid, count(*) AS nr_msgs FROM m GROUP BY ALL")
def eac_stats_ctid(spark: SparkSession, sf: str) -> DataFrame:
    return stats.by_context(messages(spark, sf)).select(*[C.id_text(F.col(c)).alias(c) for c in ("ecu", "apid", "ctid")], "nr_msgs")


@query("SELECT ecu, apid, count(*) AS nr_msgs, count(DISTINCT ctid) AS nr_ctids FROM m GROUP BY ALL")
def eac_stats_apid(spark: SparkSession, sf: str) -> DataFrame:
    return stats.by_application(messages(spark, sf)).select(*[C.id_text(F.col(c)).alias(c) for c in ("ecu", "apid")], "nr_msgs", "nr_ctids")


@query("SELECT ecu, count(*) AS nr_msgs FROM m GROUP BY ALL")
def eac_stats_ecu(spark: SparkSession, sf: str) -> DataFrame:
    return stats.by_ecu(messages(spark, sf)).select(C.id_text(F.col("ecu")).alias("ecu"), "nr_msgs")


@query("SELECT ecu, apid, ctid, count(*) AS nr_msgs, arg_min(CASE WHEN level = 4 THEN txt END, CASE WHEN level = 4 THEN idx END) AS description FROM m GROUP BY ALL")
def first_desc_wins(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    infos = m.where("ext.verb_mstp_mtin = 65").select("index", "ecu", "ext.apid", "ext.ctid", F.col("payload_text").alias("description"))
    return stats.with_descriptions(m, infos).select(*[C.id_text(F.col(c)).alias(c) for c in ("ecu", "apid", "ctid")], "nr_msgs", "description")


@query("SELECT DISTINCT ecu FROM m")
def distinct_ecus(spark: SparkSession, sf: str) -> DataFrame:
    return stats.distinct_ecus(messages(spark, sf)).select(C.id_text(F.col("ecu")).alias("ecu"))


_STREAMS = "s AS (SELECT *, (idx % 3)::INT AS stream, CASE WHEN idx % 5 = 0 THEN rt + 3600000000 ELSE rt END AS r2 FROM m)"


def _streams(spark: SparkSession, sf: str) -> DataFrame:
    late = F.when(F.col("index") % 5 == 0, 3_600_000_000).otherwise(0)  # streams that are not in order themselves
    m = messages(spark, sf).withColumn("reception_time_us", F.col("reception_time_us") + late)
    return m.withColumns({"src_stream": (F.col("index") % 3).cast("int"), "src_seq": F.col("index")})


@query(f", {_STREAMS}, k AS (SELECT *, max(r2) OVER (PARTITION BY stream ORDER BY idx) AS key FROM s) SELECT idx AS src_seq, stream AS src_stream, row_number() OVER (ORDER BY key, stream, idx) - 1 AS index FROM k".lstrip())
def merge_streams(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.merge(_streams(spark, sf)).select("src_seq", "src_stream", "index")


@query(f", {_STREAMS} SELECT idx AS src_seq, row_number() OVER (ORDER BY stream, idx) - 1 AS index FROM s".lstrip())
def concat_index(spark: SparkSession, sf: str) -> DataFrame:
    s = _streams(spark, sf)
    return ordering.concat([s.where(F.col("src_stream") == i) for i in range(3)]).select("src_seq", "index")


_SORTED = """, l AS (SELECT ecu, lc, min(rt - dms * 100) AS start FROM u GROUP BY ALL),
c AS (SELECT u.*, least(start + dms * 100, rt) AS t FROM u JOIN l USING (ecu, lc)), o AS (SELECT *, row_number() OVER (ORDER BY t, idx) - 1 AS pos FROM c)"""


def _timed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = messages(spark, sf, True).withColumn("lifecycle", F.concat_ws(":", C.id_text(F.col("ecu")), "lifecycle"))
    lcs = m.groupBy(F.col("lifecycle").alias("id")).agg(F.min(F.col("reception_time_us") - C.timestamp_us()).alias("start_time_us"))
    return m, lcs


def _sorted(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.time_sort(*_timed(spark, sf))


def _positions(spark: SparkSession, sf: str) -> Positions:
    return Positions.build(ordering.with_calculated_time(*_timed(spark, sf)), ["calculated_time_us", "index"], ["calculated_time_us", "index"])


@query(f"{_SORTED} SELECT idx AS index, t AS calculated_time_us, pos AS row_pos FROM o")
def time_sort(spark: SparkSession, sf: str) -> DataFrame:
    return _sorted(spark, sf).select("index", "calculated_time_us", "row_pos")


@query(f"{_SORTED} SELECT idx AS index, pos AS row_pos FROM o WHERE pos >= 40 AND pos < 60")
def window_page(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(spark, sf).page(40, 60).select("index", "row_pos")


@query(f"{_SORTED} SELECT pos AS row_pos FROM o WHERE pos >= 100 AND level = 2 ORDER BY pos LIMIT 50")
def search_matches(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.search(_sorted(spark, sf), C.log_level() == 2, 100, 50)


@query(f"{_SORTED} SELECT count(*) FILTER (WHERE t < epoch_us(TIMESTAMP '2024-01-10')) AS position FROM o")
def binary_search_time(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(spark, sf).lower_bound("calculated_time_us", 1_704_844_800_000_000)


@query("SELECT count(*) FILTER (WHERE idx < 777) AS position FROM m")
def binary_search_index(spark: SparkSession, sf: str) -> DataFrame:
    return Positions.build(messages(spark, sf), ["index"], ["index"]).lower_bound("index", 777)


@query(", v AS (SELECT idx, lag(dms * 100) OVER (PARTITION BY ecu, apid, ctid ORDER BY idx) - dms * 100 AS back FROM u) SELECT idx AS index, back AS back_us FROM v WHERE back > 100000")
def verify_sort_order(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf, True).withColumns({"lifecycle": F.lit(1), "row_pos": F.col("index")})
    return ordering.order_violations(m).select("index", "back_us")


@query(", v AS (SELECT idx, lc, lag(lc) OVER (PARTITION BY ecu ORDER BY idx) AS before FROM u) SELECT idx AS index, lc AS lifecycle FROM v WHERE lc <> before")
def verify_lc_order(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.lifecycle_changes(messages(spark, sf, True).withColumn("row_pos", F.col("index"))).select("index", "lifecycle")


@query(f"{_SORTED}, d AS (SELECT idx, max(rt - t) OVER (PARTITION BY ecu, lc ORDER BY rt // 1000000 RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS d FROM c) SELECT idx AS index, d AS max_delay_us FROM d")
def sliding_delay(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf, True).withColumn("lifecycle", F.concat_ws(":", C.id_text(F.col("ecu")), "lifecycle"))
    lcs = m.groupBy(F.col("lifecycle").alias("id")).agg(F.min(F.col("reception_time_us") - C.timestamp_us()).alias("start_time_us"))
    return ordering.buffering_delay(m, lcs, 3600).select("index", "max_delay_us")


@query(""", g AS (SELECT *, CASE WHEN rt - lag(rt) OVER (PARTITION BY ecu ORDER BY idx) <= 3600000000 THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT ecu, rt, sum(new) OVER (PARTITION BY ecu ORDER BY idx) AS session FROM g) SELECT ecu, session::BIGINT AS session, count(*) AS nr_msgs, min(rt) AS start_us, max(rt) AS end_us FROM s GROUP BY ALL""")
def lifecycle_sessions_simple(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("ecu").orderBy("index")
    gap = F.col("reception_time_us") - F.lag("reception_time_us").over(w)
    m = messages(spark, sf).withColumn("new", F.when(gap <= 3_600_000_000, 0).otherwise(1))
    m = m.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy(C.id_text(F.col("ecu")).alias("ecu"), "session").agg(F.count("*").alias("nr_msgs"), F.min("reception_time_us").alias("start_us"), F.max("reception_time_us").alias("end_us"))


@query("SELECT idx AS index, mcnt, lower(regexp_replace(hex(txt::BLOB), '(..)', '\\1 ', 'g')).rtrim() AS dump, regexp_replace(txt, '[^ -~]', '-', 'g') AS shown FROM m")
def hex_dump_printable(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.encode(F.col("payload_text"), "UTF-8")
    return messages(spark, sf).select("index", F.col("mcnt").cast("long").alias("mcnt"), C.hex_dump(raw).alias("dump"), C.printable(raw).alias("shown"))


@query("SELECT idx AS index, idx || ' ' || strftime(make_timestamp(rt), '%Y/%m/%d %H:%M:%S.%f') || ' ' || lpad(dms::VARCHAR, 10, ' ') || ' ' || lpad(mcnt::VARCHAR, 3, '0') || ' ' || ecu || ' ' || apid || ' ' || ctid || ' log ' || ['fatal','error','warn','info','debug','verbose'][level] || ' V 1' AS line FROM u")
def header_lines(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf, True).select("index", C.header_line().alias("line"))


@query("SELECT ecu, ctid, count(*) AS received, sum(coalesce((mcnt - lag_ - 1 + 512) % 256, 0))::BIGINT AS lost FROM (SELECT *, lag(mcnt) OVER (PARTITION BY ecu, ctid ORDER BY idx) AS lag_ FROM m) GROUP BY ALL")
def plp_counter_gap(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf).select("index", "ecu", "ext.ctid", F.col("mcnt").cast("int").alias("mcnt"))
    out = stats.counter_gaps(m, ["ecu", "ctid"], "mcnt", ["index"], 256)
    return out.select(C.id_text(F.col("ecu")).alias("ecu"), C.id_text(F.col("ctid")).alias("ctid"), "received", F.col("lost").cast("long").alias("lost"))
