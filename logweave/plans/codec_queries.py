"""Queries that go through the codecs and state machines: what they give back is checked with the SQL of what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.payload import with_text
from ..operators import lifecycle, ordering, stats
from ..operators.filters import Filter, Id
from ..operators.plugins import anonymize, export, file_transfer, rewrite
from ..schema import MSG_SCHEMA, as_batch
from ..sources import wire
from . import sinks
from .adapter import SQL, messages
from .queries import ids

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {SQL}{'' if sql[0] == ',' else chr(10)}{sql}"
        return f

    return add


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    """The events as messages in file form: raw."""
    m = messages(spark, sf, True)

    def run(parts):
        import pandas as pd

        for p in parts:
            raw = []
            for r in p.itertuples(index=False):
                msg = wire.log(bytes(r.ecu), bytes(r.apid), bytes(r.ctid), [r.text, ("u", 64, r.index), bool(r.index % 2)], int(r.vmm) >> 4, r.us, r.dms % 2**32, r.mcnt, r.index % 3 == 0)
                raw.append(wire.write(msg))
            yield pd.DataFrame({"index": p["index"], "raw": raw})

    src = m.select("index", "ecu", F.col("ext.apid").alias("apid"), F.col("ext.ctid").alias("ctid"), F.col("ext.verb_mstp_mtin").alias("vmm"), F.col("reception_time_us").alias("us"), F.col("timestamp_dms").alias("dms"), "mcnt", F.col("payload_text").alias("text"))
    return src.mapInPandas(run, "index long, raw binary")


def decoded(raw: DataFrame) -> DataFrame:
    """raw messages read back; index is kept."""

    def run(parts):
        import pandas as pd

        for p in parts:
            rows = []
            for i, b in zip(p["index"], p["raw"], strict=True):
                for msg in wire.scan(bytes(b)):
                    msg.index = i
                    rows.append(msg.row("memory", 0, i))
            yield pd.DataFrame(rows, columns=MSG_SCHEMA.fieldNames())

    return raw.mapInPandas(run, MSG_SCHEMA)


@query("SELECT idx AS index, ecu, apid, ctid, rt AS reception_time_us, dms % 4294967296 AS timestamp_dms, mcnt::BIGINT AS mcnt, level::BIGINT AS level, txt || ' ' || idx || ' ' || (idx % 2 = 1)::VARCHAR AS payload_text FROM u")
def roundtrip_dlt(spark: SparkSession, sf: str) -> DataFrame:
    m = with_text(decoded(encoded(spark, sf)))
    return ids(m, "reception_time_us", "timestamp_dms", F.col("mcnt").cast("long").alias("mcnt"), C.log_level().cast("long").alias("level"), "payload_text")


@query("SELECT idx AS index, 16 + 18 + 4 + 2 + strlen(txt) + 1 + 12 + 5 AS bytes FROM m")
def dlt_writer_sizes(spark: SparkSession, sf: str) -> DataFrame:
    m = decoded(encoded(spark, sf))
    return sinks.serialised(m).select("index", F.length("raw").cast("long").alias("bytes"))


@query("SELECT idx AS index, 3::BIGINT AS args FROM m")
def argument_counts(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.payload import arguments

    return decoded(encoded(spark, sf)).select("index", F.size(arguments()).cast("long").alias("args"))


@query("SELECT idx AS index, regexp_extract(txt, '\"k\": *([0-9]+)', 1) AS payload_text, CASE WHEN apid = 'VIEW' THEN (regexp_extract(txt, '\"k\": *([0-9]+)', 1)::BIGINT * 10000) ELSE 0 END AS timestamp_dms FROM m WHERE apid = 'VIEW' UNION ALL SELECT idx, txt, 0 FROM m WHERE apid <> 'VIEW'")
def rewrite_regex(spark: SparkSession, sf: str) -> DataFrame:
    rule = (Filter(apid=Id("VIEW")), r'"k": *(?<timeStamp>(?<text>[0-9]+))')
    return rewrite.apply(messages(spark, sf), [rule]).select("index", "payload_text", "timestamp_dms")


@query(""", f AS (SELECT ecu, apid, ctid, min(idx) AS f FROM m GROUP BY ALL),
e AS (SELECT ecu, row_number() OVER (ORDER BY min(f)) AS n FROM f GROUP BY ecu), a AS (SELECT ecu, apid, row_number() OVER (PARTITION BY ecu ORDER BY min(f)) AS n FROM f GROUP BY ecu, apid),
c AS (SELECT ecu, apid, ctid, row_number() OVER (PARTITION BY ecu, apid ORDER BY f) AS n FROM f)
SELECT idx AS index, 'E' || lpad(e.n::VARCHAR, 3, '0') AS ecu, 'A' || lpad(a.n::VARCHAR, 3, '0') AS apid, 'C' || lpad(c.n::VARCHAR, 3, '0') AS ctid
FROM m JOIN e USING (ecu) JOIN a USING (ecu, apid) JOIN c USING (ecu, apid, ctid)""")
def anonymize_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ids(anonymize.anonymize(messages(spark, sf)))


@query("SELECT doc_id, strlen(text)::BIGINT AS size, 'Complete' AS state, sha256(text) AS sha FROM documents")
def file_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    """Each document is sent as a file in packages of 1,000 bytes and put together again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.repartition(spark.sparkContext.defaultParallelism, "doc_id")  # encoding costs more than moving the texts once
    u = lambda x: ("u", 32, x)
    # packages are cut before they come to Python, which so holds no more than a batch of them, however long the texts
    raw = docs.select("doc_id", F.encode("text", "UTF-8").alias("raw")).withColumn("size", F.length("raw"))
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / 1000).cast("int"))
    step = lambda i: F.struct(i.alias("i"), F.when(i.between(1, n), F.substring("raw", (i - 1) * 1000 + 1, F.lit(1000))).alias("data"))
    steps = raw.select("doc_id", "size", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), n + 1), step)).alias("s")).select("doc_id", "size", "n", "s.*")

    def values(d: int, size: int, n: int, i: int, data: bytes | None) -> list:
        if i == 0:
            return ["FLST", u(d), f"{d}.txt", u(size), "today", u(n), u(1000), "FLST"]
        return ["FLFI", u(d), "FLFI"] if data is None else ["FLDA", u(d), u(i), data, "FLDA"]

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                rows = []
                for d, size, n, i, data in zip(*(c.to_pylist() for c in b.slice(k, 2000).columns), strict=True):
                    m = wire.log("ECU1", "SYS", "FILE", values(d, size, n, i, data))
                    m.index, m.lifecycle = d * 1_000_000 + i, 1
                    rows.append(m.row())
                yield as_batch(rows)

    found = file_transfer.transfers(steps.mapInArrow(run, MSG_SCHEMA))
    return found.select(F.col("serial").alias("doc_id"), "size", "state", F.sha2("data", 256).alias("sha"))


def _hours(n: int) -> lifecycle.Limits:
    h = 3_600_000_000
    return lifecycle.Limits(n * h, n * h, n * h, n * h // 30, n * h // 6)


@query("SELECT ecu, count(*) AS nr_msgs FROM m GROUP BY ecu")
def lifecycle_keeps_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of all lifecycles of an ECU together."""
    _, lcs = lifecycle.detect(messages(spark, sf, True), _hours(6))
    return lcs.groupBy(C.id_text(F.col("ecu")).alias("ecu")).agg(F.sum("nr_msgs").alias("nr_msgs"))


@query(""", l AS (SELECT ecu, lc, min(rt) AS s, max(rt) AS e FROM u GROUP BY ALL), w AS (SELECT * FROM l WHERE lc % 4 = 0)
SELECT ecu, lc AS lifecycle FROM l WHERE EXISTS (SELECT 1 FROM w WHERE w.ecu = l.ecu AND ((l.s >= w.s AND l.e <= w.e) OR (w.s >= l.s AND w.e <= l.e)))""")
def range_join_lifecycles(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf, True)
    l = m.groupBy("ecu", "lifecycle").agg(F.min("reception_time_us").alias("start_time_us"), F.max("reception_time_us").alias("e"))  # noqa: E741
    l = l.withColumns({"max_timestamp_us": F.col("e") - F.col("start_time_us"), "id": F.concat_ws(":", C.id_text(F.col("ecu")), "lifecycle"), "resume": F.lit(None).cast("struct<id:long,max_timestamp_us:long,start_time_us:long>")})  # noqa: E741
    w = l.where("lifecycle % 4 = 0").select("ecu", F.col("start_time_us").alias("start_us"), F.col("e").alias("end_us"), F.lit(None).cast("long").alias("resume_us"))
    kept = export.same_lifecycles(l, w)
    return kept.select(F.split_part("id", F.lit(":"), F.lit(1)).alias("ecu"), F.split_part("id", F.lit(":"), F.lit(2)).cast("long").alias("lifecycle"))


@query(", c AS (SELECT ecu, idx, txt FROM m WHERE boot) SELECT m.idx AS index, c.txt AS config FROM m ASOF LEFT JOIN c ON m.ecu = c.ecu AND m.idx >= c.idx")
def asof_config(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    own = F.when(F.col("ext.apid") == F.lit(b"SIGN"), F.col("payload_text"))
    upto = Window.partitionBy("ecu").orderBy("index").rowsBetween(Window.unboundedPreceding, 0)
    return m.select("index", F.last(own, True).over(upto).alias("config"))


@query("SELECT idx AS index, n_name AS name FROM m JOIN nation ON n_nationkey = idx % 25")
def dictionary_join(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    m = messages(spark, sf)
    return m.join(names, F.col("index") % 25 == F.col("k")).select("index", "name")


@query("SELECT idx AS index, (level = 2) AS forwarded FROM m WHERE (apid = 'VIEW' AND ctid = 'C001' AND level <= 6) OR (NOT (apid = 'VIEW' AND ctid = 'C001') AND level <= 4)")
def forward_levels(spark: SparkSession, sf: str) -> DataFrame:
    out = sinks.forward(messages(spark, sf), {(b"VIEW", b"C001"): 6}, 4)
    return out.select("index", (C.log_level() == 2).alias("forwarded"))


@query()
def stats_tree(spark: SparkSession, sf: str) -> DataFrame:
    return stats.tree(messages(spark, sf))


@query(", o AS (SELECT idx, row_number() OVER (ORDER BY rt DESC, idx) - 1 AS p FROM m) SELECT idx AS index, p AS pos FROM o")
def dense_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.numbered(messages(spark, sf).withColumn("back", -F.col("reception_time_us")), ["back", "index"], "pos").select("index", "pos")
