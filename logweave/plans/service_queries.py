"""What sessions and streams do, over the events: positions, searches, cursors, live streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators.filters import Filter, Id, combined
from ..operators.lifecycle import Limits
from ..operators.positions import Cursor, Positions
from ..operators.scan import hadoop, shared_dir, staged
from ..streaming import feed, live
from ..streaming.reorder import ByTime, Fifo, Smallest, reordered
from .adapter import SQL, messages
from .lifecycle_queries import _ROUGH, _rules, rough

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {SQL}{'' if sql[0] == ',' else chr(10)}{sql}"
        return f

    return add


def _laid_out(spark: SparkSession, sf: str) -> Positions:
    m = messages(spark, sf).withColumn("late_us", F.col("reception_time_us") + F.col("index") % 7 * 60_000_000)
    return Positions.build(m, ["late_us", "index"], ["late_us", "index"])


_ORDER = ", o AS (SELECT *, rt + idx % 7 * 60000000 AS late, row_number() OVER (ORDER BY rt + idx % 7 * 60000000, idx) - 1 AS pos FROM m)"


@query(f"{_ORDER} SELECT pos AS row_pos, idx AS index, ecu FROM o WHERE pos BETWEEN 3000 AND 4999 OR pos BETWEEN 17 AND 30")
def position_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a laid out table open the folders they lie in."""
    p = _laid_out(spark, sf)
    return p.page(3000, 5000).unionByName(p.page(17, 31)).select("row_pos", "index", C.id_text(F.col("ecu")).alias("ecu"))


@query(f"{_ORDER} SELECT 'time' AS what, count(*) FILTER (WHERE late < epoch_us(TIMESTAMP '2024-01-10')) AS position FROM o UNION ALL SELECT 'index', count(*) FILTER (WHERE idx < 777) FROM o UNION ALL SELECT 'end', count(*) FROM o")
def position_lower_bounds(spark: SparkSession, sf: str) -> DataFrame:
    p = _laid_out(spark, sf)
    found = {"time": p.lower_bound("late_us", 1_704_844_800_000_000), "index": p.lower_bound("index", 777), "end": p.lower_bound("late_us", 2**62)}
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("what"), "position") for k, df in found.items()])


@query(f"{_ORDER} SELECT pos AS row_pos, idx AS index FROM o WHERE level = 2 AND ecu <> 'E004'")
def query_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A query that is left and continued four times gives what an unbroken one gives."""
    p = _laid_out(spark, sf)
    keep = combined([Filter(level_max=2), Filter(kind=1, ecu=Id("E004"))])
    pages, cursor = [], Cursor()
    while cursor is not None and len(pages) < 4:
        page, cursor = p.query(keep, cursor, 150)
        pages.append(page)
    if cursor is not None:
        pages.append(p.query(keep, cursor, len(p))[0])
    return reduce(DataFrame.unionByName, pages).select("row_pos", "index")


@query(f"""{_ORDER}, h AS (SELECT 'errors' AS name, pos FROM o WHERE level = 2 UNION ALL SELECT 'one', pos FROM o WHERE idx = 4321 UNION ALL SELECT 'none', pos FROM o WHERE ecu = 'X' UNION ALL SELECT 'late', pos FROM o WHERE idx % 100 = 99)
SELECT name, pos AS row_pos FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS n FROM h WHERE pos >= 250) WHERE n <= 60""")
def searches_together(spark: SparkSession, sf: str) -> DataFrame:
    """Several searches read the table once; each ends by itself."""
    hits = {"errors": C.log_level() == 2, "one": F.col("index") == 4321, "none": F.col("ecu") == F.lit(b"X"), "late": F.col("index") % 100 == 99}
    found = _laid_out(spark, sf).search_all(hits, 250, 60)
    return spark.createDataFrame([(n, i) for n, (at, _) in found.items() for i in at], "name string, row_pos long")


@query(f"{_ORDER}, f AS (SELECT idx, pos, row_number() OVER (ORDER BY pos) - 1 AS n FROM o WHERE level <= 3) SELECT n AS pos, idx AS index FROM f WHERE n >= 100 AND n < 900 UNION ALL SELECT -1, count(*) FROM f WHERE idx < 2500")
def filtered_positions(spark: SparkSession, sf: str) -> DataFrame:
    """A filtered view has positions of its own over the same table; below: what lies under an index."""
    view = _laid_out(spark, sf).filtered(combined([Filter(level_max=3)]), "pos")
    return view.page(100, 900).select("pos", "index").unionByName(view.lower_bound("index", 2500).select(F.lit(-1).cast("long").alias("pos"), F.col("position").alias("index")))


def in_steps(df: DataFrame, name: str, steps: int = 3) -> str:
    """df in files of growing index, in the shared folder, for a stream to read one after another."""
    path = f"{shared_dir(df.sparkSession)}/logweave-{uuid.uuid4().hex}/{name}"
    fs, at = hadoop(df.sparkSession, path)
    fs.deleteOnExit(at)
    top = df.agg(F.max("index")).first()[0] or 0
    for k in range(steps):
        low, high = (top + 1) * k // steps, (top + 1) * (k + 1) // steps
        df.where((F.col("index") >= low) & (F.col("index") < high)).coalesce(1).write.mode("append").parquet(path)
    return path


def arriving(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def in_generations(df: DataFrame, name: str, steps: int = 3, each: int = 200_000) -> DataFrame:
    """df as a stream of `steps` triggers by growing index, each of as many files as its rows need. What reads it does not rely on the order within a trigger."""
    spark = df.sparkSession
    df = staged(df, f"{name}-rows")
    path = f"{shared_dir(spark)}/logweave-{uuid.uuid4().hex}/{name}"
    fs, at = hadoop(spark, path)
    fs.deleteOnExit(at)
    rows, top = df.agg(F.count("*"), F.max("index")).first()
    n = rows // (steps * each) + 1  # files of a step: all have rows, as these are dealt out in turn
    for k in range(steps):
        low, high = ((top or 0) + 1) * k // steps, ((top or 0) + 1) * (k + 1) // steps
        some = df.where((F.col("index") >= low) & (F.col("index") < high))
        (some.coalesce(1) if n == 1 else some.repartition(n)).write.mode("append").parquet(f"{path}/step{k}")
    found = [sorted(str(f.getPath().toString()) for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/step{k}")) if f.getPath().getName().endswith(".parquet")) for k in range(steps)]
    if any(len(f) != n for f in found):  # some indexes have few rows: a file for each step
        return arriving(spark, in_steps(df, f"{name}-single", steps), df.schema)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n).parquet(f"{path}/step*")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that is there, as a table."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/logweave-{uuid.uuid4().hex}/{name}"
    fs, at = hadoop(spark, path)
    fs.deleteOnExit(at)
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _late(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that arrive up to some minutes after their time; each ECU is a stream."""
    m = messages(spark, sf)
    late = F.col("index") * 7919 % 600 * 1_000_000
    return m.select("index", (F.col("reception_time_us") - late).alias("calculated_time_us"), "reception_time_us", "ecu", F.lit(1).cast("long").alias("lifecycle"), C.id_text(F.col("ecu")).alias("src_stream"), F.col("ext.apid").alias("apid"))


_LATE = ", a AS (SELECT idx, ecu, rt, rt - idx * 7919 % 600 * 1000000 AS t, row_number() OVER (PARTITION BY ecu ORDER BY idx) AS n FROM m)"


@query(f"""{_LATE}, e AS (SELECT r.ecu, r.idx, r.t, min(x.n) AS e FROM a r JOIN a x ON x.ecu = r.ecu AND x.n >= r.n AND x.rt > r.t + 300000000 GROUP BY ALL)
SELECT ecu, idx AS index, row_number() OVER (PARTITION BY ecu ORDER BY e, t, idx) - 1 AS out_seq FROM e""")
def reorder_by_time(spark: SparkSession, sf: str) -> DataFrame:
    """Rows go out in order of their time once it is five minutes before the latest reception; later ones at once."""
    rows = _late(spark, sf)
    out = drained(reordered(arriving(spark, in_steps(rows, "late"), rows.schema), ByTime(300_000_000)), "by_time")
    return out.select(F.col("src_stream").alias("ecu"), "index", "out_seq")


@query(f"""{_LATE}, z AS (SELECT ecu, 0::BIGINT AS n, []::STRUCT(t BIGINT, i BIGINT)[] AS h, NULL::BIGINT AS gone FROM (SELECT DISTINCT ecu FROM a)
  UNION ALL SELECT a.ecu, a.n, list_sort(list_append(CASE WHEN len(z.h) = 8 THEN z.h[2:] ELSE z.h END, {{'t': a.t, 'i': a.idx}})), CASE WHEN len(z.h) = 8 THEN z.h[1].i END FROM z JOIN a ON a.ecu = z.ecu AND a.n = z.n + 1)
SELECT ecu, gone AS index, row_number() OVER (PARTITION BY ecu ORDER BY n) - 1 AS out_seq FROM z WHERE gone IS NOT NULL""")
def reorder_by_count(spark: SparkSession, sf: str) -> DataFrame:
    """The smallest of eight rows goes out before another one comes in."""
    rows = _late(spark, sf)
    out = drained(reordered(arriving(spark, in_steps(rows, "late"), rows.schema), Smallest(8)), "by_count")
    return out.select(F.col("src_stream").alias("ecu"), "index", "out_seq")


@query(f"{_LATE} SELECT ecu, idx AS index, n - 1 AS out_seq FROM a WHERE n <= (SELECT max(n) - 25 FROM a b WHERE b.ecu = a.ecu)")
def delay_by_count(spark: SparkSession, sf: str) -> DataFrame:
    """The last 25 rows of each stream wait."""
    rows = _late(spark, sf)
    out = drained(reordered(arriving(spark, in_steps(rows, "late"), rows.schema), Fifo(25)), "delay")
    return out.select(F.col("src_stream").alias("ecu"), "index", "out_seq")


def _feed(spark: SparkSession, changes: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(spark)}/logweave-{uuid.uuid4().hex}/{name}"
    fs, at = hadoop(spark, path)
    fs.deleteOnExit(at)
    feed.publish(changes, f"{path}/feed", f"{path}/state").awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changes.schema) + ", generation int"
    return feed.read(spark, f"{path}/feed", schema)


@query("SELECT ecu, apid, ctid, count(*) AS nr_msgs, 3 AS generations FROM m GROUP BY ALL")
def feed_of_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The counts that changed in each of three generations add up to those of all messages."""
    m = messages(spark, sf).select("index", "ecu", "ext")
    found = _feed(spark, live.statistics(in_generations(m, "counted")), "counts")
    n = found.agg(F.count_distinct("generation").cast("int").alias("generations"))
    return feed.fold(found, ["ecu", "apid", "ctid"]).select(*[C.id_text(F.col(c)).alias(c) for c in ("ecu", "apid", "ctid")], "nr_msgs").crossJoin(F.broadcast(n))


@query(f", {_ROUGH},\n{_rules(Limits())}\nSELECT ecu, first AS first_index, n AS nr_msgs, q AS nr_control_req_msgs, s AS start_time_us, mn AS min_timestamp_us, mx AS max_timestamp_us, last AS last_reception_time_us, rf AS resume_from, v AS sw_version FROM l")
def feed_of_lifecycles(spark: SparkSession, sf: str) -> DataFrame:
    """Lifecycles as they change in three generations, merged ones gone, add up to those of all messages."""
    found = _feed(spark, feed.lifecycle_changes(in_generations(rough(spark, sf), "rough")), "lifecycles")
    names = ("first_index", "nr_msgs", "nr_control_req_msgs", "start_time_us", "min_timestamp_us", "max_timestamp_us", "last_reception_time_us", "resume_from", "sw_version")
    return feed.fold(found, ["ecu", "first_index"]).select(C.id_text(F.col("ecu")).alias("ecu"), *names)
