"""Lifecycles checked against SQL: the rules as a recursive query over the messages of each ECU, one message a step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import lifecycle
from ..operators.lifecycle import Limits
from ..operators.scan import running
from .adapter import SQL, messages

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
US = 1_000_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {SQL},\n{sql}"
        return f

    return add


def _rules(lim: Limits) -> str:
    """l: the lifecycles of x (idx, ecu, rec, up, has, req, ver), with first (index), id and what they resume.

    The state of an ECU is the list of its lifecycles; o: it may still be merged, g: one of its messages was given out.
    """
    end = lambda x: f"(CASE WHEN {x}.mx = 0 THEN {x}.last ELSE {x}.s + {x}.mx END)"
    slight = lambda x, s: f"({s} <= {end(x)} AND {end(x)} < {s} + {lim.overlap} AND {end(x)} > {x}.s + {lim.overlap_least})"
    new = "{'f': idx, 's': rec - u0, 'i': rec - u0, 'mn': u0, 'mx': u0, 'last': rec, 'n': 1, 'q': req::INT, 'rf': CASE WHEN again THEN c.f END, 'rm': CASE WHEN again THEN c.mx END, 'rs': CASE WHEN again THEN c.s END, 'v': NULL::VARCHAR, 'o': true, 'g': false}"
    changed = lambda **k: "{" + ", ".join(f"'{f}': {k.get(f, 'c.' + f)}" for f in "f s i mn mx last n q rf rm rs v o g".split()) + "}"
    untag = "(c.rf IS NOT NULL AND NOT up > c.mx AND up < c.rm - c.rm // 8)"
    widened = changed(
        s="least(c.s, st)", mn="CASE WHEN up < c.mn AND (c.rf IS NULL OR up > c.rm) THEN up ELSE c.mn END", mx="greatest(c.mx, up)", last="rec", n="c.n + 1", v="coalesce(c.v, ver)",
        rf=f"CASE WHEN {untag} THEN NULL ELSE c.rf END", rm=f"CASE WHEN {untag} THEN NULL ELSE c.rm END", rs=f"CASE WHEN {untag} THEN NULL ELSE c.rs END",
    )
    merged = "{'f': b.f, 's': least(b.s, c.s), 'i': CASE WHEN c.s < b.s THEN c.i ELSE b.i END, 'mn': least(b.mn, c.mn), 'mx': greatest(b.mx, c.mx), 'last': greatest(b.last, c.last), 'n': b.n + c.n, 'q': b.q + c.q, 'rf': b.rf, 'rm': b.rm, 'rs': b.rs, 'v': coalesce(b.v, c.v), 'o': b.o, 'g': b.g}"
    certain = f"(x.s < rec - up - {lim.buffering} OR x.mx - x.mn > {lim.buffering} OR rec - {lim.buffering} > {end('x')})"
    given = "list_transform(l, lambda x, k: {'f': x.f, 's': x.s, 'i': x.i, 'mn': x.mn, 'mx': x.mx, 'last': x.last, 'n': x.n, 'q': x.q, 'rf': x.rf, 'rm': x.rm, 'rs': x.rs, 'v': x.v, 'o': x.o, 'g': x.g OR k < coalesce(list_position(list_transform(l, lambda y: y.o), true), 1000000000)})"
    confirmed = "list_transform(l, lambda x: {'f': x.f, 's': x.s, 'i': x.i, 'mn': x.mn, 'mx': x.mx, 'last': x.last, 'n': x.n, 'q': x.q, 'rf': x.rf, 'rm': x.rm, 'rs': x.rs, 'v': x.v, 'o': x.o AND NOT " + certain + ", 'g': x.g})"
    return f"""y AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ecu ORDER BY idx) AS k, greatest(0, rec - up) AS st, CASE WHEN req OR up > rec THEN 0 ELSE up END AS u0 FROM x),
z AS (SELECT ecu, k, [{new.replace("CASE WHEN again THEN c.f END", "NULL::BIGINT").replace("CASE WHEN again THEN c.mx END", "NULL::BIGINT").replace("CASE WHEN again THEN c.s END", "NULL::BIGINT")}] AS l, rec + {lim.check_every} AS due FROM y WHERE k = 1
  UNION ALL SELECT ecu, k, {given} AS l, due FROM (
    SELECT ecu, k, CASE WHEN due < rec AND rec > up + {lim.buffering} THEN {confirmed} ELSE l END AS l, CASE WHEN due < rec THEN rec + {lim.check_every} ELSE due END AS due FROM (
      SELECT * EXCLUDE (l), CASE WHEN joins THEN list_append(l[:len(l) - 2], {merged}) ELSE l END AS l FROM (
        SELECT *, kind <> 'new' AND b IS NOT NULL AND c.s <= {end("b")} AND c.rf IS NULL AND NOT {slight("b", "c.s")} AND (b.o OR NOT c.g) AS joins FROM (
          SELECT * EXCLUDE (c, l), l, l[len(l)] AS c, CASE WHEN len(l) > 1 THEN l[len(l) - 1] END AS b FROM (
            SELECT * EXCLUDE (l), CASE kind WHEN 'new' THEN list_append(l, {new}) WHEN 'widen' THEN list_append(l[:len(l) - 1], {widened}) ELSE list_append(l[:len(l) - 1], {changed(n="c.n + 1", q="c.q + req::INT")}) END AS l FROM (
              SELECT *, CASE WHEN req THEN 'count' WHEN belongs AND c.s - st > {lim.buffering} AND c.mx > 0 THEN 'count' WHEN again OR NOT belongs THEN 'new' ELSE 'widen' END AS kind FROM (
                SELECT *, NOT has OR (st <= {end("c")} AND NOT {slight("c", "st")}) AS belongs,
                  rec - c.last >= {lim.resume_gap} AND up >= c.mx AND st >= c.s + {lim.resume_gap} AND rec - c.last + {lim.resume_buffering} > st - c.s AS again FROM (
                  SELECT y.*, z.l, z.due, z.l[len(z.l)] AS c FROM z JOIN y ON y.ecu = z.ecu AND y.k = z.k + 1))))))))),
e AS (SELECT ecu, unnest(l) AS l FROM (SELECT ecu, arg_max(l, k) AS l FROM z GROUP BY ecu)),
l AS MATERIALIZED (SELECT row_number() OVER (ORDER BY l.f) AS id, ecu, l.f AS first, l.n::BIGINT AS n, l.q::BIGINT AS q, l.s AS s, l.i AS i, l.mn AS mn, l.mx AS mx, l.last AS last, l.rf AS rf, l.rm AS rm, l.rs AS rs, l.v AS v FROM e)"""


COLUMNS = ("id", "ecu", "nr_msgs", "nr_control_req_msgs", "start_time_us", "initial_start_time_us", "min_timestamp_us", "max_timestamp_us", "last_reception_time_us", "resume_id", "resume_max_us", "resume_start_us", "sw_version")
_ALL = "SELECT l.id, l.ecu, l.n AS nr_msgs, l.q AS nr_control_req_msgs, l.s AS start_time_us, l.i AS initial_start_time_us, l.mn AS min_timestamp_us, l.mx AS max_timestamp_us, l.last AS last_reception_time_us, o.id AS resume_id, l.rm AS resume_max_us, l.rs AS resume_start_us, l.v AS sw_version FROM l LEFT JOIN l o ON o.ecu = l.ecu AND o.first = l.rf"


def flat(lcs: DataFrame) -> DataFrame:
    parts = lcs.withColumns({"resume_id": F.col("resume.id"), "resume_max_us": F.col("resume.max_timestamp_us"), "resume_start_us": F.col("resume.start_time_us"), "ecu": C.id_text(F.col("ecu"))})
    return parts.select(*COLUMNS)


def rough(spark: SparkSession, sf: str) -> DataFrame:
    """The events as ECUs that boot, are suspended, log late, without uptime or with a wrong one, answer with their version, and are asked.

    A second stands for ten minutes of the events. Boots are some of the signups; after some errors the ECU is suspended for 40 s.
    """
    m = messages(spark, sf)
    i, t = F.col("index"), F.floor(F.col("reception_time_us") / 600)
    boots, sleeps = (F.col("ext.apid") == F.lit(b"SIGN")) & (i % 3 != 0), (F.col("ext.apid") == F.lit(b"ERRO")) & (i % 7 == 0)
    # in blocks of indexes: an ECU's messages are not one task
    m = running(m.withColumn("_t", t), ["ecu"], "index", {"_slept": ("sum", F.when(sleeps, 40 * US)), "_boot": ("last", F.when(boots, F.col("_t")))})
    m = m.withColumns({"_slept": F.coalesce("_slept", F.lit(0)), "_boot": F.coalesce("_boot", F.lit(1_700_000_000_000_000))})
    late = F.when(i % 11 == 0, 3 * US).when(i % 97 == 0, 70 * US).when(i % 5 == 0, 300_000).otherwise(0)
    up = F.greatest(F.lit(0), F.col("_t") - F.col("_boot"))
    up = F.when((i % 13 == 0) | (i % 17 == 0), 0).when(i % 101 == 0, up + 1000 * US).otherwise(up)
    htyp = F.when(i % 13 == 0, 0x21).otherwise(0x31)
    version = (i % 23 == 0) & (i % 17 != 0)
    kind = F.when(i % 17 == 0, 0x16).when(version, 0x26).otherwise(F.col("ext.verb_mstp_mtin"))
    text = F.encode(F.concat(F.lit("v"), F.lpad((i % 1000).cast("string"), 3, "0")), "UTF-8")
    return m.withColumns(
        {
            "reception_time_us": (F.col("_t") + late + F.col("_slept")).cast("long"),
            "timestamp_dms": F.floor(up / 100).cast("long"),
            "htyp": htyp.cast("short"),
            "ext": F.col("ext").withField("verb_mstp_mtin", kind.cast("short")),
            "payload": F.when(version, F.concat(F.unhex(F.lit("130000000004000000")), text)),
        }
    ).drop("_t", "_slept", "_boot")


_ROUGH = """w AS (SELECT *, rt // 600 AS t, sum(CASE WHEN apid = 'ERRO' AND idx % 7 = 0 THEN 40000000 END) OVER v AS slept, coalesce(arg_max(CASE WHEN apid = 'SIGN' AND idx % 3 <> 0 THEN rt // 600 END, CASE WHEN apid = 'SIGN' AND idx % 3 <> 0 THEN idx END) OVER v, 1700000000000000) AS boot0 FROM m WINDOW v AS (PARTITION BY ecu ORDER BY idx ROWS UNBOUNDED PRECEDING)),
x AS (SELECT idx, ecu, (t + CASE WHEN idx % 11 = 0 THEN 3000000 WHEN idx % 97 = 0 THEN 70000000 WHEN idx % 5 = 0 THEN 300000 ELSE 0 END + coalesce(slept, 0))::BIGINT AS rec,
  (CASE WHEN idx % 13 = 0 OR idx % 17 = 0 THEN 0 WHEN idx % 101 = 0 THEN greatest(0, t - boot0) + 1000000000 ELSE greatest(0, t - boot0) END // 100 * 100)::BIGINT AS up, idx % 13 <> 0 AS has, idx % 17 = 0 AS req,
  CASE WHEN idx % 23 = 0 AND idx % 17 <> 0 THEN 'v' || lpad((idx % 1000)::VARCHAR, 3, '0') END AS ver FROM w)"""


def _hours(n: int) -> Limits:
    h = 3600 * US
    return Limits(n * h, n * h, n * h, n * h // 30, n * h // 6)


_SIX = "x AS (SELECT idx, ecu, rt AS rec, dms * 100 AS up, true AS has, false AS req, NULL::VARCHAR AS ver FROM u)"


@query(f"{_SIX},\n{_rules(_hours(6))}\nSELECT id, ecu, n AS nr_msgs, s AS start_time_us, mx AS max_timestamp_us FROM l")
def lifecycle_report(spark: SparkSession, sf: str) -> DataFrame:
    """Lifecycles of the events; the gaps there are hours, so the limits are too."""
    _, lcs = lifecycle.detect(messages(spark, sf, True), _hours(6))
    return lcs.select("id", C.id_text(F.col("ecu")).alias("ecu"), "nr_msgs", "start_time_us", "max_timestamp_us")


@query(f"{_ROUGH},\n{_rules(Limits())}\n{_ALL}")
def lifecycle_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Resumes, slight overlaps, merges, implausible uptimes, messages without uptime, requests and versions."""
    _, lcs = lifecycle.detect(rough(spark, sf), small=0)
    return flat(lcs)


@query(f"{_ROUGH},\n{_rules(Limits())}\nSELECT x.idx AS index, l.id AS lifecycle FROM x ASOF JOIN l ON x.ecu = l.ecu AND x.idx >= l.first")
def lifecycle_rules_assigned(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = lifecycle.detect(rough(spark, sf), block=500, small=0)
    return out.select("index", "lifecycle")


@query(f"""{_ROUGH},\n{_rules(Limits())}
SELECT id, CASE WHEN mx = 0 THEN last ELSE s + mx END AS end_time_us, CASE WHEN rf IS NULL THEN 0 ELSE greatest(0, s - rs) END AS suspend_duration_us, CASE WHEN rf IS NULL THEN s ELSE s + mn - greatest(0, s - rs) END AS resume_time_us,
  CASE WHEN rf IS NULL THEN s ELSE greatest(s, rs + 1) END AS resume_start_time_us, q >= n AS only_control_requests, rf IS NOT NULL AS is_resume FROM l""")
def lifecycle_derived(spark: SparkSession, sf: str) -> DataFrame:
    _, lcs = lifecycle.detect(rough(spark, sf))
    return lifecycle.derived(lcs).select("id", "end_time_us", "suspend_duration_us", "resume_time_us", "resume_start_time_us", "only_control_requests", "is_resume")


@query(f"""{_ROUGH},\n{_rules(Limits())}
SELECT id, printf('LC#%3d: ', id) || ecu || ' ' || CASE WHEN rf IS NULL THEN strftime(make_timestamp(s), '%Y/%m/%d %H:%M:%S.%f') ELSE strftime(make_timestamp(s + mn - greatest(0, s - rs)), '%Y/%m/%d %H:%M:%S RESUME') END
  || ' - ' || strftime(make_timestamp(CASE WHEN mx = 0 THEN last ELSE s + mx END), '%H:%M:%S') || printf(' #%8d', n) || CASE WHEN q >= n THEN ' CTRL_REQUESTS_ONLY' ELSE '' END || ' ' || coalesce(v, '') AS line FROM l""")
def lifecycle_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    _, lcs = lifecycle.detect(rough(spark, sf))
    return lifecycle.report(lcs).select("id", "line")
