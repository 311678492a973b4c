"""Cross-site line dedup by the spread of a line over distinct sites; DataFrame functions only.

A line (trimmed, hashed to 128 bits) that stands on `min_sites` sites or more is boilerplate. Lines that occur in fewer
than min_sites rows can't be (an aggregated count with partial sums rules them out); for the others a HyperLogLog sketch of
the sites is built by aggregation. Estimates clearly over or under min_sites decide; those within the sketch's error of it
are counted exactly. Boilerplate lines are then removed, whatever share of a document they make. A document without any
other line that isn't blank is a copied document rather than a page with boilerplate and stays as it is, for near-duplicate
removal to deal with.

Edge cases: null texts have no lines and stay null; the empty text has one empty line; blank lines are never boilerplate;
a null source is no site; repeated rows are cleaned each; equal lines in one document count once by site; extra columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, cut, shield, table

LG_K = 12
MAX_BROADCAST = 200_000
KEYS = ["h1", "h2"]


def _hashes(c) -> list:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(F.lit(k), c).alias(f"h{k}") for k in (1, 2)]


def lines(docs: DataFrame, site: str, *more) -> DataFrame:
    at = docs.select(F.col(site).alias("site"), *more, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.trim("line")
    return at.where(line != "").select("site", *[c for c in at.columns if c not in ("site", "line")], *_hashes(line))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """h1, h2 of the lines that stand on min_sites distinct sites or more."""
    every = lines(docs, site).where("site is not null").drop("pos")
    often = cut(every.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select(*KEYS), "often")
    every = every.join(checked(often, MAX_BROADCAST), KEYS, "left_semi")
    spread = cut(every.groupBy(*KEYS).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites")), "spread")
    error = max(1, round(5 * 1.04 / 2 ** (LG_K / 2) * min_sites))  # five standard errors
    near = spread.where(F.abs(F.col("sites") - min_sites) <= error).select(*KEYS)
    exact = every.join(checked(near, MAX_BROADCAST), KEYS, "left_semi").groupBy(*KEYS).agg(F.countDistinct("site").alias("sites"))
    sure = spread.where(F.col("sites") > min_sites + error).select(*KEYS)
    return cut(sure.union(exact.where(F.col("sites") >= min_sites).select(*KEYS)), "boilerplate")


def clean(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """docs with text cleaned, and n_lines and n_removed (long)."""
    flagged = boilerplate(docs, site, min_sites)
    # what is removed depends on the text alone, so a 128-bit hash of the text, with doc_id for an even spread, is the key
    key = [F.xxhash64(F.lit(k), F.col("doc_id"), F.col("text")).alias(f"_k{k}") for k in (1, 2)]
    hit = lines(docs, site, *key).join(checked(flagged, MAX_BROADCAST), KEYS, "left_semi")
    places = hit.groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("_places"))  # bounded by the lines of one text
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = docs.select(*own, *key).join(places, ["_k1", "_k2"], "left")
    every = F.split("text", "\n")
    kept = F.array_join(F.filter(every, lambda x, i: ~F.array_contains("_places", i)), "\n")
    out = out.withColumn("_kept", F.when(F.col("_places").isNotNull(), kept))
    take = F.col("_kept").isNotNull() & F.exists(F.split("_kept", "\n"), lambda x: F.trim(x) != "")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(every))
    return out.select(
        *[F.when(take, F.col("_kept")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in own],
        n_lines.cast("long").alias("n_lines"),
        F.when(take, F.size("_places")).otherwise(0).cast("long").alias("n_removed"),
    )


def strip(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """docs, with the same columns, without boilerplate lines; n_chars, where there is one, is the cleaned text's."""
    renamed, restore = shield(docs, ("n_lines", "n_removed"))
    out = clean(renamed, site, min_sites)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return restore(out).select(*docs.columns)


def op5_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return clean(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE_SQL = {
    "op5_line_spread": """
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
b AS (SELECT trim(line) AS line FROM l WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE trim(line) NOT IN (SELECT line FROM b)) AS kept, count(*) AS n_lines,
             count(*) FILTER (WHERE trim(line) IN (SELECT line FROM b)) AS n, bool_or(trim(line) <> '' AND trim(line) NOT IN (SELECT line FROM b)) AS own FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, CASE WHEN own THEN n ELSE 0 END::BIGINT AS n_removed, CASE WHEN own AND n > 0 THEN kept ELSE text END AS text
FROM documents d LEFT JOIN k USING (doc_id)"""
}
QUERIES = {"op5_line_spread": op5_line_spread}
