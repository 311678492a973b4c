"""Mixing sources to target weights by iterative proportional fitting; DataFrame functions only.

Token counts are summed to cells (source, language, topic). A cell's documents are kept with the probability
min(1, a(source) * b(language) * c(topic)); the factors are fitted, one dimension after the other, until the tokens kept by
source, by language and by topic match the target shares of the sample. The bound at 1 is part of the fit: what a full cell
can't give, the others of the same value give instead, so every target is met, or as near as its tokens allow. A document
is chosen by a hash of its doc_id, so that the choice is repeatable.

One dimension, that of the most values, is fitted exactly in each iteration (its cells in the order of their factors, by
running sums), the other two by the sums of their pairs. Between iterations only the factors of these two are held, so an
iteration is one aggregation over the cells. Their pairs may number `MAX_PAIRS` (more is an error): languages and topics
are few by nature, while sources may be as many as there are sites.

Targets are tables (value, share); where none is given, a dimension's own token shares are tempered by the exponent
`temper` (below 1 raises small values).

Edge cases: null sources and languages are values of their own; null and empty texts have no tokens, weigh nothing and are
kept with the probability of their cell (0 where the cell has no tokens); rows of a null doc_id draw by their text; equal
rows are kept or dropped together; a value without target has the target 0; an empty table gives an empty result; extra
columns pass through.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked, cut, literal, table

DIMS = ("source", "lang", "topic")
ITERATIONS, SETTLED = 40, 1e-11  # so many, or until no pair changes by more of all tokens kept
KEEP = 0.5
TEMPER = 0.7
MAX_BROADCAST, MAX_PAIRS = 100_000, 100_000


def n_tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \t\n\r\f\x0b]+"), lambda x: x != "")), F.lit(0)).cast("long")


def form(text: Column, tokens: Column) -> Column:
    """The default topic: what kind of text it is, by its form."""
    return (
        F.when(F.coalesce(text.contains(" | "), F.lit(False)), "table")
        .when(tokens < 100, "short")
        .when(tokens < 1000, "medium")
        .otherwise("long")
    )


def _same(a: DataFrame, b: DataFrame, dims) -> Column:
    return reduce(lambda x, y: x & y, [a[d].eqNullSafe(b[f"_{d}"]) for d in dims])


def _goals(cells: DataFrame, targets: dict[str, DataFrame], temper: float) -> dict[str, DataFrame]:
    """For each dimension the values of cells with their share of the sample: _dimension, share."""
    out = {}
    for d in DIMS:
        own = cells.groupBy(F.col(d).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("share"))
        given = targets.get(d)
        if given is not None:
            whole = given.agg(F.sum("share").alias("whole"))
            given = given.crossJoin(F.broadcast(whole)).select(F.col("value").alias("_v"), (F.col("share") / F.col("whole")).alias("s"))  # one row
            own = own.join(given, own["value"].eqNullSafe(given["_v"]), "left").select("value", F.coalesce("s", F.lit(0.0)).alias("share"))
        else:
            whole = own.agg(F.nullif(F.sum("share"), F.lit(0.0)).alias("whole"))
            own = own.crossJoin(F.broadcast(whole)).select("value", F.coalesce(F.col("share") / F.col("whole"), F.lit(0.0)).alias("share"))
        out[d] = own.select(F.col("value").alias(f"_{d}"), "share")
    return out


def _solved(cells: DataFrame, wide: str) -> DataFrame:
    """cells (with goal: tokens wanted of their value of `wide`, and rest: the product of the other factors) with factor, which meets the goal."""
    down = Window.partitionBy(wide).orderBy(F.desc("rest"))
    fixed = F.coalesce(F.sum("tokens").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.sum(F.col("tokens") * F.col("rest")).over(down.rowsBetween(0, Window.unboundedFollowing))
    out = cells.withColumn("_a", (F.col("goal") - fixed) / F.nullif(free, F.lit(0.0)))
    whole = Window.partitionBy(wide)
    # of the rows that may be the first one below the bound the largest factor is right; with none, all cells are full
    fits = F.max(F.when(F.col("_a") * F.col("rest") <= 1, F.col("_a"))).over(whole)
    full = F.max(F.when(F.col("rest") > 0, 1 / F.col("rest"))).over(whole)
    return out.withColumn("factor", F.greatest(F.coalesce(fits, full, F.lit(0.0)), F.lit(0.0))).drop("_a")


def _step(goal: float, now: float, fixed: float, free: float) -> float:
    """By how much a factor changes, where its tokens are `fixed` in full cells and `free` in others."""
    if now >= goal:
        return goal / now if now else 1.0
    return (goal - fixed) / free if free > 0 else 1.0


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, iterations: int = ITERATIONS, temper: float = TEMPER, keep: float = 0.0) -> DataFrame:
    """cells (source, lang, topic, tokens: one row each, cut) with weight: shares of 1 that match the target shares of every dimension.

    keep: no weight is over the cell's share of the tokens divided by keep (0: no bound).
    """
    spark, keep = cells.sparkSession, keep or 1e-9
    goals = _goals(cells, targets or {}, temper)
    n = cells.agg(*[F.count_distinct(F.struct(d)).alias(d) for d in DIMS], F.sum("tokens").alias("tokens")).first()
    wide = max(DIMS, key=lambda d: n[d])
    others = [d for d in DIMS if d != wide]
    if (pairs := n[others[0]] * n[others[1]]) > MAX_PAIRS:
        raise ValueError(f"{pairs} pairs of {others}: at most {MAX_PAIRS} can be fitted")
    want = keep * float(n["tokens"] or 0)
    own = cells.join(goals[wide], cells[wide].eqNullSafe(goals[wide][f"_{wide}"])).select(*DIMS, "tokens", (F.col("share") * want).alias("goal"))
    # at most MAX_PAIRS values of each
    goal = {d: {r[0]: r[1] * want for r in goals[d].collect()} for d in others}
    factor = {d: dict.fromkeys(goal[d], 1.0) for d in others}
    for d in others:
        places = literal(spark, [{f"_{d}": v, f"i_{d}": i} for i, v in enumerate(goal[d])], f"_{d} {cells.schema[d].dataType.simpleString()}, i_{d} int")
        own = own.join(F.broadcast(places), own[d].eqNullSafe(places[f"_{d}"])).drop(f"_{d}")
    own = cut(own, "goals")

    def fitted() -> DataFrame:
        by_place = [F.from_json(F.lit(json.dumps(list(factor[d].values()))), "array<double>")[F.col(f"i_{d}")] for d in others]
        w = _solved(own.withColumn("rest", by_place[0] * by_place[1]), wide)
        return w.select(*DIMS, "tokens", (F.col("factor") * F.col("rest")).alias("x"))

    before: dict = {}
    for _ in range(iterations):
        full = F.col("x") >= 1
        sums = fitted().groupBy(*others).agg(
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).cast("double").alias("fixed"), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("x"))).alias("free")
        ).collect()
        kept = {(r[others[0]], r[others[1]]): r["fixed"] + r["free"] for r in sums}
        if before and max(abs(x - before[k]) for k, x in kept.items()) <= SETTLED * want:
            break
        before, change = kept, {d: {} for d in others}
        for d in others:
            for v in goal[d]:
                mine = [r for r in sums if r[d] == v]
                fixed = sum(r["fixed"] for r in mine)
                # the second dimension sees the step that the first has just taken
                free = sum(r["free"] * change[others[0]].get(r[others[0]], 1.0) for r in mine)
                change[d][v] = _step(goal[d][v], fixed + free, fixed, free)
        for d in others:
            factor[d] = {v: x * change[d][v] for v, x in factor[d].items()}
    weight = F.coalesce(F.col("tokens") * F.least(F.col("x"), F.lit(1.0)) / F.nullif(F.lit(want), F.lit(0.0)), F.lit(0.0))
    return fitted().select(*DIMS, "tokens", weight.alias("weight"))


def marginals(raked: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER) -> DataFrame:
    """dimension, value, share, target of a raked table: which targets its tokens could not meet."""
    goals = _goals(raked, targets or {}, temper)
    out = []
    for d in DIMS:
        now = raked.groupBy(d).agg(F.sum("weight").alias("share"))
        got = now.join(goals[d].withColumnRenamed("share", "target"), now[d].eqNullSafe(goals[d][f"_{d}"]))
        out.append(got.select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "share", "target"))
    return reduce(DataFrame.union, out)


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, iterations: int = ITERATIONS, temper: float = TEMPER, topic=form, seed: str = "mix") -> DataFrame:
    """The sampled rows of docs, with topic, n_tokens and probability; keep: tokens of the sample, as a share of all."""
    own = [c for c in docs.columns if c not in ("topic", "n_tokens", "probability")]
    d = docs.select(*own, n_tokens(F.col("text")).alias("n_tokens"))
    d = d.withColumn("topic", topic(F.col("text"), F.col("n_tokens")))
    cells = cut(d.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens").alias("total"))
    raked = rake(cells, targets, iterations, temper, keep).crossJoin(F.broadcast(total))  # one row
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), keep * F.col("weight") * F.col("total") / F.col("tokens"))).otherwise(0.0)
    raked = cut(raked.select(*[F.col(x).alias(f"_{x}") for x in DIMS], p.alias("probability")), "probabilities")
    # the first 52 bits of a hash as a number from 0 to 1
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")))))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)
    out = d.join(checked(raked, MAX_BROADCAST), _same(d, raked, DIMS))
    return out.where(u < F.col("probability")).select(*own, "topic", "n_tokens", "probability")


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", F.round(F.col("probability") * 10000).cast("long").alias("p_10000"))


def _sql() -> str:
    """The same fit, unrolled: source is the dimension of the most values."""
    out = [r"""WITH d AS (SELECT doc_id, text, source, lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0b]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM documents),
t AS (SELECT *, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 1000 THEN 'medium' ELSE 'long' END AS topic FROM d),
w AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM t GROUP BY ALL)"""]
    for d in DIMS:
        share = f"pow(sum(tokens), {TEMPER}) / sum(pow(sum(tokens), {TEMPER})) OVER ()"
        out.append(f"g_{d} AS MATERIALIZED (SELECT {d}, {share} * {KEEP} * (SELECT sum(tokens) FROM w) AS goal, 1.0::DOUBLE AS f FROM w GROUP BY {d})")
    step = "CASE WHEN now >= goal THEN coalesce(goal / nullif(now, 0), 1) WHEN free > 0 THEN (goal - fixed) / free ELSE 1 END"
    lang, topic = "g_lang", "g_topic"
    for i in range(ITERATIONS + 1):
        out.append(f"""r{i} AS MATERIALIZED (SELECT w.*, g.goal, l.f * c.f AS rest FROM w JOIN g_source g ON w.source IS NOT DISTINCT FROM g.source JOIN {lang} l ON w.lang IS NOT DISTINCT FROM l.lang JOIN {topic} c ON w.topic = c.topic),
a{i} AS (SELECT *, (goal - coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY rest DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / nullif(sum(tokens * rest) OVER (PARTITION BY source ORDER BY rest DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS a FROM r{i}),
x{i} AS MATERIALIZED (SELECT source, lang, topic, tokens, rest * greatest(coalesce(max(CASE WHEN a * rest <= 1 THEN a END) OVER (PARTITION BY source), max(CASE WHEN rest > 0 THEN 1 / rest END) OVER (PARTITION BY source), 0), 0) AS x FROM a{i})""")
        if i == ITERATIONS:
            break
        out.append(f"""s{i} AS MATERIALIZED (SELECT lang, topic, sum(CASE WHEN x >= 1 THEN tokens ELSE 0 END) AS fixed, sum(CASE WHEN x >= 1 THEN 0 ELSE tokens * x END) AS free FROM x{i} GROUP BY lang, topic),
l{i} AS MATERIALIZED (SELECT g.lang, goal, f, {step} AS up FROM {lang} g JOIN (SELECT lang, sum(fixed) AS fixed, sum(free) AS free, sum(fixed + free) AS now FROM s{i} GROUP BY lang) s ON g.lang IS NOT DISTINCT FROM s.lang),
c{i} AS MATERIALIZED (SELECT g.topic, goal, f, {step} AS up FROM {topic} g JOIN (SELECT topic, sum(fixed) AS fixed, sum(free * up) AS free, sum(fixed + free * up) AS now FROM s{i} s JOIN l{i} l ON s.lang IS NOT DISTINCT FROM l.lang GROUP BY topic) s USING (topic)),
nl{i} AS MATERIALIZED (SELECT lang, goal, f * up AS f FROM l{i}),
nc{i} AS MATERIALIZED (SELECT topic, goal, f * up AS f FROM c{i})""")
        lang, topic = f"nl{i}", f"nc{i}"
    return ",\n".join(out) + f""",
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, x) ELSE 0 END AS p FROM x{ITERATIONS})
SELECT t.doc_id, t.source, t.lang, t.topic, n_tokens, round(p * 10000)::BIGINT AS p_10000
FROM t JOIN p ON t.source IS NOT DISTINCT FROM p.source AND t.lang IS NOT DISTINCT FROM p.lang AND t.topic = p.topic
WHERE ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, '')))), 1, 13))::BIGINT / pow(2.0, 52) < p"""


ORACLE_SQL = {"op10_mix": _sql()}
QUERIES = {"op10_mix": op10_mix}
