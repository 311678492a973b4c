"""Chat formatting with cumulative-snapshot collapse.

Logged conversations are often snapshots of one another: each request repeats all turns so far. A rolling hash of the turn
prefixes (the exclusive-or of 128-bit hashes of position, role and text) is taken at each turn; a conversation whose whole
hash is a prefix hash of a longer one, or of an equal one with a smaller conv_id, is left out by an anti-join. What is
left is rendered with role headers.

The prefix hash is a running aggregate in two levels (blocks of turn numbers, then turns in a block), so that no long
conversation has all its turns in one task at once (turns of one number, also null, do come together); what is rendered is
one row a turn, with its rank in the conversation: joined in that order, the rows are the chat, and no chat has to fit into
one row.

Edge cases: rows of a null conv_id are left out; turns are ordered by turn (null first), role and text, and repeated rows
count as turns of their own; null roles and texts render as empty but differ from empty ones in the hash; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BLOCK = 64


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rank (0, 1, ...), n_turns, and h1, h2: the rolling hash of the turns up to this one."""
    t = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    # equal rows become one row with a count: ties can then be ordered
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62)))  # null turns are before all others
    t = t.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("block", block)
    sums = t.groupBy("conv_id", "block").agg(F.sum("n").alias("bn"))
    by_block = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bn").over(by_block), F.lit(0))).drop("bn")
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("earlier", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, ["conv_id", "block"])
    t = t.withColumn("rank", F.explode(F.sequence(F.col("before") + F.col("earlier"), F.col("before") + F.col("earlier") + F.col("n") - 1)))
    for k in (1, 2):
        parts = [F.lit(k), F.col("rank"), F.col("role").isNull(), F.col("role"), F.lit(k), F.col("text").isNull(), F.col("text")]
        t = t.withColumn(f"x{k}", F.xxhash64(*parts))
    t = t.withColumn("block", F.floor(F.col("rank") / BLOCK)).drop("n", "before", "earlier")
    folds = t.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.count("*").alias("bn"))
    whole = Window.partitionBy("conv_id")
    for k in (1, 2):
        folds = folds.withColumn(f"b{k}", F.coalesce(F.bit_xor(f"b{k}").over(by_block), F.lit(0)))
    folds = folds.withColumn("n_turns", F.sum("bn").over(whole)).drop("bn")
    upto = Window.partitionBy("conv_id", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(folds, ["conv_id", "block"])
    for k in (1, 2):
        t = t.withColumn(f"h{k}", F.bit_xor(f"x{k}").over(upto).bitwiseXOR(F.col(f"b{k}")))
    return t.select("conv_id", "turn", "role", "text", "rank", "n_turns", "h1", "h2")


def collapse(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with prefix hashes, conv_id and n_snapshots of the maximal conversations)."""
    p = cut(prefixes(turns), "prefixes")
    whole = p.where("rank = n_turns - 1").select("conv_id", "n_turns", "h1", "h2")
    # of equal conversations the one with the smallest conv_id stands for all
    equal = whole.groupBy("n_turns", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_snapshots"))
    inner = p.where("rank < n_turns - 1").select((F.col("rank") + 1).alias("n_turns"), "h1", "h2").distinct()
    return p, equal.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv_id", "n_snapshots")


def render(turns: DataFrame, header: str = "<|{role}|>\n", end: str = "<|end|>\n") -> DataFrame:
    """Turns of the maximal conversations: conv_id, rank, n_turns, n_snapshots, rendered. Joined in the order of rank they are the chat."""
    p, kept = collapse(turns)
    before, after = header.split("{role}")
    text = F.concat(F.lit(before), F.coalesce("role", F.lit("")), F.lit(after), F.coalesce("text", F.lit("")), F.lit("\n" + end))
    return p.join(kept, "conv_id").select("conv_id", "rank", "n_turns", "n_snapshots", text.alias("rendered"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


ORACLE_SQL = {
    "op3_chat": """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS rank,
                  count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, string_agg(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n'), chr(2)) OVER (
        PARTITION BY conv_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS prefix FROM t),
whole AS (SELECT min(conv_id) AS conv_id, count(*) AS n_snapshots, prefix FROM p WHERE rank = n_turns - 1 GROUP BY prefix),
kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE rank < n_turns - 1))
SELECT t.conv_id, t.rank::BIGINT AS rank, n_turns::BIGINT AS n_turns, n_snapshots::BIGINT AS n_snapshots,
  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS rendered
FROM t JOIN kept USING (conv_id)"""
}
QUERIES = {"op3_chat": op3_chat}
