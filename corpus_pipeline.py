"""A training corpus from raw documents: each stage takes (spark, docs, sf_dir) and returns a DataFrame for the next.

toxicity drops documents predicted toxic, line dedup removes cross-site boilerplate lines, near-dedup keeps one document of
each group, decontamination removes benchmark passages (documents made mostly of them go), and mixing samples documents to
the target weights. All but the last return the columns of documents.

Edge cases: documents of null or empty text pass the first four stages as they are (they are never toxic, near copies or
contaminated) and are mixed as documents without tokens; repeated rows and rows of one doc_id are one document each until
near-dedup, which keeps one of equal texts; empty tables give an empty result; columns beyond those of documents stay until
the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import decontaminate, line_spread, mixing, tensor_minhash
from logweave.llm import toxicity as toxic
from logweave.llm.common import cut, discard, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic.drop_toxic(docs, table(spark, sf_dir, "labels").where(~toxic.held_out()))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_spread.strip(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tensor_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
]

# learned scores have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written to the shared folder and read again, and goes when the next one is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        after = cut(stage(spark, docs, sf_dir), f"pipeline{i}", free=True)
        if before is not None:
            discard(before)  # read for the last time
        docs = before = after
    return docs
