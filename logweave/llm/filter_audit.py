"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

One pass over the Arrow buffers measures every text: a table classes each byte, and prefix sums of the classes, read at the
documents' bounds, count code points, capitals, symbols and words. Words are hashed from prefix sums too; a document's
hashes are sorted, and equal neighbours count as one word only after their bytes were compared (two words of one hash send
that document to a plain set of its words). Which filters a document fails is then one small mask, so that the
documents reduce to counts by part and mask, and the orders are worked out on these counts: 2^k masks, k! orders, k steps.

A text is equal to an earlier one by the SHA-256 of its bytes. The documents of one text are not gathered: its smallest
doc_id is a minimum with partial aggregation, and texts with many copies are broadcast back to their rows.

Edge cases: a null text counts as the empty one, a null source as the part ''; an empty text fails the filter on length
only, and as a repetition; rows of one doc_id count as rows each and never as repetitions of each other; a row of a null
doc_id is no repetition and has no labels (its text is no earlier one either); several labels of one doc_id count as one that
has any of their ones, null labels as none; no documents give no rows; further columns of documents and labels are not read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, checked, chunks, cut, mix, powers, prefix_hash, raw_bytes, skew_join, table

MAX_BROADCAST = 200_000
MASK48 = np.uint64(2**48 - 1)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

SPACE, CAPITAL, SYMBOL, LATER = 1, 2, 4, 8  # classes of bytes; LATER: not the first byte of a code point
_class = np.zeros(256, np.uint8)
_class[[9, 10, 11, 12, 13, 32]] = SPACE
_class[65:91] = CAPITAL
_class[[ord(c) for c in "#$%&*|"]] = SYMBOL
_class[0x80:0xC0] = LATER

MEASURES = "n_chars long, n_words long, n_distinct long, n_capitals long, n_symbols long, digest binary"


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether data[a:a+n] equals data[b:b+n], for arrays of places and lengths."""
    out = np.ones(len(a), bool)
    long = np.flatnonzero(n > 64)
    for i in long.tolist():
        out[i] = np.array_equal(data[a[i] : a[i] + n[i]], data[b[i] : b[i] + n[i]])
    short = np.flatnonzero(n <= 64)
    at = 0
    while len(short):
        out[short] &= data[a[short] + at] == data[b[short] + at]
        at += 1
        short = short[n[short] > at]
    return out


def distinct_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = 48) -> np.ndarray:
    """How many different words (data[starts:ends]) each document has; at most 65,536 documents. bits: of the hashes, fewer in tests."""
    n_docs = len(offsets) - 1
    doc = (np.searchsorted(offsets, starts, "right") - 1).astype(np.uint64)
    size = ends - starts
    sums = prefix_hash(BYTE_CODE[data])
    h = mix((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] ^ size.astype(np.uint64))
    key = (doc << np.uint64(48)) | (h & MASK48 & np.uint64(2**bits - 1))
    order = np.argsort(key, kind="stable")
    key, a = key[order], starts[order]
    equal = np.flatnonzero(key[1:] == key[:-1])
    words = np.bincount(doc.astype(np.int64), minlength=n_docs)
    again = np.bincount(doc[order[equal]].astype(np.int64), minlength=n_docs)
    la, lb = size[order[equal]], size[order[equal + 1]]
    ok = la == lb
    ok[ok] = same_bytes(data, a[equal][ok], a[equal + 1][ok], la[ok])
    out = words - again
    for d in np.unique(doc[order[equal[~ok]]].astype(np.int64)).tolist():  # one hash, two words
        out[d] = len(set(_WORD.findall(data[offsets[d] : offsets[d + 1]].tobytes())))
    return out


def scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_chars, n_words, n_distinct, n_capitals, n_symbols of each text in data; at most 65,536 texts."""
    kind = _class[data]

    def counts(of: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(of, out=sums[1:])
        return np.diff(sums[offsets])

    word = kind != SPACE
    bound = np.zeros(len(data) + 1, bool)
    bound[offsets] = True
    begins = word & bound[:-1]
    begins[1:] |= word[1:] & ~word[:-1]
    ends = word & bound[1:]
    ends[:-1] |= word[:-1] & ~word[1:]
    distinct = distinct_words(data, offsets, np.flatnonzero(begins), np.flatnonzero(ends) + 1)
    return counts(kind != LATER), counts(begins), distinct, counts(kind == CAPITAL), counts(kind == SYMBOL)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, part (the source) and the measures of each whole text, with its digest."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            data, offsets = raw_bytes(batch.column(2))
            found, digests = [], []
            for a, b in chunks(np.diff(offsets)):
                for c in range(a, b, 1 << 16):
                    d = min(b, c + (1 << 16))
                    own = data[offsets[c] : offsets[d]]
                    found.append(scan(own, offsets[c : d + 1] - offsets[c]))
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                digests.append(hashlib.sha256(data[a:b]).digest())
            columns = [pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(digests, pa.binary())], names=["doc_id", "part", "n_chars", "n_words", "n_distinct", "n_capitals", "n_symbols", "digest"])

    few = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    return few.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, {MEASURES}")


def filters() -> dict[str, Column]:
    """The failure conditions by letter, over the columns of measures() and `repeated`."""
    words = F.col("n_words")
    return {
        "A": words < 200,
        "B": 100 * F.col("n_distinct") < 50 * words,
        "C": 100 * F.col("n_capitals") > 2 * F.col("n_chars"),
        "D": F.col("n_symbols") > 0,
        "E": F.col("repeated"),
    }


def failures(docs: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, part, mask of each document: bit i is set if it fails the condition i."""
    conditions = filters() if conditions is None else conditions
    seen = cut(measures(docs), "measures")
    texts = seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    texts = cut(texts, "texts")
    rows = skew_join(seen, texts, ["digest"], "left").withColumn("repeated", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    mask = F.lit(0)
    for i, failed in enumerate(conditions.values()):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    return rows.select("doc_id", "part", mask.cast("int").alias("mask"))


def by_mask(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents, and those of them labelled so. Rows of one doc_id and mask are counted before the join."""
    failed = failed.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic")).where("quality = 1 or toxic = 1")
    labels = cut(labels, "labels")
    known = failed.where("doc_id is not null").join(checked(labels, MAX_BROADCAST), "doc_id", "left")  # a doc_id has at most a row for each part and mask
    rows = known.unionByName(failed.where("doc_id is null").withColumns({"quality": F.lit(0), "toxic": F.lit(0)}))
    some = lambda c: F.coalesce(F.sum(F.when(F.col(c) == 1, F.col("n"))), F.lit(0))
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), some("quality").alias("good"), some("toxic").alias("toxic"))


def orders(letters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders of letters, and by (order, step): the step's bit, and the bits before it, as masks."""
    names = ["".join(p) for p in permutations(letters)]
    bit = np.array([[1 << letters.index(c) for c in name] for name in names]).reshape(len(names), len(letters))
    return names, bit, np.cumsum(bit, 1) - bit


def report(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """A row for each part, order of the filters and step, from by_mask()'s counts."""
    import pyarrow as pa

    names, bit, before = orders(letters)
    masks = np.arange(1 << len(letters))
    here = ((masks & bit[..., None]) != 0) & ((masks & before[..., None]) == 0)  # order, step, mask
    kept = (masks & (before | bit)[..., None]) == 0
    redundant = ((masks & bit[..., None]) != 0) & ~here
    only = masks == bit[..., None]
    step = np.tile(np.arange(1, len(letters) + 1, dtype=np.int32), len(names))
    of = [name for name in names for _ in letters]
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(batches):
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, good, toxic = np.zeros((3, len(masks)), np.int64)
                for c in cells:
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                removed = here @ n
                total = np.zeros(len(masks), np.int64)
                np.add.at(total, bit, removed)
                out = (kept @ n, removed, redundant @ n, only @ n, here @ good, here @ toxic, total[bit])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(of)), pa.array(of), pa.array(step), *[pa.array(x.reshape(-1)) for x in out]], names=["part", "filter_order", "step", *columns])

    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^k a part
    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    conditions = filters() if conditions is None else conditions
    return report(cut(by_mask(failures(docs, conditions), labels), "masks"), "".join(conditions))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLE_SQL = {
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS MATERIALIZED (SELECT doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS MATERIALIZED (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (WHERE good = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM s a, s b, s c, s d, s e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
q AS (SELECT o, k, 1 << (ascii(o[k]) - 65) AS bit, coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(o[i]) - 65))), 0)::INT AS before FROM p, range(1, 6) r(k)),
r AS (SELECT part, o, k, bit, sum(n) FILTER (WHERE mask & (before | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0) AS removed,
  sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS only_,
  sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0) AS good, sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0) AS toxic FROM m, q GROUP BY ALL)
SELECT part, o AS filter_order, k::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(only_, 0)::BIGINT AS unique_fails,
  coalesce(good, 0)::BIGINT AS good_lost, coalesce(toxic, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r"""
}
