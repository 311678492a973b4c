"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has probability s = sigmoid(b + sum of the weights of its distinct words and
word stems), the bag has 1 - prod(1 - s) (noisy-or), and the weights are learned from the labels of whole documents only.
The same sentence scores then say which sentences offend.

Labels are read from at most `max_train` documents of either class (a bounded, documented sample, in the order of a hash of
doc_id); all documents are scored whole. Executors take the sample apart: they count features by class, and give each
sentence as the numbers of its kept features; only these come to the driver.

Edge cases: null and empty texts have no sentences and the score 0.0; null labels are not used; with no usable labels, or
labels of one class only, every score is 0.0; of rows with one doc_id the smallest text is learned, and all are scored;
extra columns pass through unread (score() replaces those named as its own; drop_toxic() keeps all).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shield, small_batches, table

STOPS = ".!?\\n。！？｡।؟۔"
SENTENCE = re.compile(f"[^{STOPS}]+[{STOPS}]*")
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)
CACHE_WORDS = 100_000


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class Model:
    """Weights of words and stems, with the noisy-or of the sentences of a text."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.cache = weights, bias, {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "cache": {}}

    def word(self, w: str) -> float:
        if (x := self.cache.get(w)) is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            low = w.lower()
            x = self.cache[w] = sum(self.weights.get(f, 0.0) for f in features(low))
        return x

    def sentences(self, text: str):
        """(start, end, probability) of each sentence that has a word of the model."""
        word = self.word
        for m in SENTENCE.finditer(text):
            z = [x for w in set(WORD.findall(m[0])) if (x := word(w))]
            if z:
                yield m.start(), m.end(), 1 / (1 + np.exp(-min(40.0, max(-40.0, self.bias + sum(z)))))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        if not text or not self.weights:
            return 0.0, []
        found = list(self.sentences(text))
        rest = 1.0
        for _, _, p in found:
            rest *= 1 - p
        return float(1 - rest), found


def sentence_features(text: str) -> list[set[str]]:
    words = ({w.lower() for w in WORD.findall(m)} for m in SENTENCE.findall(text))
    return [{f for w in ws for f in features(w)} for ws in words]


def train(names: list[str], y: np.ndarray, rows: np.ndarray, cols: np.ndarray, bag_of: np.ndarray, epochs: int = 150, rate: float = 0.15, l2: float = 2e-4) -> Model:
    """Full-batch Adam on the noisy-or likelihood, classes of equal weight.

    y: the labels of the bags; rows, cols: sentence and feature, for every feature of a sentence; bag_of: each sentence's bag.
    """
    n, n1 = len(bag_of), y.sum()
    w, b = np.zeros(len(names)), -3.0
    weight = np.where(y == 1, 0.5 / n1, 0.5 / (len(y) - n1))
    m = np.zeros(len(w) + 1)
    v = np.zeros(len(w) + 1)
    for t in range(1, epochs + 1):
        s = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols], n), -30, 30)))
        miss = np.exp(np.bincount(bag_of, np.log1p(-np.minimum(s, 1 - 1e-9)), len(y)))
        p = np.clip(1 - miss, 1e-6, 1 - 1e-6)
        # d(-log likelihood)/dz of a sentence: s for label 0, -s * (1 - p) / p for label 1
        g = np.where(y[bag_of] == 1, -s * (1 - p[bag_of]) / p[bag_of], s) * weight[bag_of]
        grad = np.append(np.bincount(cols, g[rows], len(w)) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(b))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 2500, min_docs: int = 3, min_lift: float = 1.0) -> Model:
    """Learns from at most max_train documents of either class, in the order of a hash of doc_id; held-out ids are the caller's to drop.

    A feature is worth a weight if it is in min_docs toxic documents and more common there by exp(min_lift).
    """
    import pyarrow as pa

    order = F.md5(F.col("doc_id").cast("string"))
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).orderBy(order).limit(max_train)
        picked = some if picked is None else picked.unionByName(some)
    # at most 2 * max_train pairs of two numbers: small enough to broadcast
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    sample = cut(sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return Model({}, 0.0)

    def names_of(batches):
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = sorted(set().union(*sentence_features(text.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([toxic] * len(own), pa.int32())], names=["feature", "toxic"])

    counts = sample.select("text", F.col("toxic").cast("int")).mapInArrow(names_of, "feature string, toxic int")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    lift = F.log(((F.col("bad") + 0.5) / size[1]) / ((F.col("n") - F.col("bad") + 0.5) / size[0]))
    names = [r[0] for r in counts.where((F.col("bad") >= min_docs) & (lift > min_lift)).select("feature").orderBy("feature").toLocalIterator()]  # of toxic documents of the sample only
    if not names:
        return Model({}, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def numbers_of(batches):
        number = shared.value
        for b in batches:
            own = [[x for f in (sorted(number[f] for f in s if f in number) for s in sentence_features(t.as_py())) if f for x in (*f, -1)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "toxic", "numbers"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    bags = sample.select("doc_id", "text", F.col("toxic").cast("int")).mapInArrow(numbers_of, f"doc_id {kind}, toxic int, numbers array<int>")
    y, flat, bag = [], [], []
    for i, r in enumerate(bags.orderBy("doc_id").toLocalIterator()):  # features of a sentence, then -1
        y.append(r["toxic"])
        flat.append(np.array(r["numbers"], np.int32))
        bag.append(np.full(len(flat[-1]), i, np.int32))
    shared.unpersist()
    flat, bag = np.concatenate(flat), np.concatenate(bag)
    ends = flat < 0
    return train(names, np.array(y, float), (np.cumsum(ends) - ends)[~ends], flat[~ends], bag[ends])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs with score double, predicted int and offending array<struct<start, end, score>> (sentences of threshold / 2 or more)."""
    import pyarrow as pa

    columns = [c for c in docs.columns if c not in ("score", "predicted", "offending")]
    src = docs.select(*columns)
    at = columns.index("text")
    small_batches(src.sparkSession)
    shared = src.sparkSession.sparkContext.broadcast(model)  # bounded: features of the bounded training sample
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        m = shared.value
        for b in batches:
            scores, spans = [], []
            for text in b.column(at):
                s, found = m.score(text.as_py())
                scores.append(s)
                spans.append([{"start": x, "end": y, "score": float(p)} for x, y, p in found if p >= threshold / 2])
            scores = np.array(scores, float)
            new = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "score", "predicted", "offending"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields)
    return src.mapInArrow(run, f"{kinds}, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out()))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without those predicted toxic; the model is fitted on the labelled rows of docs."""
    renamed, restore = shield(docs, ("score", "predicted", "offending"))
    scored = score(renamed, fit(docs, labels), threshold).where("predicted = 0")
    return restore(scored.drop("score", "predicted", "offending")).select(*docs.columns)


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE_SQL: dict[str, str] = {}
