"""Approximate nearest neighbours with a permutation index.

A bounded sample of vectors serves as pivots. Every vector is represented by its `m` nearest pivots in order, and posted
with its place in that order in the inverted file of each of them. A query walks the files of its own nearest pivots and
adds up the footrule distance of the two orders (a pivot that is missing from one counts as place m); the best `share` of a
cell by footrule is ranked again by the exact distance.

Rows are dealt to cells by a hash, queries to blocks, and each cell meets each block in one task of bounded size. Of equal
vectors only the k + 1 smallest ids can be among k nearest, so the others are left out before (a rank limit that Spark also
applies before its shuffle), and no group of copies fills a cell or crowds out candidates.

Edge cases: vectors that are null, zero, hold null or non-finite components, or have another length than most of the
pivot sample take no part; ties go to the smaller vec_id; rows of a null vec_id take no part; rows of one vec_id are never
each other's neighbours, and a repeated query row counts once; with fewer than k candidates all are given; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

PIVOTS, PREFIX = 256, 64
SHARE, LEAST = 0.15, 256
CELL_ROWS, BLOCK_ROWS = 4096, 2048


def usable(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and v: the rows that take part."""
    v = F.col(column)
    inf = float("inf")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (x != F.lit(inf)) & (x != F.lit(-inf)))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0)).select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v"))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    d = (pivots**2).sum(1) - 2 * (x @ pivots.T)
    return np.argsort(d, 1, kind="stable")[:, :m]


class InvertedFiles:
    """The inverted files of one cell: for each pivot the rows that have it among their nearest, with its place."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, m: int):
        self.m, self.n, self.pivots = min(m, len(pivots)), len(x), pivots
        order = nearest_pivots(x, pivots, self.m)
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.rows, self.places = by // self.m, (by % self.m).astype(np.int32)
        self.starts = np.searchsorted(flat[by], np.arange(len(pivots) + 1))

    def candidates(self, q: np.ndarray, count: int) -> np.ndarray:
        """For each query the count rows of smallest footrule distance, ties in the order of rows."""
        m, out = self.m, np.zeros((len(q), min(count, self.n)), np.int64)
        for i, own in enumerate(nearest_pivots(q, self.pivots, m)):
            foot = np.zeros(self.n, np.int32)
            for place, p in enumerate(own.tolist()):
                a, b = self.starts[p], self.starts[p + 1]
                there = self.places[a:b]
                # a shared pivot saves the two penalties for a missing one
                foot[self.rows[a:b]] += np.abs(there - place) - (m - place) - (m - there)
            out[i] = np.argsort(foot, kind="stable")[: out.shape[1]]
        return out


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", column: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found of each row for which is_query(id) holds."""
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = cut(usable(vectors, id_col, column), "vectors")
    sample = [r["v"] for r in rows.orderBy(F.md5(F.col("id").cast("string")), "id").limit(pivots).select("v").collect()]  # at most `pivots` vectors
    schema = "query_id long, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [len(v) for v in sample]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n))
    base = spark.sparkContext.broadcast(np.array([v for v in sample if len(v) == size]))
    rows = rows.where(F.size("v") == size)
    place = Window.partitionBy("v").orderBy("id")
    index = rows.withColumn("copy", F.row_number().over(place)).where(F.col("copy") <= k + 1).drop("copy")
    index = cut(index, "index")
    asked = rows.where(is_query(F.col("id"))).dropDuplicates()
    n_cells, n_blocks = (max(1, -(-d.count() // n)) for d, n in ((index, CELL_ROWS), (asked, BLOCK_ROWS)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(n_cells)).cast("int")).withColumn("block", spread(n_blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("cell", spread(n_cells))

    def run(cell, block):
        ids, x = cell.column("id").to_numpy(), _matrix(cell.column("v"))
        qid, q = block.column("id").to_numpy(), _matrix(block.column("v"))
        found = []
        if len(ids) and len(qid):
            by = np.argsort(ids, kind="stable")
            ids, x = ids[by], x[by]
            files = InvertedFiles(x, base.value, prefix)
            count = max(least, int(np.ceil(share * len(ids))), k + 1)
            for a in range(0, len(q), 256):
                for i, c in enumerate(files.candidates(q[a : a + 256], count)):
                    c = c[ids[c] != qid[a + i]]
                    d = np.sqrt(((x[c] - q[a + i]) ** 2).sum(1))
                    best = np.lexsort((ids[c], d))[:k]
                    found.append((np.full(len(best), qid[a + i]), ids[c][best], d[best]))
        parts = [np.concatenate([f[j] for f in found]) if found else np.zeros(0) for j in range(3)]
        return pa.table({"query_id": parts[0].astype(np.int64), "vec_id": parts[1].astype(np.int64), "score": parts[2].astype(float)})

    hits = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(run, schema)
    hits = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


QUERIES = {"op4_permutation": op4_permutation}
ORACLE_SQL: dict[str, str] = {}
