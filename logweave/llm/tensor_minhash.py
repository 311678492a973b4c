"""MinHash near-dedup with tensored banding.

`half` + `half` collections of `k` minhashes each give half * half tables, whose keys pair one collection of either side:
2 * half * k minhashes serve half^2 tables of 2k rows. Texts of equal shingle sets are one class from the start. In each
table a class is paired with the smallest class of its bucket, candidates are confirmed on the full shingle sets, and the
links give components. What is in one component with the rest of its bucket is done; the other buckets go through `rounds`
more hubs each, and what is still mixed then, which is mostly texts that are not similar, through an exact join: a prefix
filter on the rarest shingles and a bitmap bound leave out only pairs that cannot be similar, and all others are confirmed.
So every pair that shares a table is confirmed, lies in one component, or is proven to be no link. No pairs are made within
a group that is one component, however large it is.

Chance that a link of similarity 0.8 shares no table: with half = 10 and k = 3, 1 - (1 - (1 - 0.8^3)^10)^2 = 0.0015; at 0.9
it is 4e-6.

Edge cases: null and empty texts, and texts without words, have no shingles and are linked with nothing; a text of fewer
words than a shingle is one shingle; rows of a null doc_id are their own component (null); rows of one doc_id are rows each,
with their own text's set and component (pairs name the id, and are confirmed on any of its texts); extra columns are not
read by links().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, MULT, checked, chunks, cut, discard, mix, n_parts, powers, prefix_hash, raw_bytes, skew_join, table

HALF, K = 10, 3
MAX_BROADCAST = 200_000
ROUNDS = 2  # of hubs, before the exact join
SPLIT = 1_000  # pairs that a text is sent for at once
BLOCK = 4_000  # rows of a shingle that one side of a task holds
SKETCH, BITS = 1 << 16, 1024

_is_space = np.zeros(256, bool)
_is_space[[9, 10, 11, 12, 13, 32]] = True
_code = BYTE_CODE.copy()
_code[65:91] = _code[97:123]  # A-Z count as a-z


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = 2) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text in data."""
    n = len(offsets) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n
    word = ~_is_space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word & (first[:-1] | np.append(True, ~word[:-1])))
    ends = np.flatnonzero(word & (first[1:] | np.append(~word[1:], True))) + 1
    sums = prefix_hash(_code[data])
    h = mix((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] ^ (ends - starts).astype(np.uint64) * MULT[0])
    bounds = np.searchsorted(starts, offsets)
    total = np.zeros(len(h), np.uint64)
    for j in range(size):
        total[: len(h) - j] += h[j:] * MULT[j + 1]
    total = mix(total)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(total[a : b - size + 1]))
        elif b > a:  # the whole sequence; the number of words keeps it apart from a shingle
            out.append(mix(np.array([sum(int(h[a + j]) * int(MULT[j + 1]) for j in range(b - a)) + (b - a) * int(MULT[9]) & 2**64 - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _shingled(batch_column, size: int):
    """Shingle sets of an Arrow column, a few MB of text at a time."""
    data, offsets = raw_bytes(batch_column)
    for a, b in chunks(np.diff(offsets)):
        yield from shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)


def signatures(docs: DataFrame, size: int = 2, half: int = HALF, k: int = K) -> DataFrame:
    """doc_id, n_shingles, s1 and s2 (hash of the set), u and v (the collections' hashes of either side)."""
    import pyarrow as pa
    import xxhash

    mult = MULT[16 : 16 + 2 * half * k, None]

    def run(batches):
        for batch in batches:
            n, sets, us = [], [], []
            for s in _shingled(batch.column(1), size):
                n.append(len(s))
                if len(s):
                    digest = xxhash.xxh3_128_intdigest(s.tobytes())
                    low = np.concatenate([(s * mult[j : j + k]).min(1) for j in range(0, 2 * half * k, k)]).reshape(-1, k)
                    us.append(mix((low * MULT[1 : k + 1]).sum(1, dtype=np.uint64)).view(np.int64))
                else:
                    digest = 0
                    us.append(np.zeros(2 * half, np.int64))
                sets.append((digest >> 64, digest & 2**64 - 1))
            hashes = np.array(sets, np.uint64).reshape(-1, 2).view(np.int64)
            u = np.concatenate(us) if us else np.zeros(0, np.int64)
            u = u.reshape(-1, 2 * half)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, half * len(n) + 1, half), pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1))) for x in (u[:, :half], u[:, half:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), *lists], names=["doc_id", "n_shingles", "s1", "s2", "u", "v"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, u array<long>, v array<long>")


def band_keys(classes: DataFrame) -> DataFrame:
    """id and key for every table: the collections of both sides in all pairs."""
    left = classes.select("id", F.posexplode("u").alias("i", "a"), "v")
    return left.select("id", "i", "a", F.posexplode("v").alias("j", "b")).select("id", F.xxhash64("i", "j", "a", "b").alias("key"))


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar: 100 * intersection >= percent * union.

    The pairs of one a come together behind its text, which is sent once for each `SPLIT` of them.
    """
    import pyarrow as pa

    text = docs.select(F.col("doc_id").alias("b"), "text")
    many = cut(pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT), "many")
    dealt = pairs.join(checked(many, MAX_BROADCAST), "a", "left")
    dealt = dealt.select("a", F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("n", F.lit(1)) / SPLIT)).alias("salt"), "b")
    heads = dealt.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("b"), F.lit(0).alias("turn"))
    rows = heads.union(dealt.select("a", "salt", "b", F.lit(1))).join(text, "b").select("a", "salt", "turn", "b", "text")
    rows = rows.repartition(n_parts(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "turn")

    def run(batches):
        left = None
        for batch in batches:
            keep = []
            turns = batch.column(2).to_pylist()
            for turn, right in zip(turns, _shingled(batch.column(4), size), strict=True):
                if not turn:
                    left = right
                    keep.append(False)
                    continue
                n, m = len(left), len(right)
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                x = np.concatenate((left, right))
                x.sort()
                same = int((x[1:] == x[:-1]).sum())
                keep.append(100 * same >= percent * (n + m - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id and component (the smallest id reachable) of every node of edges (a, b).

    Each round takes the smallest label among neighbours, then the label of the label, so that chains halve; sums with
    partial aggregation keep a node of many links from meeting in one task.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = cut(both, "edges")
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "start")
    for i in range(rounds):
        near = both.join(label, both["b"] == label["id"]).select(F.col("a").alias("id"), "component")
        low = label.union(near).groupBy("id").agg(F.min("component").alias("component"))
        old = label.select(F.col("id").alias("c"), F.col("component").alias("up"))  # of the round before: one step back costs less than another plan
        new = cut(low.join(old, low["component"] == old["c"]).select("id", F.least("component", "up").alias("component")), f"labels{i}")
        now = new.join(label.withColumnRenamed("component", "before"), "id").where("component != before").limit(1).count()
        label = new
        if not now:
            return label
    raise RuntimeError("the components did not settle")


def neighbours(label: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) of each bucket's hub a, another one for each seed, with the bucket's classes of other components; label: key, id, component."""
    hub = F.min_by(F.struct("id", "component"), F.xxhash64("id", F.lit(seed)))
    hubs = label.groupBy("key").agg(hub.alias("hub"), F.count("*").alias("n")).select("key", F.col("hub.id").alias("h"), F.col("hub.component").alias("hc"), "n")
    both = skew_join(label, cut(hubs, f"hubs{seed}"), ["key"]).where("component != hc")
    return oriented(both.select(F.col("h").alias("a"), F.col("id").alias("b")))


def oriented(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b) once, in one of the ways it is there: a, whose text confirm() sends to its pairs, stays a hub."""
    pair = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), (F.col("a") <= F.col("b")).alias("forth"))
    pair = pair.groupBy("x", "y").agg(F.max("forth").alias("forth"))
    return pair.select(F.when(F.col("forth"), F.col("x")).otherwise(F.col("y")).alias("a"), F.when(F.col("forth"), F.col("y")).otherwise(F.col("x")).alias("b"))


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text of the documents with one of ids (id, no repeats)."""
    return docs.select("doc_id", "text").join(checked(ids.select(F.col("id").alias("doc_id")), MAX_BROADCAST), "doc_id", "left_semi")


def rarity(texts: DataFrame, size: int) -> np.ndarray:
    """Counts of shingles by the first 16 bits of their hash, from a quarter of texts (id, component, text); it only orders shingles, so that any counts are right."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for s in _shingled(batch.column(0), size):
                total += np.bincount((s >> np.uint64(48)).astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(SKETCH, np.int64)
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(4)) == 0).select("text").mapInArrow(run, "at long, n long")
    for r in some.groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():  # at most SKETCH rows
        out[r["at"]] = r["n"]
    return out


def prefixes(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The rarest shingles of texts (id, component, text), one of which two similar sets share: shingle, id, component, n, pos and, at pos 0, a parity bitmap of the set."""
    import pyarrow as pa

    count = rarity(texts, size)

    def run(batches):
        for batch in batches:
            shingle, n, pos, row, bits = [], [], [], [], []
            for i, s in enumerate(_shingled(batch.column(2), size)):
                m = len(s)
                length = m + (-percent * m // 100) + 1
                if not m:
                    continue
                shingle.append(s[np.lexsort((s, count[(s >> np.uint64(48)).astype(np.int64)]))[:length]])
                pos.append(np.arange(length))
                row.append(np.full(length, i))
                n.append(np.full(length, m))
                odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                bits += [np.packbits(odd.astype(np.uint8)).tobytes(), *[None] * (length - 1)]
            if row:
                at = pa.array(np.concatenate(row))
                out = [pa.array(np.concatenate(shingle).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(n)), pa.array(np.concatenate(pos)), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["shingle", "id", "component", "n", "pos", "bits"])

    return texts.select("id", "component", "text").mapInArrow(run, "shingle long, id long, component long, n long, pos long, bits binary")


def exhaustive(label: DataFrame, docs: DataFrame, size: int, percent: int, block: int = BLOCK) -> DataFrame:
    """All pairs (a, b) of the ids of label (key, id, component) in different components that may be similar.

    Sets that share t shingles share one among the first n - t + 1 of either in a common order (prefix filter), and differ in
    as many shingles at least as their parity bitmaps in bits; no similar pair fails these tests.
    """
    import pyarrow as pa

    texts = label.select("id", "component").distinct().join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    rows = cut(prefixes(texts, size, percent), "prefixes")
    least = F.ceil(2 * percent * F.col("n") / (100 + percent))  # shared with a set of its size or more
    shared = rows.groupBy("shingle").agg(F.count("*").alias("held"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.max(F.col("pos") <= F.col("n") - least).alias("low"))
    shared = shared.where("c1 != c2 and low").select("shingle", "held", F.ceil(F.col("held") / block).alias("blocks"))
    shared = cut(shared.withColumnRenamed("held", "n_held"), "shared")
    some = skew_join(rows.drop("bits"), shared, ["shingle"], n="n_held").join(rows.where("pos = 0").select("id", "bits"), "id")
    some = some.withColumn("salt", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    key = ["shingle", "i", "j"]
    some = some.select("shingle", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "id", "component", "n", "pos", "bits")
    some = some.repartition(n_parts(label.sparkSession), *key).sortWithinPartitions(*key)

    def pairs(t):
        s, i, j, salt, ids, c, n, pos = (t.column(k).to_numpy() for k in range(8))
        bits = raw_bytes(t.column(8))[0].reshape(-1, BITS // 8).view(np.uint64)
        out = [np.zeros((2, 0), np.int64)]
        at, d = np.arange(len(s)), 0
        while len(at):
            d += 1
            at = at[at + d < len(s)]
            at = at[(s[at] == s[at + d]) & (i[at] == i[at + d]) & (j[at] == j[at + d])]
            x, y = at, at + d
            good = (c[x] != c[y]) & ((i[x] == j[x]) | (salt[x] != salt[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[good], y[good]
            least = -(-percent * (n[x] + n[y]) // (100 + percent))
            good = (pos[x] <= n[x] - least) & (pos[y] <= n[y] - least)
            x, y, least = x[good], y[good], least[good]
            good = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= n[x] + n[y] - 2 * least
            x, y = ids[x[good]], ids[y[good]]
            out.append(np.stack((np.minimum(x, y), np.maximum(x, y))))
        a, b = np.unique(np.concatenate(out, 1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            same = np.ones(len(t), bool)
            for k in range(3):
                v = t.column(k).to_numpy()
                same &= v == v[-1:]
            split = len(t) - int(same.sum())  # the last group may go on in the next batch
            if split:
                yield pairs(t.slice(0, split))
            held = t.slice(split)
        if held is not None and len(held):
            yield pairs(held)

    return some.mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, size: int = 2, percent: int = 80, half: int = HALF, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    sigs = cut(signatures(docs, size, half, k), "signatures")
    some = sigs.where("n_shingles > 0 and doc_id is not null")
    # texts of equal sets are one class, which its smallest doc_id stands for
    ids = cut(some.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "ids")
    classes = cut(some.join(ids, (some["doc_id"] == ids["id"]) & (some["s1"] == ids["s1"]) & (some["s2"] == ids["s2"])).select("id", "u", "v").dropDuplicates(["id"]), "classes")
    keys = band_keys(classes)
    buckets = cut(keys.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = cut(skew_join(keys, buckets, ["key"]).select("key", "id", "low", "n"), "members")
    pairs = cut(members.where("id != low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    texts = cut(texts_of(cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "paired"), docs), "texts")
    edges = cut(confirm(pairs, texts, size, percent), "confirmed", free=True)
    discard(buckets)
    found = components(edges)
    first, done = members, pairs
    members = members.where("n > 2")  # of two members, the hub's pair was all there is
    for seed in range(rounds + 1):
        label = members.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        mixed = label.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("n")).where("c1 != c2").select("key", "n")
        rest = cut(skew_join(label, cut(mixed, f"mixed{seed}"), ["key"]).select("key", "id", "component"), f"rest{seed}")
        discard(first if seed == 0 else members)  # what is in one component needs no more rounds
        members = rest
        if not rest.limit(1).count():
            break
        more = neighbours(rest, seed) if seed < rounds else exhaustive(rest, texts, size, percent)
        more = cut(more.join(done.union(done.select("b", "a")), ["a", "b"], "left_anti"), f"more{seed}")
        extra = cut(confirm(more, cut(texts_of(cut(rest.select("id").distinct(), f"ids{seed}"), texts), f"texts{seed}"), size, percent), f"confirmed{seed}", free=True)
        done = done.union(more)
        if extra.limit(1).count():
            edges = edges.union(extra)
            found = components(edges)
    by_class = cut(ids.join(found, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component_id"), "n"), "components")
    out = skew_join(sigs.select("doc_id", "n_shingles", "s1", "s2"), by_class, ["s1", "s2"], "left")
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_shingles", F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that have a smaller doc_id in their component (repeated rows once).

    Where one doc_id has several texts, all but one count as having ids beyond all others, so that none is lost for its id.
    """
    own = F.xxhash64("doc_id", "text")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("_first"), F.max(own).alias("_last"))
    several = cut(several.where("_first != _last").select("doc_id", "_first"), "several")
    key = F.when(F.col("_first").isNull() | (own == F.col("_first")), F.col("doc_id")).otherwise(own.bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62))
    keyed = docs.join(checked(several, MAX_BROADCAST), "doc_id", "left").withColumn("_key", key)
    found = links(keyed.select(F.col("_key").alias("doc_id"), "text"), size, percent).where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    kept = keyed.join(found, "_key", "left_semi").dropDuplicates(["_key"])
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))


QUERIES = {"op6_minhash": op6_minhash}
# the exact join of all sets, without any hashing
ORACLE_SQL = {
    "op6_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS MATERIALIZED (SELECT id, n, unnest(s) AS g FROM c),
p AS (SELECT a.id AS a, b.id AS b, a.n AS n, b.n AS m, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 80 * (n + m - k)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS id, a AS top FROM l UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.id),
top AS (SELECT id, min(top) AS top FROM r GROUP BY id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE coalesce(t.top, c.id) END AS component_id,
  s.doc_id = CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE coalesce(t.top, c.id) END AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN top t ON t.id = c.id"""
}
