"""Exact removal of byte strings of `length` or more that occur twice anywhere, over all documents.

A multi-document construction inserts one symbol of every document in each round, from the right to the left, and so
updates the order of their suffixes (the collection's Burrows-Wheeler transform) and the common prefixes of neighbours.
Over whole documents that takes as many rounds as the longest has bytes. Here the columns are bounded: every window of
`length` bytes has a content-defined anchor, its k-byte gram of the smallest hash (leftmost of equal ones), so equal windows
have equal anchors at equal places. The windows of one anchor form a block of at most 2 * length - k bytes, and only blocks
that share an anchor meet. These are the construction's documents, set side by side at their anchors: in each round the
blocks of an anchor are ordered by their next symbol, stably, and the end of the match with the neighbour before is the
least end in between. A window begins a repeat exactly if its match with a neighbour reaches `length` bytes: columns().

Steps, each written out for the next: anchors of all texts are counted; texts are collapsed to distinct ones; their blocks
with an anchor that occurs twice are listed by content hash; anchors of one content need no comparison, and of those of
several only one block for each content is read; Spark's sort brings the blocks of an anchor together in sequential runs,
through which the construction passes; marked windows become byte ranges of the texts. Anchors with more than `hot` contents
are compared by counting window hashes over all tasks instead, so that no anchor's blocks must fit into one.

Windows are compared by their bytes, those of hot anchors by 64-bit hashes within an anchor and column; whole texts and
blocks are equal by 128-bit hashes.

Edge cases: null texts count as empty; texts shorter than `length` lose nothing; equal texts (repeated rows too) of
`length` bytes or more lose every byte; null and repeated doc_ids keep one result a row; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, MULT, chunks, cut, discard, mix, powers, prefix_hash, raw_bytes, release, skew_join, table

LENGTH, GRAM = 200, 72
HOT = 20_000
SLICE = 5_000  # blocks of a construction, and the rest of its last anchor
PIECE = 1_000_000  # longer texts are read in pieces that overlap by a window
_LOW = np.uint64((1 << 24) - 1)


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of all windows of each text in data, the runs with the same anchor: text, first window, windows, anchor's place (all in data) and its hash."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64)
    sums = prefix_hash(BYTE_CODE[data])
    h = mix((sums[gram:] - sums[:-gram]) * powers(n + 1)[1][: n - gram + 1])
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    valid = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(valid, offsets[long], 1)
    np.add.at(valid, offsets[long + 1] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    place = (low[s] & _LOW).astype(np.int64)
    text = np.searchsorted(offsets, s, side="right") - 1
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))[: len(s)]
    count = np.diff(np.append(new, len(s)))
    return text[new], s[new], count, place[new], h[place[new]]


def _pieces(column, length: int):
    """(rows, where each row's bytes begin in its text, data, offsets) of a few MB each."""
    data, offsets = raw_bytes(column)
    for a, b in chunks(np.diff(offsets)):
        if b - a > 1 or offsets[b] - offsets[a] <= PIECE:
            yield np.arange(a, b), np.zeros(b - a, np.int64), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            continue
        text = data[offsets[a] : offsets[b]]
        for at in range(0, len(text) - length + 1, PIECE):
            part = text[at : at + PIECE + length - 1]
            yield np.array([a]), np.array([at]), part, np.array([0, len(part)])


def anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """t1 and the hash g of each anchor of texts (t1, text), with the window it begins to serve."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            t1 = b.column(0).to_numpy()
            for rows, base, data, offsets in _pieces(b.column(1), length):
                text, s, _, _, g = runs(data, offsets, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(t1[rows[text]]), pa.array(g.view(np.int64)), pa.array(s - offsets[text] + base[text])], names=["t1", "g", "s"])

    return texts.select("t1", "text").mapInArrow(run, "t1 long, g long, s long")


def blocks(texts: DataFrame, length: int, gram: int, with_bytes: bool) -> DataFrame:
    """The blocks of texts (t1, t2, n, text, flags) that begin at the flagged places: s, anchor g, its offset, windows, content hash c1, c2.

    dup: the text occurs twice. A flag is a place times 4, plus 2 for a hot anchor, plus 1 for a content that occurs twice;
    with_bytes: give these two bits, and the bytes.
    """
    import pyarrow as pa
    import xxhash

    names = ["t1", "t2", "s", "g", "off", "windows", "c1", "c2", "dup"]
    schema = "t1 long, t2 long, s long, g long, off int, windows int, c1 long, c2 long, dup boolean"
    if with_bytes:
        names, schema = [*names, "hot", "sure", "block"], schema + ", hot boolean, sure boolean, block binary"

    def run(batches):
        for b in batches:
            t1, t2, n = (b.column(i).to_numpy() for i in range(3))
            lists = b.column(4)
            for rows, base, data, offsets in _pieces(b.column(3), length):
                text, s, count, place, g = runs(data, offsets, length, gram)
                own = s - offsets[text] + base[text]
                keep, bits = [], []
                for i, r in enumerate(rows.tolist()):
                    a, e = np.searchsorted(text, (i, i + 1))
                    flags = np.sort(lists[r].values.to_numpy())
                    at = np.searchsorted(flags >> 2, own[a:e])
                    at[at == len(flags)] = 0
                    good = np.flatnonzero(flags[at] >> 2 == own[a:e])
                    keep.append(good + a)
                    bits.append(flags[at[good]])
                keep, bits = np.concatenate(keep).astype(np.int64), np.concatenate(bits)
                raw, off = data.tobytes(), (place - s)[keep]
                parts = [raw[x : x + c + length - 1] for x, c in zip(s[keep].tolist(), count[keep].tolist(), strict=True)]
                digest = b"".join([xxhash.xxh3_128_digest(x, o) for x, o in zip(parts, off.tolist(), strict=True)])
                c = np.frombuffer(digest, ">i8").astype(np.int64).reshape(-1, 2)
                r = rows[text[keep]]
                out = [t1[r], t2[r], own[keep], g[keep].view(np.int64), off.astype(np.int32), count[keep].astype(np.int32), np.ascontiguousarray(c[:, 0]), np.ascontiguousarray(c[:, 1]), n[r] > 1]
                if with_bytes:
                    out += [bits & 2 > 0, bits & 1 > 0, pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    return texts.select("t1", "t2", "n", "text", "flags").mapInArrow(run, schema)


def laid(column, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks set side by side at their anchors: bytes by block and column, first column and end of each block."""
    data, offsets = raw_bytes(column)
    size = np.diff(offsets)
    first = (length - gram) - off.astype(np.int64)
    out = np.zeros((len(size), int((first + size).max(initial=length))), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(data)) - offsets[row] + first[row]] = data
    return out, first, first + size


def least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low : high + 1] of each range, by minima of power-of-two lengths."""
    if not len(low):
        return values[:0]
    power = (np.frexp(high - low + 1)[1] - 1).astype(np.int64)
    out, level = np.empty(len(low), values.dtype), values
    for k in range(int(power.max()) + 1):
        at = np.flatnonzero(power == k)
        out[at] = np.minimum(level[low[at]], level[high[at] - (1 << k) + 1])
        level = np.minimum(level[: -(1 << k)], level[1 << k :]) if len(level) > 1 << k else level
    return out


def columns(g: np.ndarray, off: np.ndarray, column, length: int, gram: int) -> np.ndarray:
    """Which windows (block, first column) of the blocks occur in another block of their anchor; g is grouped.

    One round a column, from the right: `order` holds the blocks of each anchor in the order of what follows the column, and
    `ends` where each of them first differs from the one before it (-1: the first of its anchor).
    """
    symbols, first, last = laid(column, off, length, gram)
    n, width = symbols.shape
    hit = np.zeros((n, width - length + 1), bool)
    anchor = np.cumsum(np.concatenate(([0], g[1:] != g[:-1]))) if n else np.zeros(0, np.int64)
    order = np.arange(n)
    ends = np.full(n, width, np.int64)
    if n:
        ends[np.concatenate(([True], anchor[1:] != anchor[:-1]))] = -1
    for j in range(width - 1, -1, -1):
        there = (first[order] <= j) & (j < last[order])
        symbol = np.where(there, symbols[order, j].astype(np.int64), -1)  # -1: nothing follows yet
        key = anchor[order] * 257 + symbol + 1
        place = np.argsort(key, kind="stable")
        place = place[(first[order] <= j)[place]]  # a block that began to the right is done
        if not len(place):
            break
        a, b = place[:-1], place[1:]
        same = (key[a] == key[b]) & (symbol[b] >= 0)
        new = np.where(anchor[order[a]] == anchor[order[b]], j, -1)
        new[same] = least(ends, a[same] + 1, b[same])
        order, ends = order[place], np.concatenate(([-1], new))
        if j < hit.shape[1]:
            long = ends >= j + length
            hit[order[long], j] = True
            hit[order[:-1][long[1:]], j] = True
    return hit


def window_hashes(g: np.ndarray, off: np.ndarray, column, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of all blocks: block, place in it, and a hash of the window, its anchor and its column."""
    data, offsets = raw_bytes(column)
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    block = np.repeat(np.arange(len(count)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    sums = prefix_hash(BYTE_CODE[data])
    at = offsets[block] + place
    h = (sums[at + length] - sums[at]) * powers(len(data) + 1)[1][at]
    return block, place, mix(mix(h) + g.view(np.uint64)[block] * MULT[0] + (place - off[block]).astype(np.int64).view(np.uint64) * MULT[1])


def _ranges(block: np.ndarray, place: np.ndarray, n: int) -> list[list[int]]:
    """Of each block, the runs of marked windows: first and last in turn."""
    out: list[list[int]] = [[] for _ in range(n)]
    if len(block):
        new = np.concatenate(([True], (block[1:] != block[:-1]) | (place[1:] != place[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(block)) - 1
        for b, x, y in zip(block[first].tolist(), place[first].tolist(), place[last].tolist(), strict=True):
            out[b] += (x, y)
    return out


def compare(rows: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """c1, c2, ranges of the blocks (g, off, c1, c2, block, sure) that have windows in common with others of their anchor; rows come sorted by g."""
    import pyarrow as pa

    def some(t):
        g, off, sure = (t.column(c).to_numpy() for c in ("g", "off", "sure"))
        hit = columns(g, off, t.column("block"), length, gram)
        size = np.diff(raw_bytes(t.column("block"))[1])
        begin = (length - gram) - off.astype(np.int64)
        for i in np.flatnonzero(sure).tolist():
            hit[i, begin[i] : begin[i] + size[i] - length + 1] = True
        block, column = np.nonzero(hit)
        ranges = _ranges(block, column - begin[block], len(g))
        keep = np.array([i for i, r in enumerate(ranges) if r], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[keep]) for c in ("c1", "c2")] + [pa.array([ranges[i] for i in keep], pa.list_(pa.int32()))], names=["c1", "c2", "ranges"])

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                held.append(b)
                size += b.num_rows
                g = b.column(0).to_numpy()
                if g[0] == g[-1] or size < SLICE:
                    continue
                split = int(np.searchsorted(g, g[-1]))  # the last anchor may go on in the next slice
                yield some(pa.Table.from_batches([*held[:-1], b.slice(0, split)]))
                held, size = [b.slice(split)], b.num_rows - split
        if size:
            yield some(pa.Table.from_batches(held))

    return rows.select("g", "off", "c1", "c2", "block", "sure").mapInArrow(run, "c1 long, c2 long, ranges array<int>")


def compare_hot(rows: DataFrame, length: int) -> DataFrame:
    """As compare(), by counting the windows' hashes over all tasks."""
    import pyarrow as pa

    def explode(batches):
        for b in batches:
            for a in range(0, b.num_rows, 5000):
                t = b.slice(a, 5000)
                g, off, c1, c2 = (t.column(i).to_numpy() for i in range(4))
                sure = t.column(5).to_numpy(zero_copy_only=False)
                block, place, h = window_hashes(g, off, t.column(4), length)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c1[block]), pa.array(c2[block]), pa.array(place.astype(np.int32)), pa.array(sure[block])], names=["h", "c1", "c2", "place", "sure"])

    sure = rows.where("sure").select("c1", "c2", F.array(F.lit(0), F.length("block") - length).alias("ranges"))
    windows = rows.select("g", "off", "c1", "c2", "block", "sure").mapInArrow(explode, "h long, c1 long, c2 long, place int, sure boolean")
    twice = windows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    # a sure block counts for the others, but has its row already
    marked = windows.where("not sure").join(twice, "h").groupBy("c1", "c2").agg(F.array_sort(F.collect_set("place")).alias("places"))  # at most length - gram + 1
    pairs = marked.select("c1", "c2", F.flatten(F.transform("places", lambda p: F.array(p, p))).alias("ranges"))
    return sure.union(pairs)


def _union(ranges: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _found(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Of each distinct text that loses bytes: t1, t2, n (its rows), text and spans (ranges as found, unmerged; null where only equal texts say so)."""
    texts = docs.select("text", F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2")).where(F.octet_length("text") >= length)
    found = cut(anchors(texts, length, gram), "anchors")
    twice = cut(found.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    # equal texts give equal rows: once is enough; a list is bounded by its text's length
    flags = skew_join(found, twice, ["g"]).groupBy("t1").agg(F.collect_set(F.col("s") * 4).alias("flags"))
    flags = cut(flags, "flags", free=True)
    discard(found)
    discard(twice)
    distinct = texts.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    listed = cut(blocks(distinct.join(flags, "t1"), length, gram, False), "listed", free=True)
    discard(flags)
    content = listed.groupBy("g", "c1", "c2").agg(((F.count("*") > 1) | F.max("dup")).alias("sure"), F.min(F.struct("t1", "s")).alias("at"), F.first("windows").alias("windows"))
    content = cut(content, "content", free=True)
    by_anchor = content.groupBy("g").agg(F.count("*").alias("contents"), F.first(F.struct("c1", "c2", "windows", "sure")).alias("one"))
    by_anchor = cut(by_anchor.where("contents > 1 or one.sure"), "by_anchor")
    one = by_anchor.where("contents = 1").select("one.c1", "one.c2", F.array(F.lit(0), F.col("one.windows") - 1).alias("ranges"))
    many = by_anchor.where("contents > 1").select("g", "contents")
    bits = F.col("at.s") * 4 + F.when(F.col("contents") > hot, 2).otherwise(0) + F.col("sure").cast("int")
    flags = skew_join(content, many, ["g"], n="contents").groupBy(F.col("at.t1").alias("t1")).agg(F.collect_set(bits).alias("flags"))
    flags = cut(flags, "contested", free=True)
    rows = cut(blocks(distinct.join(flags, "t1"), length, gram, True), "blocks", free=True)
    calm = rows.where("not hot").repartition("g").sortWithinPartitions("g")
    shared = compare(calm, length, gram).union(compare_hot(rows.where("hot"), length)).union(one)
    shared = cut(shared.dropDuplicates(["c1", "c2"]), "shared", free=True)
    for done in (content, by_anchor, flags, rows):
        discard(done)
    # a window range of a block is a byte range of the text
    at = listed.select("t1", "t2", "s", "c1", "c2").join(shared, ["c1", "c2"])
    odd = F.transform("ranges", lambda x, i: x + F.col("s") + F.when(i % 2 == 1, F.lit(length)).otherwise(F.lit(0)))
    by_text = at.select("t1", "t2", odd.alias("ranges")).groupBy("t1", "t2").agg(F.flatten(F.collect_list("ranges")).alias("spans"))  # bounded by a text's length
    by_text = cut(by_text, "by_text", free=True)
    discard(listed)
    discard(shared)
    out = distinct.join(by_text, ["t1", "t2"], "left").where((F.col("n") > 1) | F.col("spans").isNotNull())

    return out.select("t1", "t2", "n", "text", "spans")


def _whole(n: int, size: int, ranges: list[int] | None) -> list[int]:
    """The byte ranges that a text of size bytes loses: starts and ends in turn."""
    return [0, size] if n > 1 else [x for r in _union(ranges) for x in r]


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Of each distinct text that loses bytes: t1, t2, n (its rows), text and spans (starts and ends of byte ranges, in turn)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            sizes = np.diff(raw_bytes(b.column(3))[1]).tolist()
            merged = [_whole(*x) for x in zip(b.column(2).to_pylist(), sizes, b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(merged, pa.list_(pa.int64()))], names=["t1", "t2", "n", "text", "spans"])

    return _found(docs, length).mapInArrow(run, "t1 long, t2 long, n long, text string, spans array<long>")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    import hashlib

    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows: list[list] = [[], [], []]
            for n, text, ranges in zip(b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                own = _whole(n, len(raw), ranges.as_py())
                sha, last = hashlib.sha256(), 0
                for x, y in zip(own[::2], own[1::2], strict=True):
                    sha.update(raw[last:x])
                    last = y
                sha.update(raw[last:])
                for out, v in zip(rows, (sum(own[1::2]) - sum(own[::2]), len(own) // 2, sha.hexdigest()), strict=True):
                    out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=["t1", "t2", "removed", "pieces", "sha"])

    found = cut(_found(docs, length).mapInArrow(run, "t1 long, t2 long, removed long, pieces long, sha string"), "digests", free=True)
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    out = own.join(found, ["t1", "t2"], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("pieces", F.lit(0)).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
    release(spark)
    return out


QUERIES = {"op9_repeats": op9_repeats}
# every window of 200 bytes, counted
ORACLE_SQL = {
    "op9_repeats": """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, hash(b[i:i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
t AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 200 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN t USING (h) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM m),
s AS MATERIALIZED (SELECT doc_id, g, min(i) AS a, max(i) + 199 AS z FROM g GROUP BY doc_id, g),
k AS (SELECT s.doc_id, g, lower(hex(b[coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY g), 0) + 1:a - 1])) AS before, z FROM s JOIN d USING (doc_id)),
a AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS z FROM s GROUP BY doc_id),
j AS (SELECT doc_id, string_agg(before, '' ORDER BY g) AS before FROM k GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(before || hex(b[z + 1:])) END) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN j USING (doc_id)"""
}
