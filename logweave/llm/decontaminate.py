"""Benchmark decontamination with a generalised suffix automaton.

The test items are normalised to words and built into one suffix automaton over words. A document's words are streamed
through it, which gives at each word the longest run of words ending there that occurs in some item. Runs of `window`
words (or the whole of a shorter item) are hits; hit spans can be removed, and documents over a coverage limit dropped.

The automata are broadcast in shards of at most `max_words` item words. With more shards than one, the documents pass
through the shards one after another, so that a task holds one shard at a time however large the benchmark is.

Edge cases: null and empty texts have no words and no hits; null and empty items are ignored, as are items of a null id;
equal items all count as found; repeated rows are matched each; extra columns pass through unread, but for those named as
matches() names its own, which are replaced (remove() keeps them).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shield, small_batches, table

# ASCII digits and letters and every byte over 0x7F make words; A-Z are lowered, all else separates
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Automaton:
    """A generalised suffix automaton over words with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 10):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.found: list[dict[int, tuple[str, ...]] | None] = [None] * len(self.len)
        self._mark(items)
        # the nearest state on the suffix path, the state itself included, that has a window
        order = sorted(range(len(self.len)), key=self.len.__getitem__)
        self.up = [-1] * len(self.len)
        for v in order:
            self.up[v] = v if self.found[v] else (self.up[self.link[v]] if self.link[v] >= 0 else -1)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        if (q := nxt[last].get(w)) is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _mark(self, items: list[tuple[str, list[bytes]]]) -> None:
        """At the state of each window: its number of words and the items that have it."""
        own: dict[int, dict[int, set[str]]] = {}
        for item, ws in items:
            v = length = 0
            size = min(self.window, len(ws))
            for w in ws:
                v, length = self.next[v][w], length + 1
                if length > size:
                    length = size
                while self.len[self.link[v]] >= length:
                    v = self.link[v]
                if length == size:
                    own.setdefault(v, {}).setdefault(size, set()).add(item)
        for v, sizes in own.items():
            self.found[v] = {n: tuple(sorted(x)) for n, x in sizes.items()}

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs [start, end) of words, joined where they touch, and the items that have a window in ws."""
        nxt, link, size, up, found = self.next, self.link, self.len, self.up, self.found
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        v = length = 0
        for i, w in enumerate(ws, 1):
            q = nxt[v].get(w)
            if q is None:
                if v == 0:
                    continue
                while v and q is None:
                    v = link[v]
                    length = size[v]
                    q = nxt[v].get(w)
                if q is None:
                    length = 0
                    continue
            v = q
            length += 1
            u = up[v]
            if u < 0:
                continue
            best = 0
            while u >= 0:
                for n, have in found[u].items():
                    if n <= length:
                        items.update(have)
                        if n > best:
                            best = n
                u = up[link[u]] if link[u] >= 0 else -1
            if best:
                start = i - best
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return spans, items


def shards(benchmark: DataFrame, max_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with their words, max_words together; read one after another, so that one shard is held at a time."""
    some, n = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    for item, text in rows.toLocalIterator():
        if ws := words(text):
            if n >= max_words:
                yield some
                some, n = [], 0
            some.append((item, ws))
            n += len(ws)
    yield some


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 500_000) -> DataFrame:
    """docs with n_words long, spans array<int> (starts and ends of hit runs of words, in turn) and items array<string>."""
    import pyarrow as pa

    spark = docs.sparkSession
    small_batches(spark)
    columns = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    out, at = docs.select(*columns), columns.index("text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    for k, items in enumerate(shards(benchmark, max_words)):
        if k:
            out = cut(out, f"shard{k}")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(Automaton(items, window))

        def run(batches, shared=shared, again=k > 0):
            machine = shared.value
            for b in batches:
                n_words, spans, items = [], [], []
                for i, text in enumerate(b.column(at)):
                    ws = words(text.as_py())
                    hit, have = machine.scan(ws)
                    if again:
                        old = b.column(len(columns) + 1)[i].as_py()
                        hit = _merged([*hit, *zip(old[::2], old[1::2], strict=True)])
                        have = have.union(b.column(len(columns) + 2)[i].as_py())
                    n_words.append(len(ws))
                    spans.append([x for s in hit for x in s])
                    items.append(sorted(have))
                new = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], *new], names=[*columns, "n_words", "spans", "items"])

        out = out.mapInArrow(run, f"{kinds}, n_words long, spans array<int>, items array<string>")
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> x - a, a -> a)")  # e - (s - a) = a + (e - s), run by run
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without hit spans; documents of which more than max_coverage of the words are hit go as a whole.

    A removed span takes its words and what stands between them; the rest of the text stays as it was.
    """
    import pyarrow as pa

    renamed, restore = shield(docs, ("n_words", "spans", "items"))
    columns, at = renamed.columns, renamed.columns.index("text")
    found = matches(renamed, benchmark, window)
    hit = F.expr("aggregate(spans, 0L, (a, x) -> x - a, a -> a)")
    found = found.where((F.col("n_words") == 0) | (hit <= max_coverage * F.col("n_words"))).drop("items", "n_words")

    def run(batches):
        for b in batches:
            texts = []
            for text, spans in zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist(), strict=True):
                if spans:
                    place = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
                    keep, last = [], 0
                    for s, e in zip(spans[::2], spans[1::2], strict=True):
                        keep.append(text[last : place[s][0]])
                        last = place[e - 1][1]
                    text = "".join([*keep, text[last:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(columns))], names=columns)

    out = restore(found.mapInArrow(run, renamed.schema)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


_W = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = {
    "op2_decontaminate": f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN win ON dw.s = win.s AND dw.size = win.size),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hits),
n AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""
}
QUERIES = {"op2_decontaminate": op2_decontaminate}
