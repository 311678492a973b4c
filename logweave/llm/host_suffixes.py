"""HTML extraction with a suffix array over the pages of a host.

The markup is read into blocks of text. Where a page has an article or main element, its blocks are the article, but for the
parts that are surely menus, forms, adverts, comments and the like; headings, and parts that are such only by a part of a class
name or id ("ad-astra") or by a word that also names parts of articles ("post-header", "social"), are left to the host's pages, as is the whole text of a
page without such an element, what the markup marks aside. A form or widget around an article is the page's, and an
article's end tag closes what was left open in it. For these the token streams of a host's pages are concatenated and their suffixes sorted: where neighbours in the
suffix array have a common prefix of `min_tokens` tokens, and such neighbours stand on `min_pages` distinct pages, the
tokens are a repeated run, which goes; all else stays. Blocks outside of articles take part in the streams, whatever their
marks, and runs may reach over blocks (a menu's items), but not over an article's own text.

Hosts are split into shards of about `shard_tokens` tokens by a hash of the stream, so that no host is one task. Equal
streams are laid once and count for the distinct pages that have them. Pages by window (a 64-bit hash) add up over the shards of a host; the windows that reach min_pages
there are then marked in each shard.

Edge cases: null and empty html gives the empty text; broken and unclosed markup is read as far as it goes; very long pages
are read whole, by one task each; equal pages count once when distinct pages are counted; null urls are one host of their
own; repeated rows are extracted each; extra columns are not read.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MULT, checked, cut, mix, skew_join, table

MIN_TOKENS, MIN_PAGES, SHARD_TOKENS = 6, 3, 400_000
MAX_BROADCAST = 100_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
ATTR = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = frozenset("script style noscript template textarea iframe svg select title".split())
SKIP = frozenset("nav aside footer form button dialog menu head header".split())
LANDMARK = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSED_BY_BLOCK = frozenset(("p", "li", "dt", "dd", "tr", "td", "th", "option"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu menubar modal nav navbar navigation newsletter notice popup promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)


FRAME = frozenset(
    "article area bar block blocks body bottom box button buttons container content desktop entry field fixed float frame global group holder inner item items layer left link links list main mobile outer overlay page panel post primary reader right row secondary section site slot small sticky story thread top unit user wide widgets wrap wrapper".split()
)
SURE, MAYBE = 2, 1
# words that name parts of articles as well: inside of one, the host's pages decide
OPEN = frozenset("header masthead navigation notice social".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WRAPPER = 3  # mark of a form or widget around: SURE unless an article element stands in it


def _mark(name: str, attrs: str, inside: bool) -> int:
    """What name and attributes say of an element: SURE that it is no article text, MAYBE for a class or id of a heading or an element in an article that can mean its text too, WRAPPER for forms and widgets outside."""
    if name in SKIP and not (inside and name == "header"):
        return WRAPPER if name == "form" and not inside else SURE
    found = 0
    for m in ATTR.finditer(attrs) if attrs and not attrs.isspace() else ():
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id") and name not in ("body", "html"):
            known = WORDS if name not in LANDMARK else frozenset(("comment", "comments"))
            for one in value.split():
                parts = [w for w in re.split(r"[^a-z]+", one) if w]
                hit = {w for w in parts if w in known}
                if not hit or inside and name == "header":
                    continue
                if not inside:
                    found = WRAPPER if hit == {"widget"} and found in (0, WRAPPER) else SURE
                elif name in HEADINGS or hit <= OPEN or not all(w in WORDS or w in FRAME for w in parts):
                    found = max(found, MAYBE)
                else:
                    found = SURE
        elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return SURE
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return SURE
        if found == SURE:
            return SURE
    return found


def blocks(html: str | None) -> tuple[list[tuple[str, bool, int]], bool]:
    """[(text, in an article element, its mark)] in page order; whether the page has an article element."""
    out: list[tuple[str, bool, int]] = []
    if not html:
        return out, False
    parts: list[str] = []
    inside, landmarks = 0, False
    open_: list[list] = []  # marked elements around: name, how many of that name are open, mark, article elements around it, article elements in it that do not count

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, inside > 0, min(SURE, max((x[2] for x in open_), default=0))))

    at, end = 0, len(html)
    while at < end:
        m = TAG.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW and not m[1]:
            if not m[3].endswith("/") or name in ("script", "style", "title", "textarea"):
                close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                at = close.end() if close else end
            continue
        if name in INLINE and not (m[3] and not m[1] and _mark(name, m[3], inside > 0)):
            if open_ and name == open_[-1][0]:
                flush()
                open_[-1][1] += -1 if m[1] else 1
                if not open_[-1][1]:
                    open_.pop()
            continue
        flush()
        if m[1]:  # an end tag
            if open_ and name == open_[-1][0]:
                open_[-1][1] -= 1
                if not open_[-1][1]:
                    open_.pop()
            elif name in LANDMARK and open_ and open_[-1][4]:
                open_[-1][4] -= 1
            elif name in LANDMARK and inside:
                while open_ and open_[-1][3] >= inside:  # what was left unclosed in it ends with it
                    open_.pop()
                inside -= 1
            continue
        if name in VOID or m[3].endswith("/") and name not in LANDMARK:
            continue
        if open_ and open_[-1][0] in CLOSED_BY_BLOCK and name not in INLINE:
            open_.pop()
        if open_ and name == open_[-1][0]:
            open_[-1][1] += 1
            continue
        if any(x[2] == SURE for x in open_):
            if name in LANDMARK:
                open_[-1][4] += 1
            continue
        mark = _mark(name, m[3], inside > 0)
        if name in LANDMARK and not mark:
            for x in open_:  # a form or widget around an article is the page's
                x[2] = 0 if x[2] == WRAPPER else x[2]
            inside += 1
            landmarks = True
        elif mark and not (mark == WRAPPER and any(x[2] == WRAPPER for x in open_) and name != "form"):
            open_.append([name, 1, mark, inside, 0])
    flush()
    return out, landmarks


def left_open(found: list[tuple[str, bool, int]], landmarks: bool) -> list[int]:
    """For each block 1 where it is text of the article, 2 where the host's pages decide, else 0."""
    if landmarks:
        return [(1 if not mark else 2 if mark == MAYBE else 0) if inside else 0 for _, inside, mark in found]
    return [0 if mark else 2 for _, _, mark in found]


def suffix_classes(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of tokens by their first `length` tokens or more, and the rank class of each suffix (prefix doubling)."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    step = 1
    while step < length:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:] if step < n else second[:0]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, step = new, step * 2
    return order, rank


def window_classes(tokens: np.ndarray, size: int) -> np.ndarray:
    """The class of each window of exactly size tokens: suffixes side by side in the suffix array whose common prefix is that long."""
    n = len(tokens) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    order = suffix_classes(tokens, size)[0]
    order = order[order < n]
    common = np.ones(n - 1, bool)
    for j in range(size):
        common &= tokens[order[1:] + j] == tokens[order[:-1] + j]
    out = np.zeros(n, np.int64)
    out[order[1:]] = np.cumsum(~common)
    return out


def page_counts(classes: np.ndarray, streams: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """Of each class, the distinct pages on which it begins; streams: -1 at separators, pages: how many have each stream."""
    if not len(classes):
        return np.zeros(0, np.int64)
    pair = np.unique(np.stack((classes, streams[: len(classes)]), 1), axis=0)
    pair = pair[pair[:, 1] >= 0]
    return np.bincount(pair[:, 0], pages[pair[:, 1]], int(classes.max()) + 1).astype(np.int64)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of n tokens lie in the windows of size tokens that begin at starts."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return np.cumsum(edges)[:-1] > 0


def repeated(tokens: np.ndarray, streams: np.ndarray, min_tokens: int, min_pages: int, pages: np.ndarray | None = None) -> np.ndarray:
    """Which tokens lie in a run of min_tokens that stands on min_pages distinct pages; streams: -1 at separators, pages: of each stream (1)."""
    classes = window_classes(tokens, min_tokens)
    pages = np.ones(int(streams.max(initial=0)) + 1, np.int64) if pages is None else pages
    often = page_counts(classes, streams, pages)[classes] >= min_pages
    return covered(np.flatnonzero(often & (streams[: len(classes)] >= 0)), len(tokens), min_tokens)


def _key():
    return [F.xxhash64(F.lit(k), F.col("page_id"), F.col("url"), F.col("html")).alias(f"k{k}") for k in (1, 2)]


def outside(pages: DataFrame) -> DataFrame:
    """Token streams of the blocks that no article protects: host, k1, k2, page (hash of the html), same (hash of the stream), tokens (0 after the page and where an article's text stood), free (1 where the markup leaves it open)."""
    import pyarrow as pa
    import xxhash

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/:?#]*)", 1))
    src = pages.select(host.alias("host"), *_key(), F.xxhash64("html").alias("page"), "html")

    def run(batches):
        for b in batches:
            keep, same, tokens, free = [], [], [], []
            for i, html in enumerate(b.column(4)):
                stream, open_ = [], []
                found, landmarks = blocks(html.as_py())
                for (text, inside, _), state in zip(found, left_open(found, landmarks), strict=True):
                    if not inside or state == 2:
                        ws = text.split(" ")
                        stream += [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1 | 1 for w in ws]
                        open_ += [int(state == 2)] * len(ws)
                    elif stream and stream[-1]:
                        stream.append(0)
                        open_.append(0)
                if stream:
                    if stream[-1]:
                        stream.append(0)
                        open_.append(0)
                    keep.append(i)
                    tokens.append(stream)
                    free.append(open_)
                    same.append(xxhash.xxh3_64_intdigest(np.array(stream, np.int64).tobytes() + bytes(open_)) >> 1)
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(same, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(free, pa.list_(pa.int8()))], names=["host", "k1", "k2", "page", "same", "tokens", "free"])

    return src.mapInArrow(run, "host string, k1 long, k2 long, page long, same long, tokens array<long>, free array<byte>")


def host_runs(streams: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """k1, k2, gone: places (among the page's free tokens) that lie in repeated runs; only pages that have such."""
    import pyarrow as pa

    # equal streams take one place in a shard, and count for all distinct pages that have them
    once = streams.groupBy("host", "same", "page").agg(F.first(F.struct("tokens", "free")).alias("s"), F.count("*").alias("n"))
    once = once.groupBy("host", "same").agg(F.first("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("pages"))
    once = cut(once.select("host", "same", "n", "pages", "s.*"), "once")
    sizes = cut(once.groupBy("host").agg(F.sum(F.size("tokens")).alias("tokens_n"), F.count("*").alias("n"), F.max(F.array_max("free")).alias("any")), "hosts")
    # a host whose markup leaves nothing open has nothing to decide
    sizes = sizes.where("any > 0").select("host", "n", F.ceil(F.col("tokens_n") / shard_tokens).alias("shards"))
    dealt = skew_join(once.drop("n"), sizes, ["host"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("same"), "shards")).select("host", "shards", "shard", "same", "pages", "tokens", "free")
    one, more = dealt.where("shards = 1"), dealt.where("shards > 1")

    def laid(table):
        """The shard's tokens, their streams (-1 at separators), the lengths and pages of its streams."""
        tokens = table.column("tokens").combine_chunks()
        lengths = np.diff(tokens.offsets.to_numpy())
        flat = tokens.flatten().to_numpy()
        gap = flat == 0
        flat = flat.copy()
        flat[gap] = -np.arange(1, gap.sum() + 1)  # separators differ from each other: no run crosses one
        return flat, np.where(gap, -1, np.repeat(np.arange(len(lengths)), lengths)), lengths, table.column("pages").to_numpy()

    def marked(table, hit, lengths):
        free = table.column("free").combine_chunks().flatten().to_numpy() > 0
        ends = np.cumsum(lengths)
        gone, keep = [], []
        for i, (a, b) in enumerate(zip(ends - lengths, ends, strict=True)):
            own = hit[a:b][free[a:b]]
            if own.any():
                keep.append(i)
                gone.append(np.flatnonzero(own).tolist())
        part = table.take(pa.array(keep, pa.int64()))
        return pa.table({"host": part.column("host"), "same": part.column("same"), "gone": pa.array(gone, pa.list_(pa.int32()))})

    def hashes(flat, at):
        """The starts of the windows without separators, and their hashes."""
        n = max(len(flat) - min_tokens + 1, 0)
        gaps = np.concatenate(([0], np.cumsum(at < 0)))
        starts = np.flatnonzero(gaps[min_tokens : min_tokens + n] == gaps[:n])
        x, total = mix(flat.view(np.uint64)), np.zeros(n, np.uint64)
        for j in range(min_tokens):
            total += x[j : j + n] * MULT[j % len(MULT)]
        return starts, mix(total)[starts].view(np.int64)

    def run(table):
        flat, at, lengths, pages = laid(table)
        return marked(table, repeated(flat, at, min_tokens, min_pages, pages), lengths)

    def count(table):
        flat, at, _, pages = laid(table)
        classes = window_classes(flat, min_tokens)
        n = page_counts(classes, at, pages)
        starts, h = hashes(flat, at)
        first = np.unique(classes[starts], return_index=True)[1]
        host, shard = table.column("host")[0].as_py(), table.column("shard")[0].as_py()
        return pa.table({"host": pa.array([host] * len(first), pa.string()), "shard": pa.array([shard] * len(first), pa.int64()), "h": pa.array(h[first]), "n": pa.array(n[classes[starts[first]]])})

    def mark(table, often):
        if not len(table):
            return pa.table({"host": pa.array([], pa.string()), "same": pa.array([], pa.int64()), "gone": pa.array([], pa.list_(pa.int32()))})
        flat, at, lengths, _ = laid(table)
        starts, h = hashes(flat, at)
        return marked(table, covered(starts[np.isin(h, often.column("h").to_numpy())], len(flat), min_tokens), lengths)

    schema, key = "host string, same long, gone array<int>", ("host", "shard")
    windows = cut(more.groupBy(*key).applyInArrow(count, "host string, shard long, h long, n long"), "windows")
    often = cut(windows.groupBy("host", "h").agg(F.sum("n").alias("pages"), F.count("*").alias("n")).where(F.col("pages") >= min_pages).select("host", "h", "n"), "often")
    often = skew_join(windows.select(*key, "h"), often, ["host", "h"]).select(*key, "h")
    wide = more.groupBy(*key).cogroup(often.groupBy(*key)).applyInArrow(mark, schema)
    gone = cut(one.groupBy(*key).applyInArrow(run, schema).union(wide), "gone")
    gone = cut(gone.join(once.select("host", "same", "n"), ["host", "same"]), "gone_n")
    return skew_join(streams.select("host", "same", "k1", "k2"), gone, ["host", "same"]).select("k1", "k2", "gone")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    import pyarrow as pa

    pages = pages.select("page_id", "url", "html")
    gone = cut(host_runs(cut(outside(pages), "streams")).dropDuplicates(["k1", "k2"]), "runs")
    src = pages.select("*", *_key()).join(checked(gone, MAX_BROADCAST), ["k1", "k2"], "left").select("page_id", "url", "html", "gone")

    def run(batches):
        for b in batches:
            texts = []
            for html, out in zip(b.column(2), b.column(3), strict=True):
                found, landmarks = blocks(html.as_py())
                drop, n, keep = set(out.as_py() or ()), 0, []
                for (text, _, _), state in zip(found, left_open(found, landmarks), strict=True):
                    if state == 2:
                        ws = text.split(" ")
                        text = " ".join(w for i, w in enumerate(ws, n) if i not in drop) if drop else text
                        n += len(ws)
                    if state and text:
                        keep.append(text)
                texts.append(" ".join(keep))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return src.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_extract": op7_extract}
ORACLE_SQL: dict[str, str] = {}
