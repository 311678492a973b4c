"""Training-data operators against brute force, on small fixtures with the edge cases that their docstrings define."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import chat, decontaminate, host_suffixes, licences, line_spread, mixing, permutation_index, queries, repeats, tensor_minhash, toxicity
from logweave.llm.common import shared_dir

WORDS = [a + b for a in "ba ce di fo gu ha je".split() for b in "lan ter mip sor vek".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


# --- toxicity -------------------------------------------------------------------------------------


def toxic_fixture(spark, n=240):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        parts = [prose(rng, 12).capitalize() + "." for _ in range(6)]
        if bad:
            parts[rng.randrange(6)] = f"You are a {rng.choice(['rotter', 'blighter'])} indeed."
        rows.append((i, " ".join(parts)))
        labels.append((i, 1, int(bad)))
    rows += [(n, None), (n + 1, ""), (n + 2, "rotter " * 5000), (3, rows[3][1])]
    return docs_of(spark, rows), spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_from_documents_and_locates_sentences(spark):
    docs, labels = toxic_fixture(spark)
    model = toxicity.fit(docs, labels.where("doc_id % 3 != 1"))
    rows = toxicity.score(docs.withColumn("score", F.lit("mine")), model).collect()
    assert len(rows) == 244
    by = {r["doc_id"]: r for r in rows}
    assert sum(by[i]["predicted"] == int(i % 4 == 0) for i in range(240)) >= 236
    assert by[240]["score"] == 0 and by[241]["score"] == 0 and by[242]["predicted"] == 1
    (span, *_) = by[0]["offending"]
    assert re.search("rotter|blighter", by[0]["text"][span["start"] : span["end"]]) and span["end"] - span["start"] < 60
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() in range(178, 186)


def test_toxicity_without_usable_labels(spark):
    docs, labels = toxic_fixture(spark, 8)
    model = toxicity.fit(docs, labels.where("toxic = 1"))
    assert {r["score"] for r in toxicity.score(docs, model).select("score").collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


# --- decontamination ------------------------------------------------------------------------------


def brute_hits(text, items, window=10):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: pat.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    ws, hit, found = low(text), set(), set()
    for i, t in items:
        own = low(t)
        if i is None or not own:
            continue
        size = min(window, len(own))
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
        for k in range(len(ws) - size + 1):
            if tuple(ws[k : k + size]) in grams:
                hit.update(range(k, k + size))
                found.add(str(i))
    return len(ws), len(hit), sorted(found)


def contaminated_fixture(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 11, 30]))) for i in range(30)] + [(98, None), (99, "..."), (None, "x y z"), (97, "Äpfel 12"), (96, prose(rng, 15))]
    items.append((95, items[0][1]))
    texts = [prose(rng, 60) for _ in range(40)]
    for k in range(20):
        a = items[k % 30][1].split()
        s = rng.randrange(max(1, len(a) - 9))
        texts[k] += " " + " ".join(a[s : s + 12]).upper() + ", " + prose(rng, 5)
    texts += [None, "", "äpfel 12 !", "Äpfel 12", " ".join(i[1] for i in items[:5]) * 40, "no such words"]
    return docs_of(spark, enumerate(texts)), texts, spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("max_words", [10**6, 40])
def test_decontamination_matches_brute_force(spark, max_words):
    docs, texts, benchmark, items = contaminated_fixture(spark)
    rows = {r["doc_id"]: r for r in decontaminate.matches(docs.select("doc_id", "text"), benchmark, max_words=max_words).collect()}
    for i, t in enumerate(texts):
        r, want = rows[i], brute_hits(t, items)
        assert (r["n_words"], sum(r["spans"][1::2]) - sum(r["spans"][::2]), r["items"]) == want


def test_decontamination_removes_spans_and_covered_documents(spark):
    docs, texts, benchmark, _ = contaminated_fixture(spark)
    out = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, benchmark).collect()}
    assert out[45] == "no such words" and out[40] is None and 44 not in out and 43 not in out and 42 in out
    again = decontaminate.matches(docs.select("doc_id").join(decontaminate.remove(docs, benchmark), "doc_id"), benchmark)
    assert decontaminate.remove(docs, benchmark.limit(0)).count() == len(texts)
    assert again.where("size(spans) = 0").count() >= again.count() - 2


# --- chat -----------------------------------------------------------------------------------------


def test_chat_keeps_maximal_conversations(spark):
    turns = []
    base = [("user", "a"), ("assistant", "b"), ("user", None), (None, "d")]
    for c, part in ((1, base[:2]), (2, base), (3, base), (4, base[:1] + [("assistant", "x")]), (5, base[1:]), (6, [("user", "a")] * 200)):
        turns += [(c, k, r, t) for k, (r, t) in enumerate(part)]
    turns += [(None, 0, "user", "lost"), (7, 0, "user", "a"), (7, 0, "user", "a"), (8, None, "user", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("rank", F.lit("mine"))
    rows = chat.render(df).collect()
    assert {r["conv_id"] for r in rows} == {2, 4, 5, 6, 8}  # 7 is two turns of what 6 repeats
    assert {r["n_snapshots"] for r in rows if r["conv_id"] == 2} == {2}
    two = "".join(r["rendered"] for r in sorted((r for r in rows if r["conv_id"] == 2), key=lambda r: r["rank"]))
    assert two == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n<|user|>\n\n<|end|>\n<|>\nd\n<|end|>\n".replace("<|>", "<||>")
    assert sum(r["conv_id"] == 6 for r in rows) == 200
    assert chat.render(df.limit(0)).count() == 0


def test_chat_turns_of_any_number(spark):
    turns = [(1, t, "user", f"t{t}") for t in (None, -100, -1, 0, 63, 64, 1000)] + [(2, 5, "user", "x" * 300_000)]
    rows = chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert [r["rendered"].split("\n")[1] for r in sorted((r for r in rows if r["conv_id"] == 1), key=lambda r: r["rank"])] == ["tNone", "t-100", "t-1", "t0", "t63", "t64", "t1000"]
    assert max(len(r["rendered"]) for r in rows if r["conv_id"] == 2) > 300_000


# --- nearest neighbours ---------------------------------------------------------------------------


def test_permutation_index(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[500:900] = x[499]  # a group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0] * 3), (None, x[0].tolist()), (100, x[100].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(0))
    got = permutation_index.search(df, lambda i: i % 100 == 0).toPandas()
    assert set(got["query_id"]) == set(range(0, 1500, 100))
    hit = total = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and np.allclose(d[g["vec_id"]], g["score"], rtol=0, atol=0)
        hit += len(set(best) & set(g["vec_id"]))
        total += 10
        if q in (500, 600, 700, 800):
            assert list(g["vec_id"]) == best
    assert hit / total >= 0.9
    assert permutation_index.search(df.limit(0), lambda i: i % 100 == 0).count() == 0
    three = df.where("vec_id in (100, 1, 2)")
    assert permutation_index.search(three, lambda i: i == 100).count() == 2


# --- line dedup -----------------------------------------------------------------------------------


def test_line_spread_matches_exact_counts(spark):
    rng = random.Random(4)
    common, near, local = "shown on every site", "shown on nine sites", "often, but on one site"
    rows = []
    for i in range(400):
        body = [prose(rng, 9) for _ in range(5)]
        site = i % 24
        body += [f"  {common} "] * (1 + i % 2) + ([near] if site < 9 else []) + ([local] if site == 1 else []) + [""]
        rows.append((i, "\n".join(body), f"site{site}"))
    rows += [(900, None, "site1"), (901, "", "site1"), (902, common, None), (903, common, "site3"), (904, "x" * 200_000, "site1"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("places", F.lit(1))
    out = {r["doc_id"]: r for r in line_spread.clean(df).collect()}
    for i in range(400):
        text = rows[i][1]
        kept = "\n".join(x for x in text.split("\n") if x.strip() != common)
        assert out[i]["text"] == kept and out[i]["n_removed"] == 1 + i % 2
    assert out[900]["text"] is None and out[900]["n_lines"] == 0 and out[901]["n_lines"] == 1
    assert out[903]["text"] == common and out[904]["n_removed"] == 0  # nothing but boilerplate: left alone
    lower = {r["doc_id"]: r for r in line_spread.clean(df, min_sites=9).collect()}
    assert near not in lower[0]["text"] and near in out[0]["text"]
    assert line_spread.strip(df).columns == df.columns and line_spread.clean(df.limit(0)).count() == 0


def test_boilerplate_goes_whatever_its_share(spark):
    common = "one long line that every site of this small collection shows"
    rows = [(i, f"{common}\nown {i}", f"site{i}") for i in range(12)] + [(20, f"{common}\n \n{common}", "site1")]
    out = {r["doc_id"]: r for r in line_spread.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all((out[i]["text"], out[i]["n_removed"]) == (f"own {i}", 1) for i in range(12))
    assert (out[20]["text"], out[20]["n_removed"]) == (rows[-1][1], 0)


# --- near-duplicates ------------------------------------------------------------------------------


def brute_components(texts, size=2):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(low).split()
        sets[i] = set(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for g in range(25):
        base = prose(rng, rng.choice([40, 80, 200])).split()
        for c in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts[g * 10 + c] = " ".join(w)
    texts |= {900: None, 901: "", 902: "one", 903: "ONE", 904: " \t", 905: prose(rng, 20_000), 906: "one two", 907: "two one"}
    df = docs_of(spark, texts.items())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in tensor_minhash.links(df).collect()}
    assert got == brute_components(texts)
    kept = tensor_minhash.keep_one(df, size=2)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute_components(texts).items() if i == c}
    assert kept.columns == df.columns
    assert tensor_minhash.links(df.limit(0)).count() == 0
    odd = docs_of(spark, [(None, "a b c"), (1, "a b c"), (1, "a b c")])
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in tensor_minhash.links(odd).collect()) == [(False, 1), (False, 1), (True, None)]


def test_different_texts_of_one_doc_id_stay(spark):
    rng = random.Random(18)
    a, b, c = (prose(rng, 40) for _ in range(3))
    kept = tensor_minhash.keep_one(docs_of(spark, [(1, a), (1, b), (1, c), (1, a), (2, b), (3, c), (4, a)])).collect()
    assert sorted(r["text"] for r in kept) == sorted([a, b, c])


@pytest.mark.parametrize("block", [10, 4000])
def test_near_duplicates_in_a_template_group_need_no_luck(spark, monkeypatch, block):
    rng = random.Random(15)
    base = [f"t{i}" for i in range(220)]
    texts = {}
    for i in range(160):  # about 0.75 alike, but for the pairs planted
        w = list(base)
        for k in rng.sample(range(1, 219), 15 + i % 3):
            w[k] = f"u{i}x{k}"
        texts[i] = " ".join(w)
    for i in range(100, 120):
        w = texts[i].split()
        for k in rng.sample(range(1, 219), 10):
            w[k] = f"v{i}x{k}"
        texts[i + 200] = " ".join(w)
    monkeypatch.setattr(tensor_minhash, "neighbours", lambda label, *a: label.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    monkeypatch.setattr(tensor_minhash.exhaustive, "__defaults__", (block,))
    df = docs_of(spark, texts.items())
    want = brute_components(texts)
    assert len({c for _, c in want.values()}) > 100
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in tensor_minhash.links(df).collect()} == want
    # one table, whose buckets hold many: stars alone link next to nothing
    got = {r["doc_id"]: r["component_id"] for r in tensor_minhash.links(df, half=1, k=1).collect()}
    assert sum(got[i] == got[i + 200] for i in range(100, 120)) >= 8


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201)], "a long, b long")
    got = {r["id"]: r["component"] for r in tensor_minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200}


# --- HTML -----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "html,expected",
    [
        (None, ""),
        ("", ""),
        ("<p>a &amp; b<br>c  \n d<p>e&nbsp;f", "a & b c d e f"),
        ('<nav>menu</nav><article><h1>T</h1><p><b>x<br><p>y<aside>no</aside><form>f<input></form><div class="ad-box">ad</div></article><footer>foot</footer>', "T x y"),
        ('<main><script>var t="</p>";</script><style>p{}</style><p>one<!-- two --> three</p></main><div class="comments">c</div>', "one three"),
        ('<article>text<section class="comments"><p>reader</p></section></article>', "text"),
        ("<article>cut off <p>here", "cut off here"),
        ("<body><div class=cookie-notice>accept</div><p>plain page</p></body>", "plain page"),
        ('<article><header><h1>Title</h1></header><p hidden>h</p><p title="a > b">p</p></article>', "Title p"),
        ("a < b", "a < b"),
        ('<article><p>one</p><div class="ad-astra share-price">The share price rose</div><div class="ad-box">buy</div><math><mi>x</mi></math></article>', "one The share price rose x"),
        ('<article><div class="site-footer">f</div><span class="ad">gone</span> kept<p>two</article>', "kept two"),
    ],
)
def test_html(spark, html, expected):
    df = spark.createDataFrame([(1, "http://h/x", html)], "page_id long, url string, html string")
    (r,) = host_suffixes.extract(df).collect()
    assert r["text"] == expected and r["n_chars"] == len(expected)


def test_host_runs_are_removed_and_unique_text_stays(spark):
    rng = random.Random(6)
    foot = "all rights of this site are with its owner"
    pages = [(i, f"https://Host.example/{i}", f"<div>{prose(rng, 30)}</div><div>{foot} <b>{i}</b></div>") for i in range(20)]
    same = [(50 + i, "https://copies.example/", "<div>the very same page each time it is read</div>") for i in range(5)]
    df = spark.createDataFrame([*pages, *same, (99, None, "<p>x</p>"), pages[0]], "page_id long, url string, html string").withColumn("text", F.lit(1))
    rows = {r["page_id"]: r["text"] for r in host_suffixes.extract(df).collect()}
    for i, _, html in pages:
        words = re.search("<div>(.*?)</div>", html)[1]
        assert foot not in rows[i] and rows[i].split()[:25] == words.split()[:25] and rows[i].endswith(str(i))
    assert rows[50] == "the very same page each time it is read"  # equal pages count once
    assert host_suffixes.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard_tokens", [400_000, 60])
def test_host_runs_match_brute_force(spark, shard_tokens):
    rng = random.Random(19)
    pages = []
    for i in range(40):
        parts = [f"<div>{prose(rng, 3)} w{i} {rng.choice(['a b c d', 'a b c d e f', 'x y z', 'one two three four five six seven'])}</div>" for _ in range(6)]
        pages.append((i, f"http://h{i % 2}/{i}", "".join(parts)))
    pages += [(100 + i, "http://h0/copy", pages[0][2]) for i in range(3)]
    words = {i: re.findall(r"[^<>/ ]+", re.sub(r"</?div>", " ", h)) for i, _, h in pages}
    want = {}
    for i, url, _ in pages:
        seen = {}
        for j, u, _ in pages:
            if u[:9] == url[:9]:
                for k in range(len(words[j]) - 5):
                    seen.setdefault(tuple(words[j][k : k + 6]), set()).add(tuple(words[j]))
        want[i] = sorted({k + d for k in range(len(words[i]) - 5) for d in range(6) if len(seen[tuple(words[i][k : k + 6])]) >= 3})
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    runs = host_suffixes.host_runs(host_suffixes.outside(df), shard_tokens=shard_tokens)
    got = {r["page_id"]: sorted(r["gone"]) for r in runs.join(df.select("page_id", *host_suffixes._key()), ["k1", "k2"]).collect()}
    assert got == {i: x for i, x in want.items() if x} and len(got) > 10


def test_a_doubtful_part_of_an_article_goes_where_it_repeats(spark):
    rng = random.Random(20)
    note = "sign up here for all of our weekly news"
    html = lambda own: f'<article><p>{prose(rng, 20)}</p><div class="ad-hoc">{own}</div></article>'
    pages = [(i, "http://n/", html(note)) for i in range(4)] + [(9, "http://n/", html("only here we speak of this"))]
    out = {r["page_id"]: r["text"] for r in host_suffixes.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(note not in out[i] and len(out[i].split()) == 20 for i in range(4)) and out[9].endswith("only here we speak of this")


def test_suffix_classes_are_ranks_of_substrings():
    rng = np.random.default_rng(7)
    t = rng.integers(0, 3, 200)
    order, rank = host_suffixes.suffix_classes(t, 4)
    subs = [tuple(t[i : i + 4]) for i in range(197)]
    for i in range(0, 197, 7):
        for j in range(0, 197, 5):
            assert (rank[i] == rank[j]) == (subs[i] == subs[j]) and (rank[i] < rank[j]) == (subs[i] < subs[j])
    assert sorted(order.tolist()) == list(range(200))


def test_runs_of_a_host_are_found_over_its_shards(spark):
    rng = random.Random(17)
    pages = [(i, "http://big/", f"<div>{prose(rng, 40)} {' '.join(f'n{i // 3}w{k}' for k in range(8))} z{i}</div>") for i in range(30)]
    streams = host_suffixes.outside(spark.createDataFrame(pages, "page_id long, url string, html string"))
    found = [{(r["k1"], r["k2"]): r["gone"] for r in host_suffixes.host_runs(streams, shard_tokens=n).collect()} for n in (400_000, 200)]
    assert found[0] == found[1] and len(found[0]) == 30


def test_two_short_phrases_side_by_side_are_no_repeated_run():
    pages = [[1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 3, 4, 20, 21], [22, 1, 2, 3, 4, 23], [5, 6, 7, 8, 24, 25], [26, 27, 5, 6, 7, 8], *[[31, 32, 33, 34, 35, 36, 40 + i] for i in range(3)]]
    tokens = np.array([t for i, p in enumerate(pages) for t in [*p, -1 - i]])
    page = np.array([x for i, p in enumerate(pages) for x in [*[i] * len(p), -1]])
    assert set(tokens[host_suffixes.repeated(tokens, page, 6, 3)].tolist()) == {31, 32, 33, 34, 35, 36}


# --- licences -------------------------------------------------------------------------------------


def test_licences_native_scan_is_the_model(spark):
    units = [t for texts in licences.NOTICES.values() for t in texts] + licences.OTHER + ["nothing here", "Licensed under the Made Up License.", "of the and", "x1 " * 150 + "Released under the MIT License " + "x2 " * 90]
    text = "\n\n".join(units)
    pieces = re.split(r"\n[ \t\r]*\n", text)
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "x " * 100_000), (1, text)], "doc_id long, text string").withColumn("family", F.lit("mine"))
    got = {}
    for r in licences.scan(df).collect():
        got.setdefault(tuple(r["words"]), []).append(r)
    wanted = 0
    for piece in pieces:
        for words in licences.windows(licences.words_of(piece)):
            family, p, share = licences.classify(words)
            want = family != licences.UNKNOWN and p >= licences.THRESHOLD
            wanted += 2 * want
            assert (tuple(words) in got) == want, piece
            for r in got.get(tuple(words), ()):
                assert r["doc_id"] == 1 and r["family"] == family and abs(r["probability"] - p) < 1e-9 and abs(r["overlap"] - share) < 1e-9 and r["confirmed"] == (share >= licences.OVERLAP)
    assert sum(map(len, got.values())) == wanted
    for f, texts in licences.NOTICES.items():
        assert all(got[tuple(licences.words_of(t))][0]["family"] == f and got[tuple(licences.words_of(t))][0]["confirmed"] for t in texts)
    assert licences.scan(df.limit(0)).count() == 0


HELD_OUT = [  # none of these is a notice of the training set
    ("MIT", "This code is distributed under the MIT license."),
    ("MIT", "PERMISSION IS HEREBY GRANTED, FREE OF CHARGE, TO ANY PERSON OBTAINING\n * A COPY OF THIS SOFTWARE AND ASSOCIATED\n * DOCUMENTATION FILES"),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("Apache-2.0", "Distributed under the terms of the Apache License 2.0"),
    ("BSD", "Code released under the BSD license"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License"),
    ("CC-BY-NC", "Shared by its author. Licensed under CC BY-NC 4.0 since last year"),
    (None, "Licensed under the Zope Public License"),
    (None, "Licensed under the Foobar License, Version 2.0."),
    (None, "This content is made available under the terms of the Eclipse Public License v. 2.0"),
    (None, "Subject to the EUPL, Version 1.2 only"),
    (None, "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    (None, "He got a license to drive a truck\nand the public was free to watch"),
]


def test_licences_on_notices_held_out(spark):
    df = spark.createDataFrame([(i, f"first line of text.\n{t}") for i, (_, t) in enumerate(HELD_OUT)], "doc_id long, text string")
    got = {r["doc_id"]: (r["family"], r["confirmed"]) for r in licences.scan(df).collect()}
    assert [got.get(i, (None, True)) for i in range(len(HELD_OUT))] == [(f, True) for f, _ in HELD_OUT]


# --- exact repeats --------------------------------------------------------------------------------


def brute_repeats(texts, length):
    seen = {}
    for d, b in enumerate(texts):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    hit = [bytearray(len(b)) for b in texts]
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                hit[d][i : i + length] = b"\1" * length
    return hit


@pytest.mark.parametrize("hot", [10**6, 2])
def test_repeats_match_brute_force(spark, monkeypatch, hot):
    rng = random.Random(8)
    texts = [prose(rng, 120) for _ in range(12)]
    for _ in range(14):
        a, b = rng.randrange(12), rng.randrange(12)
        s = rng.randrange(300)
        texts[b] = texts[b][:200] + texts[a][s : s + rng.choice([199, 200, 201, 333])] + texts[b][200:]
    texts += ["a" * 500, "a" * 199, "ab" * 100, "ä" * 120, texts[0], texts[0], "", None, "short", prose(rng, 9000) + texts[3]]
    monkeypatch.setattr(repeats._found, "__defaults__", (repeats.LENGTH, repeats.GRAM, hot))
    monkeypatch.setattr(repeats, "PIECE", 5000)
    df = docs_of(spark, enumerate(texts))
    got = {r["doc_id"]: r for r in repeats.digests(df).collect()}
    raw = [(t or "").encode() for t in texts]
    for d, hit in enumerate(brute_repeats(raw, 200)):
        n_spans = sum(hit[i] and not (i and hit[i - 1]) for i in range(len(hit)))
        kept = bytes(c for c, h in zip(raw[d], hit, strict=True) if not h)
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw[d]), sum(hit), n_spans, hashlib.sha256(kept).hexdigest()), d
    assert repeats.digests(df.limit(0)).count() == 0


def test_a_sure_block_of_a_hot_anchor_keeps_its_whole_range(spark):
    rng = random.Random(16)
    text = prose(rng, 80)[:260].encode()
    other, alone = text[:220] + b"#" * 40, prose(rng, 80)[:260].encode()
    rows = [(1, 0, 1, 1, text, True), (1, 0, 2, 2, other, False), (1, 0, 3, 3, alone, False)]
    df = spark.createDataFrame([(g, o, a, b, bytearray(x), y) for g, o, a, b, x, y in rows], "g long, off int, c1 long, c2 long, block binary, sure boolean")
    hot = [(r["c1"], repeats._union(r["ranges"])) for r in repeats.compare_hot(df, 200).collect()]
    calm = [(r["c1"], repeats._union(r["ranges"])) for r in repeats.compare(df.repartition("g").sortWithinPartitions("g"), 200).collect()]
    merge = lambda found: sorted((c, min(x for x, _ in r), max(y for _, y in r)) for c, r in found)
    assert merge(hot) == merge(calm) == [(1, 0, 60), (2, 0, 20)]


# --- mixing ---------------------------------------------------------------------------------------


def test_raking_meets_all_marginals_and_sampling_follows(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.choice([20, 150])), rng.choice(["en", "de"]), rng.choice(["a", "a", "b", None])) for i in range(3000)] + [(None, None, None, "a"), (5000, "", "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("topic", F.lit("mine"))
    share = spark.createDataFrame([("a", 0.5), ("b", 0.4), (None, 0.1)], "value string, share double")
    out = mixing.mix(df, {"source": share}, keep=0.3)
    rows = out.collect()
    n = {s: sum(r["n_tokens"] for r in rows if r["source"] == s) for s in ("a", "b", None)}
    total = sum(n.values())
    assert abs(n["a"] / total - 0.5) < 0.05 and abs(n["b"] / total - 0.4) < 0.05
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in rows}
    assert mixing.mix(df.limit(0)).count() == 0
    assert None not in {r["doc_id"] for r in rows}  # its cell has no tokens


def test_rows_without_doc_id_draw_by_their_text(spark):
    rng = random.Random(21)
    rows = [(None, prose(rng, 30), "en", "a") for _ in range(200)] + [(7, prose(rng, 30), "en", "a")] * 2
    kept = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), keep=0.5).collect()
    assert 60 < sum(r["doc_id"] is None for r in kept) < 140
    assert sum(r["doc_id"] == 7 for r in kept) in (0, 2)  # equal rows share their draw


def test_what_a_full_cell_cannot_give_others_give(spark):
    rows = [("a", "en", "long", 100), ("a", "de", "long", 900), ("b", "en", "long", 800), ("b", "de", "long", 200), ("b", "de", "short", 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    share = lambda **x: spark.createDataFrame(list(x.items()), "value string, share double")
    targets = {"source": share(a=0.5, b=0.5), "lang": share(en=0.55, de=0.45), "topic": share(long=1.0, short=0.0)}
    out = mixing.rake(cells, targets, keep=0.7).collect()
    assert all(0.7 * r["weight"] * 2000 <= r["tokens"] * (1 + 1e-9) for r in out)
    for d, v, want in (("source", "a", 0.5), ("source", "b", 0.5), ("lang", "en", 0.55), ("lang", "de", 0.45)):
        assert abs(sum(r["weight"] for r in out if r[d] == v) - want) < 1e-3
    assert any(0.7 * r["weight"] * 2000 > r["tokens"] for r in mixing.rake(cells, targets).collect())


# --- all ------------------------------------------------------------------------------------------


def test_one_query_an_operator(spark):
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


# --- markup around and in articles, near relatives of licences ---------------------------------------

MARKUP = [
    ('<body><form id="aspnetForm"><div>Menu</div><article><h1>T</h1><p>Hello you</p></article><p>foot</p></form>', ["T", "Hello you"]),
    ('<article><h1 class="post-header">Title</h1><p>x</p></article>', ["Title", "x"]),
    ('<article><div class="article-header"><h1>Title</h1></div><p>x</p></article>', ["Title", "x"]),
    ('<article><h2 id="navigation">Nav</h2><section id="social"><p>Social life of ants.</p></section></article>', ["Nav", "Social life of ants."]),
    ("<article><p>one</p><nav><a>x</a><p>two</p></article><p>after</p><article>more</article>", ["one", "more"]),
    ('<article><p>one</p><div class="ad">buy<p>two</p></article><main>m</main>', ["one", "m"]),
    ('<div class="elementor-widget"><main><p>in</p></main></div>', ["in"]),
    ('<div class="comments"><article><p>c1</p></article><article>c2</article></div><article>real</article>', ["real"]),
    ("<aside><article>teaser</article></aside><article>real<form>sign up <b>now</b></form> rest</article>", ["real", "rest"]),
    ('<article>a<div class="share">share this</div>b</article>', ["a", "b"]),
]


@pytest.mark.parametrize("html,kept", MARKUP)
def test_articles_in_forms_and_marks_in_articles(html, kept):
    found, landmarks = host_suffixes.blocks(html)
    assert [t for (t, _, _), s in zip(found, host_suffixes.left_open(found, landmarks), strict=True) if s] == kept


def test_a_heading_marked_by_its_class_stays_unless_the_host_repeats_it(spark):
    rng = random.Random(8)
    again = "Read more about all of our great offers today"
    pages = [(i, "http://h.example/", f'<article><h1 class="post-header">{prose(rng, 8)}</h1><div class="social">{again}</div><p>{prose(rng, 30)}</p></article>') for i in range(6)]
    got = {r["page_id"]: r["text"] for r in host_suffixes.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, _, html in pages:
        title, body = re.search(r"<h1[^>]*>(.*?)</h1>", html)[1], re.search(r"<p>(.*?)</p>", html)[1]
        assert got[i] == f"{title} {body}"


def test_near_relatives_are_not_confirmed(spark):
    others = [
        "SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0", "SPDX-License-Identifier: Apache-1.1", "Licensed under the Apache License, Version 1.1.", "SPDX-License-Identifier: CC-BY-ND-4.0",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 3.0.", "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: GPL-1.0-or-later", "SPDX-License-Identifier: MPL-1.1",
    ]
    own = {"SPDX-License-Identifier: MIT": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0"}
    texts = [*others, *own]
    docs = docs_of(spark, list(enumerate(texts)))
    found = [(texts[r["doc_id"]], r["family"]) for r in licences.scan(docs).where("confirmed").collect()]
    assert dict(found) == own


def test_paragraphs_end_whatever_stands_around_their_ends(spark):
    mit = "Released under the MIT License."
    texts = [f"One sentence here.{' ' * 30}\n{mit}", "Some text\n" + "#" * 40 + " SPDX-License-Identifier: MIT " + "x" * 3 + "\nmore text", f"words\n \t \n{mit}\n\nmore", f"{mit}\0", f"a.\r\n{mit}\r\n"]
    found = {r["doc_id"] for r in licences.scan(docs_of(spark, list(enumerate(texts)))).where("confirmed and family = 'MIT'").collect()}
    assert found == {0, 1, 2, 3, 4}
