"""Filter audit, fill-in-middle and packing against brute force, with the edge cases that their docstrings define."""

import hashlib
import random
import re
import zlib
from bisect import bisect_left, insort
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logweave.llm import filter_audit, middle, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask string, n int, piece string, digest string"


def docs_of(spark, rows):
    """Rows (doc_id, text, source), with columns that clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", s, 1, "mine", 7, "mine", "mine") for i, t, s in rows], DOCS).repartition(3)


def fixture():
    rng = random.Random(11)
    word = lambda: rng.choice("ab cd Ef GH é 漢字 x$y z& 😀 ij KLM".split())
    rows = [(i, " ".join(word() if rng.random() < 0.1 else f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 150, 199, 200, 260]))), rng.choice(["a", "b", None])) for i in range(60)]
    rows += [(100 + i, rows[3][1], "hot") for i in range(40)] + [(3, rows[3][1], "a"), (2, rows[5][1], "")]
    rows += [(200, None, "a"), (201, "", None), (199, "", "only"), (None, rows[3][1], "a"), (None, "alone here", "a"), (300, " \t\n\x0b\f\r ", "b"), (301, "Word " * 30_000, "b"), (302, "x" * 50_000 + "é", None)]
    return rows


# --- filter audit ---------------------------------------------------------------------------------


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    facts = []
    for i, t, s in rows:
        t = t or ""
        ws = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        own = [lab for lab in labels if i is not None and lab[0] == i]
        facts.append((s or "", {k for k, v in fails.items() if v}, any(lab[1] == 1 for lab in own), any(lab[2] == 1 for lab in own)))
    out = {}
    for part in {f[0] for f in facts}:
        mine, total = [f for f in facts if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, c in enumerate(order):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                total[c] += len(gone)
                again = sum(c in f[1] for f in mine) - len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), again, sum(f[1] == {c} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def test_audit_counts_every_order(spark):
    rows = fixture()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 130, 2)] + [(0, 0, 1), (3, 1, None), (None, 1, 1), (9999, 1, 1), (301, None, 1)]
    got = filter_audit.audit(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in got} == want


def test_audit_of_nothing_and_of_other_filters(spark):
    docs, none = docs_of(spark, fixture()), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), none).count() == 0
    two = {"x": F.col("n_words") > 100, "y": F.col("n_chars") == 0}
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"]) for r in filter_audit.audit(docs.where("source = 'a'"), none, two).collect()}
    n, long = docs.where("source = 'a'").count(), sum(len((t or "").split()) > 100 for _, t, s in fixture() if s == "a")
    assert got == {("xy", 1): (n - long, long), ("xy", 2): (n - long - 1, 1), ("yx", 1): (n - 1, 1), ("yx", 2): (n - long - 1, long)}


TEXTS = st.lists(st.text(st.sampled_from("ab AZ\n\t\x0b#$é漢😀<>PSM"), max_size=60), max_size=6)


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_scan_of_buffers(texts):
    data, offsets = buffers(texts)
    found = filter_audit.scan(data, offsets)
    for i, t in enumerate(texts):
        ws = re.findall("[^\x20\x09-\x0d]+", t)
        assert tuple(int(f[i]) for f in found) == (len(t), len(ws), len(set(ws)), len(re.findall("[A-Z]", t)), len(re.findall("[#$%&*|]", t)))


def test_words_of_one_hash_are_told_apart():
    texts = ["a b c a bb cc " * 3, "x", "", "a a a " + "y" * 100 + " " + "y" * 99 + "z " + "y" * 100]
    data, offsets = buffers(texts)
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", data.tobytes())]
    spans = [(max(a, o), min(b, p)) for a, b in spans for o, p in zip(offsets[:-1], offsets[1:], strict=True) if max(a, o) < min(b, p)]
    starts, ends = np.array(spans).T
    for bits in (48, 3, 0):
        assert filter_audit.distinct_words(data, offsets, starts, ends, bits).tolist() == [5, 1, 0, 3]


# --- fill-in-middle -------------------------------------------------------------------------------


def brute_fim(i, text):
    t = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, t
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(2)
    rows = fixture() + [(400 + i, "".join(rng.choice("aB <PSM>é漢😀\n0") for _ in range(rng.randrange(40))), "s") for i in range(150)]
    rows += [(600, "<S", "s"), (601, "a<P>b", "s"), (602, "<" * 50, "s"), (603, "<S" * 40, "s"), (604, "<P<M<S", "s")]
    out = middle.transform(docs_of(spark, rows)).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"], r["back"])) for r in out)
    want = [(i, t, brute_fim(i, t)) for i, t, _ in rows]
    assert got == sorted((i is None, i or 0, n, form, str(a), str(b), o, t or "") for i, t, (n, form, a, b, o) in want)
    assert {"plain", "psm", "spm"} == {r["form"] for r in out}
    assert middle.transform(docs_of(spark, rows).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_cuts_are_found_in_runs(texts):
    data, offsets = buffers(texts)
    runs = middle.Runs(data, offsets)
    for i, t in enumerate(texts):
        units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        assert runs.n_units()[i] == len(units)
        for k in range(len(units) + 1):
            byte, char = runs.place(np.array([i]), np.array([k]))
            before = "".join(units[:k])
            assert (byte[0] - offsets[i], char[0]) == (len(before.encode()), len(before))


# --- packing --------------------------------------------------------------------------------------


def best_fit(lengths, size):
    """Sequences that best fit of one piece after another, the longest first, opens."""
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(rooms, x)
        room = rooms.pop(i) if i < len(rooms) else size
        n += room == size
        insort(rooms, room - x)
    return n


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([7, 30, 64]).flatmap(lambda s: st.tuples(st.just(s), st.lists(st.integers(1, s), max_size=150))))
def test_plan_is_best_fit(case):
    size, lengths = case
    counts = {x: lengths.count(x) for x in lengths}
    plan = packing.plan(counts, size)
    assert plan.sequences == best_fit(lengths, size)
    if not lengths:
        return
    x = np.array([k for k, n in counts.items() for _ in range(n)])
    sequence, offset = plan.slots(x, np.concatenate([np.arange(n) for n in counts.values()]))
    for s in range(plan.sequences):
        mine, at = sorted(zip(offset[sequence == s].tolist(), x[sequence == s].tolist(), strict=True)), 0
        for o, n in mine:
            assert o == at
            at += n
        assert 0 < at <= size


def test_plan_of_billions_is_small():
    plan = packing.plan({x: 10**9 + x * x for x in range(1, 2049)})
    assert len(plan.length) < 30_000 and sum(x * (10**9 + x * x) for x in range(1, 2049)) / 2048 <= plan.sequences


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.vocabulary())


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    rng = random.Random(4)
    encode = packing.Encoder(packing.vocabulary(), memo=50)
    some = [*"aAbßsΣσς0١٢ \t\n\r\x0b\x0c\x1c\x85\xa0 ̧́é漢😀İıﬁ<|>", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  "]
    for texts in ([], [None, "", " "], *[["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(4)] for _ in range(500)]):
        ids, bounds = encode(pa.array(texts, pa.string()))
        want = [[*x.ids, 0] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


def test_packing(spark, tokenizer):
    rows = fixture() + [(None, None, None)]
    cut = packing.pieces(docs_of(spark, rows), keep_ids=True).persist()
    packed = packing.pack(cut)
    found, whole = packed.collect(), {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    want, lengths = [], []
    for (i, _, _), x in zip(rows, tokenizer.encode_batch([t or "" for _, t, _ in rows], add_special_tokens=False), strict=True):
        ids = [*x.ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want.append((str(i), k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            lengths.append(len(part))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want)
    assert len(whole) == best_fit(lengths, 2048) and max(map(len, whole.values())) <= 2048 and sum(map(len, whole.values())) == sum(lengths)
    for r in found:
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack(packing.pieces(docs_of(spark, rows).limit(0))).count() == 0
    cut.unpersist()
