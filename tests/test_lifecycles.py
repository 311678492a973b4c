"""Lifecycles in segments against one machine over all rows of an ECU."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import lifecycle as L
from logweave.operators import scan

START = 10**15
INPUT = "index long, ecu binary, reception long, uptime long, has_uptime boolean, request boolean, version string"


def rough(rng, n):
    """Boots, suspensions, delays, rows without uptime, requests, wrong uptimes, versions; mostly in the order of reception."""
    t, out = START, []
    boot, slept, step = t, 0, rng.choice([1e5, 1e6, 3e6, 2e7])
    for i in range(n):
        t += int(rng.expovariate(1 / step)) + 1
        x, kind = rng.random(), rng.random()
        if x < 0.02:
            boot, slept = t + rng.randrange(3 * 10**6), 0
            t = boot + rng.randrange(10**6)
        elif x < 0.03:
            d = rng.randrange(5 * 10**6, 2 * 10**8)
            t, slept = t + d, slept + d - rng.randrange(-3 * 10**6, 3 * 10**6)
        up, rec = t - boot - slept, t + int(rng.choice([0, 0, 0, 1, 1e5, 2e6, 3e6, 2.5e7, 7e7]) * rng.random())
        has, request = kind >= 0.02, 0.02 <= kind < 0.04
        if not has or request:
            up = 0
        elif kind < 0.045:
            up = rng.randrange(4 * 10**11)
        elif kind > 0.995:
            up = rng.randrange(10**7)
        out.append((rec, max(0, up) // 100 * 100, has, request, f"v{i}" if 0.05 < kind < 0.06 else None))
    return sorted(out, key=lambda r: r[0]) if rng.random() < 0.8 else out


def steady(rng, n):
    """Long lifecycles with few events, as blocks are for."""
    t, out = START, []
    boot = t - rng.choice([0, 10**8, 5 * 10**8])
    for i in range(n):
        t += rng.choice([1, 1000, 10**5, 10**6, 2 * 10**6])
        if rng.random() < 0.004:
            boot = t + rng.randrange(5 * 10**6)
            t = boot + rng.randrange(4 * 10**6)
        if rng.random() < 0.002:
            d = rng.randrange(10**7, 10**8)
            t, boot = t + d, boot + rng.choice([0, d])
        out.append((t + rng.choice([0, 0, 10**5, 10**6]), max(0, t - boot), True, rng.random() < 0.01, f"v{i}" if rng.random() < 0.01 else None))
    return out


def of_machine(rows):
    """{(ecu, first index): what it has} of one machine over all rows, and the lifecycle's first index of each row."""
    out, lcs = L.detect_rows([L.Row(*r) for r in rows])
    first = {lc.id: lc.first_index for lc in lcs}
    found = {(lc.ecu, lc.first_index): (*lc.row()[2:9], (first.get(lc.resume[0], -1), *lc.resume[1:]) if lc.resume else None, lc.version) for lc in lcs}
    return found, {r.index: first[r.lifecycle] for r in out}


@pytest.mark.parametrize("block,small", [(24, 0), (150, 0), (2000, 250_000)])
def test_segments_give_what_one_machine_gives(spark, monkeypatch, block, small):
    rng, rows, want, owners = random.Random(block), [], {}, {}
    for k in range(110):
        make = rough if k % 2 else steady
        own = [(len(rows) + i, b"%04d" % k, *r) for i, r in enumerate(make(rng, rng.choice([30, 200, 500])))]
        rows += own
        found, of = of_machine(own)
        want |= found
        owners |= of
    df = spark.createDataFrame([(r[0], bytearray(r[1]), *r[2:]) for r in rows], INPUT)
    monkeypatch.setattr(L, "detection_input", lambda m: m)
    out, lcs = L.detect(df, block=block, small=small)
    found = lcs.collect()
    ids = {k: i + 1 for i, k in enumerate(sorted(want, key=lambda k: k[1]))}
    first = {i: k[1] for k, i in ids.items()}
    got = {(bytes(r["ecu"]), first[r["id"]]): tuple(r[c] for c in L._NAMES[2:9]) + ((first.get(r["resume"]["id"], -1), *r["resume"][1:]) if r["resume"] else None, r["sw_version"]) for r in found}
    assert got == want and any(v[7] for v in want.values())
    assert {r["index"]: first[r["lifecycle"]] for r in out.select("index", "lifecycle").collect()} == owners


def test_one_ecu_goes_through_many_tasks(spark, monkeypatch):
    """A long lifecycle comes to its machine as blocks, many short ones to several machines; no group of rows is a fiftieth of all."""
    sent = []
    monkeypatch.setattr(L, "detection_input", lambda m: m)
    real = L.staged
    monkeypatch.setattr(L, "staged", lambda df, name, by=None: sent.append((name, real(df, name))) or sent[-1][1])
    long = [(i, bytearray(b"ONE"), START + i * 10_000, i * 10_000, True, False, None) for i in range(30_000)]
    short = [(i, bytearray(b"ONE"), START + (i // 40) * 10**9 + i % 40 * 10**6, i % 40 * 10**6, True, False, None) for i in range(30_000)]
    for rows, n in ((long, 1), (short, 750)):
        sent.clear()
        _, lcs = L.detect(spark.createDataFrame(rows, INPUT), block=250, small=0)
        assert lcs.count() == n and lcs.agg(F.sum("nr_msgs")).first()[0] == 30_000
        units = [df for name, df in sent if name == "units"]
        assert len(units) == 1  # nothing had to run again
        raw = units[0].groupBy("ecu", "_home").agg(F.sum(F.when(F.col("quiet"), 1).otherwise(F.col("nr_msgs"))).alias("n"))
        # the long one: the rows of its first minute and more, until its machine is sure, then one row a block
        assert raw.agg(F.max("n")).first()[0] <= (30_000 / 50 if n > 1 else 13_000)


def test_end_and_derived_values(spark):
    rows = [L.Row(0, b"E", START, 0, False, False), L.Row(1, b"E", START + 5, 0, False, False)]
    _, (lc,) = L.detect_rows(rows)
    assert lc.end == START + 5  # without an uptime, the last reception
    base = (7, bytearray(b"E\0\0\0"), 10, 10, START, START, 3 * 10**6, 0, START + 9)
    lcs = spark.createDataFrame([(*base, None, None), (8, *base[1:3], 0, START - 5, *base[5:7], 4 * 10**6, base[8], (7, 10**6, START), "V"), (1234, *base[1:3], 0, START + 50, *base[5:7], 4 * 10**6, base[8], (7, 10**6, START), None)], L._INFO)
    a, b, c = L.derived(lcs).orderBy("nr_control_req_msgs", "id").orderBy(F.when(F.col("id") == 7, 0).otherwise(1), "id").collect()
    assert (a["end_time_us"], a["suspend_duration_us"], a["resume_time_us"], a["resume_start_time_us"], a["only_control_requests"], a["is_resume"]) == (START + 9, 0, START, START, True, False)
    assert (b["end_time_us"], b["suspend_duration_us"], b["resume_time_us"], b["resume_start_time_us"], b["is_resume"]) == (START - 5 + 4 * 10**6, 0, START - 5 + 3 * 10**6, START + 1, True)
    assert (c["suspend_duration_us"], c["resume_time_us"], c["resume_start_time_us"]) == (50, START + 3 * 10**6, START + 50)
    lines = [r["line"] for r in L.report(lcs).orderBy("order_us", "id").collect()]
    assert lines[0].startswith("LC#  7: E") and " CTRL_REQUESTS_ONLY " in lines[0] and " RESUME - " in lines[1] and lines[1].endswith(" V") and lines[2].startswith("LC#1234: ")


def test_running_aggregates_over_blocks(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, rng.randrange(100)])) for k in ("a", "b") for i in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    what = {"top": ("max", F.col("v")), "low": ("min", F.col("v")), "all": ("sum", F.coalesce("v", F.lit(0))), "newest": ("last", F.col("v"))}
    for before in (False, True):
        got = {(r["k"], r["i"]): (r["top"], r["low"], r["all"], r["newest"]) for r in scan.running(df, ["k"], "i", what, 70, before).collect()}
        for k in ("a", "b"):
            mine = sorted((i, v) for c, i, v in rows if c == k)
            for n, (i, _) in enumerate(mine):
                seen = [v for _, v in mine[: n + (not before)]]
                some = [v for v in seen if v is not None]
                assert got[k, i] == (max(some, default=None), min(some, default=None), sum(some), some[-1] if some else None)
