"""Reordering with state, change feeds, progress."""

import heapq
import random
import time

import pytest
from pyspark.sql import functions as F
from test_engine import boots, table

from logweave.operators import lifecycle
from logweave.plans.service_queries import arriving, drained, in_steps
from logweave.streaming import feed, live
from logweave.streaming.reorder import ByTime, Fifo, Smallest, reordered

S = 1_000_000


def rows_of(rng, n):
    """(time, arrival, reception, ecu, lifecycle): receptions grow, delays differ."""
    t, out = 10**12, []
    for i in range(n):
        t += rng.choice([1000, 200_000, 2 * S])
        out.append((t - rng.choice([0, 0, S, 3 * S, 40 * S if rng.random() < 0.02 else 0]), i, t, rng.choice([b"E1", b"E2"]), 1 + i // 150))
    return out


def test_bounds_of_time():
    rng = random.Random(1)
    rows = rows_of(rng, 400)
    way, held, out = ByTime(10 * S), [], []
    for r in rows:
        out += way.add(held, r)
    want, rest, heap = [], None, []
    for r in rows:
        heapq.heappush(heap, r)
        while heap and heap[0][0] + 10 * S < r[2]:
            want.append(heapq.heappop(heap))
    assert out == want and list(way.rest(held)) == sorted(heap) and len(out) > 300


def test_bound_grows_with_the_delays_seen():
    """While a lifecycle's window fills, nothing goes out; then the bound is the least one and the greatest delay of the window."""
    way, held = ByTime(2 * S, 3), []
    at = 10**12
    rows = [(at + i * 1_100_000 - (700_000 if i == 4 else 100_000), i, at + i * 1_100_000, b"E", 1) for i in range(12)]
    out = [[x[1] for x in way.add(held, r)] for r in rows]
    assert out[0] == out[1] == [] and way.bound == 2 * S + 100_000
    bounds = []
    way, held = ByTime(2 * S, 3), []
    for r in rows:
        list(way.add(held, r))
        bounds.append(way.bound)
    assert bounds[0] == 2 * S + 1000 * S and bounds[4] == 2 * S + 700_000 and bounds[6] == 2 * S + 700_000 and bounds[7] == 2 * S + 100_000
    list(way.add(held, (at + 20 * S, 99, at + 20 * S, b"E", 2)))
    assert way.bound == 2 * S + 1000 * S  # a new lifecycle has a window of its own


@pytest.mark.parametrize("way", [Fifo(5), Smallest(5), ByTime(5 * S), ByTime(5 * S, 3)])
def test_state_carries_over_batches(spark, way):
    rows = rows_of(random.Random(3), 120)
    df = spark.createDataFrame([(t, i, r, bytearray(e), lc, "k" if i % 3 else "l") for t, i, r, e, lc in rows], "calculated_time_us long, index long, reception_time_us long, ecu binary, lifecycle long, src_stream string")
    got = drained(reordered(arriving(spark, in_steps(df, "rows", 4), df.schema), way), "out").orderBy("src_stream", "out_seq").select("src_stream", "index").collect()
    for key, mine in (("k", [r for r in rows if r[1] % 3]), ("l", [r for r in rows if r[1] % 3 == 0])):
        whole = type(way)(**{f: getattr(way, f) for f in ("n", "least", "window") if hasattr(way, f)})
        held, want = whole.load([]), []
        for r in mine:
            want += [x[1] for x in whole.add(held, r)]
        assert [r["index"] for r in got if r["src_stream"] == key] == want


def test_idle_streams_give_out_the_rest(spark, tmp_path):
    rows = rows_of(random.Random(3), 20)
    df = spark.createDataFrame([(t, i, r, bytearray(e), lc, "k") for t, i, r, e, lc in rows], "calculated_time_us long, index long, reception_time_us long, ecu binary, lifecycle long, src_stream string")
    out = reordered(arriving(spark, in_steps(df, "rows", 1), df.schema), Smallest(50), idle_ms=300)
    q = out.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.table("idle").count() == 20:
                break
        assert [r["index"] for r in spark.table("idle").orderBy("out_seq").collect()] == [r[1] for r in sorted(rows)]
    finally:
        q.stop()


def test_feed_folds_to_the_batch_at_every_generation(spark, tmp_path):
    m = table(spark, boots())
    stream = arriving(spark, in_steps(m, "msgs", 3), m.schema)
    seen = feed.Progress().add_to(spark)
    folder = str(tmp_path / "feed")
    changes = feed.lifecycle_changes(stream)
    feed.publish(changes, folder, str(tmp_path / "c1")).awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changes.schema) + ", generation int"
    found, top = feed.read(spark, folder, schema), m.agg(F.max("index")).first()[0] + 1
    assert found.select("generation").distinct().count() == 3
    for g in range(3):
        upto = m.where(F.col("index") < top * (g + 1) // 3)
        _, lcs = lifecycle.detect(upto)
        want = sorted((bytes(r["ecu"]), r["nr_msgs"], r["start_time_us"], r["max_timestamp_us"], r["sw_version"]) for r in lcs.collect())
        got = sorted((bytes(r["ecu"]), r["nr_msgs"], r["start_time_us"], r["max_timestamp_us"], r["sw_version"]) for r in feed.fold(found, ["ecu", "first_index"], g).collect())
        assert got == want
    whole = sorted(map(str, feed.fold(found, ["ecu", "first_index"]).collect()))
    assert feed.compact(spark, folder, schema, ["ecu", "first_index"], 1) == 1
    again = feed.read(spark, folder, schema)
    assert sorted(map(str, feed.fold(again, ["ecu", "first_index"]).collect())) == whole and again.select("generation").distinct().count() == 2
    assert any(p["rows"] == len(boots()) and p["batch"] == 2 for p in seen.latest.values())
    counts = live.statistics(arriving(spark, in_steps(m, "more", 2), m.schema))
    feed.publish(counts, str(tmp_path / "stats"), str(tmp_path / "c2")).awaitTermination()
    table_ = feed.fold(feed.read(spark, str(tmp_path / "stats"), "ecu binary, apid binary, ctid binary, nr_msgs long, generation int"), ["ecu", "apid", "ctid"])
    assert table_.agg(F.sum("nr_msgs")).first()[0] == len(boots())
    spark.streams.removeListener(seen)
