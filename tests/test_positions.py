"""Positions, sessions over them, merges by blocks, patterns that Java refuses."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_engine import boots, some, table

from logweave.operators import filters, ordering
from logweave.operators.filters import Filter, Id
from logweave.operators.positions import Cursor, Positions
from logweave.plans import session


def laid_out(spark, n=500, parts=7):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(20)]), i // 3) for i in rng.sample(range(n * 2), n)]
    return sorted(rows), Positions.build(spark.createDataFrame(rows, "i long, v long, t long"), ["i"], ["t", "v"], "pos", parts)


def test_positions_pages_and_bounds(spark):
    rows, p = laid_out(spark)
    assert len(p) == 500 and 1 < len(p.ranges) <= 7
    assert [(r["pos"], r["i"]) for r in p.rows().orderBy("pos").collect()] == [(k, r[0]) for k, r in enumerate(rows)]
    for a, b in ((0, 3), (120, 200), (490, 700), (5, 5)):
        assert [r["i"] for r in p.page(a, b).orderBy("pos").collect()] == [r[0] for r in rows[a:b]]
    for t in (-1, 0, 100, 333, 10**6):
        assert p.lower_bound("t", t).first()["position"] == sum(r[2] < t for r in rows)
        assert p.lower_bound("v", t).first()["position"] == sum(r[1] is not None and r[1] < t for r in rows)
    plan = p.lower_bound("t", 100)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"_part#\d+ (?:IN|INSET|=)|PartitionFilters: \[_part", plan)) >= 1


def test_positions_of_a_filtered_view(spark):
    rows, p = laid_out(spark)
    even = [r for r in rows if r[0] % 2 == 0]
    view = p.filtered(F.col("i") % 2 == 0, "n")
    assert len(view) == len(even)
    assert [(r["n"], r["i"]) for r in view.page(40, 90).orderBy("n").collect()] == [(k, even[k][0]) for k in range(40, 90)]
    assert view.lower_bound("t", 120).first()["position"] == sum(r[2] < 120 for r in even)
    again = view.filtered(F.col("i") % 3 == 0, "m")
    assert [r["i"] for r in again.rows().orderBy("m").collect()] == [r[0] for r in even if r[0] % 3 == 0]


def test_searches_and_cursors(spark):
    rows, p = laid_out(spark)
    hits = [k for k, r in enumerate(rows) if r[1] == 7]
    got, at = [], 0
    while at is not None:
        found, at = p.search(F.col("v") == 7, at, 4)
        got += found
    assert got == hits
    both = p.search_all({"a": F.col("v") == 7, "b": F.col("v").isNull(), "c": F.lit(False)}, 50, 3)
    assert both["a"][0] == [h for h in hits if h >= 50][:3] and both["b"][0] == [k for k, r in enumerate(rows) if r[1] is None and k >= 50][:3] and both["c"] == ([], None)
    cursor, seen = Cursor(), []
    while cursor is not None:
        page, cursor = p.query(F.col("v") < 5, cursor, 17)
        seen += sorted(r["pos"] for r in page.collect())
    assert seen == [k for k, r in enumerate(rows) if r[1] is not None and r[1] < 5]


def test_empty_positions(spark):
    p = Positions.build(spark.createDataFrame([], "i long, t long"), ["i"], ["t"])
    assert len(p) == 0 and p.page(0, 9).count() == 0 and p.search(F.lit(True)) == ([], None) and p.lower_bound("t", 5).first()["position"] == 0
    assert p.filtered(F.lit(True), "n").rows().count() == 0 and p.query(F.lit(True))[1] is None


def test_session_over_positions(spark):
    s = session.from_messages(table(spark, boots()))
    st = s.stream([Filter(ecu=Id("ECU1"))], 10, 15)
    rows = s.msgs.where("ecu = 'ECU1'").orderBy("row_pos").select("index", "calculated_time_us").collect()
    assert [r["index"] for r in st.window().orderBy("pos").collect()] == [r[0] for r in rows[10:15]]
    assert st.position_of_index(rows[40][0]) == 40
    other = s.msgs.where("ecu = 'ECU2'").orderBy("row_pos").select("index", "calculated_time_us").collect()[33]
    assert st.position_of_index(other[0]) == sum(r[1] < other[1] for r in rows)
    with pytest.raises(session.Unknown):
        st.position_of_index(10**9)
    plain = s.stream()
    assert plain.position_of_index(other[0]) == s.msgs.where(F.col("index") == other[0]).first()["row_pos"]
    assert set(st.search_all({"x": [Filter(payload="5")], "y": []}, 0, 2)) == {"x", "y"}
    first, cursor = s.continue_query([Filter(ecu=Id("ECU2"))], Cursor(), 100)
    rest, end = s.continue_query([Filter(ecu=Id("ECU2"))], cursor, 100)
    assert first.count() == 100 and rest.count() == 78 and end is None
    s.pause()
    with pytest.raises(session.Paused):
        st.search([])
    s.resume()
    assert st.search([], 0, 3)[0] == [0, 1, 2]
    s.close()
    assert not s.streams


def test_unsorted_session_stands_by_index(spark):
    s = session.from_messages(table(spark, boots()), sort=False)
    assert [r["index"] for r in s.msgs.orderBy("row_pos").limit(5).collect()] == [0, 1, 2, 3, 4]
    assert s.stream([Filter(ecu=Id("ECU2"))]).position_of_index(0) == 0


@pytest.mark.parametrize("block", [3, 1000])
def test_merge_of_one_long_stream(spark, block):
    rng = random.Random(block)
    rows = [(k, i, rng.randrange(200)) for k, n in ((0, 300), (1, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "src_stream int, src_seq long, reception_time_us long").withColumn("index", F.lit(0))
    got = [(r["src_stream"], r["src_seq"]) for r in ordering.merge(df, block).orderBy("index").collect()]
    heads, want = {0: 0, 1: 0}, []
    while heads:  # a heap of the streams' heads
        k = min(heads, key=lambda k: (next(r[2] for r in rows if r[:2] == (k, heads[k])), k))
        want.append((k, heads[k]))
        heads[k] += 1
        if heads[k] == (300, 20)[k]:
            del heads[k]
    assert got == want


def test_patterns_that_java_refuses_match_nothing(spark):
    m = some(spark).withColumn("payload_text", F.lit("Ωx"))
    assert filters.apply(m, [Filter(payload_regex="([")]).count() == 0
    assert filters.apply(m, [Filter(negate=True, payload_regex="([")]).count() == 13
    assert filters.apply(m, [Filter(payload_regex=r"\p{Greek}x")]).count() == 13
    assert filters.apply(m, [Filter(ecu=Id("E[", True))]).count() == 0
