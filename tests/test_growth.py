"""Work that has to spread over tasks however large the tables, and however few their files and keys, are."""

from pyspark.sql import functions as F

from logweave import schema as S
from logweave.operators.plugins import can, someip
from logweave.plans import codec_queries as C
from logweave.plans import format_queries as Q
from logweave.sources import text_formats, wire

SF = "/root/testdata/sf0.001"


def _rows(spark, msgs):
    return spark.createDataFrame([m.row() for m in msgs], S.MSG_SCHEMA)


def test_can_frames_stay_where_they_are(spark):
    lines = ["date Mon Jan 01 12:00:00.000 am 2024", "//BusMapping: CAN 1 = Body", " 1.000000 1  40  Rx   d 2 05 01  Length = 1"]
    m = _rows(spark, text_formats.read_asc(lines))
    out = can.decode(m, {"Body": {0x40: ("Speed", [can.Signal("v", 0, 8)])}})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan
    assert [r[0] for r in out.where("payload_text is not null").select("payload_text").collect()] == ["Speed [0x40] v=5"]


def test_can_lines_read_fast_are_as_read_field_by_field(monkeypatch):
    heads = ["1.000000", " -1.000000", "1.00000", "١.000000", "1.000000 CANFD"]
    rest = ["1 40 Rx d 2 05 01 x", "1 40x Tx d 2 05 0g x", "300 xx Rx d 2 05 01 ", "1 40 Rx d 2 05 01", "1 4G Rx d 1 01 x", "1 40 Rx d 2x 05 01 x", "1\t40 Rx d 1  A1 x", "1 40 Rq d 1 01 x", "a 40 Rx d 1 01 x", "1 Rx 40 1 0 8 2 05 01 x", "1 40 Rx d 0 x"]
    lines = [f"{h} {r}" for h in heads for r in rest] + ["", "date x", "// 1.0"]

    def read():
        return [(c, c and c.frame is not None and c.payload(x)) for x in lines for c in [text_formats.CanLine.parse(x)]]

    fast = read()
    monkeypatch.setattr(text_formats, "_FRAME", text_formats.re.compile(r"(?!)"))
    assert fast == read() and sum(c is not None for c, _ in fast) > 10


def test_events_of_one_file_are_encoded_by_many_tasks(spark):
    m = Q.read_back(spark, SF, lambda e: [Q._log(e)])
    assert m.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    assert m.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_batches_hold_null_headers_and_no_rows():
    some = [wire.Message(5, b"ECU1", 1, 0x20, 2, 4, None, b"x", None, 0, 7), wire.Message(5, b"ECU1", 1, 0x21, 2, 4, (1, 2, b"APID", b"CTID"), b"", "t", 0, 8)]
    got = S.as_batch([m.row() for m in some]).to_pylist()
    assert got[0]["ext"] is None and got[1]["ext"] == {"verb_mstp_mtin": 1, "noar": 2, "apid": b"APID", "ctid": b"CTID"}
    assert S.as_batch([]).num_rows == 0


def test_segments_are_read_in_one_pass(spark):
    def piece(index, values):
        m = wire.log(b"ECU1", b"NW\0\0", b"TC\0\0", values, 4, 0)
        m.ext, m.index = (1 | S.MSTP_NW_TRACE << 1 | 1 << 4, len(values), b"NW\0\0", b"TC\0\0"), index
        return m

    u = lambda n, x: ("u", n, x)
    raw = bytes.fromhex("00050006 0000000a 0001 0002 01 01 00 00 aabb")
    other = wire.log(b"ECU1", b"APID", b"CTID", ["hello"], 4, 0)
    other.index = 9
    whole = piece(8, [bytes(8) + b"\x07", raw])
    steps = [piece(0, ["NWST", u(32, 3), bytes(8) + b"\x07", u(32, len(raw)), u(16, 2), u(16, 10)]), piece(2, ["NWCH", u(32, 3), u(16, 0), raw[:10]]), piece(4, ["NWCH", u(32, 3), u(16, 1), raw[10:]]), piece(6, ["NWEN", u(32, 3)])]
    m = _rows(spark, [*steps, whole, other]).withColumn("more", F.col("index") * 2)
    out = someip.decode(m, {5: ("svc", {6: "go"})})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan and out.schema.names == m.schema.names
    got = {r["index"]: (r["payload_text"], r["more"]) for r in out.collect()}
    text = "request svc[7].go (0001:0002) v1 rc=0 aa bb"
    assert len(got) == 6 and got[6] == (text, 12) and got[8] == (text, 16) and got[9] == (None, 18)


def test_a_trace_is_written_by_many_tasks(spark, monkeypatch):
    written = []
    parts = Q._parts
    monkeypatch.setattr(Q, "_parts", lambda m, name: written.append(parts(m, name)) or written[-1])
    monkeypatch.setattr(Q, "EACH", 100)
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    got = Q.read_files(spark, SF).select("src_stream", "index").collect()
    assert sorted(map(tuple, got)) == [(k, i) for k in range(2) for i in range((n + 1 - k) // 2)]
    assert Q.read_file_ranges(spark, SF).count() == n
    # files of a trace, and their number, grow with the events
    assert [len(w) >= 5 for w in written] == [True] * 3
    assert {p.rsplit("/", 1)[1] for p in written[0]} == {p.rsplit("/", 1)[1] for p in written[1]}


def test_texts_are_cut_before_they_are_encoded(spark):
    out = C.file_reassembly(spark, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Generate explode")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    both = docs.join(out, "doc_id", "full").where("state = 'Complete' and sha = sha2(t, 256) and size = octet_length(t)")
    assert both.count() == docs.count()


def test_a_generation_is_many_files(spark):
    from logweave.plans import service_queries

    for top, each in ((900, 50), (900, 1000)):
        df = spark.range(top).select(F.col("id").alias("index"))
        seen = []
        stream = service_queries.in_generations(df, "t", each=each)
        path = spark.conf.get("spark.checkpoint.dir") + f"/generations-{each}"

        def note(batch, _):
            seen.append((batch.count(), batch.agg(F.min("index")).first()[0]))

        stream.writeStream.foreachBatch(note).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
        assert seen == [(300, 0), (300, 300), (300, 600)]
    gappy = spark.createDataFrame([(0,), (1,), (900,)], "index long")
    assert service_queries.drained(service_queries.in_generations(gappy, "g", each=1), "gappy").count() == 3
