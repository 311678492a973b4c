import json

import pytest
from pyspark.sql import functions as F

from logweave.functions import columns as C
from logweave.functions.payload import log_infos, with_text
from logweave.operators import filters, lifecycle, ordering, stats
from logweave.operators.filters import EVENT, MARKER, NEGATIVE, Filter, Id
from logweave.operators.lifecycle import Row, detect_rows
from logweave.operators.plugins import anonymize, chain, export, file_transfer, from_config, model_decode, non_verbose, rewrite, someip
from logweave.plans import session, sinks
from logweave.schema import MSG_SCHEMA
from logweave.sources import wire
from logweave.streaming import live

BASE = 1_640_995_200_000_000  # 2022-01-01


def table(spark, msgs):
    for i, m in enumerate(msgs):
        m.index = i
    return spark.createDataFrame([m.row("f", 0, m.index) for m in msgs], MSG_SCHEMA)


def some(spark):
    msgs = [wire.log(f"E{i % 2}", f"A{i % 3}", "CTX", [f"text {i}"], level=1 + i % 6, reception_us=BASE + i * 1000, dms=10 * i) for i in range(12)]
    bare = wire.Message(BASE, b"E0\0\0", payload=b"\x01\0\0\0abc")
    return table(spark, [*msgs, bare])


def indexes(df):
    return sorted(r["index"] for r in df.select("index").collect())


def test_filter_truth_table(spark):
    m = with_text(some(spark)).persist()
    all_ = set(range(13))
    odd = {i for i in range(12) if i % 2}
    e1 = Filter(ecu=Id("E1"))
    assert set(indexes(filters.apply(m, [e1]))) == odd
    assert set(indexes(filters.apply(m, [Filter(NEGATIVE, ecu=Id("E1"))]))) == all_ - odd
    assert set(indexes(filters.apply(m, [Filter(negate=True, apid=Id("A1"))]))) == all_ - {1, 4, 7, 10}  # the one without header too
    assert indexes(filters.apply(m, [Filter(enabled=False, negate=True)])) == sorted(all_)  # a disabled filter does not count
    assert m.where(Filter(enabled=False, negate=True).column()).count() == 0
    assert set(indexes(filters.apply(m, [e1, Filter(EVENT, level_max=2)]))) == {1, 7}
    assert set(indexes(filters.apply(m, [e1, Filter(EVENT, level_max=2)], events=False))) == odd
    assert set(indexes(filters.apply(m, [Filter(MARKER, ecu=Id("E1"))]))) == all_
    assert indexes(filters.apply(m, [Filter(payload="TEXT 1", ignore_case=True)])) == [1, 10, 11]
    assert indexes(filters.apply(m, [Filter(payload="TEXT 1")])) == []
    assert indexes(filters.apply(m, [Filter(payload_regex="^text (?=[37])")])) == [3, 7]
    assert indexes(filters.apply(m, [Filter(ctid=Id("X$", True))])) == []  # patterns see the NUL padding
    assert indexes(filters.apply(m, [Filter(apid=Id("A[01]", True), level_min=5)])) == [4, 10]
    assert m.where(filters.combined([])).count() == 13
    m.unpersist()


def test_filter_formats():
    f = Filter.from_json('{"type":1,"ecu":"E1","apid":"A.","payload":"x","logLevelMax":3,"not":true,"lifecycles":[1,"a",-1,3],"atLoadTime":true}')
    assert f.kind == NEGATIVE and f.apid.regex and not f.ecu.regex and f.lifecycles == (1, 3) and f.negate
    assert Filter.from_json(f.to_json()) == f
    assert Filter.from_json({"type": 0, "mstp": 3}).verb_mstp_mtin == (6, 0x0E)
    assert json.loads(Filter.from_json({"type": 0, "mstp": 3}).to_json())["mstp"] == 3
    for bad in ('{"type":7}', "[]", '{"type":0,"logLevelMin":9}'):
        with pytest.raises(ValueError):
            Filter.from_json(bad)
    xml = "<dltfilter><filter><type>0</type><enablefilter>1</enablefilter><enableapplicationid>1</enableapplicationid><applicationid>APP</applicationid><enablepayloadtext>1</enablepayloadtext><payloadtext>Abc</payloadtext></filter></dltfilter>"
    (d,) = filters.from_dlf(xml)
    assert d.apid == Id("APP") and d.payload == "Abc" and d.ignore_case
    with pytest.raises(ValueError):
        filters.from_dlf("<x/>")
    assert [(f.apid, f.ctid) for f in filters.from_records("APID CTI- A--- ---- ")] == [(Id("APID"), Id("CTI")), (Id("A"), None)]
    (a, b) = filters.from_triples("E:A:C,:A.*:")
    assert a.ctid == Id("C") and b.ecu is None and b.apid.regex


LC = [
    ([(1000, 1000), (2000, 500), (2500, 1500)], 1),
    ([(1000, 1000), (3000, 1000), (4000, 500), (4500, 1500)], 2),
    ([(1000, 1000), (3000, 1000), (5000, 100), (5500, 4500), (5501, 4501)], 1),
    ([(40000, 40000), (80001, 40000), (120002, 40000), (160003, 40000)], 4),
    ([(1000, 10**10)], 1),
]


@pytest.mark.parametrize("rows,expected", LC)
def test_lifecycle_scenarios(rows, expected):
    out, lcs = detect_rows([Row(i, b"ECU1", BASE + r * 1000, t * 1000, True, False) for i, (r, t) in enumerate(rows)])
    assert len(lcs) == expected and [r.index for r in out] == list(range(len(rows))) and sum(lc.nr_msgs for lc in lcs) == len(rows)


def boots():
    msgs = []
    for ecu, shift in ((b"ECU1", 0), (b"ECU2", 7)):
        for boot in range(2):
            start = BASE + boot * 200_000_000 + shift * 1000
            msgs += [wire.log(ecu, "A", "C", [i], reception_us=start + 2_000_000 + i * 1_000_000, dms=i * 10_000) for i in range(1, 90)]
    msgs.append(wire.response(b"ECU1", "A", "C", 19, b"\0\x04\0\0\0SW 1", reception_us=BASE + 50_500_000, dms=484_000))
    return sorted(msgs, key=lambda m: m.reception_time_us)


def test_lifecycles_in_spark_in_both_modes(spark):
    m = table(spark, boots())
    for mode in ("per_ecu", "exact"):
        out, lcs = lifecycle.detect(m, mode=mode)
        rows = lcs.orderBy("id").collect()
        assert [(r["id"], bytes(r["ecu"]), r["nr_msgs"]) for r in rows] == [(1, b"ECU1", 90), (2, b"ECU2", 89), (3, b"ECU1", 89), (4, b"ECU2", 89)]
        assert [r["sw_version"] for r in rows] == ["SW 1", None, None, None]
        assert out.groupBy("lifecycle").count().count() == 4
    assert "SW 1" in lifecycle.report(lcs).where("id = 1").first()["line"]


def test_suspended_ecu_resumes():
    rows = [Row(i, b"E", BASE + (20 + i) * 10**6, (10 + i) * 10**6, True, False) for i in range(100)]
    rows += [Row(100 + i, b"E", BASE + (420 + i) * 10**6, (115 + i) * 10**6, True, False) for i in range(100)]
    _, lcs = detect_rows(rows)
    assert len(lcs) == 2 and lcs[1].resume == (1, 109 * 10**6, BASE + 10 * 10**6) and lcs[1].suspended > 0


def test_statistics(spark):
    m = some(spark)
    assert {(bytes(r["ecu"]), r["nr_msgs"]) for r in stats.by_ecu(m).collect()} == {(b"E0\0\0", 7), (b"E1\0\0", 6)}
    assert stats.by_application(m).count() == 6
    t = {bytes(r["ecu"]): r for r in stats.tree(m).collect()}
    assert t[b"E0\0\0"]["nr_msgs"] == 7 and len(t[b"E0\0\0"]["apids"]) == 3
    infos = table(spark, [wire.log_info("E0", "A1", "CTX", "first"), wire.log_info("E0", "A1", "CTX", "second"), wire.log_info("E9", "NEW", "CTX", "only described")])
    d = {(bytes(r["ecu"]), bytes(r["apid"])): r for r in stats.with_descriptions(m, log_infos(infos)).where("ctid is null and apid is not null").collect()}
    assert d[b"E0\0\0", b"A1\0\0"]["description"] == "first" and d[b"E9\0\0", b"NEW\0"]["nr_msgs"] == 0


def test_session_windows_and_searches(spark):
    s = session.from_messages(table(spark, boots()), limits=lifecycle.Limits())
    st = s.stream([Filter(ecu=Id("ECU1"))], 10, 15)
    assert [r["pos"] for r in st.window().orderBy("pos").collect()] == [10, 11, 12, 13, 14]
    assert st.change_window(0, 3).count() == 3
    found, nxt = st.search([Filter(payload="5")], 0, 4)
    assert len(found) == 4 and nxt == found[-1] + 1
    again, _ = st.search([Filter(payload="5")], nxt, 4)
    assert min(again) >= nxt
    assert st.position_of_time(0) == 0 and st.position_of_index(0) == 0
    assert s.query([Filter(ecu=Id("ECU2"))], 5, 8).count() == 3
    assert sum(len(c) for c in st.chunks(50)) == 179
    assert s.statistics().count() >= 2
    s.close()


def test_time_sort_uses_the_lifecycle_start(spark):
    s = session.from_messages(table(spark, boots()), text=False)
    rows = s.msgs.orderBy("row_pos").select("calculated_time_us", "reception_time_us").collect()
    assert all(a[0] <= b[0] for a, b in zip(rows, rows[1:], strict=False)) and all(r[0] <= r[1] for r in rows)
    assert ordering.order_violations(s.msgs).count() == 0
    s.close()


def test_writer_lines_and_rolling_files(spark, tmp_path):
    m = some(spark)
    path = str(tmp_path / "out.dlt")
    assert sinks.write_dlt(m, path) == 13
    with open(path, "rb") as f:
        back = list(wire.scan(f.read()))
    assert [x.timestamp_dms for x in back][:12] == [10 * i for i in range(12)]
    line = sinks.lines(m).where("index = 3").first()["line"]
    assert line == "3 2022/01/01 00:00:00.003000         30 000 E1-- A0-- CTX- log info V 1 [text 3]"
    assert sinks.lines(m).where("index = 12").first()["line"].endswith("--- --- N - 0 [[1] abc|]")
    assert sinks.lines(m, "hex").where("index = 12").first()["line"].endswith("[01 00 00 00 61 62 63]")
    roll = sinks.RollingFile(str(tmp_path / "cap"), 10, zipped=True)
    for _ in range(3):
        roll.write(bytes(600_000))
    roll.close()
    assert [p.rsplit("/", 1)[1] for p in roll.paths] == ["cap_001.dlt.zip", "cap_002.dlt.zip", "cap_003.dlt.zip"]


def test_native_text_agrees_with_the_decoder(spark):
    m = table(spark, [wire.Message(payload=p) for p in (b"\x01\0\0\0abc", b"\x02\0\0\0a\x01", b"ab", b"\x01\0\0\0", b"\x09\0\0\0a\r\nb")])
    for r in with_text(m).select(C.non_verbose_text().alias("a"), F.col("payload_text").alias("b")).collect():
        assert r["a"] == r["b"]
    ids = spark.createDataFrame([(bytearray(b"A\x01\xff\0"),), (bytearray(b"ABCD"),)], "x binary").select(C.id_text(F.col("x")).alias("t"), C.id_u32le(F.col("x")).alias("n"), C.id_bytes(C.id_text(F.col("x"))).alias("b"), C.hex_parse(C.hex_dump(F.col("x"))).alias("h"))
    rows = ids.collect()
    assert [r["t"] for r in rows] == ["A-?", "ABCD"] and rows[1]["n"] == int.from_bytes(b"ABCD", "little") and bytes(rows[1]["b"]) == b"ABCD" and bytes(rows[0]["h"]) == b"A\x01\xff\0"


def test_rewrite(spark):
    m = with_text(table(spark, [wire.log("E", "SYS", "JOUR", ["2022/12/31 kernel: 12.345 the text"], dms=5), wire.log("E", "X", "JOUR", ["a b 1.5 c"], dms=6)]))
    rule = (Filter(apid=Id("SYS"), ctid=Id("JOUR")), r"^.*? .*? (?<timeStamp>\d+\.\d+) (?<text>.*)$")
    rows = rewrite.apply(m, [rule]).orderBy("index").collect()
    assert [(r["payload_text"], r["timestamp_dms"]) for r in rows] == [("the text", 123_450), ("a b 1.5 c", 6)]
    assert from_config({"name": "Rewrite", "enabled": False}) is None
    with pytest.raises(ValueError):
        from_config({"name": "nothing"})


def test_anonymize_hides_all_text(spark):
    out = anonymize.anonymize(some(spark))
    assert indexes(out) == list(range(13)) and out.where(F.col("payload_text").contains("text ")).count() == 0
    assert {bytes(r["ecu"]) for r in out.select("ecu").collect()} == {b"E001", b"E002"}


FIBEX = """<fx:FIBEX xmlns:ho="http://h" xmlns:fx="http://f"><fx:ELEMENTS><fx:ECUS><fx:ECU ID="Ecu1"><fx:MANUFACTURER-EXTENSION><SW_VERSION>{version}</SW_VERSION></fx:MANUFACTURER-EXTENSION></fx:ECU></fx:ECUS>
<fx:PDUS><fx:PDU ID="P0"><ho:DESC>{text}=</ho:DESC><fx:BYTE-LENGTH>0</fx:BYTE-LENGTH></fx:PDU>
<fx:PDU ID="P1"><fx:BYTE-LENGTH>4</fx:BYTE-LENGTH><fx:SIGNAL-INSTANCES><fx:SIGNAL-INSTANCE><fx:SIGNAL-REF ID-REF="S_SINT32"/></fx:SIGNAL-INSTANCE></fx:SIGNAL-INSTANCES></fx:PDU></fx:PDUS>
<fx:FRAMES><fx:FRAME ID="ID_77"><fx:BYTE-LENGTH>4</fx:BYTE-LENGTH><fx:PDU-INSTANCES><fx:PDU-INSTANCE><fx:PDU-REF ID-REF="P0"/></fx:PDU-INSTANCE><fx:PDU-INSTANCE><fx:PDU-REF ID-REF="P1"/></fx:PDU-INSTANCE></fx:PDU-INSTANCES>
<fx:MANUFACTURER-EXTENSION><MESSAGE_INFO>DLT_LOG_WARN</MESSAGE_INFO><APPLICATION_ID>HLD</APPLICATION_ID></fx:MANUFACTURER-EXTENSION></fx:FRAME></fx:FRAMES></fx:ELEMENTS></fx:FIBEX>"""


def test_non_verbose_dictionary(spark, tmp_path):
    (tmp_path / "old.xml").write_text(FIBEX.format(version="1.0.0", text="old"))
    (tmp_path / "new.xml").write_text(FIBEX.format(version="1.0.10", text="new"))
    m = table(spark, [wire.Message(ecu=b"Ecu1", payload=b"\x4d\0\0\0\xfe\xff\xff\xff"), wire.Message(ecu=b"Ecu1", payload=b"\x4d\0\0\0\xfe"), wire.Message(ecu=b"Ecu2", payload=b"\x4d\0\0\0\0\0\0\0")])
    rows = from_config({"name": "NonVerbose", "fibexDir": str(tmp_path)})(m).orderBy("index").collect()
    assert rows[0]["payload_text"] == "new= -2" and rows[0]["ext"]["verb_mstp_mtin"] == 0x30 and bytes(rows[0]["ext"]["apid"]) == b"HLD\0"
    assert "needs 4 bytes" in rows[1]["payload_text"] and rows[2]["payload_text"] is None


MODEL = {
    "map": {"9": {"0": "base", "42": "other"}},
    "interfaces": {
        "base": {"name": "I", "id": 9, "attributes": [{"name": "App", "id": 5, "type": "struct", "elements": [{"name": "Ready", "type": "Boolean"}]}]},
        "other": {"name": "I", "id": 9, "attributes": [{"name": "Arr", "id": 5, "type": "array", "size": 0, "max_size": 3, "array_type": {"name": "n", "type": "UInt8"}}], "methods": [{"name": "call", "id": 6, "in_args": [{"name": "e", "type": "enumeration", "baseType": "UInt8", "values": {"ON": 1}}], "out_args": []}]},
    },
}


def test_model_decoding_follows_the_announced_model(spark):
    def msg(member, raw):
        return wire.log("E", "A", "MMSG", ["p", ("u", 32, 1), ("u", 32, 2), ("u", 32, 3), ("u", 32, 0), "i", "[x]", ("u", 32, 9), ("u", 32, member), "C", ("u", 8, 2), ("u", 8, 0), raw])

    config = wire.log("E", "A", "MDLT", ["Version: 1, git: abc, model hash: 42"])
    m = table(spark, [msg(5, b"\x01"), config, msg(5, b"\0\0\0\x02\x07\x08"), msg(6, b"\x01"), msg(99, b"")])
    texts = [r["payload_text"] for r in model_decode.decode(m, model_decode.Model([MODEL])).orderBy("index").collect()]
    head = "p 1 2 3 0 i [x] 9 {} C 2 0 "
    assert texts[0] == head.format(5) + "App(struct) = [Ready(Boolean) = 1]"
    assert texts[2] == head.format(5) + "Arr(array) = [n(UInt8) = 7, n(UInt8) = 8]"
    assert texts[3] == head.format(6) + "call(e(enumeration) = ON)" and texts[1] is None and texts[4] is None


def u(n, bits=32):
    return ("u", bits, n)


def transfer(serial, data, size=None, drop=(), start=True, end=True):
    parts = [data[i : i + 3] for i in range(0, len(data), 3)]
    out = [wire.log("E", "S", "F", ["FLST", u(serial), "dir/f.bin", u(len(data) if size is None else size), "now", u(len(parts)), u(3), "FLST"])] if start else []
    out += [wire.log("E", "S", "F", ["FLDA", u(serial), u(i + 1), p, "FLDA"]) for i, p in enumerate(parts) if i not in drop]
    return out + ([wire.log("E", "S", "F", ["FLFI", u(serial), "FLFI"])] if end else [])


def test_file_transfers(spark, tmp_path):
    error = wire.log("E", "S", "F", ["FLER", 5, 7, u(4), "a", "b", "c", "d", "e", "FLER"], level=2)
    m = table(spark, [*transfer(1, b"abcdefgh"), *transfer(2, b"abcdefgh", drop=(1,)), *transfer(3, b"abcdef", start=False), *transfer(4, b"abc", end=False)[:1], error])
    found = {r["serial"]: r for r in file_transfer.transfers(m).collect()}
    assert {k: r["state"] for k, r in found.items()} == {1: "Complete", 2: "Incomplete", 3: "Complete", 4: "Error"}
    assert bytes(found[1]["data"]) == b"abcdefgh" and found[3]["name"] == "<missing_flst>" and (found[4]["code"], found[4]["errno"]) == (5, 7)
    t = file_transfer.transfers(m)
    saved = file_transfer.save(t, str(tmp_path), "*.bin")
    assert [p.rsplit("/", 1)[1] for p in saved] == ["f.bin"] and file_transfer.save(t, str(tmp_path), "*.bin") == []
    assert file_transfer.without_data(m).count() == m.count() - 3 - 2 - 2
    assert sinks.transfer_report(t).count() == 4


def test_someip_segments(spark):
    def nw(*values):
        out = wire.log("E", "S", "TC", list(values))
        v, n, a, c = out.ext
        out.ext = (1 | 2 << 1 | 1 << 4, n, a, c)
        return out

    raw = bytes.fromhex("12340001000000080000000101010200") + b"\xaa\xbb"
    head = bytes(8) + b"\x07"
    m = table(spark, [nw("NWST", u(9), head, u(18), u(2, 16), u(10, 16)), nw("NWCH", u(9), u(0, 16), raw[:10]), nw("NWCH", u(9), u(1, 16), raw[10:]), nw("NWEN", u(9)), nw("NWEN", u(8)), nw(head, raw)])
    texts = [r["payload_text"] for r in someip.decode(m, {0x1234: ("Svc", {1: "get"})}).orderBy("index").collect()]
    assert texts[3] == texts[5] == "notification Svc[7].get (0000:0001) v1 rc=0 aa bb" and "unknown id" in texts[4] and texts[1].endswith("NWCH 9 (0)")


def test_can_frames_are_bound_by_the_first_announced_name(spark):
    from logweave.operators.plugins import can
    from logweave.sources import text_formats as T

    lines = ["date Mon Feb 13 08:22:30.000 pm 2023", "//BusMapping: CAN 1 = Body_CAN", " 0.100000 1  10 Rx   d 2 05 01  Length = 0"]
    m = table(spark, list(T.read_asc(lines)))
    channels = {"Body": {0x10: ("Speed", [can.Signal("v", 0, 8), can.Signal("w", 8, 8)])}}
    assert can.decode(m, channels).where("index = 1").first()["payload_text"] == "Speed [0x10] v=5, w=1"


def test_export_keeps_information_first(spark):
    m = table(spark, [wire.log_info("E", "A", "C", "d"), wire.log("E", "A", "C", ["x"], reception_us=5), wire.log("E", "B", "C", ["y"], reception_us=50)])
    out = export.select(with_text(m), [Filter(apid=Id("B"))], first_us=10)
    assert [(r["index"], r["info_first"]) for r in out.orderBy("index").collect()] == [(0, True), (2, False)]


def test_chain_applies_in_order(spark):
    m = some(spark)
    assert chain(m, [lambda d: d.where("index < 5"), lambda d: d.withColumn("index", F.col("index") + 100)]).agg(F.max("index")).first()[0] == 104


def test_streaming_gives_what_batch_gives(spark, tmp_path):
    import pandas as pd

    msgs = boots()
    raw = [wire.write(m)[16:] for m in msgs]
    whole = b"".join(raw)
    cuts = [whole[i : i + 1000] for i in range(0, len(whole), 1000)]  # packets do not respect messages
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        part = list(enumerate(cuts))[k * len(cuts) // 2 : (k + 1) * len(cuts) // 2]
        pd.DataFrame([("host", BASE, i, d) for i, d in part], columns=["sender", "received_us", "seq", "data"]).to_parquet(folder / f"{k}.parquet")
    src = live.read_folder(spark, str(folder))
    q = live.messages(src).writeStream.format("memory").queryName("got").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("got").orderBy("index").collect()
    assert [bytes(r["payload"]) for r in got] == [m.payload for m in msgs]
    table(spark, msgs).repartition(1).write.parquet(str(tmp_path / "msgs"))
    stream = spark.readStream.schema(MSG_SCHEMA).parquet(str(tmp_path / "msgs"))
    q = live.lifecycles(stream).writeStream.format("memory").queryName("lcs").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.table("lcs")
    assert out.count() > 100 and out.select("ecu", "key").distinct().count() == 4
    q = live.statistics(stream).writeStream.format("memory").queryName("st").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("st").agg(F.sum("nr_msgs")).first()[0] == len(msgs)
