"""CAN signals as expressions against arithmetic on whole payloads; FIBEX codings."""

import random

from pyspark.sql import functions as F

from logweave.operators.plugins import can

FIBEX = """<fx:FIBEX xmlns:fx="f" xmlns:ho="h"><fx:ELEMENTS>
<fx:CHANNEL ID="c"><ho:SHORT-NAME>Body</ho:SHORT-NAME><fx:FRAME-TRIGGERING ID="t"><fx:IDENTIFIER><fx:IDENTIFIER-VALUE>0x40</fx:IDENTIFIER-VALUE></fx:IDENTIFIER><fx:FRAME-REF ID-REF="f1"/></fx:FRAME-TRIGGERING></fx:CHANNEL>
<fx:FRAME ID="f1"><ho:SHORT-NAME>Speed</ho:SHORT-NAME><fx:PDU-INSTANCE><fx:PDU-REF ID-REF="p1"/></fx:PDU-INSTANCE></fx:FRAME>
<fx:PDU ID="p1"><fx:SIGNAL-INSTANCES>
<fx:SIGNAL-INSTANCE ID="i1"><fx:BIT-POSITION>0</fx:BIT-POSITION><fx:BIT-LENGTH>8</fx:BIT-LENGTH><fx:SIGNAL-REF ID-REF="s1"/></fx:SIGNAL-INSTANCE>
<fx:SIGNAL-INSTANCE ID="i2"><fx:BIT-POSITION>8</fx:BIT-POSITION><fx:BIT-LENGTH>8</fx:BIT-LENGTH><fx:IS-HIGH-LOW-BYTE-ORDER>true</fx:IS-HIGH-LOW-BYTE-ORDER><fx:SIGNAL-REF ID-REF="s2"/></fx:SIGNAL-INSTANCE></fx:SIGNAL-INSTANCES></fx:PDU>
<fx:SIGNAL ID="s1"><ho:SHORT-NAME>temp</ho:SHORT-NAME><fx:CODING-REF ID-REF="k1"/></fx:SIGNAL><fx:SIGNAL ID="s2"><ho:SHORT-NAME>mode</ho:SHORT-NAME><fx:CODING-REF ID-REF="k2"/></fx:SIGNAL>
</fx:ELEMENTS><fx:PROCESSING-INFORMATION><ho:UNIT ID="u1"><ho:SHORT-NAME>deg</ho:SHORT-NAME><ho:DISPLAY-NAME>C</ho:DISPLAY-NAME></ho:UNIT>
<fx:CODING ID="k1"><ho:CODED-TYPE ho:BASE-DATA-TYPE="A_INT8"/><ho:COMPU-METHODS><ho:COMPU-METHOD><ho:CATEGORY>LINEAR</ho:CATEGORY><ho:UNIT-REF ID-REF="u1"/><ho:COMPU-SCALE><ho:COMPU-RATIONAL-COEFFS><ho:COMPU-NUMERATOR><ho:V>10</ho:V><ho:V>1</ho:V></ho:COMPU-NUMERATOR><ho:COMPU-DENOMINATOR><ho:V>2</ho:V></ho:COMPU-DENOMINATOR></ho:COMPU-RATIONAL-COEFFS></ho:COMPU-SCALE></ho:COMPU-METHOD></ho:COMPU-METHODS></fx:CODING>
<fx:CODING ID="k2"><ho:CODED-TYPE ho:BASE-DATA-TYPE="A_UINT8"/><ho:COMPU-METHODS><ho:COMPU-METHOD><ho:CATEGORY>TEXTTABLE</ho:CATEGORY><ho:COMPU-SCALE><ho:LOWER-LIMIT>1</ho:LOWER-LIMIT><ho:UPPER-LIMIT>1</ho:UPPER-LIMIT><ho:COMPU-CONST><ho:VT>on</ho:VT></ho:COMPU-CONST></ho:COMPU-SCALE></ho:COMPU-METHOD>
<ho:COMPU-METHOD><ho:CATEGORY>IDENTICAL</ho:CATEGORY><ho:INTERNAL-CONSTRS><ho:SCALE-CONSTR VALIDITY="NOT-VALID"><ho:LOWER-LIMIT>255</ho:LOWER-LIMIT><ho:UPPER-LIMIT>255.0</ho:UPPER-LIMIT></ho:SCALE-CONSTR></ho:INTERNAL-CONSTRS></ho:COMPU-METHOD></ho:COMPU-METHODS></fx:CODING>
</fx:PROCESSING-INFORMATION></fx:FIBEX>"""


def value(s, data):
    if s.bit + s.bits > 8 * len(data):
        return None
    whole = int.from_bytes(data, "big" if s.big_endian else "little")
    raw = whole >> (8 * len(data) - s.bit - s.bits if s.big_endian else s.bit) & (1 << s.bits) - 1
    return raw - (1 << s.bits) if raw >> s.bits - 1 and (s.signed or s.bits == 64) else raw


def test_bits_of_both_orders(spark):
    rng = random.Random(1)
    signals = [can.Signal(str(i), rng.randrange(70), rng.choice([1, 3, 8, 12, 16, 31, 32, 33, 57, 60, 63, 64]), rng.random() < 0.5, rng.random() < 0.5) for i in range(60)]
    datas = [rng.randbytes(n) for n in (0, 1, 2, 7, 8, 9, 17, 64) for _ in range(3)] + [b"\xff" * 12]
    table = can.frames(spark, {"c": {1: ("f", signals)}}).crossJoin(spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(datas)], "i long, data binary"))
    for r in table.select("i", can.raw_values(F.col("data"), F.col("signals")).alias("raw")).collect():
        assert r["raw"] == [value(s, datas[r["i"]]) for s in signals]


def test_codings_of_a_dictionary(spark, tmp_path):
    (tmp_path / "a.xml").write_text(FIBEX)
    found = can.load([str(tmp_path / "a.xml")])
    name, (temp, mode) = found["Body"][0x40]
    assert name == "Speed" and (temp.signed, temp.factor, temp.offset, temp.unit) == (True, 0.5, 5.0, "C") and mode.texts == {1: "on"} and mode.invalid == ((255.0, 255.0),) and mode.big_endian
    data = F.unhex(F.col("d"))
    rows = spark.createDataFrame([("FE01",), ("0A02",), ("00FF",), ("05",)], "d string").crossJoin(can.frames(spark, found))
    text = F.zip_with("signals", can.raw_values(data, F.col("signals")), lambda s, raw: F.concat(s["name"], F.lit("="), can.shown(s, raw)))
    got = {r["d"]: r["t"] for r in rows.select("d", text.alias("t")).collect()}
    assert got == {"FE01": ["temp=4.0 C", "mode=on"], "0A02": ["temp=10.0 C", "mode=2"], "00FF": ["temp=5.0 C", "mode=invalid"], "05": ["temp=7.5 C", None]}
    assert can.metadata(found)[0]["children"][0]["children"][1]["texts"] == {1: "on"}
