"""Queries over readers, decoders and filter formats: the events are written in a format, read back by the operator, and compared with the SQL of the events."""

from __future__ import annotations

import struct
import uuid
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..functions.payload import log_infos, with_text
from ..operators import filters, lifecycle, ordering, stats
from ..operators.filters import Filter
from ..operators.plugins import can, export, model_decode, non_verbose, someip
from ..operators.scan import hadoop, shared_dir, staged
from ..schema import MSG_SCHEMA
from ..sources import binary_formats, datasource, splits, text_formats, wire
from . import sinks
from .adapter import SQL, messages
from .queries import I, ids

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
US = 1_000_000
DAY = 86_400 * US
EACH = 200_000  # events that a task encodes, at most about that many
BASE = 1_704_067_200 * US  # the first of January 2024
TEXT = "txt || ' ' || idx AS payload_text"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH {SQL}{'' if sql[0] == ',' else chr(10)}{sql}"
        return f

    return add


def spread(msgs: DataFrame, order: list | None = None) -> DataFrame:
    """msgs over as many tasks as they need, however few their files have: encoding costs more than moving the rows once. order: dealt out in ranges of it."""
    n = max(msgs.sparkSession.sparkContext.defaultParallelism, msgs.count() // EACH + 1)
    return msgs.repartitionByRange(n, *order) if order else msgs.repartition(n, "index")


def read_back(spark: SparkSession, sf: str, messages_of: Callable[[tuple], Iterable[wire.Message]], order: list | None = None) -> DataFrame:
    """The messages that messages_of(event) gives; index becomes the event's, and order is spread()'s. An event is a tuple: index (e[0]), us, ecu, apid, ctid, level, mcnt, text."""

    def run(batches):
        for b in batches:
            rows, event = [], namedtuple("event", b.schema.names)
            for e in map(event, *(c.to_pylist() for c in b.columns)):
                for m in messages_of(e):
                    m.index = e[0]
                    rows.append(m.row("memory", 0, m.index))
            yield S.as_batch(rows)

    m = spread(messages(spark, sf), order)
    level = F.shiftright(F.col("ext.verb_mstp_mtin").cast("int"), 4)
    src = m.select("index", F.col("reception_time_us").alias("us"), "ecu", "ext.apid", "ext.ctid", level.alias("level"), "mcnt", F.col("payload_text").alias("text"))
    return src.mapInArrow(run, MSG_SCHEMA)


def _log(e, values: list | None = None) -> wire.Message:
    m = wire.log(bytes(e.ecu), bytes(e.apid), bytes(e.ctid), [e.text, ("u", 64, e[0])] if values is None else values, int(e.level), int(e.us), 0, int(e.mcnt))
    return m


def _bare(m: wire.Message) -> bytes:
    """A message without storage header, whose own header names the ECU."""
    raw = wire.write(m)[16:]
    return bytes([raw[0] | S.HTYP_ECU, raw[1]]) + (len(raw) + 4).to_bytes(2, "big") + m.ecu + raw[4:]


@query(f"SELECT {I}, level::BIGINT AS level, {TEXT} FROM m")
def serial_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Serial headers, with other bytes before and behind that the scan has to pass."""

    def read(e):
        raw = b"noise" + S.SERIAL_MAGIC + _bare(_log(e)) + b"DL" + S.SERIAL_MAGIC + _bare(_log(e))
        return list(wire.scan(raw))[:1]

    return ids(with_text(read_back(spark, sf, read)), C.log_level().cast("long").alias("level"), "payload_text")


@query(f"SELECT {I}, rt AS reception_time_us, {TEXT} FROM m")
def bare_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Messages without any leading header, as they come over a network."""
    return ids(with_text(read_back(spark, sf, lambda e: [wire.read_bare(_bare(_log(e)), reception_us=int(e.us))[1]])), "reception_time_us", "payload_text")


@query(f"SELECT {I}, rt // {US} * {US} + rt % {US} AS reception_time_us, {TEXT} FROM m")
def resync_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A file whose first message is cut off: the scan finds the next one."""

    def read(e):
        raw = wire.write(_log(e))
        return list(wire.scan(raw[5:] + raw + raw[: len(raw) // 2]))[:1]

    return ids(with_text(read_back(spark, sf, read)), "reception_time_us", "payload_text")


@query(f"SELECT idx AS index, 'CAN1' AS ecu, {BASE} + rt % {DAY} AS reception_time_us, (rt % {DAY}) // 100 AS timestamp_dms, (idx % 2048)::BIGINT AS frame, idx % 251 * 65536 + (idx // 7) % 256 * 256 + level AS data FROM m")
def asc_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    def read(e):
        t, i = int(e.us) % DAY, int(e[0])
        line = f" {t // US}.{t % US:06d} 1  {i % 2048:x}             Rx   d 3 {i % 251:02x} {i // 7 % 256:02x} {int(e.level):02x}  Length = 1"
        return text_formats.read_asc(["date Mon Jan 01 12:00:00.000 am 2024", "base hex", line])

    m = read_back(spark, sf, read)
    frame = F.conv(F.hex(F.concat(*[F.substring("payload", 4 - k, 1) for k in range(4)])), 16, 10).cast("long")
    return m.select("index", C.id_text(F.col("ecu")).alias("ecu"), "reception_time_us", "timestamp_dms", frame.alias("frame"), F.conv(F.hex(F.substring("payload", 5, 3)), 16, 10).cast("long").alias("data"))


@query(f"SELECT idx AS index, 'LC01' AS ecu, left(apid, 3) || '_' AS tag4, rt - {BASE} AS reception_time_us, (rt - {BASE}) // 100 % 4294967296 AS timestamp_dms, level::BIGINT AS level, '7 8 ' || CASE level WHEN 2 THEN 'E' WHEN 3 THEN 'W' WHEN 4 THEN 'I' WHEN 5 THEN 'D' ELSE 'V' END || ' ' || left(apid, 3) || '_ : ' || txt AS payload_text FROM m")
def logcat_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    def read(e):
        t = int(e.us) - BASE
        got = text_formats.read_logcat([f"{t // US}.{t % US:06d} 7 8 {'?FEWIDV'[int(e.level)]} {bytes(e.apid)[:3].decode()}_ : {e.text}"])
        return list(got)[1:]

    m = read_back(spark, sf, read)
    return m.select("index", C.id_text(F.col("ecu")).alias("ecu"), C.id_text(F.col("ext.apid")).alias("tag4"), "reception_time_us", "timestamp_dms", C.log_level().cast("long").alias("level"), "payload_text")


@query(f"SELECT idx AS index, rt // 1000 * 1000 AS reception_time_us, level::BIGINT AS level FROM m WHERE rt >= {BASE + DAY}")
def logcat_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates without a year are those of the reference's year."""

    def read(e):
        t = datetime(1970, 1, 1) + timedelta(microseconds=int(e.us))
        if int(e.us) < BASE + DAY:
            return []
        return list(text_formats.read_logcat([f"{t:%m-%d %H:%M:%S}.{t.microsecond // 1000:03d}  7  8 {'?FEWIDV'[int(e.level)]} tag: {e.text}"], ref=date(2024, 12, 31)))[1:]

    return read_back(spark, sf, read).select("index", "reception_time_us", C.log_level().cast("long").alias("level"))


@query("SELECT idx AS index, 'GL01' AS ecu, rt // 1000 * 1000 AS reception_time_us, level::BIGINT AS level, txt AS payload_text, left(apid, 4) AS apid FROM m")
def genlog_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    words = ("", "FAT", "ERR", "WRN", "INF", "DBG", "VER")

    def read(e):
        t = datetime(1970, 1, 1) + timedelta(microseconds=int(e.us))
        return list(text_formats.read_genlog(["not a line", f"[{t:%Y-%m-%d %H:%M:%S}.{t.microsecond // 1000:03d}] [{words[int(e.level)]}] [{bytes(e.apid).decode()}] {e.text}"]))[1:]

    m = read_back(spark, sf, read)
    return m.select("index", C.id_text(F.col("ecu")).alias("ecu"), "reception_time_us", C.log_level().cast("long").alias("level"), "payload_text", C.id_text(F.col("ext.apid")).alias("apid"))


@query("SELECT idx AS index, 'ev' || left(lower(apid), 2) AS snake, left(apid, 1) || substr(lower(apid), 2, 2) || 'E' AS camel FROM m")
def tag_abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    """Initials of the parts, or capitals, filled up from the left."""

    def both(parts):
        for p in parts:
            p["snake"] = [text_formats.abbreviation(f"ev_{a.lower()}") for a in p["apid"]]
            p["camel"] = [text_formats.abbreviation(f"{a.capitalize()}Event") for a in p["apid"]]
            yield p[["index", "snake", "camel"]]

    return messages(spark, sf).select("index", C.id_text(F.col("ext.apid")).alias("apid")).mapInPandas(both, "index long, snake string, camel string")


def _blf(objects: list[bytes]) -> bytes:
    import zlib

    head = b"LOGG" + struct.pack("<I", 144) + bytes(32) + struct.pack("<8H", 2024, 1, 0, 1, 0, 0, 0, 0) + bytes(88)
    inner = b"".join(objects)
    data = zlib.compress(inner)
    size = 32 + len(data)
    return head + b"LOBJ" + struct.pack("<HHII", 16, 1, size, 10) + struct.pack("<HHIII", 2, 0, 0, len(inner), 0) + data + bytes(size % 4)


def _object(kind: int, ns: int, body: bytes) -> bytes:
    return b"LOBJ" + struct.pack("<HHII", 32, 1, 32 + len(body), kind) + struct.pack("<IHHQ", 2, 0, 0, ns) + body


@query(f"SELECT idx AS index, 'CAN1' AS ecu, (rt % {DAY}) // 100 AS timestamp_dms, lpad(lower(to_hex(idx % 251)), 2, '0') || lpad(lower(to_hex(level)), 2, '0') AS data FROM m")
def blf_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Compressed containers with a channel's name and a CAN frame each."""
    xml = b'<channels><channel number="1" type="CAN" network="Body"/></channels>\0'

    def read(e):
        ns, i = int(e.us) % DAY * 1000, int(e[0])
        frame = struct.pack("<HBBI", 1, 0, 2, i % 2048) + bytes([i % 251, int(e.level)]) + bytes(6)
        return list(binary_formats.read_blf(_blf([_object(65, 0, struct.pack("<IIII", 2, 0, len(xml), 0) + xml), _object(86, ns, frame)])))[1:]

    m = read_back(spark, sf, read)
    return m.select("index", C.id_text(F.col("ecu")).alias("ecu"), "timestamp_dms", F.lower(F.hex(F.substring("payload", 5, 8))).alias("data"))


def _udp(data: bytes, flags: int = 0, offset: int = 0) -> bytes:
    """An Ethernet frame with (a fragment of) a datagram to the log port."""
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(data), 1, flags | offset // 8, 9, 17, 0) + b"\x0a\0\0\1\x0a\0\0\2"
    return bytes(12) + b"\x08\x00" + ip + data


def _capture(frames: list[bytes], us: int) -> bytes:
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", us // US, us % US, len(f), len(f)) + f for f in frames)


@query(f"SELECT {I}, rt AS reception_time_us, {TEXT} FROM m")
def pcap_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Captured datagrams with a message each."""

    def read(e):
        raw = _bare(_log(e))
        return binary_formats.read_pcap(_capture([_udp(struct.pack(">HHHH", 1, binary_formats.PORT, 8 + len(raw), 0) + raw)], int(e.us)))

    return ids(with_text(read_back(spark, sf, read)), "reception_time_us", "payload_text")


@query(f"SELECT {I}, {TEXT} FROM m")
def pcap_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """The datagram comes in two fragments, its message in two datagrams' worth of bytes."""

    def read(e):
        raw = _bare(_log(e))
        data = struct.pack(">HHHH", 1, binary_formats.PORT, 8 + len(raw), 0) + raw
        return binary_formats.read_pcap(_capture([_udp(data[:24], 0x2000), _udp(data[24:], 0, 24)], int(e.us)))

    return ids(with_text(read_back(spark, sf, read)), "payload_text")


@query("""SELECT idx AS index, CASE idx % 4 WHEN 0 THEN '[get_software_version ok] ' || txt WHEN 1 THEN '[timezone ok] {"gmt_off_secs":' || (idx % 3600 - 1800) || ',"is_dst":' || (idx % 3 = 0)::VARCHAR || '}'
  WHEN 2 THEN '[unregister_context ok] {"apid":"' || apid || '","comid":"remo","ctid":"' || ctid || '"}' ELSE '[set_log_level not_supported] ' END AS payload_text FROM m""")
def control_texts(spark: SparkSession, sf: str) -> DataFrame:
    def read(e):
        i, a, c = int(e[0]), bytes(e.apid), bytes(e.ctid)
        service, body = [
            (S.GET_SOFTWARE_VERSION, b"\0" + struct.pack("<I", len(e.text)) + e.text.encode()),
            (S.TIMEZONE, b"\0" + struct.pack("<iB", i % 3600 - 1800, i % 3 == 0)),
            (S.UNREGISTER_CONTEXT, b"\0" + a + c + b"remo"),
            (S.SET_LOG_LEVEL, b"\1"),
        ][i % 4]
        return wire.scan(wire.write(wire.response(bytes(e.ecu), a, c, service, body, int(e.us))))

    return with_text(read_back(spark, sf, read)).select("index", "payload_text")


@query("SELECT idx AS index, ecu, apid, ctid, txt AS description FROM m UNION ALL SELECT idx, ecu, apid, NULL, NULL FROM m")
def log_info_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    def read(e):
        a, text = bytes(e.apid), e.text.encode()
        body = b"\7" + struct.pack("<H", 1) + a + struct.pack("<H", 1) + bytes(e.ctid) + struct.pack("<bbH", 4, 0, len(text)) + text + struct.pack("<H", 0)
        return wire.scan(wire.write(wire.response(bytes(e.ecu), b"DA1\0", b"DC1\0", S.GET_LOG_INFO, body, int(e.us))))

    found = log_infos(read_back(spark, sf, read))
    return found.select("index", *[C.id_text(F.col(c)).alias(c) for c in ("ecu", "apid", "ctid")], "description")


@query(f"SELECT {I} FROM m WHERE level <= 4 AND regexp_matches(ecu, '00[1-3]') AND NOT (apid = 'SIGN')")
def filters_from_json(spark: SparkSession, sf: str) -> DataFrame:
    texts = ['{"type": 0, "ecu": "00[1-3]", "logLevelMax": 4}', '{"type": 1, "apid": "SIGN"}', '{"type": 0, "enabled": false, "apid": "VIEW"}']
    read = [Filter.from_json(Filter.from_json(t).to_json()) for t in texts]  # once round, so that the writer is tried too
    return ids(filters.apply(messages(spark, sf), read))


@query(f"SELECT {I} FROM m WHERE (apid = 'VIEW' OR contains(lower(txt), '\"k\": 1')) AND NOT (ecu = 'E004')")
def filters_from_dlf(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda kind, **more: f"<filter><type>{kind}</type><enablefilter>1</enablefilter>{''.join(f'<{k}>{v}</{k}>' for k, v in more.items())}</filter>"
    xml = "<dltfilter>" + one(0, enableapplicationid=1, applicationid="VIEW") + one(0, enablepayloadtext=1, payloadtext='"K": 1') + one(1, enableecuid=1, ecuid="E004") + "</dltfilter>"
    return ids(filters.apply(messages(spark, sf), filters.from_dlf(xml)))


@query(f"SELECT {I} FROM m WHERE (apid = 'VIEW' AND ctid = 'C001') OR apid = 'ERRO'")
def filters_from_records(spark: SparkSession, sf: str) -> DataFrame:
    return ids(filters.apply(messages(spark, sf), filters.from_records("VIEW C001 ERRO ---- ")))


@query(f"SELECT {I} FROM m WHERE (ecu = 'E001' AND apid = 'VIEW') OR regexp_matches(ctid, 'C00[23]')")
def filters_from_triples(spark: SparkSession, sf: str) -> DataFrame:
    return ids(filters.apply(messages(spark, sf), filters.from_triples("E001:VIEW,::C00[23]")))


@query("SELECT idx AS index, ecu, 'NVAP' AS apid, 'NVCT' AS ctid, 4::BIGINT AS level, 'count is ' || (idx % 1000 - 500) || ' ' || (idx % 2 = 1)::VARCHAR AS payload_text FROM m WHERE idx % 3 = 0")
def non_verbose_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of a dictionary: a static text, a signed and a boolean signal."""
    parts = [(S.TI_STRG | S.SCOD_UTF8, 0, "count is"), (S.TI_SINT | 2, 2, None), (S.TI_BOOL | 1, 1, None)]
    frame = non_verbose.Frame(3, (4 << 4, 0, b"NVAP", b"NVCT"), parts)
    found = non_verbose.Dictionary({(b"E%03d" % k, 77): frame for k in range(10)}, [], {}, [])

    def read(e):
        i = int(e[0])
        m = _log(e)
        m.ext, m.payload, m.htyp = None, struct.pack("<IhB", 77 if i % 3 == 0 else 78, i % 1000 - 500, i % 2), m.htyp & ~1
        return [m]

    m = non_verbose.decode(read_back(spark, sf, read), found).where("payload_text is not null")
    return ids(m, C.log_level().cast("long").alias("level"), "payload_text")


_CAN_SIGNALS = [
    can.Signal("v", 0, 12), can.Signal("on", 12, 4, texts={2: "error", 3: "paid"}), can.Signal("be", 16, 12, big_endian=True), can.Signal("t", 28, 12, big_endian=True, signed=True, factor=0.5, offset=-40.0, unit="C"),
    can.Signal("n", 40, 7, signed=True, invalid=((63, 63),)), can.Signal("wide", 3, 60), can.Signal("past", 60, 8),
]


@query("""SELECT idx AS index, 'Speed [0x40] v=' || (idx % 4096) || ', on=' || CASE level WHEN 2 THEN 'error' WHEN 3 THEN 'paid' ELSE level::VARCHAR END || ', be=' || (idx * 7 % 4096) || ', t=' || ((CASE WHEN idx * 5 % 4096 >= 2048 THEN idx * 5 % 4096 - 4096 ELSE idx * 5 % 4096 END) * 0.5 - 40)::DOUBLE
  || ' C, n=' || CASE WHEN idx % 128 = 63 THEN 'invalid' ELSE (CASE WHEN idx % 128 >= 64 THEN idx % 128 - 128 ELSE idx % 128 END)::VARCHAR END
  || ', wide=' || ((idx % 4096 + level * 4096 + (idx * 7 % 4096 // 16) * 65536 + ((idx * 7 % 16) * 16 + idx * 5 % 4096 // 256) * 16777216 + (idx * 5 % 256) * 4294967296 + (idx % 128) * 1099511627776 + 17::BIGINT * 281474976710656 + 1::BIGINT * 72057594037927936) // 8) AS payload_text FROM m""")
def can_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of both byte orders over byte ends, scaled, signed, with text tables and invalid values; all in native expressions."""
    table = {"Body": {0x40: ("Speed", _CAN_SIGNALS)}}

    def read(e):
        i, us = int(e[0]), int(e.us) % DAY
        word, big = i % 4096 | int(e.level) << 12, i * 7 % 4096 << 12 | i * 5 % 4096
        data = bytes([word & 255, word >> 8, big >> 16, big >> 8 & 255, big & 255, i % 128, 17, 1])
        lines = ["date Mon Jan 01 12:00:00.000 am 2024", "//BusMapping: CAN 1 = Body", f" {us // US}.{us % US:06d} 1  40  Rx   d 8 {data.hex(' ')}  Length = 1"]
        return text_formats.read_asc(lines)

    found = can.decode(staged(read_back(spark, sf, read), "can"), table)  # two passes read it
    return found.where("ext.noar = 2 and length(payload) = 12").select("index", "payload_text")


@query("SELECT idx AS index, 'request svc[7].go (0001:' || lpad(lower(to_hex(idx % 65536)), 4, '0') || ') v1 rc=0 ' || lpad(lower(to_hex(idx % 251)), 2, '0') || ' ' || lpad(lower(to_hex(level)), 2, '0') AS payload_text FROM m")
def segment_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    """A SOME/IP message in two pieces between a start and an end, put together by its segment id."""

    def read(e):
        i = int(e[0])
        raw = struct.pack(">HHIHHBBBB", 5, 6, 10, 1, i % 65536, 1, 1, 0, 0) + bytes([i % 251, int(e.level)])
        u = lambda n, x: ("u", n, x)
        steps = [["NWST", u(32, i), bytes(8) + b"\7", u(32, len(raw)), u(16, 2), u(16, 10)], ["NWCH", u(32, i), u(16, 0), raw[:10]], ["NWCH", u(32, i), u(16, 1), raw[10:]], ["NWEN", u(32, i)]]
        for k, values in enumerate(steps):
            m = wire.log(bytes(e.ecu), b"NW\0\0", b"TC\0\0", values, 4, int(e.us))
            m.ext = (1 | S.MSTP_NW_TRACE << 1 | 1 << 4, len(values), b"NW\0\0", b"TC\0\0")
            m.mcnt = k
            yield m

    m = read_back(spark, sf, read).withColumn("index", F.col("index") * 4 + F.col("mcnt"))
    found = someip.decode(m, {5: ("svc", {6: "go"})})
    return found.where("mcnt = 3").select((F.col("index") / 4).cast("long").alias("index"), "payload_text")


@query("SELECT idx AS index, 'set(v(UInt16) = ' || (idx % 65536) || ', on(Boolean) = ' || (idx % 2) || ')' AS payload_text FROM m")
def model_decode_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The last argument of a call, read by the method of an interface whose version the ECU announced."""
    method = {"id": 9, "name": "set", "in_args": [{"name": "v", "type": "UInt16"}, {"name": "on", "type": "Boolean"}]}
    model = model_decode.Model([{"map": {"3": {"11": "I.v11"}}, "interfaces": {"I.v11": {"methods": [method]}}}])

    def read(e):
        i = int(e[0])
        first = wire.log(bytes(e.ecu), b"MUN\0", b"MDLT", ["Version: 1.0, git: abc, model hash: 11"], 4, int(e.us))
        call = wire.log(bytes(e.ecu), b"MUN\0", b"MMSG", [*["x"] * 7, ("u", 32, 3), ("u", 32, 9), *["x"] * 3, struct.pack(">HB", i % 65536, i % 2)], 4, int(e.us))
        first.mcnt, call.mcnt = 0, 1
        return [first, call]

    m = read_back(spark, sf, read).withColumn("index", F.col("index") * 2 + F.col("mcnt"))
    found = model_decode.decode(m, model).where("mcnt = 1")
    text = F.regexp_extract("payload_text", r"(set\(.*\))$", 1)
    return found.select((F.col("index") / 2).cast("long").alias("index"), text.alias("payload_text"))


@query(f"SELECT {I}, false AS info_first FROM u WHERE level <= 4 AND lc BETWEEN 20 AND 59 AND rt BETWEEN {BASE + DAY} AND {BASE + 19 * DAY}")
def export_select(spark: SparkSession, sf: str) -> DataFrame:
    keep = spark.range(20, 60)
    return ids(export.select(messages(spark, sf, True), [Filter(level_max=4)], keep, BASE + DAY, BASE + 19 * DAY), "info_first")


@query("SELECT idx AS index, strlen(txt)::BIGINT AS size FROM m WHERE strlen(txt) > 0")
def ascii_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The text of a line behind its header, between brackets."""
    got = sinks.lines(read_back(spark, sf, lambda e: [_log(e, [e.text])]))
    return got.select("index", F.length(F.regexp_extract("line", r"(?s) \[(\{.*\})\]$", 1)).cast("long").alias("size"))


@query("SELECT idx AS index, idx % 2 = 0 AS big_endian, true AS has_ext, idx % 3 = 0 AS has_session, (idx % 8)::BIGINT AS version, idx % 5 = 1 AS request, idx % 5 = 2 AS response FROM m")
def header_flags(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("index")
    htyp = F.lit(1) + F.when(i % 2 == 0, S.HTYP_BIG_ENDIAN).otherwise(0) + F.when(i % 3 == 0, S.HTYP_SESSION).otherwise(0) + (i % 8) * 32
    vmm = F.when(i % 5 == 1, S.MSTP_CONTROL << 1 | S.MTIN_REQUEST << 4).when(i % 5 == 2, S.MSTP_CONTROL << 1 | S.MTIN_RESPONSE << 4).otherwise(F.col("ext.verb_mstp_mtin"))
    m = messages(spark, sf).withColumn("htyp", htyp.cast("short")).withColumn("ext", F.col("ext").withField("verb_mstp_mtin", vmm.cast("short")))
    flags = [C.has_flag(f).alias(n) for f, n in ((S.HTYP_BIG_ENDIAN, "big_endian"), (S.HTYP_EXT, "has_ext"), (S.HTYP_SESSION, "has_session"))]
    return m.select("index", *flags, C.version().cast("long").alias("version"), C.is_ctrl_request().alias("request"), C.is_ctrl_response().alias("response"))


@query("SELECT idx AS index, left(apid, (idx % 4 + 1)::INT) AS shown, list_sum(list_transform(range(1, least(4, idx % 4 + 1) + 1), lambda k: ascii(substr(apid, k, 1)) * pow(256, k - 1)))::BIGINT AS number, NULL::VARCHAR AS bad FROM m")
def id_display(spark: SparkSession, sf: str) -> DataFrame:
    """Ids from text, shown again, and as a little-endian number; text beyond ASCII is no id."""
    m = messages(spark, sf).withColumn("t", F.expr("left(decode(ext.apid, 'ISO-8859-1'), int(index % 4 + 1))"))
    own = C.id_bytes(F.col("t"))
    return m.select("index", C.id_text(own).alias("shown"), C.id_u32le(own).alias("number"), C.id_text(C.id_bytes(F.concat(F.lit("ä"), "t"))).alias("bad"))


@query("SELECT idx AS index, txt AS back, NULL::VARCHAR AS bad FROM m")
def hex_parse_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    dump = C.hex_dump(F.encode("payload_text", "UTF-8"))
    text = lambda c: F.decode(C.hex_parse(c), "UTF-8")
    return messages(spark, sf).select("index", text(dump).alias("back"), text(F.concat(dump, F.lit(" "))).alias("bad"))


@query(f"SELECT idx AS index, CASE WHEN idx % 3 = 0 THEN rt ELSE least(rt, {BASE} + idx * 100) END AS calculated_time_us FROM m")
def service_times(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of unknown lifecycles stand at their reception."""
    m = messages(spark, sf).withColumns({"lifecycle": F.when(F.col("index") % 3 == 0, 99).otherwise(1).cast("long"), "timestamp_dms": F.col("index")})
    lcs = spark.range(1, 2).select("id", F.lit(BASE).alias("start_time_us"))
    return ordering.time_sort(m, lcs, unknown_at_reception=True).select("index", "calculated_time_us")


@query(f", l AS (SELECT idx AS id, {BASE} + idx % 97 * 1000 AS s FROM m), r AS (SELECT l.id, CASE WHEN l.id % 4 = 3 THEN greatest(l.s, o.s + 1) ELSE l.s END AS k FROM l LEFT JOIN l o ON o.id = l.id - 1) SELECT id, (row_number() OVER (ORDER BY k, id))::BIGINT AS place FROM r")
def resumed_lifecycles(spark: SparkSession, sf: str) -> DataFrame:
    """A resumed lifecycle stands behind where it came from, whatever its own start."""
    start = lambda i: F.lit(BASE) + i % 97 * 1000
    l = messages(spark, sf).select(F.col("index").alias("id"), start(F.col("index")).alias("start_time_us"))  # noqa: E741
    resume = F.struct((F.col("id") - 1).alias("id"), F.lit(0).cast("long").alias("max_timestamp_us"), start(F.col("id") - 1).alias("start_time_us"))
    l = l.withColumn("resume", F.when(F.col("id") % 4 == 3, resume))  # noqa: E741
    return ordering.numbered(ordering.resumed_order(l), ["order_us", "id"], "place").select("id", (F.col("place") + 1).alias("place"))


@query("SELECT idx AS first_index, 'E001 LC#7 f' || idx || '.bin ' || idx || ' ' || CASE WHEN idx % 3 = 0 THEN 'Error(-2, 5)' ELSE 'Complete' END AS line FROM m")
def transfer_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    bad = F.col("index") % 3 == 0
    found = m.select(F.col("index").alias("first_index"), F.lit(b"E001").alias("ecu"), F.lit(7).alias("lifecycle"), F.concat(F.lit("f"), "index", F.lit(".bin")).alias("name"), F.col("index").alias("size"), F.when(bad, "Error").otherwise("Complete").alias("state"), F.lit(-2).alias("code"), F.lit(5).alias("errno"))
    return sinks.transfer_report(found)


def _parts(msgs: DataFrame, name: str) -> list[str]:
    """Binary traces written by executors, one for each partition, in the shared folder: their paths in order."""
    spark, folder = msgs.sparkSession, f"{shared_dir(msgs.sparkSession)}/logweave-{uuid.uuid4().hex}/{name}"
    sinks.write_parts(msgs, folder)
    fs, at = hadoop(spark, folder)
    fs.deleteOnExit(at)
    return sorted(str(f.getPath().toString()) for f in fs.listStatus(at) if str(f.getPath().getName()).endswith(".dlt"))


@query(f"SELECT (row_number() OVER (ORDER BY idx) - 1)::BIGINT AS index, ecu, apid, ctid, {TEXT} FROM m")
def read_file_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Traces read in splits whose ends lie anywhere in their messages."""
    paths = _parts(read_back(spark, sf, lambda e: [_log(e)], ["index"]), "long")
    m = ordering.numbered(splits.read_splits(spark, paths, split_bytes=1 << 20).drop("index"), ["src_stream", "src_seq"])
    return ids(with_text(m), "payload_text")


@query(f"SELECT (idx % 2)::INT AS src_stream, row_number() OVER (PARTITION BY idx % 2 ORDER BY idx) - 1 AS index, ecu, apid, ctid, {TEXT} FROM m")
def read_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one base name in different folders are streams of their own; those of a folder follow one another as one trace."""
    events = read_back(spark, sf, lambda e: [_log(e)], ["index"])
    events = staged(events.withColumn("_trace", F.col("index") % 2), "two")
    n = max(2, spark.sparkContext.defaultParallelism // 2, events.count() // (2 * EACH) + 1)
    paths = []
    for k in range(2):
        # a range of the events is a file: no task writes or reads a whole trace
        paths.append(_parts(events.where(F.col("_trace") == k).drop("_trace").repartitionByRange(n, "index"), f"trace{k}"))
    m = staged(datasource.read_logs(spark, paths[0] + paths[1]), "read").withColumn("_trace", (F.col("src_stream") >= len(paths[0])).cast("int"))
    upto = Window.partitionBy("_trace").orderBy("src_stream").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    before = m.groupBy("_trace", "src_stream").agg(F.count("*").alias("_n")).select("src_stream", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    m = m.join(F.broadcast(before), "src_stream").withColumns({"index": F.col("index") + F.col("_before"), "src_stream": F.col("_trace")})
    return ids(with_text(m), "src_stream", "payload_text")


@query("SELECT k AS text, regexp_matches(k, '[\\^$*+?()\\[\\]{}|.\\-\\\\=!<>,]') AS special FROM (SELECT DISTINCT unnest([event_type, event_type || '.*', event_type || '-', '{' || event_type]) AS k FROM events)")
def regex_characters(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an id given in a filter is meant as a pattern."""
    kinds = spark.read.parquet(f"{sf}/events.parquet").select("event_type").distinct()
    k = F.col("event_type")
    texts = kinds.select(F.explode(F.array(k, F.concat(k, F.lit(".*")), F.concat(k, F.lit("-")), F.concat(F.lit("{"), k))).alias("text"))
    return texts.select("text", filters.regex_chars_in(F.col("text")).alias("special"))


@query(", c AS (SELECT ecu, apid, ctid, count(*) AS n FROM m GROUP BY ALL) SELECT ecu, apid, ctid, n AS nr_msgs, sum(n) OVER (PARTITION BY ecu, apid)::BIGINT AS app_msgs, sum(n) OVER (PARTITION BY ecu)::BIGINT AS ecu_msgs FROM c")
def stats_tree_flat(spark: SparkSession, sf: str) -> DataFrame:
    """The nested statistics, taken apart again."""
    apps = stats.tree(messages(spark, sf)).select("ecu", F.col("nr_msgs").alias("ecu_msgs"), F.explode("apids").alias("a"))
    ctx = apps.select("ecu", "ecu_msgs", "a.apid", F.col("a.nr_msgs").alias("app_msgs"), F.explode("a.ctids").alias("c"))
    return ctx.select(*[C.id_text(F.col(x)).alias(y) for x, y in (("ecu", "ecu"), ("apid", "apid"), ("c.ctid", "ctid"))], F.col("c.nr_msgs").alias("nr_msgs"), "app_msgs", "ecu_msgs")


HOUR = 3600 * US


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The events of each ECU in their order, 40 to a session of 40 s; sessions begin 10 hours apart."""
    m = messages(spark, sf)
    n = F.row_number().over(Window.partitionBy("ecu").orderBy("index")) - 1
    m = m.withColumn("_n", n).withColumn("timestamp_dms", (F.col("_n") % 40 * 10_000).cast("long"))
    start = BASE + F.floor(F.col("_n") / 40) * 10 * HOUR
    m = m.withColumn("reception_time_us", (start + F.col("timestamp_dms") * 100).cast("long")).withColumn("htyp", F.lit(0x35).cast("short"))
    return m.withColumn("payload", F.lit(None).cast("binary")).drop("_n")


_SESSIONS = f", n AS (SELECT ecu, idx, row_number() OVER (PARTITION BY ecu ORDER BY idx) - 1 AS n FROM m), s AS (SELECT ecu, n // 40 AS g, count(*) AS nr_msgs, {BASE} + n // 40 * {10 * HOUR} AS start_time_us, (count(*) - 1) * {US} AS max_timestamp_us, min(idx) AS f FROM n GROUP BY ecu, n // 40)"


@query(f"{_SESSIONS} SELECT ecu, nr_msgs, start_time_us::BIGINT AS start_time_us, max_timestamp_us::BIGINT AS max_timestamp_us, start_time_us::BIGINT + max_timestamp_us::BIGINT AS last_reception_time_us FROM s")
def lifecycle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Boots far apart: one lifecycle for each, with its start, length and messages."""
    _, lcs = lifecycle.detect(_sessions(spark, sf))
    return lcs.select(C.id_text(F.col("ecu")).alias("ecu"), "nr_msgs", "start_time_us", "max_timestamp_us", "last_reception_time_us")


@query(f"{_SESSIONS}, o AS (SELECT *, row_number() OVER (ORDER BY f) AS id FROM s) SELECT n.idx AS index, o.id AS lifecycle FROM n JOIN o ON n.ecu = o.ecu AND n.n // 40 = o.g")
def lifecycle_assigned(spark: SparkSession, sf: str) -> DataFrame:
    """Every message has its lifecycle; ids are dense in the order of first messages."""
    out, _ = lifecycle.detect(_sessions(spark, sf))
    return out.select("index", "lifecycle")


@query(f"{_SESSIONS} SELECT ecu, count(*) AS lines, count(DISTINCT start_time_us) AS starts FROM s GROUP BY ecu")
def lifecycle_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The report's lines: ECU and start are read from them."""
    _, lcs = lifecycle.detect(_sessions(spark, sf))
    got = lifecycle.report(lcs).select(F.regexp_extract("line", r"^LC# *\d+: (.{4}) (\S+ \S+) -", 1).alias("ecu"), F.regexp_extract("line", r"^LC# *\d+: (.{4}) (\S+ \S+) -", 2).alias("start"))
    return got.groupBy("ecu").agg(F.count("*").alias("lines"), F.count_distinct("start").alias("starts"))
