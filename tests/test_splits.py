"""Traces in splits against one scan of the whole file, for damaged files and any size of split."""

import random
import struct

import pytest

from logweave import schema as S
from logweave.operators import ordering
from logweave.sources import datasource, splits, wire


def trace(rng, size, magic=S.STORAGE_MAGIC, damage=True, front=b""):
    """Messages of all sizes; some hold headers or whole messages, some are torn, noise and holes lie between."""
    out, n, total = [front], 0, len(front)
    while total < size:
        kind = rng.random()
        payload = rng.randbytes(rng.choice([0, 5, 40, 300, 3000, 65_000 if rng.random() < 0.1 else 200]))
        if kind < 0.03:
            payload += magic + rng.randbytes(rng.randrange(40))
        elif kind < 0.05 and out:
            payload += out[-1][:30_000]
        htyp = rng.choice([0x20, 0x21, 0x31, 0x35]) if rng.random() < 0.9 else 0x22
        head = b"".join([struct.pack(">I", 77)] * (bool(htyp & 4) + bool(htyp & 16))) + (b"\x41\x01APIDCTID" if htyp & 1 else b"")
        raw = struct.pack(">BBH", htyp, n % 256, min(65_535, 4 + len(head) + len(payload))) + head + payload
        raw = raw[:65_535]
        raw = (magic + struct.pack("<II", n, 5) + b"ECU1" if magic == S.STORAGE_MAGIC else magic) + raw
        if damage and kind > 0.97:
            raw = raw[: rng.randrange(1, len(raw))] if rng.random() < 0.5 else raw + rng.randbytes(rng.choice([1, 50, 5000]))
        if damage and kind > 0.9995:
            raw += b"\0" * rng.choice([3, 200_000])
        out.append(raw)
        total += len(raw)
        n += 1
    whole = b"".join(out)
    return whole[: rng.randrange(len(whole) - 200, len(whole))] if damage else whole


def values(m):
    return (m["reception_time_us"], bytes(m["ecu"]), m["timestamp_dms"], m["htyp"], m["mcnt"], bytes(m["payload"])) if not isinstance(m, wire.Message) else (m.reception_time_us, m.ecu, m.timestamp_dms, m.htyp, m.mcnt, m.payload)


FILES = [
    ("clean", S.STORAGE_MAGIC, False, b""),
    ("torn first message", S.STORAGE_MAGIC, True, S.STORAGE_MAGIC + b"\0" * 9),
    ("noise", S.STORAGE_MAGIC, True, b"\xef\xbb\xbf12"),
    ("zeros", S.STORAGE_MAGIC, False, b"\0" * 300_000),
    ("serial", S.SERIAL_MAGIC, True, b"x"),
]


@pytest.mark.parametrize("name,magic,damage,front", FILES)
def test_splits_give_what_a_scan_gives(spark, tmp_path, name, magic, damage, front):
    rng = random.Random(name)
    raw = trace(rng, 2_600_000, magic, damage, front)
    path = tmp_path / "a.dlt"
    path.write_bytes(raw)
    want = [values(m) for m in wire.scan(raw)]
    assert len(want) > 500
    for split in (97_000, 400_003, 1 << 20, 1 << 27):
        got = splits.read_splits(spark, [str(path)], split_bytes=split).select("src_seq", "reception_time_us", "ecu", "timestamp_dms", "htyp", "mcnt", "payload").toPandas().sort_values("src_seq").to_dict("records")
        assert [values(m) for m in got] == want, (name, split)
        assert len({m["src_seq"] for m in got}) == len(got)


def test_files_of_both_kinds_and_without_messages(spark, tmp_path):
    rng = random.Random(5)
    raws = [trace(rng, 300_000, S.STORAGE_MAGIC), trace(rng, 300_000, S.SERIAL_MAGIC), b"", b"no message here", b"\0" * (splits.PROBE + 10) + trace(rng, 100_000, S.SERIAL_MAGIC, False)]
    paths = []
    for i, raw in enumerate(raws):
        (tmp_path / str(i)).mkdir()
        paths.append(str(tmp_path / str(i) / "x.dlt"))
        (tmp_path / str(i) / "x.dlt").write_bytes(raw)
    m = ordering.numbered(splits.read_splits(spark, paths).drop("index"), ["src_stream", "src_seq"])
    got = {}
    for r in m.orderBy("index").toPandas().to_dict("records"):
        got.setdefault(r["src_stream"], []).append(values(r))
    assert got == {i: [values(x) for x in wire.scan(raw)] for i, raw in enumerate(raws) if list(wire.scan(raw))}


def test_files_belong_to_the_paths_they_were_asked_by(spark, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    for p, n in (("x.dlt", 3), ("sub/x.dlt", 5)):
        (tmp_path / p).write_bytes(b"".join(wire.write(wire.log("E", "A", "C", [i])) for i in range(n)))
    got = datasource.read_logs(spark, [str(tmp_path / "sub" / "x.dlt"), str(tmp_path / "x.dlt")]).groupBy("src_stream").count().collect()
    assert {r["src_stream"]: r["count"] for r in got} == {0: 5, 1: 3}
    place = datasource._place
    assert place("file:/a/sub/x.dlt", ["file:/a/x.dlt", "file:/a/sub/x.dlt"]) == 1 and place("file:/a/.x", ["file:/b", "file:/a"]) == 1
