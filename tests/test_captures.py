"""Captures read by byte ranges and written in chunks, against the one-task parser."""

from __future__ import annotations

import random
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewright.operators import traces as T
from tracewright.sources import capture_splits as C
from tracewright.sources import pcapng

MAC = "02:42:ac:11:00:02"
MARK = b"\x06\0\0\0"


@pytest.fixture
def ranges(spark):
    """Byte ranges of some thousands of bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def set_(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "1")

    yield set_
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def hard(seed, n=400):
    """Packets full of what begins a block: sizes that hold the separator, captures within packets, runs of separators."""
    rng = random.Random(seed)
    packets = [(i * 0.001, rng.randbytes(rng.choice([14, 15, 60, 500, 1504, 1514, 1700]))) for i in range(n)]
    inner = pcapng.render(packets[: n // 4])
    packets[n // 2] = (n // 2 * 0.001, bytes(20) + inner)
    packets[n // 2 + 1] = (packets[n // 2][0], inner[48:] + bytes(3))
    packets[n // 3] = (packets[n // 3][0], MARK * 40_000)
    packets[n // 3 + 1] = (packets[n // 3 + 1][0], bytes(14) + MARK)
    packets[0] = (0.0, MARK * 4)
    return packets


def found(spark, path):
    out = {}
    for r in C.read_packets(spark, str(path)).collect():
        out.setdefault(r.trace_id.rsplit("/", 1)[1], []).append((r.seq, r.ts, bytes(r.frame)))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("size", ["4k", "60k", "1m"])
def test_ranges_equal_one_task(spark, ranges, tmp_path, size):
    made = {"a.pcapng": hard(1), "b.pcapng": [(6e-6, bytes(14))], "c.pcapng": [(i * 0.5, random.Random(i).randbytes(1514)) for i in range(60)]}
    for name, packets in made.items():
        (tmp_path / name).write_bytes(pcapng.render(packets))
    ranges(size)
    assert C.pieces(spark, str(tmp_path)).rdd.getNumPartitions() >= {"4k": 100, "60k": 10, "1m": 1}[size]
    got = found(spark, tmp_path)
    assert got == {n: [(i, t, f) for i, (t, f) in enumerate(pcapng.parse((tmp_path / n).read_bytes()), 1)] for n in made}
    assert [s for s, _, _ in got["a.pcapng"]] == list(range(1, 401))


def block(kind, body):
    return pcapng._block(kind, body)


SECTION = block(pcapng.SECTION, struct.pack("<IHHq", pcapng.MAGIC, 1, 0, -1))
LINK = block(pcapng.INTERFACE, struct.pack("<HHI", 1, 0, 0))


def enhanced(ticks, frame=bytes(60), link=0, kept=None):
    return block(pcapng.ENHANCED, struct.pack("<IIIII", link, ticks >> 32, ticks & 0xFFFFFFFF, len(frame) if kept is None else kept, len(frame)) + frame)


MANY = b"".join(enhanced(i) for i in range(100, 400))
BAD = {
    "empty": b"",
    "no section": LINK + MANY,
    "no packets": SECTION + LINK,
    "no link": SECTION + MANY,
    "two links": SECTION + LINK + LINK + MANY,
    "a link after packets": SECTION + MANY + LINK,
    "a second link after packets": SECTION + LINK + MANY + LINK,
    "another kind of link": SECTION + block(pcapng.INTERFACE, struct.pack("<HHI", 113, 0, 0)) + MANY,
    "a second section": SECTION + LINK + MANY + SECTION + LINK + MANY,
    "simple packets": SECTION + LINK + MANY + block(pcapng.SIMPLE_PACKET, bytes(24)) + MANY,
    "obsolete packets": SECTION + LINK + MANY + block(pcapng.OBSOLETE_PACKET, bytes(40)),
    "an unknown link": SECTION + LINK + MANY + enhanced(500, link=1) + enhanced(600),
    "a short frame": SECTION + LINK + MANY + enhanced(500, bytes(13)),
    "a frame beyond its block": SECTION + LINK + MANY + enhanced(500, kept=99),
    "times going back": SECTION + LINK + MANY + enhanced(5) + MANY,
    "times going back later": SECTION + LINK + MANY + MANY,
    "cut": (SECTION + LINK + MANY)[:-6],
    "cut in a header": SECTION + LINK + MANY + enhanced(500)[:9],
    "lengths that disagree": SECTION + LINK + MANY[: 92 * 150] + enhanced(300)[:-4] + struct.pack("<I", 96) + MANY[92 * 150 :],
    "big-endian": struct.pack(">IIIHHqI", pcapng.SECTION, 28, pcapng.MAGIC, 1, 0, -1, 28),
    "not a capture": b"hello " * 1000,
}


@pytest.mark.parametrize("name", sorted(BAD))
def test_invalid_captures(spark, ranges, tmp_path, name):
    (tmp_path / "x.pcapng").write_bytes(BAD[name])
    ranges("3k")
    if name != "big-endian":
        with pytest.raises(pcapng.CaptureError):
            pcapng.parse(BAD[name])
    with pytest.raises(Exception, match="Capture|capture|cut|block|times|packet|frame"):
        C.read_packets(spark, str(tmp_path)).collect()


def test_other_blocks_and_resolutions(spark, ranges, tmp_path):
    """Blocks that aren't packets are passed over; ticks follow the interface's options."""
    options = struct.pack("<HHBxxxHHqHH", 9, 1, 9, 14, 8, 5, 0, 0)
    link = block(pcapng.INTERFACE, struct.pack("<HHI", 1, 0, 0) + options)
    names = block(4, bytes(700))
    data = SECTION + link + b"".join(enhanced(10**9 + i) + (names if i % 7 == 0 else b"") for i in range(200)) + block(5, bytes(12))
    (tmp_path / "x.pcapng").write_bytes(data)
    ranges("2k")
    assert found(spark, tmp_path)["x.pcapng"] == [(i, t, f) for i, (t, f) in enumerate(pcapng.parse(data), 1)]


def test_guesses_are_corrected():
    """A run whose guess differs from what the run before it implies is searched again; those after it wait."""
    run = lambda start, length, entry, **more: {"file": "f", "start": start, "length": length, "entry": entry, "packets": 1, "links": [], "late_link": False, "fault": None, "head": b"", "tail": b"", "whole": length - max(entry, 0)} | more
    link = struct.pack("<HHI", 1, 0, 0)
    first = run(0, 1000, 0, links=[link], tail=struct.pack("<II", 6, 300), whole=900)
    ok = C.checked([first, run(10, 500, 200)])
    assert [(r["entry"], r["owner"], r["first_seq"], r["settled"], r["fault"]) for r in ok] == [(0, None, 1, True, None), (200, 0, 3, True, None)]
    wrong = C.checked([first, run(10, 500, 40), run(20, 500, 0)])
    assert [(r["entry"], r["settled"]) for r in wrong] == [(0, True), (200, False), (None, True)]
    inside = C.checked([first | {"tail": struct.pack("<II", 6, 2000)}, run(10, 500, -1, packets=0), run(20, 500, 0), run(30, 1000, 900)])
    assert [(r["entry"], r["owner"], r["settled"]) for r in inside] == [(0, None, True), (-1, 0, True), (-1, 0, False), (900, 0, True)]
    assert C.checked([first])[0]["fault"] == "cut block"


def test_writing(spark, tmp_path):
    rng = random.Random(3)
    events = {"day 1/a": [(round(i * 0.01, 6), rng.randint(0, 1), rng.choice([14, 60, 1514, 1536])) for i in range(1000)], "b": [(0.0, 1, 60)], "c=x": [(0.3, 0, 14), (0.3, 1, 15), (1.0000019, 0, 14)]}
    traces = None
    for name, e in events.items():
        one = T.from_events(spark, name, e)
        traces = one if traces is None else traces.unionByName(one)
    place = str(tmp_path / "out")
    C.write_captures(traces.repartition(5), place, MAC, 100.0, chunk=128)
    again = C.written(spark, place, traces, MAC, 100.0)
    for name, e in events.items():
        got = T.to_events(again.where(F.col("trace_id") == name))
        assert got == pcapng.encode(e, MAC, 100.0)[1]
    files = [p for p in Path(place).rglob("part-*")]
    assert len(files) == 3 and {len(pcapng.parse(p.read_bytes())) for p in files} == {1000, 1, 3}
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        C.write_captures(traces, place, MAC, 100.0)
    for bad in ([(0.0, 0, 13)], [(101.0, 0, 60)], [(1.0, 0, 60), (0.5, 0, 60)]):
        with pytest.raises(Exception, match="encode|times"):
            C.write_captures(T.from_events(spark, "t", bad), str(tmp_path / f"bad{bad[0][2]}{bad[0][0]}"), MAC, 100.0)
        assert not list(tmp_path.glob("bad*/**/part-*"))
    with pytest.raises(pcapng.CaptureError, match="changed"):
        C.written(spark, place, traces.withColumn("frame_length", F.col("frame_length") + 1), MAC, 100.0)


def test_ipv6_text(spark):
    """Against Python's own text, but for addresses that hold an IPv4 one, which newer versions write apart."""
    import ipaddress

    from tracewright.functions.frames import ipv6_text

    rng = random.Random(4)
    made = [bytes(16), b"\xff" * 16, bytes(15) + b"\1", b"\1" + bytes(15), bytes.fromhex("20010db8000000000001000000000001"), bytes.fromhex("20010000000100000000000100000000")]
    made += [b"".join(rng.choice([b"\0\0", b"\0\0", b"\0\1", b"\x0a\xbc", b"\xff\0"]) for _ in range(8)) for _ in range(3000)]
    rows = spark.createDataFrame([(bytearray(b),) for b in made] + [(bytearray(4),), (None,)], "b binary")
    got = [(r.b, r.t) for r in rows.select("b", ipv6_text(F.col("b")).alias("t")).collect()]
    assert {t for b, t in got if b is None or len(b) != 16} == {None}
    assert all(t == str(ipaddress.IPv6Address(bytes(b))) for b, t in got if b is not None and len(b) == 16 and bytes(b[:12]) != bytes(10) + b"\xff\xff")


def test_long_trace_in_bounded_files(spark, tmp_path):
    """no file, and so no task's sort, grows with a trace; its files are read as one trace, and checked as one."""
    n, place = 1000, f"file://{tmp_path}/long"
    trace = spark.range(n).select(F.lit("a b").alias("trace_id"), (F.col("id") + 1).alias("seq"), (F.col("id") / 8).alias("ts"), (F.col("id") % 2).cast("tinyint").alias("direction"), (60 + F.col("id") * 7 % 1455).alias("frame_length"))
    C.write_captures(trace, place, MAC, 1000.0, chunk=32, part=128)
    files = [p for p in (tmp_path / "long").rglob("part-*")]
    assert sorted(p.parent.name for p in files) == sorted(f"after={i}" for i in range(0, n, 128))
    again = C.written(spark, place, trace, MAC, 1000.0)
    assert [(r.seq, r.ts) for r in again.orderBy("seq").collect()] == [(i + 1, i / 8) for i in range(n)]
    back = trace.withColumn("ts", F.when(F.col("seq") > 128, F.col("ts") - 10).otherwise(F.col("ts")))
    C.write_captures(back, f"{place}2", MAC, 1000.0, chunk=32, part=128)
    with pytest.raises(C.CaptureError, match="not decrease"):
        C.read_packets(spark, f"{place}2")
