"""Captures, artifacts, headers, configuration, stages and streams."""

from __future__ import annotations

import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_models import EVENTS
from tracewright.functions import frames
from tracewright.operators import traces as T
from tracewright.plans import config, stages
from tracewright.sources import artifacts, headers, inspection, pcapng
from tracewright.streaming import rates

MAC = "02:42:ac:11:00:02"


def raw(blocks: list[tuple[int, bytes]], order: str = "<") -> bytes:
    """A capture by hand, independent of the writer."""
    out = b""
    for kind, body in blocks:
        body += bytes(-len(body) % 4)
        out += struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)
    return out


def section(order="<"):
    return 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)


def packet(ts: int, frame: bytes, order="<"):
    return 6, struct.pack(order + "IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(frame), len(frame)) + frame


def test_parse_by_hand():
    for order in "<>":
        link = (1, struct.pack(order + "HHI", 1, 0, 0) + struct.pack(order + "HHB3x", 9, 1, 9) + struct.pack(order + "HH", 0, 0))
        data = raw([section(order), link, packet(1_500_000_000, bytes(14), order), (5, bytes(12)), packet(2_000_000_000, bytes(20), order)], order)
        assert pcapng.parse(data) == [(1.5, bytes(14)), (2.0, bytes(20))]


@pytest.mark.parametrize(
    "blocks",
    [
        [section()],
        [section(), (1, struct.pack("<HHI", 1, 0, 0))],
        [section(), (1, struct.pack("<HHI", 113, 0, 0)), packet(1, bytes(14))],
        [section(), (1, struct.pack("<HHI", 1, 0, 0)), packet(1, bytes(13))],
        [section(), (1, struct.pack("<HHI", 1, 0, 0)), packet(2, bytes(14)), packet(1, bytes(14))],
        [section(), (1, struct.pack("<HHI", 1, 0, 0)), (3, bytes(20))],
        [section(), (1, struct.pack("<HHI", 1, 0, 0)), (1, struct.pack("<HHI", 1, 0, 0)), packet(1, bytes(14))],
    ],
)
def test_bad_captures(blocks):
    with pytest.raises(pcapng.CaptureError):
        pcapng.parse(raw(blocks))


def test_cut_capture():
    data = raw([section(), (1, struct.pack("<HHI", 1, 0, 0)), packet(1, bytes(14))])
    with pytest.raises(pcapng.CaptureError):
        pcapng.parse(data[:-3])


def test_encode_quantizes_and_reads_back():
    data, again = pcapng.encode([(0.0, 0, 60), (0.3, 1, 64), (1.0000019, 0, 14)], MAC, 2.0)
    assert again == [(0.0, 0, 60), (0.3, 1, 64), (1.000001, 0, 14)] and pcapng.parse(data)[0][1][:6] == bytes.fromhex("020000000001")
    with pytest.raises(ValueError, match="window"):
        pcapng.encode([(3.0, 0, 60)], MAC, 2.0)


def test_spark_readers(spark, tmp_path):
    data, again = pcapng.encode([(0.5, 0, 60), (1.5, 1, 64)], MAC, 2.0)
    (tmp_path / "a.pcapng").write_bytes(data)
    (tmp_path / "b.pcapng").write_bytes(data)
    t = pcapng.read_trace(spark, str(tmp_path), MAC)
    assert t.count() == 4 and T.to_events(t.where(F.col("trace_id").endswith("a.pcapng"))) == again
    pcapng.register(spark)
    rows = spark.read.format("pcapng").load(str(tmp_path)).orderBy("trace_id", "seq").collect()
    assert [(r.seq, r.ts, len(r.frame)) for r in rows] == [(1, 0.5, 60), (2, 1.5, 64)] * 2


def test_inspection(spark):
    ip4 = bytes.fromhex("450000280000000040060000c0a80001c0a80002") + bytes(20)
    ip6 = bytes.fromhex("6000000000081140") + bytes.fromhex("20010db8000000000000000000000001") + bytes.fromhex("fe800000000000000000000000000001") + bytes(8)
    arp = bytes.fromhex("0001080006040001") + bytes(6) + bytes([10, 0, 0, 1]) + bytes(6) + bytes([10, 0, 0, 2])
    target, peer = bytes.fromhex("0242ac110002"), bytes.fromhex("020000000001")
    made = [(peer + target + b"\x08\x00" + ip4), (target + peer + b"\x86\xdd" + ip6), (target + peer + b"\x08\x06" + arp), (target + peer + b"\x08\x00" + ip4[:10])]
    rows = spark.createDataFrame([("t", i, float(i), bytearray(f)) for i, f in enumerate(made, 1)], pcapng.PACKETS)
    got = {(r.dimension, r.key): r["count"] for r in inspection.inspect(rows, MAC).collect()}
    assert got["direction", "outbound"] == 1 and got["direction", "inbound"] == 3
    assert (got["protocol", "tcp"], got["protocol", "other"]) == (1, 3 - (got["protocol", "udp"]))
    assert got["source_address", "192.168.0.1"] == 1 and got["source_address", "2001:db8::1"] == 1 and got["destination_address", "10.0.0.2"] == 1
    assert got["ethertype", str(0x0800)] == 2 and got["source_mac", MAC] == 1


def test_macs(spark):
    one = spark.range(1)
    assert one.select(frames.normalized_mac(F.lit("02:42:AC:11:00:02"))).first()[0] == MAC
    assert one.select(frames.peer_mac(F.lit("02:00:00:00:00:01"))).first()[0] == "02:00:00:00:00:02"
    for bad in ("01:00:00:00:00:01", "00:00:00:00:00:00", "02:42"):
        with pytest.raises(Exception, match="unicast"):
            one.select(frames.normalized_mac(F.lit(bad))).collect()
        with pytest.raises(ValueError, match="unicast"):
            artifacts.unicast_mac(bad)


def test_strict_json():
    with pytest.raises(ValueError, match="repeated"):
        artifacts.strict_json(b'{"a": 1, "a": 2}')
    with pytest.raises(ValueError, match="non-finite"):
        artifacts.strict_json(b'{"a": NaN}')
    assert artifacts.capture_metadata(artifacts.render_capture_metadata(MAC)) == {"interface": "eth0", "target_mac": MAC}
    with pytest.raises(ValueError, match="interface"):
        artifacts.capture_metadata(b'{"interface": "eth1", "target_mac": "02:42:ac:11:00:02"}')


def test_publish(tmp_path):
    p = tmp_path / "x"
    assert artifacts.publish(p, b"a") and not artifacts.publish(p, b"a")
    with pytest.raises(FileExistsError):
        artifacts.publish(p, b"b")
    with pytest.raises(ZeroDivisionError):
        artifacts.atomic_replace(p, b"c", lambda b: 1 / 0)
    assert p.read_bytes() == b"a" and [f.name for f in tmp_path.iterdir()] == ["x"]


def test_identities(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a").write_bytes(b"1")
    (tmp_path / "d/b").write_bytes(b"22")
    before = artifacts.directory_identity(spark, str(tmp_path / "d"))
    assert before == artifacts.directory_identity(spark, str(tmp_path / "d"))
    (tmp_path / "d/b").write_bytes(b"23")
    assert before != artifacts.directory_identity(spark, str(tmp_path / "d"))
    assert artifacts.first_difference({"a": {"b": 1}}, {"a": {"b": 1.0}}) == ".a.b" and artifacts.first_difference({"a": 1}, {"a": 1}) is None
    names = spark.createDataFrame([("a",), ("z",)], "name string")
    assert {(r.name, r.problem) for r in artifacts.exact_set(names, ["a", "b"]).collect()} == {("b", "missing"), ("z", "foreign")}


def test_log_and_toml(spark, tmp_path):
    log = tmp_path / "run.log"
    artifacts.append_run_log(log, {"event": "start", "stage": "fit"})
    artifacts.append_run_log(log, {"event": "complete", "stage": "fit", "generation": 2})
    assert [r.generation for r in artifacts.read_run_log(spark, str(log)).collect()] == [None, 2] and len(artifacts.parse_run_log(log.read_bytes())) == 2
    (tmp_path / "a.toml").write_text(artifacts.render_toml({"a": 1, "b": {"c": [1.5, "x"], "d": {"e": True}}}))
    assert artifacts.read_toml(tmp_path / "a.toml") == {"a": 1, "b": {"c": [1.5, "x"], "d": {"e": True}}}
    assert set(artifacts.schema_documents()) == {"run_log", "history", "trace", "generated", "packets"}


def test_transfers(spark):
    good = "HTTP/1.1 302 Found\r\nLocation: /y\r\n\r\nHTTP/1.1 206 Partial\r\nContent-Range: bytes 0-9/100\r\nContent-Length: 10\r\n\r\n"
    cases = {
        1: (good, None), 2: (good.replace("206", "200"), "status"), 3: (good.replace("bytes 0-9", "bytes 0-8"), "range"), 4: (good.replace("Length: 10", "Length: 11"), "length"),
        5: (good.replace("Location: /y", "X: y"), "redirect"), 6: (good.split("\r\n\r\n")[0] + "\r\n\r\n", "status"), 7: (good.replace("Content-Length: 10", "Content-Length: 10\r\ncontent-length: 10"), "length"),
        8: ("HTTP/1.0 206\r\n\r\n", "status line"), 9: (("HTTP/1.1 302 F\r\nLocation: /y\r\n\r\n" * 4) + good.split("\r\n\r\n")[1] + "\r\n\r\n", "redirects"),
    }
    files = spark.createDataFrame([(k, bytearray(v[0].encode())) for k, v in cases.items()], "transfer_id bigint, content binary")
    want = spark.createDataFrame([(k, 0, 9, 100) for k in cases], "transfer_id bigint, range_start bigint, range_end bigint, object_size bigint")
    assert {r.transfer_id: r.problem for r in headers.transfers(files, want).collect()} == {k: v[1] for k, v in cases.items()}


def test_urls(spark):
    cases = {"https://example.com/x?y=1": True, "http://a.b:80": True, "ftp://example.com": False, "http://10.0.0.1/": False, "https://-x.com": False, "http://": False}
    long = ".".join(["a" * 63] * 3 + ["b" * 61])
    cases |= {
        "http://a.b/x y": False, "https://example.com./": True, "https://a.b..": False, f"http://{long}/": True, f"http://{long}c.": False, "HTTPS://me:x@a.b:65535?q": True, "http://a.b:65536/": False,
        "http://a.b:x/": False, "http://[::1]/": False, "http://256.1.1.1/": True, "http://01.2.3.4": True, "http://a.b:/": True, "http://a_b.c": False, "http://a.b:000080": True, f"http://{'a' * 64}.b": False, "": False,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", headers.valid_url(F.col("u")).alias("ok")).collect()
    assert {r.u: r.ok for r in rows} == cases == {k: headers.is_url(k) for k in cases}


def document(folder: Path) -> dict:
    return {
        "run": {"directory": str(folder), "minimum_free_bytes": 1, "master_seed": 73, "final_seed": 97},
        "target": {"image": "i", "argv": ["x"], "working_directory": "/w", "mounts": [], "environment": {}},
        "capture": {"image": "c", "network_probe_url": "https://example.invalid/", "readiness_timeout_seconds": 2.0, "workload_timeout_seconds": 5.0, "flush_timeout_seconds": 2.0, "total_timeout_seconds": 10.0},
        "generation": {"trial": {"max_packets": 500, "max_output_bytes": 1000000, "max_wall_seconds": 5.0}, "final": {"max_packets": 1000, "max_output_bytes": 2000000, "max_wall_seconds": 10.0}},
        "genetic": {"population_size": 4, "generation_count": 1, "tournament_size": 2, "elite_count": 1, "trial_seeds": [17], "duplicate_mutation_attempts": 1, "early_stopping_generations": 0, "early_stopping_tolerance": 0.0, "resume": True},
        "models": {"enabled": ["poisson_empirical"], "poisson_empirical": {"crossover_probability": 0.3, "mutation_probability": 0.2, "mutation_scale": 0.1, "c_lambda": {"lower": 0.5, "upper": 1.5}}},
        "similarity": {"iat_diagnostic_quantile": 0.75, "acf_lags": [1], "acf_lag_weights": [1.0], "acf_iat_weight": 0.5, "acf_size_weight": 0.5, "multiscale_widths_seconds": [1.0, 2.5], "multiscale_scale_weights": [0.5, 0.5],
                       "multiscale_packet_weight": 0.5, "multiscale_byte_weight": 0.5, "max_direction_bin_cells": 100, "method_weights": {"frame_size_ks": 0.25, "iat_ks": 0.25, "autocorrelation": 0.25, "multiscale_rate": 0.25}},
    }


@pytest.mark.parametrize(
    ("path", "value"),
    [(("run", "master_seed"), -1), (("run", "master_seed"), 1.0), (("genetic", "trial_seeds"), [97]), (("genetic", "elite_count"), 4), (("similarity", "acf_lag_weights"), [0.5]), (("capture", "network_probe_url"), "http://1.2.3.4/"), (("models", "enabled"), ["other"]), (("extra",), {})],
)
def test_config_refuses(tmp_path, path, value):
    d = document(tmp_path)
    at = d
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    with pytest.raises(config.ConfigError):
        config.check(d)


def test_run_from_capture_to_comparison(spark, tmp_path):
    (tmp_path / "capture.json").write_bytes(artifacts.render_capture_metadata(MAC))
    (tmp_path / "reference.pcapng").write_bytes(pcapng.encode(EVENTS, MAC, 30.0)[0])
    (tmp_path / "experiment.toml").write_bytes(config.render(config.check(document(tmp_path))))
    run = stages.Run(spark, config.load(tmp_path / "experiment.toml"))
    result = run.all()
    assert 0 < result["aggregate_score"] <= 1 and {p.name for p in tmp_path.iterdir()} == set(stages.FILES)
    assert run.all() == result  # a second run reuses every file
    (tmp_path / "generated.pcapng").write_bytes(b"x")
    with pytest.raises(ValueError, match="isn't what the model gives"):
        run.compare()


def test_streams(spark, tmp_path):
    rows = [("t", i, i * 1_500_000, i % 2, 60 + i) for i in range(1, 9)]
    frame = spark.createDataFrame(rows, "trace_id string, seq bigint, ts_us bigint, direction int, frame_length bigint")
    for k, part in enumerate((frame.where("seq <= 4"), frame.where("seq > 4"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = rates.streaming_iats(stream).writeStream.format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.seq, r.iat_us) for r in spark.table("gaps").collect()) == [(i, 1_500_000) for i in range(1, 8)]
    timed = stream.withColumn("at", F.timestamp_micros("ts_us"))
    query = rates.windowed_rates(timed, "4 seconds", "1 second").writeStream.format("memory").outputMode("complete").queryName("rates").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("rates").agg(F.sum("packets")).first()[0] == 8
