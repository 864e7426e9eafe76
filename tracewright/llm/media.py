"""ISO media containers: write payloads as tracks of 8x8 grey frames, and read containers by their boxes.

``build`` stores bytes losslessly: one video track of uncompressed 8-bit frames (64 bytes each), a sync sample every
16 frames, one chunk per 16 frames. ``inspect`` walks nested boxes of any such file (32- and 64-bit sizes, boxes to
the end of the file, stco or co64, uniform or listed sample sizes, with or without a sync table) and decodes the
sample tables to codec, duration and keyframe byte ranges; payload bytes are never interpreted.

Edge cases: a null text counts as empty, and an empty payload still fills one frame; a truncated or foreign file
gives what its boxes say before they end, codec None and no ranges if they say nothing; a file names no more samples than it
has bytes, and payload is read back only where its ranges together take no more than the file's bytes; equal payloads give equal files; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, small_batches, text_or_empty

FRAME, GROUP, TIMESCALE, TICKS = 64, 16, 1000, 40
#: Containers inside each other that are still opened; the format itself needs seven.
DEEPEST = 32
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(payload: bytes) -> bytes:
    return payload + b"\0" * ((-len(payload)) % FRAME if payload else FRAME)


def build(payload: bytes) -> bytes:
    """A file whose only track holds payload, which must be whole frames."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"a payload is a positive number of {FRAME}-byte frames")
    n = len(payload) // FRAME
    chunks, ticks = -(-n // GROUP), n * TICKS
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    runs = [(1, GROUP, 1)] if n % GROUP == 0 or chunks == 1 else [(1, GROUP, 1), (chunks, n % GROUP, 1)]
    runs = [(1, n, 1)] if chunks == 1 else runs
    syncs = range(1, n + 1, GROUP)

    def moov(first: int, wide: bool) -> bytes:
        offsets = [first + i * GROUP * FRAME for i in range(chunks)]
        table = full(b"co64", struct.pack(f">I{chunks}Q", chunks, *offsets)) if wide else full(b"stco", struct.pack(f">I{chunks}I", chunks, *offsets))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, TICKS)),
            full(b"stss", struct.pack(f">I{chunks}I", chunks, *syncs)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            table,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1)
        hdlr = full(b"hdlr", bytes(4), b"vide", bytes(12), b"payload\0")
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(16), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    wide = len(payload) + (1 << 20) + 16 * chunks > 0xFFFFFFFF
    data_head = 16 if len(payload) + 8 > 0xFFFFFFFF else 8
    first = len(head) + len(moov(0, wide)) + data_head
    return head + moov(first, wide) + box(b"mdat", payload)


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, depth first; leaves a container where a size makes no sense."""
    # what is open: the next box's start, the end, and the path; boxes nested deeper than DEEPEST are passed over
    open_boxes: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while open_boxes:
        start, end, path = open_boxes.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        at = start + 8
        if size == 1 and at + 8 <= end:
            (size,) = struct.unpack_from(">Q", data, at)
            at += 8
        elif size == 0:
            size = end - start
        if size < at - start or start + size > end:
            continue
        yield (*path, kind), at, start + size
        open_boxes.append((start + size, end, path))
        if kind in CONTAINERS and len(path) < DEEPEST:
            open_boxes.append((at, start + size, (*path, kind)))


def inspect(data: bytes) -> list[dict]:
    """One record per track: handler, codec, duration (seconds), samples, sample byte ranges and keyframe numbers."""
    tracks: list[dict] = []
    left = len(data)  # bytes that samples of one size may still claim: all tracks together have no more samples than the file has bytes
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"handler": None, "codec": None, "timescale": 0, "ticks": 0, "times": [], "sizes": [], "runs": [], "chunks": [], "syncs": None})
            continue
        if b"trak" not in path:
            continue
        t, body = tracks[-1], memoryview(data)[at:end]
        try:
            if kind == b"mdhd":
                wide = struct.unpack_from(">B", body)[0] == 1
                t["timescale"], t["ticks"] = struct.unpack_from(">IQ" if wide else ">II", body, 20 if wide else 12)
            elif kind == b"hdlr" and b"mdia" in path:
                t["handler"] = struct.unpack_from("4s", body, 8)[0].decode("latin-1")
            elif kind == b"stsd" and struct.unpack_from(">I", body, 4)[0]:
                t["codec"] = struct.unpack_from("4s", body, 12)[0].decode("latin-1")
            elif kind in (b"stts", b"stsc", b"stss", b"stco", b"co64"):
                (n,) = struct.unpack_from(">I", body, 4)
                form = {b"stts": ">II", b"stsc": ">III", b"stss": ">I", b"stco": ">I", b"co64": ">Q"}[kind]
                size = struct.calcsize(form)
                rows = list(struct.iter_unpack(form, body[8 : 8 + min(n, (len(body) - 8) // size) * size]))
                name = {b"stts": "times", b"stsc": "runs", b"stss": "syncs"}.get(kind, "chunks")
                t[name] = rows if kind in (b"stts", b"stsc") else [r[0] for r in rows]
            elif kind == b"stsz":
                size, n = struct.unpack_from(">II", body, 4)
                n = min(n, left // size if size else (len(body) - 12) // 4)
                left -= size * n
                t["sizes"] = [size] * n if size else [r[0] for r in struct.iter_unpack(">I", body[12 : 12 + 4 * n])]
        except struct.error:
            continue
    return [_track(t) for t in tracks]


def _track(t: dict) -> dict:
    """A track's figures. Ranges are those of the sample tables, whether or not the file holds the bytes."""
    spans: list[tuple[int, int]] = []
    sizes = t["sizes"]
    sample = 0
    for i, (first, per_chunk, _) in enumerate(t["runs"]):
        last = t["runs"][i + 1][0] - 1 if i + 1 < len(t["runs"]) else len(t["chunks"])
        if not 0 < first <= last + 1 or sample >= len(sizes):
            break  # runs begin at rising chunks
        for offset in t["chunks"][first - 1 : last] if per_chunk else ():
            if sample >= len(sizes):
                break
            for size in sizes[sample : sample + per_chunk]:
                spans.append((offset, size))
                offset += size
            sample += per_chunk
    ticks = sum(n * delta for n, delta in t["times"]) or t["ticks"]
    syncs = range(1, len(spans) + 1) if t["syncs"] is None else t["syncs"]
    keys = [spans[s - 1] for s in syncs if 0 < s <= len(spans)]
    return {"handler": t["handler"], "codec": t["codec"], "duration": ticks / t["timescale"] if t["timescale"] else 0.0, "samples": spans, "keyframes": keys}


STORED = "key bigint, n_bytes bigint, media binary"
FEATURES = "key bigint, n_bytes bigint, media_bytes bigint, media_sha256 string, codec string, duration double, keyframes array<struct<offset:bigint,size:bigint>>, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint"


def _store(batches):
    for b in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("key").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([build(padded(t)) for t in texts], pa.binary())], ["key", "n_bytes", "media"]
        )


def _features(batches):
    for b in batches:
        out: dict[str, list] = {k: [] for k in ("media_bytes", "media_sha256", "codec", "duration", "keyframes", "payload_bytes", "payload_sha256", "tail_crc32")}
        for data in b.column("media"):
            data = data.as_py() or b""
            track = next(iter(inspect(data)), {"codec": None, "duration": 0.0, "samples": [], "keyframes": []})
            claimed = sum(s for _, s in track["samples"])
            payload = b"".join(data[o : o + s] for o, s in track["samples"]) if claimed <= len(data) else b""
            for k, v in zip(out, (len(data), hashlib.sha256(data).hexdigest(), track["codec"], track["duration"], [{"offset": o, "size": s} for o, s in track["keyframes"]], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:])), strict=True):
                out[k].append(v)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())])), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n_bytes"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["key", "n_bytes", *out])


def store_text(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media: each text as a container file."""
    from pyspark.sql import functions as F

    return small_batches(docs).select(F.col(key).cast("bigint").alias("key"), text_or_empty(text).alias("text")).mapInArrow(_store, STORED)


def media_features(files: DataFrame) -> DataFrame:
    """Features of each container in the media column of key, n_bytes, media."""
    return small_batches(files).select("key", "n_bytes", "media").mapInArrow(_features, FEATURES)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_features(store_text(read_table(spark, sf_dir, "documents")))
    return found.selectExpr(
        "key as doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        "to_json(struct(codec, duration, keyframes)) as feature",
    )
