"""Captures of any size, both ways, through Spark's own readers and writers: many tasks read one file, and rendering is parallel.

Reading. Spark's text source with the bytes that begin a packet block as its line separator cuts a capture wherever they occur
and deals out the file's byte ranges; it reads any store that Spark reads and keeps bytes as they are. What one task gets of a
file's range is a run: pieces that each begin with the separator, so runs tile the file. The separator also occurs inside
blocks (in every packet of 1536 to 1791 bytes, for one), so a piece need not begin a block. Therefore:

1. Each run looks for the first piece from which block lengths lead, block by block, to the run's end, and reports that entry,
   its packets, and the bytes before the entry and after its last whole block.
2. A file's runs are checked in order, a small row each: a run's last block, cut or not, says where the next run's entry is.
   A run that guessed otherwise is searched again from the entry found; each round settles one run of each file at least.
3. Runs are read again from their entries; packets are numbered by the sums of the runs' counts. The one packet that lies across
   two or more runs is put together from their ends. Times are checked within runs and across them.

A task holds one run (spark.sql.files.maxPartitionBytes plus a block), the check of a file one row for each of its runs.
Byte order must be little-endian, as in captures written here; others are an error (pcapng.read_packets takes both).

Writing. Chunks of packets are rendered in parallel; the text writer then strings the chunks of a trace together into files of at
most PART packets each, as capture tools do with long traces: the folder after=N holds the file of the packets after the first N,
a capture of its own. So no task holds or sorts more than a few bounded files. Reading numbers such files' packets as one trace.
Its line separator is the last field of a small block that readers skip, so the file is a capture; Spark's committer leaves no
partial file behind a failed task.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import build_frame, direction
from . import pcapng
from .pcapng import ENHANCED, ETHERNET, INTERFACE, MAGIC, OBSOLETE_PACKET, PACKETS, SECTION, SIMPLE_PACKET, CaptureError

MARK = struct.pack("<I", ENHANCED)
#: A guess may take no block for larger; blocks found by the check may have any size.
LARGEST = 16 << 20
HEADER, HEAD = 28, 64
RUN = (
    "file string, start bigint, length bigint, entry bigint, packets bigint, first bigint, last bigint, links array<binary>, late_link boolean, fault string, "
    "head binary, tail binary, before binary, after binary"
)
CHECKED = "file string, start bigint, entry bigint, owner bigint, first_seq bigint, resolution int, seconds bigint, settled boolean, fault string"


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, piece): what stands between the separators, in the order of each range."""
    lines = spark.read.option("lineSep", MARK.decode()).option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes, list[int]]]:
    """(columns of its first row but the piece, bytes, where pieces begin) for each run."""
    key, first, parts, places, size = None, None, [], [], 0
    for batch in batches:
        names = [n for n in batch.schema.names if n != "piece"]
        for file, start, piece, i in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("piece").to_pylist(), range(len(batch)), strict=True):
            if (file, start) != key:
                if key is not None:
                    yield first, b"".join(parts), places
                key, parts, places, size = (file, start), [], [], 0
                first = {n: batch.column(n)[i].as_py() for n in names}
                if start > 0:
                    parts, size = [MARK], 4
                parts.append(piece)
                places = [0]
            else:
                places.append(size)
                parts += [MARK, piece]
                size += 4
            size += len(piece)
    if key is not None:
        yield first, b"".join(parts), places


def chain(data: bytes, at: int, most: int | None = None) -> tuple[list[tuple[int, int, int]], int] | None:
    """(type, place, size) of the whole blocks from a place on, and where the first one that isn't whole begins; None if they don't fit."""
    found = []
    while at + 12 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if size < (32 if kind == ENHANCED else 12) or size % 4 or most is not None and size > most:
            return None
        if at + size > len(data):
            break
        if struct.unpack_from("<I", data, at + size - 4)[0] != size:
            return None
        found.append((kind, at, size))
        at += size
    return found, at


def entry_of(data: bytes, places: list[int]) -> int:
    """The first piece from which blocks lead to the run's end; -1 if there is none."""
    for at in places:
        if chain(data, at, LARGEST) is not None:
            return at
    return -1


def packet(data: bytes, at: int, size: int) -> tuple[int, bytes] | str:
    """(ticks, frame) of a packet block, or what is wrong with it."""
    link, high, low, kept, _ = struct.unpack_from("<IIIII", data, at + 8)
    if link:
        return "packet of an unknown interface"
    if kept > size - 32:
        return "cut packet"
    if kept < 14:
        return "a frame has fewer than 14 bytes"
    return high << 32 | low, data[at + 28 : at + 28 + kept]


def survey(found: DataFrame, reading: str) -> DataFrame:
    """One row per run; where found has an entry, it isn't searched. An entry of -1: no block begins there."""

    def run(batches, reading=reading):  # its name keeps Spark from taking an earlier reading, with other ranges, for this one
        names = [f.split()[0] for f in RUN.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 6, pa.list_(pa.binary()), pa.bool_(), pa.string(), *[pa.binary()] * 4]
        for first, data, places in runs_of(batches):
            given = first.get("entry")
            entry = given if given is not None else 0 if first["start"] == 0 else entry_of(data, places)
            walked = chain(data, entry) if entry >= 0 else None
            fault, links, ticks, late, packets = None, [], [], False, 0
            blocks, end = walked or ([], len(data))
            if walked is None and entry >= 0:
                fault = "block lengths disagree"
            if first["start"] == 0 and (data[:4] != b"\x0a\x0d\x0d\x0a" or data[8:12] != struct.pack("<I", MAGIC)):
                fault = "not a little-endian capture"
            for kind, at, size in blocks:
                if kind == SECTION and (first["start"] or at):
                    fault = fault or "a capture is one section"
                elif kind == INTERFACE:
                    links.append(data[at + 8 : at + size - 4])
                    late = late or bool(packets) or first["start"] > 0
                elif kind in (OBSOLETE_PACKET, SIMPLE_PACKET):
                    fault = fault or "only enhanced packet blocks are read"
                elif kind == ENHANCED:
                    packets += 1
                    high, low = struct.unpack_from("<II", data, at + 12)
                    ticks = [ticks[0] if ticks else high << 32 | low, high << 32 | low]
            tail = data[end:] if entry >= 0 else b""
            row = (first["file"], first["start"], len(data), entry, packets, ticks[0] if ticks else None, ticks[1] if ticks else None, links, late, fault)
            row += (data[:HEAD], tail[:HEADER], data[:entry] if entry >= 0 else data, tail)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    return found.mapInArrow(run, RUN)


def checked(rows: list[dict]) -> list[dict]:
    """A file's runs in order: entries that the runs before them imply, the run that each run's first bytes belong to, numbers of
    first packets. An entry that differs from a run's own guess isn't settled; what comes after it waits."""
    out, expected, owner, seq, links, fault = [], 0, None, 1, [], None
    for k, r in enumerate(rows):
        fault = fault or r["fault"]
        inside = expected >= r["length"]
        row = {"file": r["file"], "start": r["start"], "entry": -1 if inside else expected, "owner": owner if expected else None, "first_seq": seq, "settled": r["entry"] == (-1 if inside else expected), "fault": None}
        out.append(row)
        if inside:
            expected -= r["length"]
            continue
        if not row["settled"]:
            return [*out, *({**row, "start": x["start"], "entry": None, "owner": None, "settled": True} for x in rows[k + 1 :])]
        links += r["links"]
        if r["late_link"]:
            fault = fault or "packet of an unknown interface"
        seq += r["packets"]
        expected, owner = 0, None
        if r["tail"]:
            head = r["tail"]
            for later in rows[k + 1 :]:
                if len(head) >= 8:
                    break
                head += later["head"]
            if len(head) < 8:
                fault = fault or "cut block"
                continue
            kind, size = struct.unpack_from("<II", head)
            cut = r["length"] - (r["entry"] + r["whole"])
            if size < 12 or size % 4:
                fault = fault or "block lengths disagree"
                break
            expected, owner = size - cut, r["start"]
            seq += kind == ENHANCED
    if expected and fault is None:
        fault = "cut block"
    if fault is None and (len(links) != 1 or struct.unpack_from("<H", links[0])[0] != ETHERNET):
        fault = "a capture has exactly one Ethernet interface"
    if fault is None and seq == 1:
        fault = "a capture has packets"
    resolution, seconds = 6, 0
    if len(links) == 1:
        options = pcapng._options(links[0][8:], "<")
        resolution = options.get(pcapng.TSRESOL, b"\x06")[0]
        seconds = struct.unpack("<q", options[pcapng.TSOFFSET])[0] if pcapng.TSOFFSET in options else 0
    return [{**row, "resolution": resolution, "seconds": seconds, "fault": fault} for row in out]


def check(surveyed: DataFrame) -> DataFrame:
    small = surveyed.select("file", "start", "length", "entry", "packets", "links", "late_link", "fault", "head", "tail", (F.col("length") - F.greatest("entry", F.lit(0)) - F.octet_length("after")).alias("whole"))
    schema = pa.schema([("file", pa.string()), *((n, pa.int64()) for n in ("start", "entry", "owner", "first_seq")), ("resolution", pa.int32()), ("seconds", pa.int64()), ("settled", pa.bool_()), ("fault", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        rows = checked(sorted(table.to_pylist(), key=lambda r: r["start"]))
        return pa.Table.from_pylist([{"resolution": 6, "seconds": 0, **r} for r in rows], schema)

    return small.groupBy("file").applyInArrow(run, CHECKED)


def second_of(ticks: int, resolution: int, seconds: int) -> float:
    return seconds + ticks / (2.0 ** (resolution & 127) if resolution & 128 else 10.0**resolution)


def packets_in(found: DataFrame) -> DataFrame:
    """The whole packets of each run, found having entries, first numbers and resolutions."""

    def run(batches):
        for first, data, _ in runs_of(batches):
            if len(data) != first["length"]:
                raise CaptureError(f"{first['file']}: byte ranges differ from those that were surveyed; sizes of partitions must not change before the packets are read")
            if first["entry"] < 0:
                continue
            seqs, times, frames, seq, before = [], [], [], first["first_seq"], -1.0
            for kind, at, size in chain(data, first["entry"])[0]:
                if kind != ENHANCED:
                    continue
                got = packet(data, at, size)
                if isinstance(got, str):
                    raise CaptureError(f"{first['file']}: {got}")
                ts = second_of(got[0], first["resolution"], first["seconds"])
                if ts < 0 or ts < before:
                    raise CaptureError(f"{first['file']}: times must be finite, not negative and not decrease")
                before = ts
                seqs.append(seq)
                times.append(ts)
                frames.append(got[1])
                seq += 1
                if len(seqs) == 10_000:
                    yield batch_of(first["file"], seqs, times, frames)
                    seqs, times, frames = [], [], []
            if seqs:
                yield batch_of(first["file"], seqs, times, frames)

    return found.mapInArrow(run, PACKETS)


def batch_of(file: str, seqs: list, times: list, frames: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(seqs)), pa.array(seqs, pa.int64()), pa.array(times, pa.float64()), pa.array(frames, pa.binary())], ["trace_id", "seq", "ts", "frame"])


def across(surveyed: DataFrame, places: DataFrame) -> DataFrame:
    """Packets that lie across runs: the end of the run they begin in and the first bytes of those after it."""
    both = surveyed.select("file", "start", "packets", "length", "before", "after").join(places.drop("fault"), ["file", "start"])
    begun = both.where("entry >= 0 AND octet_length(after) > 0").select("file", F.col("start").alias("owner"), "start", F.col("after").alias("bytes"), (F.col("first_seq") + F.col("packets")).alias("seq"), "resolution", "seconds")
    ended = both.where("owner IS NOT NULL").select("file", "owner", "start", F.col("before").alias("bytes"), F.lit(None).cast("bigint").alias("seq"), "resolution", "seconds")
    whole = begun.unionByName(ended).groupBy("file", "owner").agg(
        F.array_sort(F.collect_list(F.struct("start", "bytes"))).alias("parts"), F.max("seq").alias("seq"), F.first("resolution").alias("resolution"), F.first("seconds").alias("seconds")
    )  # a block's bytes, so no array outgrows a block

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                data = b"".join(p["bytes"] for p in r["parts"])
                kind, size = struct.unpack_from("<II", data)
                if size != len(data) or struct.unpack_from("<I", data, size - 4)[0] != size:
                    raise CaptureError(f"{r['file']}: block lengths disagree")
                if kind in (OBSOLETE_PACKET, SIMPLE_PACKET, SECTION, INTERFACE):
                    raise CaptureError(f"{r['file']}: only enhanced packet blocks are read")
                if kind == ENHANCED:
                    got = packet(data, 0, size)
                    if isinstance(got, str):
                        raise CaptureError(f"{r['file']}: {got}")
                    yield batch_of(r["file"], [r["seq"]], [second_of(got[0], r["resolution"], r["seconds"])], [got[1]])

    return whole.mapInArrow(run, PACKETS)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of all captures under path, each file read by as many tasks as it has byte ranges.

    trace_id is the file's path, or the folder of a trace that write_packets wrote, whose files are read as one trace.
    """
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    short = sizes.where("length < 28").orderBy("path").first()
    if short is not None:
        raise CaptureError(f"{short.path}: cut block")
    raw = pieces(spark, path)
    # the small figures of a run, and its two ends, which are shorter than a block
    reading = uuid.uuid4().hex
    surveyed = survey(raw, reading).persist()
    places = check(surveyed).persist()
    while not (wrong := places.where("NOT settled")).isEmpty():
        again = survey(raw.join(F.broadcast(wrong.select("file", "start", "entry")), ["file", "start"]), reading)  # few runs
        surveyed = surveyed.join(F.broadcast(wrong.select("file", "start")), ["file", "start"], "left_anti").unionByName(again).persist()
        places = check(surveyed).persist()
    bad = places.where("fault IS NOT NULL").orderBy("file").first()
    if bad is not None:
        raise CaptureError(f"{bad.file}: {bad.fault}")
    if surveyed.isEmpty():
        raise CaptureError(f"{path}: a capture has packets")
    joined = raw.join(F.broadcast(places.select("file", "start", "entry", "first_seq", "resolution", "seconds").join(surveyed.select("file", "start", "length"), ["file", "start"])), ["file", "start"])  # a row per byte range
    between = across(surveyed, places).persist()
    ticks = lambda c: F.col("seconds") + F.col(c) / F.when(F.col("resolution") >= 128, F.pow(F.lit(2.0), F.col("resolution") - 128)).otherwise(F.pow(F.lit(10.0), F.col("resolution").cast("double")))
    edges = surveyed.where("packets > 0").join(places.select("file", "start", "first_seq", "resolution", "seconds"), ["file", "start"])
    edges = edges.select("file", F.col("first_seq").alias("seq"), ticks("first").alias("first"), ticks("last").alias("last")).unionByName(between.select(F.col("trace_id").alias("file"), "seq", F.col("ts").alias("first"), F.col("ts").alias("last")))
    edges = edges.select(trace_of(F.col("file")).alias("file"), (F.col("seq") + packets_before(F.col("file"))).alias("seq"), "first", "last")
    before = F.lag("last").over(Window.partitionBy("file").orderBy("seq"))
    back = edges.withColumn("before", before).where("first < before").first()
    if back is not None:
        raise CaptureError(f"{back.file}: times must be finite, not negative and not decrease")
    file = F.col("trace_id")
    return packets_in(joined).unionByName(between).select(trace_of(file).alias("trace_id"), (F.col("seq") + packets_before(file)).alias("seq"), "ts", "frame")


def read_trace(spark: SparkSession, path: str, mac: str) -> DataFrame:
    p = read_packets(spark, path)
    return p.select("trace_id", "seq", "ts", direction(F.col("frame"), F.lit(mac)).alias("direction"), F.octet_length("frame").cast("bigint").alias("frame_length"))


# Writing

#: Fixed values of the format: a block type for local use, which readers skip; as large as a block without content can be.
LOCAL, EMPTY = 0x80000001, 12
SEPARATOR = struct.pack("<I", EMPTY)
CHUNK = 4096
#: Packets of one file.
PART = 65_536
#: A file of a longer trace: its trace's folder, and the packets before it.
NAMED = "^(.*/trace_id=[^/]*/)after=([0-9]+)/[^/]*$"


def trace_of(file: Column) -> Column:
    """What names the trace of a file: the trace's folder where the trace may have several files, else the file."""
    return F.regexp_replace(file, NAMED, "$1")


def packets_before(file: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(file, NAMED, 2), F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))


def chunks(packets: DataFrame, window: float | None = None, chunk: int = CHUNK, of: int = PART // CHUNK) -> DataFrame:
    """(trace_id, chunk, content): the captures of each trace in ordered chunks, rendered in parallel, each ending before the separator; a file has ``of`` chunks."""
    end = struct.pack("<II", LOCAL, EMPTY)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("seq", "ts", "frame")), strict=True))
        if window is not None and rows[-1][1] > window or any(len(f) < 14 for *_, f in rows):
            raise ValueError("a trace to encode ends by the window and has frames of 14 bytes or more")
        if rows[0][1] < 0 or any(a[1] > b[1] for a, b in zip(rows, rows[1:], strict=False)):
            raise CaptureError("times must be finite, not negative and not decrease")
        number = table.column("chunk")[0].as_py()
        data = pcapng.render([(t, f) for _, t, f in rows], number % of == 0)
        return pa.table({"trace_id": pa.array([table.column("trace_id")[0].as_py()]), "chunk": pa.array([number], pa.int64()), "content": pa.array([data + end], pa.binary())})

    rows = packets.select("trace_id", "seq", "ts", "frame", F.floor((F.col("seq") - 1) / chunk).alias("chunk"))
    return rows.groupBy("trace_id", "chunk").applyInArrow(run, "trace_id string, chunk bigint, content binary")


def write_packets(packets: DataFrame, path: str, window: float | None = None, chunk: int = CHUNK, part: int = PART) -> None:
    """Write the packets (trace_id, seq, ts, frame) of each trace as captures below path, in folders trace_id=<its id>/after=<packets before>.

    seq counts from 1 in each trace. Tasks are as many as files, which have at most part packets, but a chunk at least.
    """
    of = max(1, part // chunk)
    files = packets.groupBy("trace_id").agg(F.ceil(F.max("seq") / (chunk * of)).alias("n")).agg(F.sum("n")).first()[0] or 1
    made = chunks(packets, window, chunk, of).select("trace_id", (F.floor(F.col("chunk") / of) * (of * chunk)).alias("after"), "chunk", F.col("content").cast("string").alias("value"))
    ordered = made.repartition(int(files), "trace_id", "after").sortWithinPartitions("trace_id", "after", "chunk").select("trace_id", "after", "value")
    ordered.write.option("lineSep", SEPARATOR.decode()).partitionBy("trace_id", "after").text(path)


def write_captures(traces: DataFrame, path: str, mac: str, window: float, chunk: int = CHUNK, part: int = PART) -> None:
    """write_packets for traces, whose frames are made of their directions and lengths."""
    long = F.when(F.col("frame_length") < 14, F.raise_error(F.lit("a trace to encode ends by the window and has frames of 14 bytes or more")).cast("bigint")).otherwise(F.col("frame_length"))
    write_packets(traces.select("trace_id", "seq", "ts", build_frame(F.col("direction"), long, F.lit(mac)).alias("frame")), path, window, chunk, part)


def written(spark: SparkSession, path: str, traces: DataFrame, mac: str, window: float) -> DataFrame:
    """The traces as read back from what write_captures wrote; an error if anything but the times' last digits changed."""
    name = F.url_decode(F.regexp_extract("trace_id", "trace_id=([^/]*)/", 1))
    again = read_trace(spark, path, mac).withColumn("trace_id", F.url_decode(name)).persist()
    columns = ["trace_id", "seq", F.col("direction").cast("int").alias("direction"), "frame_length"]
    if not traces.select(*columns).exceptAll(again.select(*columns)).isEmpty() or not again.select(*columns).exceptAll(traces.select(*columns)).isEmpty() or not again.where(F.col("ts") > window).isEmpty():
        raise CaptureError("writing changed the trace")
    return again
