"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. A window is the
set of its shingles (``shingle`` consecutive words, or the whole window if it is shorter). A place in a document, as many
words long as the window, holds it if at least ``share`` of the window's distinct shingles occur there; at a share of 1
its words must stand there one by one.

1. Items are cut into pieces of about a megabyte that repeat ``window`` - 1 words, so no window is lost, and pieces are
   dealt to blocks of at most ``block`` bytes. Documents are read twice for each block; benchmarks have one, as a rule.
2. The first reading counts, over all documents, how often each shingle of the block occurs; tasks send one number per
   shingle. Counts order the shingles by rarity.
3. A place that holds o of a window's m shingles must hold one of its m - o + 1 rarest: these prefixes alone are looked up
   in the second reading. (At a share of 1 that is one shingle a window.)
4. Bounds: the place must lie within its document (length); at a share of 1 the prefix shingle must stand at its own
   offset, else anywhere within the place (position).
5. What is left is verified: words byte by byte at a share of 1, else by the number of shared shingles.

The block goes to the tasks with the code: at most ``block`` bytes of text plus a number per shingle, whatever the number of
documents or items. Documents aren't shuffled (with several blocks, one row per document and block is). Long texts are read
in stretches that overlap by ``window`` - 1 words, so memory doesn't grow with them.

Edge cases: a null or empty text has no words; an item without words has no windows; items are told apart by their ids as
text, a null id counting as empty text, and rows that repeat an id count as one item; documents keep one row each, whatever
their ids; without documents the result is empty, without items nothing is hit; other columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, held, read_table, small_batches

WINDOW, SHINGLE, BLOCK, STRETCH, CANDIDATES = 10, 3, 8 << 20, 1 << 20, 1 << 20
SPACE = 32

IS_WORD = np.zeros(256, bool)
IS_WORD[ord("0") : ord("9") + 1] = IS_WORD[ord("A") : ord("Z") + 1] = IS_WORD[ord("a") : ord("z") + 1] = IS_WORD[128:] = True
LOWER = np.where(IS_WORD, np.arange(256), SPACE).astype(np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

BASE, STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(32)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> SHIFT)) * MIX
    return h ^ (h >> SHIFT)


class Words:
    """Words of a stretch of bytes that holds one or more texts, each followed by a byte that belongs to no word.

    at: where each word starts in the stretch; canon: words in small letters, one space after each; first, end: where each
    stands there; doc: the text that it belongs to; hash: 64 bits.
    """

    def __init__(self, data: np.ndarray, texts: np.ndarray):
        keep = IS_WORD[data]
        before = np.zeros_like(keep)
        before[1:] = keep[:-1]
        self.at = np.flatnonzero(keep & ~before)
        self.canon = LOWER[data[keep | before]]
        if len(keep) and keep[-1]:
            self.canon = np.append(self.canon, np.uint8(SPACE))
        self.end = np.flatnonzero(self.canon == SPACE)
        self.first = np.concatenate((self.end[:0], [0], self.end[:-1] + 1)) if len(self.end) else self.end
        self.doc = np.searchsorted(texts, self.at, "right") - 1
        self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.at)

    def _hashes(self) -> np.ndarray:
        if not len(self.at):
            return np.empty(0, np.uint64)
        size = self.end - self.first + 1
        within = np.arange(len(self.canon)) - np.repeat(self.first, size)
        power = np.cumprod(np.full(int(size.max()), BASE))
        return mixed(np.add.reduceat((self.canon.astype(np.uint64) + np.uint64(1)) * power[within], self.first))

    def shingles(self, k: int) -> np.ndarray:
        """Hashes of k words from each word on that has k - 1 after it, in its text or the next."""
        n = max(len(self) - k + 1, 0)
        h = self.hash[:n] + np.uint64(k)
        for j in range(1, k):
            h = h * STEP + self.hash[j : j + n]
        return mixed(h)

    def text(self, i: int, n: int) -> bytes:
        return self.canon[self.first[i] : self.end[i + n - 1]].tobytes()


def stretches(data: np.ndarray, overlap: int, size: int) -> Iterator[tuple[int, Words]]:
    """(number of its first word, words) for each stretch of a text; each but the first repeats the last words of the one before."""
    begin, stop, number = 0, size, 0
    while True:
        while stop < len(data) and IS_WORD[data[stop - 1]]:
            rest = np.flatnonzero(~IS_WORD[data[stop : stop + size]])
            stop = stop + int(rest[0]) + 1 if len(rest) else stop + size
        w = Words(data[begin:stop], np.zeros(1, np.int64))
        last = stop >= len(data) or not any(IS_WORD[data[i : i + size]].any() for i in range(stop, len(data), size))
        if last or len(w) > overlap:
            yield number, w
            if last:
                return
            number += len(w) - overlap
            begin = begin + int(w.at[len(w) - overlap]) if overlap else stop
        stop += size


class Keys:
    """Sorted hashes and a table of flags that turns nearly all others away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = min(max(len(keys).bit_length() + 4, 12), 22)
        self.shift = np.uint64(64 - bits)
        self.flags = np.zeros(1 << bits, bool)
        self.flags[keys >> self.shift] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of h that are among the keys, and which keys they are."""
        at = np.flatnonzero(self.flags[h >> self.shift])
        i = np.searchsorted(self.keys, h[at])
        same = i < len(self.keys)
        same[same] = self.keys[i[same]] == h[at[same]]
        return at[same], i[same]


class Block:
    """Windows of a block of pieces, by length; tokens: the distinct shingles by their number of words."""

    def __init__(self, pieces: list[tuple[str, bytes]], window: int, shingle: int):
        self.items = sorted({item for item, _ in pieces})
        number = {item: i for i, item in enumerate(self.items)}
        ids: dict[bytes, int] = {}
        self.owners: list[list[int]] = []
        self.texts: list[bytes] = []
        self.hashes: list[tuple[np.uint64, np.uint64]] = []
        rows: dict[int, list[np.ndarray]] = {}
        self.group: dict[int, list[int]] = {}
        for item, text in pieces:
            w = Words(np.frombuffer(text, np.uint8), np.zeros(1, np.int64))
            if not len(w):
                continue
            n = min(window, len(w))
            h = w.shingles(min(shingle, n))
            for i in range(len(w) - n + 1):
                t = w.text(i, n)
                j = ids.setdefault(t, len(ids))
                if j == len(self.texts):
                    self.texts.append(t)
                    self.owners.append([])
                    self.hashes.append((w.hash[i], w.hash[i + n - 1]))
                    rows.setdefault(n, []).append(h[i : i + n - min(shingle, n) + 1])
                    self.group.setdefault(n, []).append(j)
                if not self.owners[j] or self.owners[j][-1] != number[item]:
                    self.owners[j].append(number[item])
        self.shingle = shingle
        self.rows = {n: np.array(r) for n, r in rows.items()}
        found: dict[int, list[np.ndarray]] = {}
        for n, r in self.rows.items():
            found.setdefault(min(shingle, n), []).append(r.ravel())
        self.tokens = {k: Keys(np.unique(np.concatenate(v))) for k, v in sorted(found.items())}
        self.length = np.zeros(len(self.texts), np.int64)
        for n, j in self.group.items():
            self.length[j] = n
        self.ends = np.array(self.hashes, np.uint64).reshape(-1, 2)

    def rank(self, counts: dict[int, np.ndarray], share: float) -> None:
        """Choose each window's prefix: for each token that is in one, the windows and its first offsets in them."""
        self.share, self.need, self.sets, self.prefix = share, np.zeros(len(self.texts), np.int64), {}, {}
        listed: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for n, r in self.rows.items():
            k, windows = min(self.shingle, n), np.array(self.group[n])
            keys = self.tokens[k].keys
            order = np.empty(len(keys), np.int64)
            order[np.lexsort((keys, counts[k]))] = np.arange(len(keys))
            ranks = order[np.searchsorted(keys, r)]
            places = np.argsort(ranks, axis=1, kind="stable")
            sorted_ranks = np.take_along_axis(ranks, places, 1)
            distinct = np.ones_like(ranks, bool)
            distinct[:, 1:] = sorted_ranks[:, 1:] != sorted_ranks[:, :-1]
            m = distinct.sum(1)
            self.need[windows] = np.ceil(share * m - 1e-9).astype(np.int64).clip(1)
            prefix = m - self.need[windows] + 1
            chosen = distinct & (np.cumsum(distinct, 1) <= prefix[:, None])
            row, column = np.nonzero(chosen)
            token = np.searchsorted(keys, r[row, places[row, column]])
            listed.setdefault(k, []).append((token, windows[row], places[row, column]))
            self.sets[n] = (windows, r)
        for k, parts in listed.items():
            token, windows, offset = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(token, kind="stable")
            kept, first, size = np.unique(token[order], return_index=True, return_counts=True)
            self.prefix[k] = (Keys(self.tokens[k].keys[kept]), first, size, windows[order], offset[order])
        self.row_of = np.zeros(len(self.texts), np.int64)
        for windows, _ in self.sets.values():
            self.row_of[windows] = np.arange(len(windows))

    def candidates(self, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, places) that share a prefix token and pass the bounds of length and position."""
        for k, (keys, first, size, windows, offset) in self.prefix.items():
            at, i = keys.find(w.shingles(k))
            inside = w.doc[at] == w.doc[at + k - 1]
            at, i = at[inside], i[inside]
            ends = np.cumsum(size[i])
            begin = 0
            while begin < len(at):
                stop = max(int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CANDIDATES, "right")), begin + 1)
                n = size[i[begin:stop]]
                entry = np.repeat(first[i[begin:stop]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                window, place = windows[entry], np.repeat(at[begin:stop], n)
                if self.share == 1:
                    yield self._within(w, window, place - offset[entry])
                else:
                    slots = self.length[window] - k + 1
                    for back in range(int(slots.max())):
                        yield self._within(w, window[back < slots], (place - back)[back < slots])
                begin = stop

    def _within(self, w: Words, window: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = place + self.length[window] - 1
        inside = (place >= 0) & (last < len(w))
        inside[inside] = w.doc[place[inside]] == w.doc[last[inside]]
        return window[inside], place[inside]

    def matches(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(windows, places), each pair once: verified."""
        windows, places = [], []
        for window, place in self.candidates(w):
            if self.share == 1:
                last = place + self.length[window] - 1
                same = (w.hash[place] == self.ends[window, 0]) & (w.hash[last] == self.ends[window, 1])
                window, place = window[same], place[same]
                same = [self.texts[j] == w.text(i, self.length[j]) for j, i in zip(window.tolist(), place.tolist(), strict=True)]
                same = np.array(same, bool)
            else:
                same = self._overlap(w, window, place) >= self.need[window]
            windows.append(window[same])
            places.append(place[same])
        if not windows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.stack((np.concatenate(places), np.concatenate(windows))), axis=1)
        return pairs[1], pairs[0]

    def _overlap(self, w: Words, window: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many of a window's distinct shingles its place holds."""
        shared = np.zeros(len(window), np.int64)
        for n, (_, rows) in self.sets.items():
            mine = np.flatnonzero(self.length[window] == n)
            h = w.shingles(min(self.shingle, n))
            for some in np.array_split(mine, len(mine) // 65536 + 1):
                wanted = np.sort(rows[self.row_of[window[some]]], axis=1)
                there = h[place[some][:, None] + np.arange(wanted.shape[1])]
                held_ = (wanted[:, :, None] == there[:, None, :]).any(2)
                held_[:, 1:] &= wanted[:, 1:] != wanted[:, :-1]
                shared[some] = held_.sum(1)
        return shared


def texts_of(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts, nulls being empty, and where each begins (and the last one ends)."""
    a = batch.column(column)
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    if a.null_count:
        a = a.fill_null("")
    _, offsets, data = a.buffers()
    offsets = np.frombuffer(offsets, kind)[a.offset : a.offset + len(a) + 1].astype(np.int64) if offsets else np.zeros(len(a) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def readings(batch: pa.RecordBatch, column: str, overlap: int, size: int) -> Iterator[tuple[int, int, Words]]:
    """(row of its first text, number of its first word, words) for stretches that cover all texts of a batch.

    Short texts are read together, a long one by itself in several stretches.
    """
    data, offsets = texts_of(batch, column)
    row = 0
    while row < len(batch):
        stop = max(int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1, row + 1)
        if offsets[row + 1] - offsets[row] > size:
            for number, w in stretches(data[offsets[row] : offsets[row + 1]], overlap, size):
                yield row, number, w
            row += 1
            continue
        n = offsets[row + 1 : stop + 1] - offsets[row:stop]
        joined = b"\0".join(memoryview(data[a:b]) for a, b in zip(offsets[row:stop].tolist(), offsets[row + 1 : stop + 1].tolist(), strict=True))
        yield row, 0, Words(np.frombuffer(joined, np.uint8), np.concatenate(([0], np.cumsum(n + 1)[:-1])))
        row = stop


def item_pieces(items: DataFrame, text: str, key: str, window: int, stretch: int) -> DataFrame:
    """(item, piece): pieces of every item that has words, as its words with single spaces."""

    def cut(batches):
        for batch in batches:
            names, pieces = [], []
            for row in range(len(batch)):
                data, offsets = texts_of(batch.slice(row, 1), "text")
                for _, w in stretches(data[offsets[0] : offsets[1]], window - 1, stretch):
                    if len(w):
                        names.append(batch.column("item")[row].as_py())
                        pieces.append(w.canon.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.binary())], ["item", "piece"])

    flat = items.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    return small_batches(flat).mapInArrow(cut, "item string, piece binary")


def blocks_of(pieces: DataFrame, size: int) -> Iterator[list[tuple[str, bytes]]]:
    """Pieces in blocks of at most size bytes (a piece that is larger is a block of its own); one block if there are none."""
    weight = F.octet_length("piece") + F.octet_length("item")
    total, most = pieces.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    n = 1
    while n == 1 and total > size or n > 1 and largest > max(size, most):
        n = max(2 * n, 2 * total // size)
        block = F.pmod(F.xxhash64("item", "piece"), F.lit(n))
        largest = pieces.groupBy(block).agg(F.sum(weight).alias("n")).agg(F.max("n")).first()[0]
    if n == 1:
        yield [(r.item, bytes(r.piece)) for r in pieces.collect()]
        return
    for b in range(n):
        found = [(r.item, bytes(r.piece)) for r in pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(n)) == b).collect()]
        if found:
            yield found


def rarity(texts: DataFrame, token: str, pieces: list, window: int, shingle: int, stretch: int) -> dict[int, dict[int, int]]:
    """How often each shingle of the block occurs in all texts: a number per shingle from each task, added up by Spark."""

    def count(batches):
        block = held(f"decontaminate-{token}", "count", lambda: Block(pieces, window, shingle))
        found = {k: np.zeros(len(keys.keys), np.int64) for k, keys in block.tokens.items()}
        for batch in batches:
            for _, _, w in readings(batch, "text", shingle - 1, stretch):
                for k, keys in block.tokens.items():
                    at, i = keys.find(w.shingles(k))
                    found[k] += np.bincount(i[w.doc[at] == w.doc[at + k - 1]], minlength=len(found[k]))
        for k, n in found.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some), pa.array(n[some])], ["k", "i", "n"])

    rows = texts.select("text").mapInArrow(count, "k int, i bigint, n bigint").groupBy("k", "i").agg(F.sum("n").alias("n"))
    counts: dict[int, dict[int, int]] = {}
    for r in rows.collect():
        counts.setdefault(r.k, {})[r.i] = r.n
    return counts


HITS = "n_words bigint, spans array<struct<first:bigint,stop:bigint>>, items array<string>"


def hits(texts: DataFrame, keys: list[str], token: str, pieces: list, counts: dict, window: int, shingle: int, share: float, stretch: int) -> DataFrame:
    """keys, n_words, spans (stretches of hit words, apart and in order) and items of each text against one block."""

    def make() -> Block:
        block = Block(pieces, window, shingle)
        numbers = {k: np.zeros(len(t.keys), np.int64) for k, t in block.tokens.items()}
        for k, found in counts.items():
            numbers[k][list(found)] = list(found.values())
        block.rank(numbers, share)
        return block

    def scan(batches):
        block = held(f"decontaminate-{token}", "hits", make)
        for batch in batches:
            n, places, windows = np.zeros(len(batch), np.int64), {}, {}
            for row, number, w in readings(batch, "text", window - 1, stretch):
                if number or not len(w):
                    n[row] += len(w) - (window - 1 if number else 0)
                else:
                    of = np.bincount(w.doc)
                    n[row : row + len(of)] += of
                window_, place = block.matches(w)
                if not len(place):
                    continue
                doc = w.doc[place]
                first = place - np.searchsorted(w.doc, doc) + number
                cuts = np.flatnonzero(np.diff(doc)) + 1
                for d, p, v in zip(doc[np.concatenate(([0], cuts))].tolist(), np.split(first, cuts), np.split(window_, cuts), strict=True):
                    places.setdefault(row + d, []).append((p, p + block.length[v]))
                    windows.setdefault(row + d, set()).update(v.tolist())
            spans, found = [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
            for row, parts in places.items():
                spans[row] = union(np.concatenate([p for p, _ in parts]), np.concatenate([q for _, q in parts]))
                found[row] = [block.items[i] for i in sorted({i for v in windows[row] for i in block.owners[v]})]
            arrays = [batch.column(k) for k in keys]
            arrays += [pa.array(n), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, "n_words", "spans", "items"])

    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, "text").mapInArrow(scan, f"{kinds}, {HITS}")


def union(first: np.ndarray, stop: np.ndarray) -> list[dict[str, int]]:
    order = np.argsort(first, kind="stable")
    first, stop = first[order], np.maximum.accumulate(stop[order])
    new = np.concatenate(([True], first[1:] > stop[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(first) - 1]))
    return [{"first": a, "stop": b} for a, b in zip(first[new].tolist(), stop[last].tolist(), strict=True)]


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
    window: int = WINDOW, shingle: int = SHINGLE, share: float = 1.0, block: int = BLOCK, stretch: int = STRETCH,
) -> DataFrame:
    """key, n_words, spans (first and stop word of each stretch of hit words) and items (ids as text, sorted) of every document."""
    if not (0 < share <= 1 and window >= 1 and shingle >= 1):
        raise ValueError("share must be in (0, 1], window and shingle at least 1")
    spark = docs.sparkSession
    texts = small_batches(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")))
    scratch = Scratch(spark, "decontaminate")
    pieces = scratch.keep(item_pieces(items, item_text, item_key, window, stretch))
    run, found, tagged = uuid.uuid4().hex, [], None
    blocks = blocks_of(pieces, block)
    current = next(blocks, [])
    for number in range(1 << 30):
        following = next(blocks, None)
        if following is not None and tagged is None:
            tagged = scratch.keep(texts.withColumn("uid", F.monotonically_increasing_id()))
        table, keys = (texts, ["key"]) if tagged is None else (tagged, ["uid", "key"])
        counts = rarity(table, f"{run}-{number}", current, window, shingle, stretch) if current else {}
        hit = hits(table, keys, f"{run}-{number}", current, counts, window, shingle, share, stretch)
        found.append(hit if tagged is None else scratch.keep(hit))
        if following is None:
            break
        current = following
    if tagged is None:
        scratch.drop()
        return found[0].withColumnRenamed("key", key)
    joined = reduce(DataFrame.unionAll, found).groupBy("uid").agg(
        F.first("key").alias(key), F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return joined.select(key, "n_words", F.expr(MERGE).alias("spans"), "items")


#: Spans of several blocks: one that begins before the last one stops (or where it does) lengthens it.
MERGE = """
reverse(aggregate(spans, cast(array() as array<struct<first:bigint,stop:bigint>>), (done, s) ->
  if(size(done) > 0 and s.first <= done[0].stop,
     concat(array(named_struct('first', done[0].first, 'stop', greatest(done[0].stop, s.stop))), slice(done, 2, size(done))),
     concat(array(s), done))))
"""


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.getField("stop") - s.getField("first"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT uid, i, n, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT uid, i, p.n, item FROM places p JOIN windows USING (n, t)),
hit AS (SELECT uid, count(DISTINCT j) AS n_hit FROM (SELECT uid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT uid, i, n FROM found)) GROUP BY uid),
items AS (
  SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT uid, item FROM found) GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (uid) LEFT JOIN items USING (uid)
"""
