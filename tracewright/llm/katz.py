"""Scoring of texts by a Katz back-off model.

Tokens are a text's words, with A to Z in lower case, and one end; before a text stand as many start marks as the order
asks for. With Good-Turing discounts d(r) of each length for counts up to 5, h' being h without its first word,

    P(w | h) = d(c(h w)) c(h w) / c(h)     if h w occurs in training,
               alpha(h) P(w | h')          if only h does,
               P(w | h')                   otherwise,

    P(w) = d(c(w)) c(w) / N, and the mass that discounting frees goes to the one unknown word.

alpha(h) is what the sequences of h leave of 1, over what their last words leave of 1 in P( | h'), so each distribution
sums to 1 exactly. A history that discounting leaves no mass counts as seen once more; if no discount is valid (tiny
corpora), none is used and the unknown word counts as seen once. ``order`` is the longest sequence, 2 if not given.

Texts become blocks: each task turns what it reads into token arrays with a dictionary of its own, kept in a table
bucketed by block. In a block, a sequence is a number: that of the sequence without its last word, and that word. Counts
are exchanged by hash bucket, not by text: a block sends each distinct sequence once with its count, however often it
occurs, so no word, however frequent, makes a bucket large, and gets back the corpus's figures for just its own entries.
For each length there is one exchange of counts, and from 2 on one of the sums behind alpha, shorter ones first (a
sequence's share enters once, through the first block that holds it). Buckets hold about ``BUCKET`` tokens' entries,
whatever the corpus's size. Block tables are bucketed so that joining answers to blocks moves only the answers.
Sequences are known by 64-bit hashes.

Edge cases: a null text counts as empty and is one token, the end; with no training rows every token is unknown and
scores 0; a null key is kept, and folded as the empty string; equal keys are told apart; an empty table gives an empty
result; a task holds ``block`` tokens plus one text, or the entries of one bucket.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, forget, materialize, read_table, small_batches, text_or_empty

BLOCK, LARGEST, ORDER = 1_000_000, 5, 2
#: Tokens of the corpus for each bucket of the exchanges.
BUCKET = 4_000_000
START = np.uint64(0x9E3779B97F4A7C15)
TOKENS = "block bigint, keys array<bigint>, held array<boolean>, lengths array<int>, dictionary binary, tokens binary"


# Arrays as bytes: a byte for the item size, then the items; sorted keys as differences.


def packed(a: np.ndarray) -> bytes:
    """Nonnegative integers in as few bytes each as the largest needs."""
    top = int(a.max()) if len(a) else 0
    size = next(s for s in (1, 2, 4, 8) if top < 1 << 8 * s)
    return bytes([size]) + a.astype(f"<u{size}").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def packed_keys(a: np.ndarray) -> bytes:
    """Ascending 64-bit keys."""
    gaps = np.diff(a, prepend=np.uint64(0))
    top = int(gaps.max()) if len(gaps) else 0
    size = max(1, -(-top.bit_length() // 8))
    return bytes([size]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpacked_keys(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8, offset=1).reshape(-1, b[0])
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : b[0]] = raw
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def discounts(seen: list[int]) -> dict[int, float]:
    """d(r) for r up to the largest k, at most LARGEST, for which all are valid; seen[r - 1]: how many occur r times."""
    for k in range(LARGEST, 0, -1):
        n = [0, *seen]
        if not n[1]:
            continue
        rest = (k + 1) * n[k + 1] / n[1]
        found = {r: ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0 for r in range(1, k + 1)}
        if all(0 < d <= 1 for d in found.values()) and min(found.values()) < 1:
            return found
    return {}


def discounted(counts: np.ndarray, d: dict[int, float]) -> np.ndarray:
    factor = np.ones(LARGEST + 2)
    for r, x in d.items():
        factor[r] = x
    return counts * factor[np.minimum(counts, LARGEST + 1)]


def tokenised(docs: DataFrame, text: str, key: str, held: Column, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        part, n = TaskContext.get().partitionId(), 0
        words: defaultdict[bytes, int] = defaultdict()
        words.default_factory = words.__len__
        keys, held, arrays, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(arrays)
            order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            hashes = np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[order]
            row = ([(part << 24) + n], [keys], [held], [[len(a) for a in arrays]], [hashes.tobytes()], [rank[tokens].astype("<u4").tobytes()])
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["block", "keys", "held", "lengths", "dictionary", "tokens"])

        for b in batches:
            for k, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                found = t.as_py().encode("utf-8", "surrogatepass").lower().split()
                found.append(b"")
                keys.append(k)
                held.append(h)
                arrays.append(np.array(list(map(words.__getitem__, found)), np.uint32))
                size += len(found)
                if size >= block:
                    yield flush()
                    words.clear()
                    keys, held, arrays, size, n = [], [], [], 0, n + 1
        if arrays:
            yield flush()

    rows = small_batches(docs).select(F.col(key).cast("bigint").alias("key"), text_or_empty(text).alias("text"), held.alias("held"))
    return rows.mapInArrow(run, TOKENS)


class Level:
    """A block's distinct sequences of one length: the one without the last word, the one without the first, counts."""

    def __init__(self, keys: np.ndarray, of: np.ndarray, start: int, starts: np.ndarray, train: np.ndarray, buckets: int):
        self.keys, self.of, self.start = keys, of, start
        self.history = np.concatenate((np.zeros(1, np.int32), of[:-1]))
        self.history[starts] = start
        self.count = np.bincount(of[train], minlength=len(keys))
        self.past = np.bincount(self.history[train], minlength=len(keys))
        self.order, self.slices = Block._slices(keys, buckets)
        self.first = self.last = self.suffix = None


class Block:
    """A block's tokens and its distinct sequences up to a length; the dictionary ends with the start mark."""

    def __init__(self, row: dict, buckets: int, order: int):
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.keys, self.held = row["keys"], np.array(row["held"], bool)
        train = np.repeat(~self.held, self.lengths)
        hashes = np.concatenate((np.frombuffer(row["dictionary"], np.uint64), [START]))
        size = np.int64(len(hashes))
        word = np.frombuffer(row["tokens"], "<u4").astype(np.int32)
        self.levels = [Level(hashes, word, len(hashes) - 1, self.starts, train, buckets)]
        for _ in range(1, order):
            less = self.levels[-1]
            codes = np.append(less.history * size + word, less.start * size + size - 1)
            local, place = np.unique(codes, return_inverse=True)
            first, last = (local // size).astype(np.int32), (local % size).astype(np.int32)
            mixed = (less.keys[first] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ ((hashes[last] + np.uint64(0x165667B19E3779F9)) * np.uint64(0x9FB21C651E98DF25))
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x = Level(mixed ^ (mixed >> np.uint64(29)), place[:-1].astype(np.int32), int(place[-1]), self.starts, train, buckets)
            x.first, x.last, x.suffix = first, last, np.full(len(local), less.start, np.int32)
            x.suffix[x.of] = less.of
            self.levels.append(x)

    @staticmethod
    def _slices(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Positions of keys by bucket and key, and (bucket, from, to) in that order."""
        of = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((keys, of))
        edges = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=buckets))))
        return order, [(b, int(edges[b]), int(edges[b + 1])) for b in range(buckets) if edges[b] < edges[b + 1]]

    @staticmethod
    def answered(order: np.ndarray, replies: list[dict], field: str, read: Callable) -> np.ndarray:
        """An answer's values in the order of the block's entries; replies in order of bucket."""
        values = np.concatenate([read(r[field]) for r in sorted(replies, key=lambda r: r["bucket"])])
        out = np.empty_like(values)
        out[order] = values
        return out


def _floats(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<f8")


def _rows(names_kinds: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names_kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names_kinds, strict=True)], [n for n, _ in names_kinds])


REQUEST = [("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary())]
REQUEST_DDL = "bucket int, block bigint, keys binary, a binary, b binary"
REPLY = [("block", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("own", pa.binary()), ("seen", pa.list_(pa.int64()))]
REPLY_DDL = "block bigint, bucket int, a binary, b binary, own binary, seen array<bigint>"


def _ask(table: DataFrame, make: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """A row for each block (with the answers joined to it) and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                yield _rows(REQUEST, list(make(b.slice(i, 1).to_pylist()[0])))

    return table.mapInArrow(run, REQUEST_DDL)


def _answer(requests: DataFrame, combine: Callable) -> DataFrame:
    """combine(inverse, distinct keys, rows) gives each request's a, b and own, and the bucket's figures."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys = [unpacked_keys(r["keys"]) for r in rows]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        *told, seen = combine(inverse, len(distinct), rows)
        out, at = [], 0
        for r, k in zip(rows, keys, strict=True):
            out.append((r["block"], r["bucket"], *(f and f(inverse, at, at + len(k)) for f in told), None))
            at += len(k)
        out.append((-1, rows[0]["bucket"], None, None, None, seen))
        return pa.Table.from_batches([_rows(REPLY, out)])

    return requests.groupBy("bucket").applyInArrow(run, REPLY_DDL)


def _total(rows: list[dict], field: str, inverse: np.ndarray, n: int, read: Callable = unpacked) -> np.ndarray:
    values = np.concatenate([read(r[field]) for r in rows])
    total = np.zeros(n, values.dtype)
    np.add.at(total, inverse, values)
    return total


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, LARGEST + 2), minlength=LARGEST + 3)[1 : LARGEST + 2].tolist()


def _figures(replies: DataFrame) -> list[int]:
    """Sums of the buckets' figures: one short row."""
    got = replies.where("block < 0").select(F.posexplode("seen").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    return [r.x for r in sorted(got, key=lambda r: r.i)]


def _by_block(replies: DataFrame, name: str) -> DataFrame:
    return replies.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "a", "b", "own")).alias(name))


def score(docs: DataFrame, held: Column, text: str = "text", key: str = "doc_id", block: int = BLOCK, order: int = ORDER) -> DataFrame:
    """key, held, n_tokens, n_known, train_tokens, base_score and score of every row; held rows don't train."""
    if order < 1:
        raise ValueError("the order must be positive")
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"katz_tokens_{uuid.uuid4().hex}"
    kept: list[DataFrame] = []
    try:
        tokenised(docs, text, key, held, block).write.option("compression", "zstd").bucketBy(partitions, "block").saveAsTable(name)
        return _scored(spark.table(name), partitions, order, kept)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for used in kept:
            forget(used)


def _scored(table: DataFrame, partitions: int, order: int, kept: list[DataFrame]) -> DataFrame:
    """score's rows for a table of tokens, written; what is written on the way is added to kept."""
    size = table.select(F.explode("lengths").alias("n")).agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions, -(-size // BUCKET))
    levels = range(1, order + 1)

    def counts_of(k: int) -> Callable:
        def make(row: dict) -> Iterator[tuple]:
            x = Block(row, buckets, k).levels[-1]
            keys, count, past = x.keys[x.order], x.count[x.order], x.past[x.order]
            for b, i, j in x.slices:
                yield b, row["block"], packed_keys(keys[i:j]), packed(count[i:j]), packed(past[i:j]) if k < order else None

        return make

    def summed(k: int) -> Callable:
        def combine(inverse, n, rows):
            own = np.concatenate([unpacked(r["a"]) for r in rows])
            total = np.zeros(n, np.int64)
            np.add.at(total, inverse, own)
            past = _total(rows, "b", inverse, n) if k < order else None
            tell_own = None
            if k > 1:
                trained, owner = np.flatnonzero(own), np.zeros(len(own), bool)
                owner[trained[np.unique(inverse[trained], return_index=True)[1]]] = True
                tell_own = lambda v, i, j: np.packbits(owner[i:j]).tobytes()
            tell_past = None if past is None else lambda v, i, j: packed(past[v[i:j]])
            return lambda v, i, j: packed(total[v[i:j]]), tell_past, tell_own, [*_counts_of_counts(total), int(total.sum()), int((total > 0).sum())]

        return combine

    for k in levels:
        kept.append(materialize(_answer(_ask(table, counts_of(k)), summed(k)), f"katz-counts-{k}"))
    counted = list(kept)
    figures = [_figures(c) or [0] * (LARGEST + 3) for c in counted]
    tokens, vocabulary = figures[0][-2:]
    d = [discounts(f[:-2]) for f in figures]
    freed = sum(r * figures[0][r - 1] * (1 - x) for r, x in d[0].items())
    whole, unknown = (tokens, freed / tokens) if d[0] else (tokens + 1, 1 / (tokens + 1))

    def known(row: dict, top: int, weighed: int) -> tuple[Block, list[np.ndarray], np.ndarray, np.ndarray]:
        """The block, the corpus's counts by length up to top, what it counts histories of length top - 1, and P of length weighed."""
        x = Block(row, buckets, top)
        count = [Block.answered(v.order, row[f"n{k}"], "a", unpacked) for k, v in enumerate(x.levels, 1)]
        p = np.where(count[0] > 0, discounted(count[0], d[0]) / whole, unknown)
        past = None
        for k in range(2, top + 1):
            less, v = x.levels[k - 2], x.levels[k - 1]
            past = Block.answered(less.order, row[f"n{k - 1}"], "b", unpacked)
            if k <= weighed:
                alpha = Block.answered(less.order, row[f"w{k}"], "a", _floats)
                total = Block.answered(less.order, row[f"w{k}"], "b", unpacked)
                seen = count[k - 1] > 0
                back = np.where(past[v.first] > 0, alpha[v.first], 1.0) * p[v.suffix]
                p = np.where(seen, discounted(count[k - 1], d[k - 1]) / np.maximum(total[v.first], 1), back)
        return x, count, past, p

    def shares_of(k: int) -> Callable:
        def make(row: dict) -> Iterator[tuple]:
            x, count, past, p = known(row, k, k - 1)
            less, v = x.levels[-2:]
            sizes = {b: j - i for b, i, j in v.slices}
            bits = [np.unpackbits(np.frombuffer(q["own"], np.uint8), count=sizes[q["bucket"]]).astype(bool) for q in sorted(row[f"n{k}"], key=lambda q: q["bucket"])]
            own = np.empty(len(v.keys), bool)
            own[v.order] = np.concatenate(bits)
            lower = np.bincount(v.first[own], p[v.suffix[own]], len(less.keys))[less.order]
            used = np.bincount(v.first[own], discounted(count[k - 1][own], d[k - 1]), len(less.keys))[less.order]
            keys, past = less.keys[less.order], past[less.order]
            for b, i, j in less.slices:
                yield b, row["block"], packed_keys(keys[i:j]), np.concatenate((used[i:j], lower[i:j])).astype("<f8").tobytes(), packed(past[i:j])

        return make

    def weigh(inverse, n, rows):
        halves = [_floats(r["a"]) for r in rows]
        used, lower, past = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        np.add.at(used, inverse, np.concatenate([h[: len(h) // 2] for h in halves]))
        np.add.at(lower, inverse, np.concatenate([h[len(h) // 2 :] for h in halves]))
        past[inverse] = np.concatenate([unpacked(r["b"]) for r in rows])
        total = past + (used >= past)
        alpha = np.ones(n)
        some = past > 0
        alpha[some] = (1 - used[some] / total[some]) / np.maximum(1 - lower[some], 1e-15)
        return lambda v, i, j: alpha[v[i:j]].astype("<f8").tobytes(), lambda v, i, j: packed(total[v[i:j]]), None, []

    told = table
    for k in levels:
        told = told.join(_by_block(counted[k - 1], f"n{k}"), "block")
        if k > 1:
            answers = _answer(_ask(told, shares_of(k)), weigh)
            if k < order:
                answers = materialize(answers, f"katz-weights-{k}")
                kept.append(answers)
            told = told.join(_by_block(answers, f"w{k}"), "block")

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                x, count, _, p = known(b.slice(i, 1).to_pylist()[0], order, order)
                c = count[0][x.levels[0].of]
                base = np.log10((c + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
                sums = [np.add.reduceat(v, x.starts) for v in (base, np.log10(p)[x.levels[-1].of], (c > 0).astype(np.int64))]
                columns = [x.keys, x.held, x.lengths, sums[2], [tokens] * len(x.keys), sums[0], sums[1]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(columns, SCORED, strict=True)], [n for n, _ in SCORED])

    return materialize(told.mapInArrow(evaluate, SCORED_DDL), "katz-scores")


SCORED = [("key", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
SCORED_DDL = "key bigint, held boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fold(F.col("doc_id"), 5) == 1).withColumnsRenamed({"key": "doc_id", "held": "held_out"})
