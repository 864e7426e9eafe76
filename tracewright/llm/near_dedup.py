"""Near duplicates by order MinHash over word shingles, verified by banded alignment.

Words are runs between white space, in lower case; shingles are 5 words, labelled by their occurrence. Each of 72
samples hashes all labelled shingles, takes the two smallest and keeps them in text order, so a sample survives edits
that leave those shingles and their order. Three samples make a band; texts that share one of 24 bands are candidates.

Texts of equal words are one class from the start. In the first round, a bucket's members are compared with its pivot,
the member that shares buckets with most others, which for copies of one original is that original. Buckets whose
members are then of one class are done. The others take rounds that need no pairs of members either:

- A few pivots stand for the bucket; members that align with one join its class. Let P be the shingles of all pivots.
- A pair with a Jaccard index of 0.8 shares at least 4/9 of the sum of its sizes. A member with fewer shingles in P than
  any partner in the bucket demands is *apart*: whatever it resembles must share a shingle outside P with it, or k of
  them if k are lacking. So members go to cells, one for each of their shingles outside P (of a member that lacks k, all
  but its k - 1 largest hashes). A cell with an apart member and several classes is a bucket of the next round. Most
  cells have a single member, as random edits are not repeated: a bitmap of the cells that several members or their
  hashes meet in, one of them apart, tells which to make at all.
- The other members stay in the bucket without the pivots. They are near P; most are of one class by now. From the
  fourth round on, pivots come from the class with fewest members in the bucket, and later rounds have more pivots.

Random edits of one original share few shingles outside it, so cells are tiny; a group within a group shares many, and
its cells get their own pivots. Rounds end when every bucket is of one class. So every pair that shares a bucket is
compared, of one class anyway, or shown to be below the threshold, and no pairs of a bucket are ever listed. Buckets of
many differently permuted copies of one text (alike as sets, not in order) take work in proportion to their square.

A pair is confirmed if at least 0.8 of its distinct shingles align: aligned / (a + b - aligned), the longest common
subsequence of first occurrences within the band that this threshold leaves. It never exceeds the Jaccard index, and
equals it where the common shingles stand in the same order. Confirmed pairs' connected components are the classes.

Edge cases: a null text counts as empty; texts without words are one class; texts of fewer than 5 words are one shingle;
a null key orders after all others; rows that repeat key and text are both members of their class and, in drop_near,
both stay if their class keeps them; very long texts are hashed whole, in slices; an empty table gives an empty
result; other columns are untouched.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, held, marked, materialize, read_table, small_batches, text_or_empty

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 3
#: Share of the sum of two sizes that a pair of this similarity has in common.
SHARE = SIMILARITY / (1 + SIMILARITY)
#: Pivots beside the first, the round from which the rarest class gives them, and from which they are MORE times as many.
PIVOTS, MINORITY, LATE, MORE, MOST = 3, 3, 7, 4, 48
#: Members and shingles that one task compares with pivots at once.
GROUP_ROWS, GROUP_SHINGLES = 64, 300_000
#: Bits of a round's map of cells: for each shingle outside P, at most (8 MB; a fuller map keeps more cells, never fewer), and in a chunk.
BITS_EACH, MOST_BITS, CHUNK_BITS = 16, 1 << 26, 1 << 16
SEED = 41


def words_of(column: str):
    """The text as lower-case words with one space between."""
    return F.trim(F.regexp_replace(F.lower(text_or_empty(column)), SPACE, " "))


class Sketcher:
    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        n = BANDS * ROWS
        self.factor = rng.integers(1 << 62, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(1 << 63, size=n, dtype=np.uint64)
        self.place = rng.integers(1 << 62, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.memo: dict[str, int] = {}

    @staticmethod
    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    def plain(self, text: str) -> np.ndarray:
        """Hashes of the shingles, in text order."""
        from xxhash import xxh3_64_intdigest

        memo = self.memo
        if len(memo) > 100_000:
            memo.clear()
        words = text.split(" ") if text else []
        for w in set(words).difference(memo):
            memo[w] = xxh3_64_intdigest(w)
        w = np.array([memo[x] for x in words], np.uint64)
        n = max(1, len(w) - WORDS + 1) if len(w) else 0
        h = np.zeros(n, np.uint64)
        for j in range(min(WORDS, len(w))):
            h += w[j : j + n] * self.place[j]
        return self.mix(h)

    def shingles(self, text: str) -> np.ndarray:
        """Hashes of the occurrence-labelled shingles, in text order."""
        h = self.plain(text)
        self.distinct = n = len(h)
        order = np.argsort(h, kind="stable")
        same = np.concatenate(([False], h[order][1:] == h[order][:-1])) if n else np.zeros(0, bool)
        if same.any():
            self.distinct = n - int(same.sum())
            starts = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
            label = np.empty(n, np.uint64)
            label[order] = (np.arange(n) - starts).astype(np.uint64)
            h = np.where(label > 0, self.mix(h + label * np.uint64(0x9E3779B97F4A7C15)), h)
        return h

    def bands(self, text: str) -> tuple[list[int], int]:
        """The buckets of a text, and the number of its distinct shingles."""
        h = self.shingles(text)
        if not len(h):
            return [], 0
        n = len(self.factor)
        at, low = np.zeros((0, n), np.int64), np.zeros((0, n), np.uint64)
        for i in range(0, len(h), 2048):
            part = h[i : i + 2048, None] * self.factor + self.shift
            part ^= part >> np.uint64(31)
            part *= np.uint64(0x9FB21C651E98DF25)
            k = min(2, len(part))
            best = np.argpartition(part, k - 1, axis=0)[:k]
            at = np.concatenate((at, best + i))
            low = np.concatenate((low, np.take_along_axis(part, best, 0)))
            if len(at) > 2:
                best = np.argpartition(low, 1, axis=0)[:2]
                at, low = np.take_along_axis(at, best, 0), np.take_along_axis(low, best, 0)
        first, last = h[at.min(0)], h[at.max(0)]
        sample = self.mix(first * np.uint64(0xC2B2AE3D27D4EB4F) + last).reshape(BANDS, ROWS)
        band = sample[:, 0].copy()
        for j in range(1, ROWS):
            band = self.mix(band * np.uint64(0x165667B19E3779F9) + sample[:, j])
        return self.mix(band + np.arange(BANDS, dtype=np.uint64)).view(np.int64).tolist(), self.distinct


def sketcher() -> Sketcher:
    return held("near_dedup", "sketcher", Sketcher)


def distinct_shingles(text: str) -> np.ndarray:
    """Hashes of the distinct shingles, in the order of first occurrences."""
    h = sketcher().plain(text)
    return h[np.sort(np.unique(h, return_index=True)[1])]


def aligned(left: np.ndarray, right: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Share of distinct shingles that align within the band of the threshold; 0 if that can't reach it."""
    total = len(left) + len(right)
    need = similarity * total / (1 + similarity)
    band = total - 2 * need
    if min(len(left), len(right)) < need - 1e-9:
        return 0.0
    order = np.argsort(left)
    at = np.minimum(np.searchsorted(left, right, sorter=order), len(left) - 1)
    places = order[at]
    at = np.flatnonzero(left[places] == right)
    places = places[at][np.abs(places[at] - at) <= band + 1e-9]
    if len(places) < need - 1e-9:
        return 0.0
    if (np.diff(places) > 0).all():
        longest = len(places)
    else:
        tails: list[int] = []
        for j in places.tolist():
            k = bisect_left(tails, j)
            tails[k : k + 1] = [j]
        longest = len(tails)
    return longest / (total - longest)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bands = sketcher().bands
    for b in batches:
        found = [bands(t.as_py()) for t in b.column("words")]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("digest"), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.int64())], ["key", "digest", "bands", "size"])


COMPARED = "pivot bigint, salt int, rid bigint, degree bigint, size bigint, own boolean, links array<bigint>, inside bigint, outside array<bigint>"


def _compare(cells: bool):
    """Of a group, pivots with some of their members: each member's links, its number of shingles in P, and those outside."""

    def run(table: pa.Table) -> pa.Table:
        words = table.column("words")
        rows = table.drop_columns(["words"]).to_pylist()
        pivots = {r["rid"]: (r["label"], distinct_shingles(words[i].as_py())) for i, r in enumerate(rows) if r["own"]}
        union = np.unique(np.concatenate([h for _, h in pivots.values()])) if pivots else np.zeros(0, np.uint64)
        out = []
        for i, r in enumerate(rows):
            if r["own"]:
                continue
            h = distinct_shingles(words[i].as_py())
            links = [q for q, (label, other) in pivots.items() if label != r["label"] and aligned(other, h) >= SIMILARITY]
            beyond = np.setdiff1d(h, union, assume_unique=True) if cells else h[:0]
            inside = len(h) - len(beyond)
            lacking = int(np.ceil(SHARE * (len(h) + max(r["least"], SIMILARITY * len(h))) - 1e-9)) - inside
            beyond = np.sort(beyond)[: max(0, len(beyond) - max(1, lacking) + 1)]
            out.append((r["pivot"], r["salt"], r["rid"], r["degree"], r["size"], r["rid"] in pivots, links, inside, beyond.view(np.int64)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()))
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in COMPARED.split(", ")])

    return run


def _slots(batch: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of a batch's members, the slot of each one's cell, and the number of shingles of each member."""
    lists = batch.column("outside")
    x, n = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    pivot = np.repeat(batch.column("pivot").to_numpy(zero_copy_only=False), n).view(np.uint64)
    return x, (Sketcher.mix(x.view(np.uint64) + Sketcher.mix(pivot)) & np.uint64(bits - 1)).astype(np.int64), n


def _seen(bits: int):
    """Of a task's members, the slots by chunk: each slot's place, whether it has several members, and an apart one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, apart = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for b in batches:
            _, s, n = _slots(b, bits)
            slots.append(s)
            apart.append(np.repeat(b.column("apart").to_numpy(zero_copy_only=False), n))
        slot, at, count = np.unique(np.concatenate(slots), return_inverse=True, return_counts=True)
        several, near = count > 1, np.bincount(at, np.concatenate(apart), len(slot)) > 0
        code = (slot % CHUNK_BITS << 2 | several << 1 | near).astype(np.int32)
        chunk, start = np.unique(slot // CHUNK_BITS, return_index=True)
        codes = pa.ListArray.from_arrays(np.append(start, len(code)).astype(np.int32), code)
        yield pa.RecordBatch.from_arrays([pa.array(chunk.astype(np.int32)), codes], ["chunk", "codes"])

    return run


def _met(table: pa.Table) -> pa.Table:
    """The bits of one chunk: slots that have several members, one of them apart."""
    code = table.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    members = np.bincount(code >> 2, 1 + (code >> 1 & 1), CHUNK_BITS)
    met = (members > 1) & (np.bincount(code >> 2, code & 1, CHUNK_BITS) > 0)
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "met": pa.array([np.packbits(met).tobytes()])})


def _only(bits: int, found: bytes):
    """Members with those shingles outside P whose cells' bits are set."""
    met = np.frombuffer(found, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, slot, n = _slots(b, bits)
            stays = (met[slot >> 3] >> (7 - (slot & 7)) & 1).astype(bool)
            ends = np.concatenate(([0], np.cumsum(stays)))[np.concatenate(([0], np.cumsum(n)))]
            left = pa.ListArray.from_arrays(ends.astype(np.int32), x[stays])
            yield b.set_column(b.schema.get_field_index("outside"), "outside", left)

    return run


def _meeting(told: DataFrame) -> DataFrame:
    """told (pivot, rid, apart, outside, ...) without shingles of cells that one member has, or no apart one; a few others may stay."""
    n = told.agg(F.sum(F.size("outside"))).first()[0] or 0
    bits = min(MOST_BITS, max(CHUNK_BITS, 1 << (BITS_EACH * n).bit_length()))
    seen = told.select("pivot", "apart", "outside").mapInArrow(_seen(bits), "chunk int, codes array<int>")
    met = {r.chunk: bytes(r.met) for r in seen.groupBy("chunk").applyInArrow(_met, "chunk int, met binary").collect()}
    found = b"".join(met.get(i, bytes(CHUNK_BITS // 8)) for i in range(bits // CHUNK_BITS))
    return told.mapInArrow(_only(bits, found), told.schema)


def components(links: DataFrame, work: Scratch, left: str = "pivot", right: str = "rid") -> DataFrame:
    """(node, label) of every linked node: the smallest node that links reach. Label passing with pointer jumps."""
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    edges = work.keep(edges.union(edges.select("b", "a")).distinct())
    labels = work.keep(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        passed = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("beyond"))
        moved = passed.join(jump, "next").select("node", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") != F.col("label")).alias("moved"))
        moved = work.keep(moved)
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def _merged(labels: DataFrame | None, found: DataFrame, work: Scratch) -> DataFrame:
    """(node, label) of every linked node after more links: classes are joined by their labels only."""
    if labels is None:
        return components(found, work)
    ends = found.select("pivot", "rid")
    for end in ("pivot", "rid"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left").withColumn(end, F.coalesce(f"{end}_label", end)).drop(f"{end}_label")
    moved = components(ends, work)
    known = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return work.keep(known.unionByName(moved.join(labels, "node", "left_anti")))


def _round(members: DataFrame, words: DataFrame, work: Scratch, i: int) -> tuple[DataFrame, DataFrame]:
    """(pivots of the buckets, members compared with them) of round i; the first one is without cells."""
    rare = F.lit(0).cast("bigint")
    if i >= MINORITY:
        members = members.join(members.groupBy("bucket", "label").agg((-F.count("*")).alias("rare")), ["bucket", "label"])
        rare = F.col("rare")
    rank, who = F.struct(rare, F.col("degree"), -F.col("rid")), F.struct("rid", "size", "label")
    pivots = members.groupBy("bucket").agg(F.max_by(who, rank).alias("top"))
    pivots = work.keep(pivots.select("bucket", F.col("top.rid").alias("pivot"), F.col("top.size").alias("pivot_size"), F.col("top.label").alias("pivot_label")))
    pairs = members.join(pivots, "bucket").where(F.col("rid") != F.col("pivot"))
    if not i:
        pairs = pairs.where(F.least("size", "pivot_size") >= F.lit(SHARE) * (F.col("size") + F.col("pivot_size")) - 1e-9)
    own = pivots.select("pivot", F.col("pivot").alias("rid"), F.col("pivot_label").alias("label")).distinct()
    asked = work.keep(pairs.groupBy("pivot", "rid").agg(F.max("degree").alias("degree"), F.max("size").alias("size"), F.max("label").alias("label"), F.max(rare).alias("rare")))
    if i:
        part = F.pmod(F.xxhash64("rid", F.lit(i)), F.lit(min(MOST, PIVOTS * MORE ** max(0, i - LATE + 1))))
        more = asked.groupBy("pivot", part.alias("part")).agg(F.max_by(F.struct("rid", "label"), F.struct("rare", "degree", -F.col("rid"))).alias("top"))
        own = own.unionByName(more.select("pivot", "top.rid", "top.label"))
    groups = F.ceil(F.greatest(F.count("*") / GROUP_ROWS, F.sum("size") / GROUP_SHINGLES)).cast("int")
    salts = work.keep(asked.groupBy("pivot").agg(groups.alias("n"), F.min("size").alias("least")))
    rows = asked.join(salts, "pivot").select("pivot", "rid", "degree", "size", "label", "least", F.pmod(F.xxhash64("rid"), F.col("n")).cast("int").alias("salt"), F.lit(False).alias("own"))
    heads = own.join(salts, "pivot").select("pivot", "rid", F.lit(0).cast("bigint").alias("degree"), F.lit(0).cast("bigint").alias("size"), "label", "least", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), F.lit(True).alias("own"))
    told = work.keep(rows.unionByName(heads).join(words, "rid").groupBy("pivot", "salt").applyInArrow(_compare(i > 0), COMPARED))
    if not i:
        return pivots, told
    # apart: near the pivots neither by its own size nor for any size that a member near them has
    reach = F.col("inside") / F.lit(SHARE) - F.col("size") + 1e-6
    told = told.withColumn("reach", reach)
    near = told.where("not own and reach >= size").groupBy("pivot", F.floor(F.log(1.05, F.col("size"))).alias("kind")).agg(F.min("size").alias("lo"), F.max("reach").alias("far"))
    near = near.groupBy("pivot").agg(F.collect_list(F.struct("lo", "far")).alias("near")).join(salts, "pivot")
    near = near.select("pivot", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"), "near")
    meets = F.exists(F.coalesce("near", F.array().cast("array<struct<lo:bigint,far:double>>")), lambda x: (x["lo"] <= F.col("reach")) & (x["far"] >= F.col("size")))
    judged = told.join(near, ["pivot", "salt"], "left")
    return pivots, judged.withColumn("apart", (F.col("reach") < F.col("size")) & ~meets).drop("near", "salt", "reach", "inside")


def resolve(members: DataFrame, words: DataFrame, work: Scratch) -> DataFrame | None:
    """(node, label) of the linked ones of members(bucket, rid, degree, size), every bucket resolved; None without links."""
    members, labels, i = members.withColumn("label", F.col("rid")), None, 0
    while True:
        pivots, told = _round(members, words, work, i)
        told = work.keep(told)
        found = told.select(F.explode("links").alias("pivot"), "rid")
        merged = not found.isEmpty()
        if merged:
            labels = _merged(labels, found, work)
        if i:
            stay = told.where("not own and not apart").select("pivot", "rid")
            rest = members.join(pivots.select("bucket", "pivot"), "bucket").join(stay, ["pivot", "rid"]).withColumn("apart", F.lit(True))
            lifted = _meeting(told.where("not own").select("rid", "degree", "size", "apart", "outside", "pivot")).select("rid", "degree", "size", "apart", F.explode("outside").alias("x"), "pivot")
            cells = lifted.select(F.xxhash64("pivot", "x").alias("bucket"), "rid", "degree", "size", F.lit(None).cast("bigint").alias("label"), "apart")
            pool = rest.select(*cells.columns).unionByName(cells)
        else:
            pool = members.join(pivots.select("bucket", F.col("pivot").alias("rid")), ["bucket", "rid"], "left_anti").withColumn("apart", F.lit(True))
        if labels is None:
            pool = pool.withColumn("label", F.col("rid"))
        elif merged or i:
            pool = pool.drop("label").join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
        pool = work.keep(pool.select("bucket", "rid", "degree", "size", "label", "apart"))
        mixed = pool.groupBy("bucket").agg((F.min("label") != F.max("label")).alias("mixed"), F.max("apart").alias("open")).where("mixed and open")
        members = work.keep(pool.join(work.keep(mixed.select("bucket")), "bucket", "left_semi").drop("apart"))
        if members.isEmpty():
            return labels
        if not i:
            words = work.keep(words.join(members.select("rid").distinct(), "rid", "left_semi"))
        i += 1


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, kept): key and digest of every row; and (digest, keep_key, keep_digest) of every digest in a class of several rows."""
    texts = small_batches(docs).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    base = _worded(texts)
    work = Scratch(docs.sparkSession, "near")
    rows = materialize(base.mapInArrow(_bands, "key bigint, digest binary, bands array<bigint>, size bigint"), "near-rows")
    order = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key"))).getField("key")
    reps = rows.groupBy("digest").agg(order.alias("first"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("size").alias("size"))
    reps = work.keep(reps.withColumn("rid", F.monotonically_increasing_id()))
    entries = reps.select("rid", "size", F.explode("bands").alias("bucket"))
    sizes = work.keep(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    shared = work.keep(entries.join(sizes, "bucket"))
    degree = shared.groupBy("rid").agg(F.sum("n").alias("degree"))
    ranked = work.keep(shared.select("rid", "bucket", "size").join(degree, "rid"))
    labels = resolve(ranked, _texts_of(texts, reps, ranked.select("rid").distinct(), work), work)
    if labels is None:
        labels = ranked.select(F.col("rid").alias("node"), F.col("rid").alias("label")).limit(0)
    labelled = reps.join(labels.withColumnRenamed("node", "rid"), "rid", "left").where("label is not null or copies > 1")
    labelled = work.keep(labelled.select("digest", "first", F.coalesce("label", "rid").alias("label")))
    best = F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("digest"))).alias("best")
    winners = labelled.groupBy("label").agg(best)
    kept = labelled.join(winners, "label").select("digest", F.col("best.first").alias("keep_key"), F.col("best.digest").alias("keep_digest"))
    kept = materialize(kept, "near-kept")
    work.drop()
    return rows.select("key", "digest"), kept


def _worded(texts: DataFrame) -> DataFrame:
    """texts (key, text, ...) with the text's words and their digest for the text."""
    return texts.withColumn("words", words_of("text")).drop("text").withColumn("digest", F.unhex(F.md5(F.col("words").cast("binary"))))


def _both():
    """Digest and key as one value, where no key is a key too: equal to itself in a join, so what a join dealt by it is dealt for good."""
    return F.concat("digest", F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")).alias("both")


def _texts_of(texts: DataFrame, reps: DataFrame, needed: DataFrame, work: Scratch) -> DataFrame:
    """(rid, words) of the texts that are candidates at all, one of each class of copies. Of other texts few are shuffled, see marked."""
    wanted = work.keep(reps.withColumnRenamed("first", "key").join(needed, "rid").select(_both(), "rid", "key"))
    base = _worded(marked(texts, wanted, "key").where("hit")).select(_both(), "words")
    return work.keep(base.join(wanted.select("both", "rid"), "both").dropDuplicates(["both"]).select("rid", "words"))


def drop_near(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each class, its smallest key; columns unchanged. Few rows are shuffled but those that go, see marked."""
    rows, kept = classes(docs, text, key)
    stays = F.col("key").eqNullSafe(F.col("keep_key")) & (F.col("digest") == F.col("keep_digest"))
    gone = materialize(rows.join(kept, "digest").where(~stays).select(_both(), "key"), "near-gone")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    whole = marked(whole, gone, "key")
    left = _worded(whole.where("hit")).select("row", _both()).join(gone, "both", "left_anti")
    return whole.where("not hit").select("row.*").unionByName(left.select("row.*"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, kept = classes(read_table(spark, sf_dir, "documents"))
    joined = rows.join(kept, "digest", "left")
    alone = F.col("keep_digest").isNull()
    return joined.select(
        F.col("key").alias("doc_id"),
        F.when(alone, F.col("key")).otherwise(F.col("keep_key")).alias("class_id"),
        (alone | (F.col("key").eqNullSafe(F.col("keep_key")) & (F.col("digest") == F.col("keep_digest")))).alias("kept"),
    )
