"""Packing of tokenised documents into sequences by the sum-of-squares rule.

Documents become pieces (doc_id, piece, start, length, ids_crc32); only documents above the capacity are cut. Pieces
are dealt by a hash of their key into groups of about ``group`` pieces, and each group is packed on its own: with many
thousand pieces in a group, the bins left open at its end are a small share. In a group, longer pieces come first, and
each goes where the sum over gaps of (open bins with that gap) squared becomes smallest; among equals into the tightest
bin, and a new bin counts as one with a gap of the whole capacity.

The memory of a task is bounded by ``group``, whatever the input's size; no piece depends on another group.

Edge cases: a null text counts as empty and is one token, the end id; equal keys are packed apart like any others; an
empty table gives an empty result; texts of any length are tokenised whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, held, materialize, read_table, small_batches, text_or_empty

CAPACITY, END, GROUP = 4096, 1, 32768
#: Words and parts of words whose ids a worker keeps twice over, and the longest such word.
MEMO, MEMO_CHARS = 450_000, 40
#: Marks that often end a word, and letters whose lower case depends on what stands beside them.
MARKS, SPECIAL_CASE = ".,;:!?", re.compile("[\u03a3\u0130]")
#: The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PLAIN)}
#: str.split() takes these for white space, the tokenizer doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts, by a tokenizer whose pieces never span white space: each word is encoded once and remembered."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memo = Recent(memo)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if ODD_SPACE.search(text):
            return self._whole(text)
        words = text.split()
        ids = list(map(self.memo.young.get, words))
        if None in ids:
            self.memo.turn()
            find = self.memo.find
            for i, found in enumerate(ids):
                if found is None:
                    ids[i] = find(words[i]) or self._word(words[i])
        return b"".join(ids)

    def _word(self, word: str) -> bytes:
        parts, new = [], False
        for p in self._split(word):
            found = self.memo.find(p)
            if found is None:
                found, new = self._letters(p) if p in MARKS or self._plain(p) else self._whole(p), True
                if len(p) <= MEMO_CHARS:
                    self.memo.young[p] = found
            parts.append(found)
        ids = b"".join(parts)
        if len(word) <= MEMO_CHARS and not new:  # a word seen once leaves its parts only
            self.memo.young[word] = ids
        return ids

    @staticmethod
    def _plain(part: str) -> bool:
        """Whether normalisation leaves nothing but letters, so that the tokenizer doesn't split the part."""
        return part.isalpha() and (part.isascii() or unicodedata.normalize("NFC", part).isalpha() and not SPECIAL_CASE.search(part))

    def _letters(self, part: str) -> bytes:
        """Ids of what the tokenizer's own normalisation and splitting would leave as one piece."""
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).lower().encode().decode("latin-1").translate(BYTES)
        return np.array([t.id for t in self.model.tokenize(part)], "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _split(word: str) -> tuple[str, ...]:
        """Parts that the tokenizer encodes alone too: letters in lower case, and one mark after them."""
        stem, mark = (word[:-1], (word[-1],)) if word[-1] in MARKS else (word, ())
        if WordEncoder._plain(stem):
            return (stem.lower(), *mark)
        return (word,)


def encoder(path: str, memo: int = MEMO) -> WordEncoder:
    return held("packing", (path, memo), lambda: WordEncoder(path, memo))


def tokenised(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, memo: int = MEMO) -> DataFrame:
    """The pieces of all documents."""
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, memo).encode
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(t.as_py()) + tail
                for n, i in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[i : i + 4 * capacity]
                    rows.append((k, n, i // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, placed in the order given."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.int64(1) << 40
    for i, s in enumerate(lengths.tolist()):
        gaps = count[s:]
        # placing into gap h leaves gap h - s; closed bins (gap 0) don't count
        change = count[: capacity + 1 - s] - gaps + 1
        change[gaps == 0] = never
        change = 2 * change
        change[0] -= 2 * count[0] + 1 if gaps[0] else 0
        change[-1] = 2 * count[capacity - s] + 1 if s < capacity else 0
        h = int(change.argmin()) + s
        if h == capacity:
            at, n = n, n + 1
        else:
            at = open_bins[h].pop()
            count[h] -= 1
        bins[i], offsets[i] = at, capacity - h
        if h > s:
            count[h - s] += 1
            open_bins[h - s].append(at)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset. pieces is read twice: give a table, not a plan that is costly to repeat."""
    groups = max(1, -(-pieces.count() // group))

    def run(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        order = np.lexsort((table.column("ids_crc32").to_numpy(), table.column("piece").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy(), -length))
        table = table.take(pa.array(order))
        bins, offsets = sum_of_squares(length[order], capacity)
        ids = table.column("g").to_numpy() + bins * groups
        return table.drop(["g"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    g = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("bigint")
    return pieces.withColumn("g", g).groupBy("g").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP, memo: int = MEMO) -> DataFrame:
    """The packed pieces of docs; memo bounds the words that a worker remembers, which changes no result."""
    pieces = materialize(tokenised(docs, path or default_vocabulary(), text, key, capacity, memo=memo), "pieces")
    return pack(pieces, capacity, group)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
