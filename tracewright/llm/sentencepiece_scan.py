"""SentencePiece encoding and decoding by a max-plus scan over chunks.

The vocabulary is a byte-pair one: merging best-scored neighbours first. A sequence of pieces is the encoding of its
text exactly if every piece encodes to itself and every two neighbours encode, together, to themselves. So encoding
is a best path through nodes (end position, last piece) whose edges weigh 0 if the neighbours agree and minus infinity
if not, and exactly one path to the text's end has weight 0. In this max-plus algebra the part of a path inside a
chunk is a transfer matrix from the nodes that can stand at the chunk's start to those at its end; as its entries are
0 or minus infinity, a row set is kept as the bits of an integer, "or" being max and "and" being plus.

Texts above ``chunk`` characters become rows of a chunk each, spread over the cluster: one pass computes matrices, a
grouped pass combines those of a text (tiny, and associative: ``compose``) and picks the node at every border, and one
more backtraces all chunks independently. Shorter texts are one chunk from the start node. Where no piece of the
vocabulary holds two neighbouring characters, every path passes between them (a cut), so matrices have rank one there
and the words between cuts are encoded once and remembered.

Ids and text are those of the sentencepiece library: a space is put before the text, spaces become U+2581, characters
outside the vocabulary become the byte pieces of their UTF-8 form.

Edge cases: a null text counts as empty, which has no ids; a U+2581 in a text decodes to a space, as in the library;
equal keys are told apart by a row number; long texts without any cut are scanned whole; an empty table gives an
empty result; unknown or control ids decode to nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, beside, held, materialize, read_table, small_batches, text_or_empty

CHUNK = 32768
#: Chunks of a text that are cut off at once.
CUT = 64
#: Words (twice over) and pairs of pieces that a worker remembers, and rows it returns at once.
WORDS, PAIRS, ROWS = 300_000, 300_000, 500
SPACE = "▁"
GROUPS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Scanner:
    """The vocabulary of a model file with what is remembered of its words and neighbours."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.texts: list[bytes] = [b""] * n
        self.byte_ids = [model.unk_id()] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.texts[i] = bytes([int(piece[3:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.texts[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.ids))
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.valid: dict[str, bool] = {}
        self.agree: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.automaton = None
        self.words = Recent(WORDS)

    def merge(self, text: str) -> list[str]:
        """The definition: join the best-scored neighbours, leftmost first, until none can be joined."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def is_valid(self, piece: str) -> bool:
        if piece not in self.ids:
            return len(piece) == 1
        if piece not in self.valid:
            self.valid[piece] = self.merge(piece) == [piece]
        return self.valid[piece]

    def agrees(self, left: str | None, right: str) -> bool:
        """Weight of an edge: True is 0, False minus infinity. None stands for a cut, which agrees with all."""
        if left is None:
            return self.is_valid(right)
        known = self.agree.get(left)
        if known is None:
            known = self.agree[left] = {}
        if right not in known:
            self.pairs += 1
            if self.pairs > PAIRS:
                self.agree.clear()
                self.pairs, known = 0, {}
                self.agree[left] = known
            known[right] = self.is_valid(right) and self.merge(left + right) == [left, right]
        return known[right]

    def is_cut(self, text: str, at: int) -> bool:
        return at <= 0 or at >= len(text) or text[at - 1 : at + 1] not in self.inside

    def nodes(self, text: str, end: int, start: int = 0) -> list[str]:
        """The pieces that can end at end, longest first; a character outside the vocabulary stands for itself."""
        return [text[b:end] for b in range(max(start, end - self.longest), end) if self.is_valid(text[b:end])]

    def matcher(self):
        """An automaton that finds, at each end, the pieces that end there."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for p in self.ids.keys() | {c for p in self.ids for c in p}:
                if self.is_valid(p):
                    self.automaton.add_word(p, (len(p), p))
            self.automaton.make_automaton()
        return self.automaton

    def path(self, text: str) -> list[str]:
        """The pieces of a text that begins at a cut: the one path of weight 0, found node by node."""
        agree, n = self.agree, len(text)
        last: list[str | None] = [None] * (n + 1)
        for end, (size, piece) in self.matcher().iter(text):
            if last[end + 1] is None:
                begin = end + 1 - size
                if begin:
                    left = last[begin]
                    if left is None:
                        continue
                    known = agree.get(left)
                    weight = known.get(piece) if known is not None else None
                    if not (self.agrees(left, piece) if weight is None else weight):
                        continue
                last[end + 1] = piece
        out, end = [], n
        while end:
            piece = last[end] or text[end - 1 : end]
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def to_ids(self, pieces: list[str]) -> bytes:
        found: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            found.extend([i] if i is not None else [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")])
        return np.array(found, "<u4").tobytes()

    def word(self, text: str) -> bytes:
        found = self.words.find(text) if text else b""
        if found is None:
            inside = self.inside
            cuts = [0, *[i for i in range(1, len(text)) if text[i - 1 : i + 1] not in inside], len(text)]
            if len(cuts) > 2:
                found = b"".join([self.word(text[a:b]) for a, b in zip(cuts, cuts[1:])])  # noqa: B905
            else:
                found = self.to_ids([text] if self.is_valid(text) else self.path(text))
            if len(text) <= 64:
                self.words.young[text] = found
        return found

    def between_cuts(self, text: str) -> bytes:
        """Ids of a text with a cut at both ends."""
        words = GROUPS.findall(text) if SPACE + SPACE in text else text.replace(SPACE, " " + SPACE).replace("\n", " \n ").split(" ")
        self.words.turn()
        known, word = self.words.young, self.word
        return b"".join([known.get(w) or word(w) for w in words])

    def encode(self, text: str) -> bytes:
        return self.between_cuts(SPACE + text.replace(" ", SPACE)) if text else b""

    def decode(self, ids: bytes) -> str:
        texts, n = self.texts, len(self.texts)
        out = b"".join([texts[i] for i in np.frombuffer(ids, "<u4").tolist() if i < n]).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    # Chunks: text is the chunk with context on both sides, [start, end) the chunk itself.

    def border(self, text: str, at: int) -> list[tuple[int, str | None]]:
        """The nodes (position relative to at, piece or None at a cut) that can be the last at or before at."""
        out: list[tuple[int, str | None]] = []
        for end in range(at, max(-1, at - self.longest), -1):
            if self.is_cut(text, end):
                return [*out, (end - at, None)]
            out += [(end - at, p) for p in self.nodes(text, end)]
        return out

    def sweep(self, text: str, live: dict[tuple[int, str | None], int], start: int, end: int, back: dict | None = None) -> dict[tuple[int, str | None], int]:
        """From nodes (position, piece) with their row sets to all nodes up to end; back gets predecessors."""
        by_end: dict[int, list[tuple[str | None, int]]] = {}
        for (at, piece), rows in live.items():
            by_end.setdefault(at, []).append((piece, rows))
        for at in range(start + 1, end + 1):
            here: list[tuple[str | None, int]] = []
            for piece in self.nodes(text, at):
                rows = 0
                for left, mask in by_end.get(at - len(piece), ()):
                    if self.agrees(left, piece):
                        rows |= mask
                        if back is not None:
                            back[at, piece] = (at - len(piece), left)
                if rows:
                    here.append((piece, rows))
            if here and self.is_cut(text, at):
                rows = 0
                for piece, mask in here:
                    rows |= mask
                    if back is not None:
                        back[at, None] = (at, piece)
                here = [(None, rows)]
            if here:
                by_end[at] = by_end.get(at, []) + here
        return {(at, piece): rows for at, here in by_end.items() for piece, rows in here}

    def cuts(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """The first and last cut in (start, end]."""
        first = next((i for i in range(start + 1, end + 1) if self.is_cut(text, i)), None)
        return None if first is None else (first, next(i for i in range(end, start, -1) if self.is_cut(text, i)))

    def matrix(self, text: str, start: int, end: int) -> list[int]:
        """For each node at the chunk's end, in border's order, the set of nodes at its start that reach it."""
        entries = self.border(text, start)
        live = {(start + at, piece): 1 << i for i, (at, piece) in enumerate(entries)}
        cuts = self.cuts(text, start, end)
        if cuts:
            reached = self.sweep(text, live, start, cuts[0]).get((cuts[0], None), 0)
            live, start = {(cuts[1], None): reached}, cuts[1]
        reach = self.sweep(text, live, start, end)
        return [reach.get((end + at, piece), 0) for at, piece in self.border(text, end)]

    def backtrace(self, text: str, start: int, end: int, entry: int, leave: int) -> bytes:
        """Ids of the pieces after the entry node up to the leaving one."""
        at, piece = self.border(text, start)[entry]
        off, last = self.border(text, end)[leave]
        goal, node = (end + off, last), (start + at, piece)
        cuts = self.cuts(text, start, end)
        if not cuts:
            return self.to_ids(self._walk(text, node, start, end, goal))
        head = self._walk(text, node, start, cuts[0], (cuts[0], None))
        tail = self._walk(text, (cuts[1], None), cuts[1], end, goal)
        return self.to_ids(head) + self.between_cuts(text[cuts[0] : cuts[1]]) + self.to_ids(tail)

    def _walk(self, text: str, node, start: int, end: int, goal) -> list[str]:
        back: dict = {}
        self.sweep(text, {node: 1}, start, end, back)
        out: list[str] = []
        while goal != node:
            if goal[1] is not None:
                out.append(goal[1])
            goal = back[goal]
        return out[::-1]


def compose(left: list[int], right: list[int]) -> list[int]:
    """Max-plus product of two chunks' matrices; associative."""
    out = []
    for rows in right:
        total, i = 0, 0
        while rows:
            if rows & 1:
                total |= left[i]
            rows >>= 1
            i += 1
        out.append(total)
    return out


def choose(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """Entry and leaving node of each chunk on the path of weight 0 from the first node to the last."""
    prefix = [[1]]
    for m in matrices:
        prefix.append(compose(prefix[-1], m))
    leave, out = next(i for i, rows in enumerate(prefix[-1]) if rows), []
    for m, before in zip(matrices[::-1], prefix[-2::-1], strict=True):
        entry = next(i for i, rows in enumerate(before) if rows and m[leave] >> i & 1)
        out.append((entry, leave))
        leave = entry
    return out[::-1]


def scanner(path: str) -> Scanner:
    return held("sentencepiece", path, lambda: Scanner(path))


def _pack(rows: list[int]) -> list[str]:
    return [f"{r:x}" for r in rows]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """key, text (null as empty), ids (binary, little-endian 32-bit) and chunks of every row."""
    path = path or default_vocabulary()
    rows = small_batches(docs).select(F.col(key).cast("bigint").alias("key"), text_or_empty(text).alias("text"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(path)
        for b in batches:
            for i in range(0, len(b), ROWS):
                part = b.slice(i, ROWS)
                ids = pa.array([s.encode(t.as_py()) for t in part.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array([1] * len(part), pa.int32())], ["key", "text", "ids", "chunks"])

    short = rows.where(F.length("text") <= chunk).mapInArrow(small, "key bigint, text string, ids binary, chunks int")
    giant = rows.where(F.length("text") > chunk)
    return short.unionByName(_encode_giant(giant, path, chunk))


def _encode_giant(giant: DataFrame, path: str, chunk: int) -> DataFrame:
    s = scanner(path)
    context = 2 * s.longest
    texts = materialize(giant.withColumn("uid", F.monotonically_increasing_id()), "giant-texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, text in zip(b.column("uid").to_pylist(), b.column("text"), strict=True):
                norm = SPACE + text.as_py().replace(" ", SPACE)
                for j in range(0, len(norm), chunk * CUT):
                    at = range(j, min(len(norm), j + chunk * CUT), chunk)
                    first = [max(0, i - context) for i in at]
                    columns = [[uid] * len(at), [i // chunk for i in at], [i - f for i, f in zip(at, first, strict=True)], [min(chunk, len(norm) - i) for i in at], [norm[f : i + chunk + 1] for i, f in zip(at, first, strict=True)]]
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["uid", "i", "start", "size", "body"])

    parts = texts.select("uid", "text").mapInArrow(cut, "uid bigint, i int, start int, size int, body string").repartition("uid", "i")
    parts = materialize(parts, "giant-chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(path)
        for b in batches:
            found = [_pack(s.matrix(r["body"], r["start"], r["start"] + r["size"])) for r in b.select(["body", "start", "size"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("i"), pa.array(found, pa.list_(pa.string()))], ["uid", "i", "m"])

    def borders(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["i"])
        path = choose([[int(x, 16) for x in r["m"]] for r in rows])
        return pa.table({"uid": pa.array([r["uid"] for r in rows], pa.int64()), "i": pa.array([r["i"] for r in rows], pa.int32()), "entry": pa.array([p[0] for p in path], pa.int32()), "leave": pa.array([p[1] for p in path], pa.int32())})

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(path)
        for b in batches:
            found = [s.backtrace(r["body"], r["start"], r["start"] + r["size"], r["entry"], r["leave"]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("i"), pa.array(found, pa.binary())], ["uid", "i", "ids"])

    chosen = parts.select("uid", "i", "body", "start", "size").mapInArrow(matrices, "uid bigint, i int, m array<string>").groupBy("uid").applyInArrow(borders, "uid bigint, i int, entry int, leave int")
    traced = parts.join(chosen, ["uid", "i"]).select("uid", "i", "body", "start", "size", "entry", "leave").mapInArrow(ids, "uid bigint, i int, ids binary")
    whole = traced.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), ""))
    return texts.join(whole, "uid").select("key", "text", joined.alias("ids"), F.size("parts").alias("chunks"))


def decode(encoded: DataFrame, columns: list, path: str | None = None, ids: str = "ids") -> DataFrame:
    """columns (of encoded) with decoded, the text of ids."""
    path = path or default_vocabulary()
    picked = small_batches(encoded).select(F.struct(*columns).alias("row"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(path)
        for b in batches:
            for i in range(0, len(b), ROWS):
                part = b.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([s.decode(x.as_py() or b"") for x in part.column("ids")], pa.string())], ["row", "decoded"])

    return beside(picked.mapInArrow(run, f"row {picked.schema['row'].dataType.simpleString()}, decoded string"), "decoded")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(read_table(spark, sf_dir, "documents"))
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    back = decode(coded, [F.col("key").alias("doc_id"), n, F.crc32("ids").alias("ids_crc32"), "chunks", "text"])
    return back.select("doc_id", "n_tokens", "ids_crc32", "chunks", (F.col("decoded") == F.col("text")).alias("round_trip"))
