"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. A trigram's vector binds (multiplies) its letters' vectors, each
permuted (rotated) by its place; a text's vector bundles (adds) its trigrams' vectors; a language's prototype bundles
its training texts. A text gets the language whose prototype has the largest cosine.

Letters are lower-cased; a to z have a class each and all other letters share 37 classes by code point. Every run of
other characters is one boundary, class 0. Training is a distributed sum over all training rows: each task bundles
what it reads into one vector per language and Spark adds those, so the driver gets one vector per language.

Edge cases: a null text, or one without letters, is ``und`` with score 0; rows with null language don't train; with no
training rows at all every text is ``und``; equal cosines give the language first by name; a lang, source or key never
reaches the prediction; very long texts are taken whole; repeated rows are judged alike; the columns made here take the
place of input columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, fold, held, read_table, small_batches

CLASSES, DIMENSIONS, SEED = 64, 1024, 20260101
#: Trigram vectors that a worker keeps; others are bound again each time.
KEPT = 32768
UNKNOWN = "und"
#: Cosines below which keep_known takes a text for no language at all: of a text of one word (one standard deviation of a
#: random cosine), and of one with LONG trigrams or more; between them the bound grows with the trigrams.
LEAST, LEAST_LONG, LONG = 0.03, 0.12, 200


class Space:
    """Letter classes and the vectors of trigrams; made once in each worker."""

    def __init__(self, seed: int = SEED, dimensions: int = DIMENSIONS):
        rng = np.random.default_rng(seed)
        letters = rng.choice(np.array([-1, 1], np.int8), (CLASSES, dimensions))
        self.places = [np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters]
        self.kept, self.filled = np.empty((KEPT, dimensions), np.int8), 0
        self.slot = np.full(CLASSES**3, -1, np.int32)
        classes = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                classes[c] = c - 96 if 97 <= c <= 122 else 27 + c % 37
        self.classes = classes

    def grams(self, text: str) -> np.ndarray:
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
        c = self.classes[points].astype(np.int32)
        c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
        codes = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        return codes[c[1:-1] != 0]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = self.places
        return a[codes // CLASSES**2] * b[codes // CLASSES % CLASSES] * c[codes % CLASSES]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        new = codes[self.slot[codes] < 0]
        if len(new) and self.filled + len(new) <= KEPT:
            self.slot[new] = self.filled + np.arange(len(new))
            self.kept[self.filled : self.filled + len(new)] = self.bind(new)
            self.filled += len(new)
            new = new[:0]
        return self.bind(codes) if len(new) else self.kept[self.slot[codes]]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.places[2].shape[1])
        for i in range(0, len(codes), 4096):
            total += counts[i : i + 4096].astype(np.float32) @ self.vectors(codes[i : i + 4096]).astype(np.float32)
        return total


def space(seed: int, dimensions: int) -> Space:
    return held("langid", (seed, dimensions), lambda: Space(seed, dimensions))


def train(rows: DataFrame, text: str = "text", lang: str = "lang", seed: int = SEED, dimensions: int = DIMENSIONS) -> dict[str, list[float]]:
    """Prototype vectors by language, from all rows with a language and a text."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, counts = space(seed, dimensions), {}
        for b in batches:
            for t, k in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if k not in counts:
                    counts[k] = np.zeros(CLASSES**3, np.int64)
                used, n = np.unique(s.grams(t.as_py()), return_counts=True)
                counts[k][used] += n
        for k, n in counts.items():
            used = np.flatnonzero(n)
            v = s.bundle(used, n[used])
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["lang", "i", "x"])

    sums = (
        small_batches(rows).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
        .mapInArrow(partial, "lang string, i int, x double")
        .groupBy("lang", "i")
        .agg(F.sum("x").alias("x"))
    )
    # one vector of fixed length per language comes to the driver
    out: dict[str, list[float]] = {}
    for r in sums.collect():
        out.setdefault(r.lang, [0.0] * dimensions)[r.i] = r.x
    return out


def classify(docs: DataFrame, model: dict[str, list[float]], columns: list, text: str = "text", seed: int = SEED, dimensions: int = DIMENSIONS) -> DataFrame:
    """columns (of docs) with lang_pred, score (the best prototype's cosine, not below 0) and the number of trigrams."""
    langs = sorted(model)
    matrix = np.array([model[k] for k in langs]).reshape(len(langs), dimensions)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def predict(texts: pa.Array) -> tuple[list[str], list[float], list[int]]:
        s = space(seed, dimensions)
        names, scores, sizes = [], [], []
        for t in texts:
            codes, n = np.unique(s.grams(t.as_py() or ""), return_counts=True)
            sizes.append(int(n.sum()))
            v = s.bundle(codes, n)
            size = float(np.linalg.norm(v))
            if not len(codes) or not langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            cos = matrix @ v / max(size, 1e-300)
            best = int(np.argmax(cos))
            names.append(langs[best])
            scores.append(float(min(1.0, max(0.0, cos[best]))))
        return names, scores, sizes

    picked = small_batches(docs).select(F.struct(*columns).alias("row"), F.col(text).cast("string").alias("text"))
    row = picked.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores, sizes = predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], ["row", "lang_pred", "score", "n_grams"])

    return beside(picked.mapInArrow(run, f"row {row}, lang_pred string, score double, n_grams bigint"), "lang_pred", "score", "n_grams")


def keep_known(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = LEAST, least_long: float = LEAST_LONG) -> DataFrame:
    """docs, columns unchanged, without texts of no known language: those without letters, or nearer to none than least."""
    model = train(docs.where(fold(F.col(key), 4) != 2), text, lang)
    judged = classify(docs, model, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")], text)
    bound = F.lit(least) + F.lit(least_long - least) * F.least(F.lit(1.0), F.col("n_grams") / LONG)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= bound)).select("doc.*")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held))
    return classify(docs, model, [F.col("doc_id"), held.alias("held_out")])
