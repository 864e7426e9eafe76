"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

The kernel compares words by the letter triples they share in order, gaps allowed: a triple that spans s characters
(at most 6) weighs 0.6^s, so a letter put into or between others moves little weight. Word ends count as a letter, and
the kernel is normalised. Landmarks (at most 400) give the Nystroem features k(x, Z) K(Z, Z)^(-1/2); a squared-hinge
SVM is trained on them. As the decision is linear in k(x, Z), it collapses to one table over triples, which is all that
scoring needs.

Labels are of documents, so sentences are labelled first, as bags of words: a sentence of a toxic document counts as
toxic if it has a witness, a word found in so many different places of toxic sentences, and next to none of clean ones,
that chance doesn't explain it; toxic texts that no such word explains may have rarer ones (see ``witnesses``). Each toxic sentence trains by its witnesses (also with a letter or mark inserted); each clean one
by the word that currently scores highest, found anew in each round. A text scores as its worst word: the words
between white space, their parts between other characters, and runs of single letters read as one word.

Toxic texts that no word explains train a second machine of the same kind on whole sentences, whose symbols are words:
pairs of words in order, at most three words apart, weighted by their distance. A text's sentences first all count as
toxic, then only the one that scores highest. It is kept if, trained on half of those texts and of the clean ones, it
finds half of the other toxic ones and next to none (``NOISE``) of the other clean ones, of which a few may be labelled wrongly;
a text then scores as the worse of word and sentence. Fewer than ``UNEXPLAINED`` such texts train no machine.

The classifier is fitted on a sample of labelled rows, bounded by ``rows`` per label and ``longest`` characters a text,
taken in order of a hash of the text; scoring covers whole texts of all rows.

Edge cases: a null or empty text, or one without words, scores what the SVM gives no evidence, near 0; without toxic
or without clean training rows every text scores 0; labels that repeat or conflict all train; rows without a label
don't; very long words are scored by windows; equal texts score equally; score and predicted take
the place of input columns of those names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Recent, beside, fold, materialize, read_table, small_batches

CLASSES, SPAN, DECAY = 64, 6, 0.6
ROWS, LONGEST, LANDMARKS, ROUNDS, SEED = 3000, 20_000, 400, 4, 7
WINDOW, MEMO, SHARP = 24, 200_000, 6.0
NOTHING, LETTER = -2.0, -3.0
#: Bits of a word pair's code, and unexplained texts that a sentence machine needs.
PAIR_BITS, UNEXPLAINED = 18, 8
#: Clean-labelled texts that may be wrong; share of chance finds among rare witnesses.
NOISE, DISCOVERY = 0.01, 0.05
SENTENCE = re.compile(r"[.!?\n]+")
PARTS = re.compile(r"[^\W\d_]+")
ADDRESS = re.compile(r"\W*(?:[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}|[a-z][a-z0-9+.-]*://\S+)\W*")
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def letter_class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37


def units(token: str) -> list[str]:
    """What a token, lower-cased and without white space, is scored as: its letters, and its parts of letters alone."""
    parts = PARTS.findall(token)
    whole = "".join(parts)
    if ADDRESS.fullmatch(token):
        found = []  # an address is no word of a sentence
    else:
        found = [whole] if len(parts) < 2 else [whole, *parts]
    return [u[i : i + WINDOW] for u in found if len(u) > 1 for i in range(0, max(1, len(u) - WINDOW // 2), WINDOW // 2)]


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and normalised weight of each word's distinct triples."""
    longest = max(map(len, words), default=0) + 2
    grid = np.full((len(words), longest + SPAN), -1, np.int64)
    for i, w in enumerate(words):
        grid[i, 0] = grid[i, len(w) + 1] = 0
        grid[i, 1 : len(w) + 1] = [letter_class(c) for c in w]
    codes, weights = [], []
    for a, b in OFFSETS:
        x, y, z = grid[:, :longest], grid[:, a : longest + a], grid[:, b : longest + b]
        codes.append(np.where(z >= 0, (x * CLASSES + y) * CLASSES + z, -1))
        weights.append(DECAY ** (b + 1))
    row = np.repeat(np.arange(len(words)), longest)
    code = np.concatenate([c.ravel() for c in codes])
    row, weight = np.tile(row, len(OFFSETS)), np.repeat(weights, len(words) * longest)
    row, code, weight = row[code >= 0], code[code >= 0], weight[code >= 0]
    key, inverse = np.unique(row * CLASSES**3 + code, return_inverse=True)
    weight = np.bincount(inverse, weight, len(key))
    row, code = key // CLASSES**3, key % CLASSES**3
    norm = np.sqrt(np.bincount(row, weight**2, len(words)))
    return row, code, weight / norm[row]


def decide(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    out = np.empty(len(words))
    for i in range(0, len(words), 4000):
        part = words[i : i + 4000]
        row, code, weight = triples(part)
        out[i : i + 4000] = np.bincount(row, weight * table[code], len(part)) + bias
    return out


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel values of all of a, blockwise, against the bounded list b."""
    used = np.unique(triples(b)[1])
    place = np.full(CLASSES**3, -1)
    place[used] = np.arange(len(used))

    def dense(words: list[str]) -> np.ndarray:
        row, code, weight = triples(words)
        keep = place[code] >= 0
        m = np.zeros((len(words), len(used)))
        m[row[keep], place[code[keep]]] = weight[keep]
        return m

    right = dense(b).T
    return np.concatenate([dense(a[i : i + 1000]) @ right for i in range(0, len(a), 1000)])


def squared_hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear SVM, by Newton steps on its primal."""
    z = np.hstack((x, np.ones((len(x), 1))))
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (z @ w) < 1
        za = z[active]
        new = np.linalg.solve(ridge + za.T @ (za * c[active, None]), za.T @ (c[active] * y[active]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def nystroem(k: np.ndarray) -> np.ndarray:
    """K^(-1/2) of the landmarks' kernel matrix, without directions that have next to no weight."""
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6
    return vectors[:, good] / np.sqrt(values[good])


def pairs_of(sentence: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and normalised weights of a sentence's word pairs."""
    words = ["".join(PARTS.findall(w)) for w in sentence.lower().split()]
    h = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words if w], np.uint64)
    codes, weights = [], []
    for gap in range(1, 4):
        if len(h) > gap:
            mixed = (h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:]) * np.uint64(0xD6E8FEB86659FD93)
            codes.append((mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64))
            weights.append(np.full(len(h) - gap, DECAY ** (gap + 1)))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0)
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    weight = np.bincount(inverse, np.concatenate(weights))
    return code, weight / np.linalg.norm(weight)


def sentence_kernel(a: list[tuple], b: list[tuple]) -> np.ndarray:
    table, out = np.zeros((1 << PAIR_BITS)), np.zeros((len(a), len(b)))
    for j, (code, weight) in enumerate(b):
        table[code] = weight
        out[:, j] = [w @ table[c] for c, w in a]
        table[code] = 0
    return out


def sentences_of(text: str | None) -> list[str]:
    return [s for s in SENTENCE.split((text or "").lower()) if s.strip()]


def fit_sentences(bad: list[list[tuple]], clean: list[list[tuple]]) -> tuple[np.ndarray, float]:
    """Table over word pairs and bias, from the sentences of toxic texts and those of clean ones, a list for each text.

    Clean texts may be wrongly labelled: the border lies between the toxic texts and all but ``NOISE`` of the clean ones, if
    they part; else above all clean ones.
    """
    rng, best = np.random.default_rng(SEED), None
    clean = [t for t in clean if t]
    flat = [s for t in clean for s in t]
    flat = [flat[i] for i in rng.permutation(len(flat))]
    hard = flat[: 10 * LANDMARKS]
    for _ in range(ROUNDS):
        positive = [s for t in bad for s in t] if best is None else best
        marks = [positive[i] for i in rng.permutation(len(positive))[: LANDMARKS // 2]] + hard[: LANDMARKS // 2]
        root, rows = nystroem(sentence_kernel(marks, marks)), positive + hard
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(hard))))
        w, bias = squared_hinge(sentence_kernel(rows, marks) @ root, y, np.where(y > 0, 20.0 * max(1.0, len(hard) / len(positive)), 20.0))
        table, at = np.zeros(1 << PAIR_BITS), root @ w
        for x, (code, weight) in zip(at, marks, strict=True):
            table[code] += x * weight
        score = [float(v @ table[c]) for c, v in flat]
        hard = [flat[i] for i in np.argsort(score)[::-1][: 10 * LANDMARKS]]
        best = [max(t, key=lambda s: float(s[1] @ table[s[0]])) for t in bad]
    low = float(np.quantile([v @ table[c] for c, v in best], 0.1))
    worst = [max(float(v @ table[c]) for c, v in t) for t in clean] or [low - 1.0]
    high = float(np.quantile(worst, 1 - NOISE, method="lower"))
    return table, -(low + high) / 2 if low > high else -max(worst) - 1e-3


def phrases(texts: list[str], labels: list[int], model: tuple[np.ndarray, float]) -> tuple[np.ndarray, float] | None:
    """The sentence machine for toxic texts that model doesn't explain, if it holds on texts left out."""
    margins = Scorer(*model).margins(texts)
    bad = [t for t, y, m in zip(texts, labels, margins, strict=True) if y and m < 0]
    bad = [s for s in ([pairs_of(x) for x in sentences_of(t)] for t in dict.fromkeys(bad)) if s]
    clean = [[pairs_of(x) for x in sentences_of(t)] for t in dict.fromkeys(t for t, y in zip(texts, labels, strict=True) if not y)] if len(bad) >= UNEXPLAINED else []
    if not any(clean):
        return None
    table, bias = fit_sentences(bad[::2], clean[::2])
    hit = lambda part: sum(any(w @ table[c] + bias > 0 for c, w in t) for t in part)
    if 2 * hit(bad[1::2]) < len(bad[1::2]) or hit(clean[1::2]) > NOISE * len(clean[1::2]):
        return None
    return fit_sentences(bad, clean)


def witnesses(sentences: list[tuple[str, int, int]]) -> list[str]:
    """Words that toxic sentences (sentence, label, number of its text) have in common beyond chance.

    A word counts once between the same two neighbours: copies of a toxic text, edited here and there, don't make its
    rare words look like witnesses. First come words that no word of the corpus would match by chance. Toxic texts without
    one may have rarer ones: of the words in those texts, as many are taken as keep chance finds below ``DISCOVERY`` of all, and
    of these only words that alone explain at least half of their texts. A word that came into toxic texts by chance stands
    beside the words that explain them, and explains none.
    """
    both: dict[str, int] = {}
    for s, y, _ in sentences:
        both[s] = max(y, both.get(s, 0))
    # every place once: numbers in arrays, as sets of them would take some hundred bytes each
    ids: dict[str, int] = {}
    words, owner, place = set(), array("q"), array("q")
    for now in (1, 0):  # toxic sentences first: of others, only the words these have matter
        for s, y in both.items():
            if y == now:
                for u, at in places_of(s):
                    words.add(u)
                    i = ids.setdefault(u, len(ids)) if y else ids.get(u)
                    if i is not None:
                        owner.append(2 * i + y)
                        place.append(at)
    size = len(words)
    del words
    owner, place = np.frombuffer(owner, np.int64), np.frombuffer(place, np.int64)
    order = np.lexsort((place, owner))
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (place[order][1:] != place[order][:-1])
    count = np.bincount(owner[order][new], minlength=2 * len(ids)).reshape(-1, 2).tolist()
    seen = {u: tuple(count[i]) for u, i in ids.items()}
    del owner, place, order, new, count, ids
    toxic, clean = sum(both.values()), len(both) - sum(both.values())
    share = min(0.5, max(toxic, 1) / max(1, len(both)))
    least = max(3.0, (np.log(max(2, size)) + 1) / np.log(1 / share))
    found = {u for u, (c, b) in seen.items() if b >= least and c <= 0.05 * b}
    return sorted(found | rare_witnesses(sentences, {u: c for u, (c, _) in seen.items()}, found, clean))


def places_of(sentence: str) -> list[tuple[str, int]]:
    """Units of a sentence's words and the neighbours that each stands between."""
    tokens = ["", *sentence.split(), ""]
    return [(u, hash((tokens[i - 1], tokens[i + 1]))) for i in range(1, len(tokens) - 1) for u in units(tokens[i])]


def rare_witnesses(sentences: list[tuple[str, int, int]], seen: dict[str, int], found: set[str], clean: int) -> set[str]:
    """seen: the places of each word in clean sentences, of which there are clean."""
    of: dict[int, list[str]] = {}
    for s, y, t in sentences:
        if y:
            of.setdefault(t, []).append(s)
    open_ = {t for t, ss in of.items() if not any(u in found for s in ss for u, _ in places_of(s))}
    bad: dict[str, set] = {}
    texts: dict[str, set] = {}
    for t in open_:
        for s in of[t]:
            for u, place in places_of(s):
                bad.setdefault(u, set()).add(place)
                texts.setdefault(u, set()).add(t)
    n = sum(len(set(of[t])) for t in open_)
    if not n or not clean:
        return set()
    share = min(0.5, n / (n + clean))
    chance = {u: _tail(len(b), seen[u], share) for u, b in bad.items() if len(b) >= 3 and len(texts[u]) >= 3 and seen[u] <= 0.05 * len(b)}
    order = sorted(chance, key=lambda u: (chance[u], u))
    passed = [i for i, u in enumerate(order, 1) if chance[u] <= DISCOVERY * i / len(bad)]
    chosen = set(order[: passed[-1]]) if passed else set()
    count: dict[int, int] = {}
    for u in chosen:
        for t in texts[u]:
            count[t] = count.get(t, 0) + 1
    while chosen:  # the word that explains the smallest part of its texts alone goes, until each explains half of them
        alone = {u: sum(count[t] == 1 for t in texts[u]) / len(texts[u]) for u in chosen}
        u = min(sorted(chosen), key=lambda u: (alone[u], -chance[u]))
        if alone[u] >= 0.5:
            break
        chosen.discard(u)
        for t in texts[u]:
            count[t] -= 1
    return chosen


def _tail(bad: int, clean: int, share: float) -> float:
    """Chance that of bad + clean places at most clean are clean, if each is toxic with the given chance."""
    n = bad + clean
    return float(sum(comb(n, i) * (1 - share) ** i * share ** (n - i) for i in range(clean + 1)))


def inserted(word: str, rng: np.random.Generator) -> str:
    i = int(rng.integers(1, max(2, len(word))))
    return word[:i] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + word[i:]


def fit(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """The table over triples and the bias; all zero and very negative if a label is missing."""
    rng = np.random.default_rng(SEED)
    sentences = [(s.strip().lower(), y, i) for i, (t, y) in enumerate(zip(texts, labels, strict=True)) for s in SENTENCE.split(t) if s.strip()]
    bad = witnesses(sentences)
    clean = sorted({u for s, y, _ in sentences if not y for t in s.split() for u in units(t)} - set(bad))
    if not bad or not clean:
        return np.zeros(CLASSES**3), NOTHING
    marks = bad[:: max(1, len(bad) // (LANDMARKS // 2))][: LANDMARKS // 2]
    variants = [inserted(w, rng) for w in bad for _ in range(3) if len(w) > 4]
    hard = [clean[i] for i in rng.permutation(len(clean))[: 2 * LANDMARKS]]
    for _ in range(ROUNDS):
        landmarks = marks + hard[: LANDMARKS - len(marks)]
        root = nystroem(kernel(landmarks, landmarks))
        words = bad + variants + hard
        x = kernel(words, landmarks) @ root
        y = np.concatenate((np.ones(len(bad) + len(variants)), -np.ones(len(hard))))
        c = np.concatenate((np.full(len(bad), 50.0), np.full(len(variants), 20.0), np.full(len(hard), 20.0)))
        w, bias = squared_hinge(x, y, c)
        row, code, weight = triples(landmarks)
        table = np.bincount(code, weight * (root @ w)[row], CLASSES**3)
        scores = decide(clean, table, bias)
        worst = np.argsort(-scores)[: 3 * LANDMARKS]
        hard = list(dict.fromkeys([clean[i] for i in worst] + hard))[: 10 * LANDMARKS]
    # the border between the lowest witness and the highest clean word, if they part
    low, high = float(np.quantile(decide(bad, table, bias), 0.02)), float(scores[worst[0]])
    return table, bias - (low + high) / 2 if high < low else bias


class Scorer:
    def __init__(self, table: np.ndarray, bias: float, sentences: tuple[np.ndarray, float] | None = None, memo: int = MEMO):
        self.table, self.bias, self.sentences, self.memo = table, bias, sentences, Recent(memo)

    def margins(self, texts: list[str | None]) -> list[float]:
        lists = [(t or "").lower().split() for t in texts]
        self.memo.turn()
        known = self.memo.young.get
        found = [list(map(known, words)) for words in lists]
        new = dict.fromkeys(w for words, m in zip(lists, found, strict=True) if None in m for w, x in zip(words, m, strict=True) if x is None)
        if new:
            self._learn([w for w in new if self.memo.find(w) is None])
            found = [list(map(known, words)) if None in m else m for words, m in zip(lists, found, strict=True)]
        worst = [max(max(m, default=NOTHING), self._spelled(words, m)) for words, m in zip(lists, found, strict=True)]
        return worst if self.sentences is None else [max(w, self._sentence(t)) for w, t in zip(worst, texts, strict=True)]

    def _sentence(self, text: str | None) -> float:
        table, bias = self.sentences
        return max((float(w @ table[c]) + bias for c, w in map(pairs_of, sentences_of(text))), default=NOTHING)

    def _learn(self, tokens: list[str]) -> None:
        split = [units(t) for t in tokens]
        flat = list(dict.fromkeys(u for us in split for u in us))
        value = dict(zip(flat, decide(flat, self.table, self.bias).tolist(), strict=True)) if flat else {}
        for t, us in zip(tokens, split, strict=True):
            self.memo.young[t] = max((value[u] for u in us), default=LETTER if len(PARTS.findall(t)) == 1 else NOTHING)

    def _spelled(self, words: list[str], margins: list[float]) -> float:
        """The worst of runs of at least 4 single letters."""
        if margins.count(LETTER) < 4:
            return NOTHING
        runs = re.findall("1{4,}", "".join("1" if m == LETTER else "0" for m in margins))
        if not runs:
            return NOTHING
        whole = "".join("1" if m == LETTER else "0" for m in margins)
        spelled = ["".join(PARTS.findall("".join(words[m.start() : m.end()]))) for m in re.finditer("1{4,}", whole)]
        return float(max(decide([u for s in spelled for u in units(s)] or ["aa"], self.table, self.bias)))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int = ROWS, longest: int = LONGEST) -> tuple[list[str], list[int]]:
    """At most rows labelled texts per label, of at most longest characters, first by hash: a bounded list for the driver.

    Rows are chosen by key and hash alone; only the chosen ones' texts move.
    """
    text_ = F.col(text).cast("string")
    brief = docs.where(text_.isNotNull() & (F.length(text_) <= longest)).select(F.col(key).alias("key"), F.xxhash64(text_).alias("h"))
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    both = brief.join(known, "key")
    chosen = [both.where(F.col("label") == y).orderBy("h", "key").limit(rows) for y in (0, 1)]
    chosen = materialize(chosen[0].unionByName(chosen[1]), "toxicity-sample")
    found = docs.select(F.col(key).alias("key"), text_.alias("text")).join(F.broadcast(chosen), "key").where(F.xxhash64("text") == F.col("h"))
    picked = [(r.text, r.label) for r in found.select("text", "label", "h").orderBy("h", "label").limit(2 * rows).toLocalIterator()]
    return [t for t, _ in picked], [y for _, y in picked]


def classify(docs: DataFrame, model: tuple, columns: list, text: str = "text", memo: int = MEMO) -> DataFrame:
    """columns (of docs) with score, 0 to 1, and predicted; memo bounds the words that a worker remembers, which changes no result."""
    used = np.flatnonzero(model[0])
    values, bias, sentences = model[0][used], model[1], model[2] if len(model) > 2 else None
    picked = small_batches(docs).select(F.struct(*columns).alias("row"), F.col(text).cast("string").alias("text"))
    row = picked.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CLASSES**3)
        table[used] = values
        scorer = Scorer(table, bias, sentences, memo)
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                score = 1 / (1 + np.exp(-SHARP * np.clip(scorer.margins(part.column("text").to_pylist()), -20, 20)))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["row", "score", "predicted"])

    return beside(picked.mapInArrow(run, f"row {row}, score double, predicted int"), "score", "predicted")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple:
    """The word machine's table and bias, and the sentence machine's or None."""
    texts, known = sample(docs, labels, key, text, label)
    model = fit(texts, known)
    return *model, phrases(texts, known, model)


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", memo: int = MEMO) -> DataFrame:
    """docs, columns unchanged, without those predicted toxic."""
    model = train(docs.where(fold(F.col(key), 5) != 0), labels, key, text, label)
    judged = classify(docs, model, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")], text, memo)
    return judged.where("predicted = 0").select("doc.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 5) == 0
    return classify(docs, train(docs.where(~held), labels), [F.col("doc_id"), held.alias("held_out")])
