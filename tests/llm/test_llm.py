"""The training-data operators against definitions, libraries and small fixtures; nulls, empties, ties and clashing names."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import common, exact_dedup, html_text, katz, langid, media, near_dedup, packing, sentencepiece_scan, sharding, toxicity

DOCS = "doc_id bigint, text string, lang string, digest string, row int"
EN = "the people of the town that is with them and there was this thing"
DE = "der hund und die katze sind auf dem weg nicht sicher eine zwei"


def docs(spark, rows, ddl=DOCS):
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated keys, null, empty, blank and long texts, copies, and columns whose names operators use inside."""
    rows = [
        (1, "a b", "en", "x", 1), (2, "a\t b", "en", "y", 2), (3, None, None, None, None), (4, "", "en", "z", 4), (None, "a b", "de", "q", 5), (5, " \n", "en", "w", 6),
        (6, "x" * 70000, "en", "l", 7), (7, "the cat, the dog.", "en", "k", 8), (7, "the cat, the dog.", "en", "k", 8), (8, "é你 \U0001f600 12", "fr", "u", 9),
    ]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def nothing(spark):
    return docs(spark, [])


# Exact dedup


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")].append(r.doc_id)
    return groups


@pytest.mark.parametrize(("k", "tracked"), [(1, 8), (64, 256)])
def test_exact(spark, odd, k, tracked):
    got = exact_dedup.decide(odd, k=k, tracked=tracked).collect()
    groups = brute_groups(odd.collect())
    kept = Counter()
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).digest() == bytes(r.digest))
        ids = groups[text]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None) and r.key in ids
        kept[text] += r.kept
    assert len(got) == odd.count() and set(kept.values()) == {1}
    left = exact_dedup.drop_copies(odd, k=k, tracked=tracked)
    assert left.columns == odd.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted((r.key for r in got if r.kept), key=str)


def test_exact_empty(nothing):
    assert exact_dedup.decide(nothing).count() == 0 and exact_dedup.drop_copies(nothing).count() == 0


def test_exact_hot_group_has_no_shuffle(spark):
    rows = docs(spark, [(i, "same" if i % 2 else f"t{i}", None, None, None) for i in range(2000)])
    got = exact_dedup.decide(rows)
    assert got.where("kept").count() == 1001 and got.where("group_size = 1000").count() == 1000


# Sharding


def test_lookup_table():
    names = sharding.shard_names(7)
    table = sharding.lookup_table(names, 1009)
    sizes = Counter(table)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.2 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(["a"], 10)


def test_assign(spark, odd, nothing):
    got = sharding.assign(odd, F.col("doc_id"), sharding.shard_names(5), 101).collect()
    table = sharding.lookup_table(sharding.shard_names(5), 101)
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, f"shard-{table[slot]:03d}")
    assert len(got) == odd.count() and sharding.assign(nothing, F.col("doc_id"), ["a"], 101).count() == 0


# Media


def test_media_round_trip(spark, odd):
    files = media.store_text(odd)
    got = media.media_features(files).collect()
    assert len(got) == odd.count()
    texts = defaultdict(set)
    for r in odd.collect():
        texts[r.doc_id].add(r.text or "")
    for r in got:
        want = [media.padded(t.encode()) for t in texts[r.key]]
        assert r.payload_sha256 in {hashlib.sha256(w).hexdigest() for w in want} and r.payload_bytes % 64 == 0
        assert r.tail_crc32 in {zlib.crc32(w[-64:]) for w in want} and r.codec == "raw " and r.duration == pytest.approx(r.payload_bytes / 64 * 0.04)
        assert len(r.keyframes) == math.ceil(r.payload_bytes / 1024)
    for r in files.collect():
        track = media.inspect(bytes(r.media))[0]
        for i, (o, n) in enumerate(track["keyframes"]):
            assert (o, n) == track["samples"][16 * i]


def test_media_by_hand():
    box, full = media.box, media.full
    stbl = box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(70))), full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 30)), full(b"stss", struct.pack(">III", 2, 1, 3)),
        full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), full(b"stsz", struct.pack(">IIIII", 0, 3, 5, 7, 9)), full(b"co64", struct.pack(">IQQ", 2, 1000, 2000)),
    )
    mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 50, 0, 0))
    moov = box(b"moov", box(b"trak", box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", stbl))))
    wide = struct.pack(">I4sQ", 1, b"free", 24) + bytes(8)
    t = media.inspect(wide + moov + struct.pack(">I4s", 0, b"mdat") + bytes(20))[0]
    assert (t["handler"], t["codec"], t["duration"]) == ("vide", "avc1", 0.5)
    assert t["samples"] == [(1000, 5), (1005, 7), (2000, 9)] and t["keyframes"] == [(1000, 5), (2000, 9)]
    assert media.inspect(b"") == [] and media.inspect(b"nonsense that is no box") == [] and media.inspect(moov[:40]) == []


# Language identification


def test_langid(spark, odd, nothing):
    rows = [(i, " ".join(random.Random(i).sample((EN if i % 2 else DE).split(), 9)), "en" if i % 2 else "de", None, i) for i in range(80)]
    table = docs(spark, rows)
    model = langid.train(table.where("doc_id < 60"))
    got = langid.classify(table.where("doc_id >= 60"), model, [F.col("doc_id"), F.col("lang")]).collect()
    assert all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in got)
    edge = {r.doc_id: r for r in langid.classify(odd, model, ["doc_id", "digest", "row"]).collect()}
    assert edge[3].lang_pred == edge[4].lang_pred == edge[5].lang_pred == "und" and edge[3].score == 0 and edge[6].lang_pred in ("en", "de")
    none = langid.train(nothing)
    assert none == {} and {r.lang_pred for r in langid.classify(odd, none, ["doc_id"]).collect()} == {"und"}
    assert langid.keep_known(nothing).count() == 0
    kept = langid.keep_known(table)
    assert kept.columns == table.columns and kept.count() == 80


def test_bundles_are_sums():
    s = langid.Space(1, 256)
    codes = s.grams("abcab")
    direct = sum(s.bind(np.array([c]))[0].astype(int) for c in codes)
    assert np.array_equal(s.bundle(*np.unique(codes, return_counts=True)), direct)
    a, b, c = (s.places[2][k].astype(int) for k in (1, 2, 3))
    abc = s.bind(np.array([(1 * 64 + 2) * 64 + 3]))[0]
    assert np.array_equal(abc, np.roll(a, 2) * np.roll(b, 1) * c)


# Toxicity


def kernel_brute(a, b):
    def features(w):
        x = [0, *map(toxicity.letter_class, w), 0]
        f = defaultdict(float)
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, min(len(x), i + toxicity.SPAN)):
                    f[x[i], x[j], x[k]] += toxicity.DECAY ** (k - i + 1)
        return f

    p, q = features(a), features(b)
    dot = lambda u, v: sum(x * v.get(k, 0) for k, x in u.items())
    return dot(p, q) / math.sqrt(dot(p, p) * dot(q, q))


def test_kernel():
    words = ["idiot", "idxiot", "the", "moron", "moon", "été"]
    got = toxicity.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(kernel_brute(a, b))


def labelled(n):
    rng = random.Random(3)
    syllables = "an er in the on at es or ti re nd st en of ou ha ed".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    out = []
    for i in range(n):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["idiot", "moron", "scumbag"])
        out.append((" ".join(words[:20]) + ". " + " ".join(words[20:]), int(i % 4 == 0)))
    return out


def test_toxicity(spark, odd, nothing):
    data = labelled(600)
    table = docs(spark, [(i, t, None, None, i) for i, (t, _) in enumerate(data)])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "doc_id bigint, toxic int")
    model = toxicity.train(table.where("doc_id < 450"), labels)
    got = toxicity.classify(table.where("doc_id >= 450"), model, ["doc_id"]).collect()
    assert sum(r.predicted == data[r.doc_id][1] for r in got) >= 0.97 * len(got)
    scorer = toxicity.Scorer(*model)
    assert min(scorer.margins(["you i.d.i.o.t there", "an idxiot of", "m-o-r-o-n", "the i d i o t at"])) > 0 > scorer.margins(["then an other thing"])[0]
    edge = toxicity.classify(odd, model, ["doc_id", "row"]).collect()
    assert len(edge) == odd.count() and all(0 <= r.score < 0.5 for r in edge if r.doc_id in (3, 4, 5))
    silent = toxicity.train(table, labels.where("toxic = 0"))
    assert all(r.predicted == 0 for r in toxicity.classify(table, silent, ["doc_id"]).collect())
    assert toxicity.keep_clean(nothing, labels).count() == 0
    kept = toxicity.keep_clean(table, labels)
    assert kept.columns == table.columns and 440 <= kept.count() <= 455


# Near duplicates


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_alignment_is_exact():
    rng = random.Random(1)
    for _ in range(60):
        base = [str(rng.randrange(30)) for _ in range(60)]
        edit = list(base)
        for _ in range(rng.randrange(4)):
            edit[rng.randrange(len(edit))] = "new"
        x, y = (near_dedup.distinct_shingles(" ".join(t)) for t in (base, edit))
        m = lcs(list(x), list(y))
        true = m / (len(x) + len(y) - m)
        got = near_dedup.aligned(x, y)
        assert got == pytest.approx(true) if true >= 0.8 else got < 0.8


def test_near(spark, odd, nothing):
    rng = random.Random(2)
    rows, base = [], [[f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))] for _ in range(40)]
    for g, words in enumerate(base):
        for c in range(1 + g % 4 * 3):
            t = list(words)
            for _ in range(c * len(t) // 400):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), (" " if c % 2 else "\n").join(t).upper() if c % 3 == 1 else " ".join(t), None, None, g))
    table = docs(spark, rows)
    kept, found = near_dedup.classes(table)[1], {}
    texts = {r[0]: " ".join(r[1].lower().split()) for r in rows}
    sets = {i: set(near_dedup.distinct_shingles(t)) for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    digest = {hashlib.md5(t.encode()).digest(): i for i, t in sorted(texts.items(), reverse=True)}
    for r in kept.collect():
        found[bytes(r.digest)] = r.keep_key
    assert all(found.get(d, i) == root(i) for d, i in digest.items())
    left = near_dedup.drop_near(table)
    assert left.columns == table.columns and sorted(r.doc_id for r in left.collect()) == sorted({root(i) for i in texts})
    assert near_dedup.drop_near(nothing).count() == 0
    alone = near_dedup.drop_near(odd).collect()
    assert sorted(r.doc_id for r in alone) == [1, 3, 6, 7, 7, 8]


def test_near_chains(spark):
    """Versions of versions: every pair that aligns ends in one class, though no pivot covers a chain."""
    rng, texts = random.Random(8), []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for _ in range(40):
            texts.append(" ".join(words))
            for _ in range(rng.randint(3, 6)):
                words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
    label, sets = list(range(len(texts))), [near_dedup.distinct_shingles(t) for t in texts]

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i + 1, i // 40 * 40 + 40):
            if near_dedup.aligned(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    kept = near_dedup.classes(docs(spark, [(i, t, None, None, i) for i, t in enumerate(texts)]))[1]
    found = {bytes(r.digest): r.keep_key for r in kept.collect()}
    assert [found.get(hashlib.md5(t.encode()).digest(), i) for i, t in enumerate(texts)] == [root(i) for i in range(len(texts))]


# Packing


def test_packing(spark, odd, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.pack_documents(odd, capacity=16, group=4).collect()
    wanted = []
    for r in odd.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, i in enumerate(range(0, len(ids), 16)):
            part = ids[i : i + 16]
            wanted.append((str(r.doc_id), k, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 16
    assert packing.pack_documents(nothing).count() == 0


def test_word_encoder():
    e = packing.encoder(packing.default_vocabulary())
    for t in ["a\x1cb c", "<|endoftext|>a b", "don't stop  x", "ΑΣ ς é ́x", "'s't 1234 !!!a", "İstanbul, ÉŒ ǆ ﬁ Å. X y"]:
        assert e.encode(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_sum_of_squares_by_definition():
    rng = random.Random(4)
    lengths = [rng.randint(1, 20) for _ in range(200)]
    bins, offsets = packing.sum_of_squares(np.array(lengths), 20)
    gaps: dict[int, int] = {}
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        count = Counter(g for g in gaps.values() if g)
        cost = {}
        for h in {*[g for g in gaps.values() if g >= n], 20}:
            c = Counter(count)
            if h < 20:
                c[h] -= 1
            if h > n:
                c[h - n] += 1
            cost[h] = sum(v * v for v in c.values())
        took = gaps.get(b, 20)
        assert cost[took] == min(cost.values()) and o == 20 - took
        gaps[b] = took - n
    assert len(gaps) <= 1.1 * math.ceil(sum(lengths) / 20)


# HTML


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<script>x</script><p>a &amp; b&nbsp;c</p>", "a & b c"),
        ("<nav><a href=/>Home</a></nav><article><h1>Head</h1><p>" + "some text, with commas, " * 5 + "</p><p>Er.</p><aside>no</aside></article><footer>end</footer>", "Head\n" + ("some text, with commas, " * 5).strip() + "\nEr."),
        ("<div class='post'><p>" + "long text, here, " * 9 + "</p></div><div id='comments'><p>" + "reader, comment, words, " * 4 + "</p></div>", ("long text, here, " * 9).strip()),
        ("<article><p>" + "body, of, text, " * 5 + "<br>next<ul><li><a href=1>one link</a><li><a href=2>two links</a></ul><p hidden>no<p>yes", ("body, of, text, " * 5).strip() + " next\nyes"),
        ("<p>a < b <b>bold</b> &lt;i&gt; <!-- no --> end", "a < b bold <i> end"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html or "") == text


def test_html_is_robust(spark):
    for bad in ("<" * 999, "<div>" * 5000 + "x", "<a href='", "</p></div>", "<p " + "a=b " * 999, "\x00<p>퟿"):
        html_text.main_text(bad)
    rows = spark.createDataFrame([(1, "u", "<p>x"), (1, "u", "<p>x"), (2, None, None)], "page_id bigint, url string, html string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(rows, ["page_id", "url"]).collect()) == [(1, "x", 1), (1, "x", 1), (2, "", 0)]
    assert html_text.extract(rows.limit(0), ["page_id"]).count() == 0


# Katz


def brute_katz(rows, held):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(low)) + ["\n"] for t in rows]
    one, two, past = Counter(), Counter(), Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            one.update(t)
            two.update(zip(["\r", *t[:-1]], t, strict=True))
            past.update(["\r", *t[:-1]])
    d1, d2 = (katz.discounts([Counter(c.values())[i] for i in range(1, 7)]) for c in (one, two))
    n = sum(one.values())
    unknown = sum(v * (1 - d1.get(v, 1)) for v in one.values()) / n if d1 else 1 / (n + 1)
    p = lambda w: d1.get(one[w], 1) * one[w] / (n if d1 else n + 1) if w in one else unknown
    used, mass = defaultdict(float), defaultdict(float)
    for (a, b), c in two.items():
        used[a] += d2.get(c, 1) * c
        mass[a] += p(b)
    total = {a: past[a] + (used[a] >= past[a]) for a in past}
    alpha = {a: (1 - used[a] / total[a]) / (1 - mass[a]) for a in past}

    def prob(a, b):
        c = two.get((a, b), 0)
        return d2.get(c, 1) * c / total[a] if c else alpha[a] * p(b) if a in past else p(b)

    for a in list(past)[:5]:
        assert sum(prob(a, b) for b in one) + alpha[a] * unknown == pytest.approx(1.0)
    base = lambda w: math.log10((one[w] + 0.5) / (n + 0.5 * (len(one) + 1)))
    return [(len(t), sum(w in one for w in t), n, sum(map(base, t)), sum(math.log10(prob(a, b)) for a, b in zip(["\r", *t[:-1]], t, strict=True))) for t in tokens]


@pytest.mark.parametrize("block", [1, 50, 10**6])
def test_katz(spark, odd, block):
    rng = random.Random(5)
    texts = [" ".join(f"W{int(rng.paretovariate(0.9)) % 300}" for _ in range(rng.randint(0, 60))) for _ in range(120)] + [r.text for r in odd.orderBy("row").collect()]
    held = [i % 5 == 1 for i in range(len(texts))]
    table = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id bigint, text string, h boolean")
    got = sorted(katz.score(table, F.col("h"), block=block).collect(), key=lambda r: r.key)
    for r, (n, known, total, base, score), h in zip(got, brute_katz(texts, held), held, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held) == (n, known, total, h)
        assert (r.base_score, r.score) == (pytest.approx(base), pytest.approx(score))


def test_katz_edges(spark, nothing):
    assert katz.score(nothing, F.lit(False)).count() == 0
    one = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id bigint, text string")
    got = katz.score(one, F.lit(True)).collect()
    assert all((r.n_known, r.train_tokens, r.score) == (0, 0, 0.0) for r in got)


# SentencePiece


@pytest.fixture(scope="module")
def scan():
    return sentencepiece_scan.Scanner(sentencepiece_scan.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=sentencepiece_scan.default_vocabulary())


def random_texts(n, size):
    rng = random.Random(6)
    parts = ["a", "e", "t", "th", "ing", "▁", " ", "  ", "\n", "\t", "é", "你", "\U0001f600", "0", "12", ".", ",", "==", "the", "Q", "//", "x"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_scan_equals_the_library(scan, library):
    for t in [*random_texts(800, 50), "a" * 300, "=" * 200, " " * 100, "abcdefghij" * 30]:
        assert scan.encode(t) == np.array(library.encode(t), "<u4").tobytes()
        assert scan.decode(scan.encode(t)) == library.decode(library.encode(t)) == t.replace("▁", " ")


@pytest.mark.parametrize("size", [32, 50])
def test_chunks_equal_the_whole(scan, size):
    for t in [*random_texts(200, 120), "a" * 500, "=" * 300, "abc123" * 60]:
        if not t:
            continue
        norm = sentencepiece_scan.SPACE + t.replace(" ", sentencepiece_scan.SPACE)
        parts = []
        for i in range(0, len(norm), size):
            first = max(0, i - 2 * scan.longest)
            parts.append((norm[first : i + size + 1], i - first, i - first + min(size, len(norm) - i)))
        path = sentencepiece_scan.choose([scan.matrix(*p) for p in parts])
        assert b"".join(scan.backtrace(*p, *nodes) for p, nodes in zip(parts, path, strict=True)) == scan.encode(t)


def test_products_are_associative(scan):
    text = sentencepiece_scan.SPACE + "=" * 200
    m = [scan.matrix(text, i, i + 40) for i in (20, 60, 100)]
    assert sentencepiece_scan.compose(sentencepiece_scan.compose(m[0], m[1]), m[2]) == sentencepiece_scan.compose(m[0], sentencepiece_scan.compose(m[1], m[2]))


def test_encode_job(spark, odd, nothing, library):
    got = sentencepiece_scan.encode(odd, chunk=64)
    back = sentencepiece_scan.decode(got, ["key", "ids", "text", "chunks"]).collect()
    assert len(back) == odd.count() and max(r.chunks for r in back) > 1000
    for r in back:
        assert bytes(r.ids) == np.array(library.encode(r.text), "<u4").tobytes() and r.decoded == r.text
    assert sentencepiece_scan.encode(nothing).count() == 0


# Together


def test_shared_folder(spark, tmp_path):
    df = common.materialize(spark.range(5), "x")
    assert df.count() == 5 and all(f.startswith(common.shared_dir(spark).replace("file://", "file:/").rstrip("/")) or common.shared_dir(spark) in f for f in df.inputFiles())
    common.forget(df)


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["language", "toxicity", "exact_dedup", "near_dedup", "packing"] and pipeline.ORACLE_SQL is None
    data = labelled(300)
    rows = [(i, t, "en", "s", len(t)) for i, (t, _) in enumerate(data)] + [(1000, data[1][0], "en", "s", 1), (1001, data[1][0] + " andthe", "en", "s", 1), (1002, "123 456", "en", "s", 1), (1003, None, "en", "s", 0)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(data)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs_, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in pipeline.STAGES[:-1]:
        docs_ = common.materialize(stage(spark, docs_, str(tmp_path)), name)
        assert docs_.columns == table.columns
        seen.append({r.doc_id for r in docs_.select("doc_id").collect()})
    assert seen[0] == {r[0] for r in rows} - {1002, 1003}
    toxic = {i for i, (_, y) in enumerate(data) if y}
    assert len(seen[1] & toxic) <= 4 and len((seen[0] - toxic) - seen[1]) <= 4
    assert 1000 not in seen[2] and 1 in seen[2] and 1001 in seen[2] and seen[3] == seen[2] - {1001}
    packed = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == seen[3] and json.dumps(sorted(packed[0].asDict())) == json.dumps(sorted(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]))
