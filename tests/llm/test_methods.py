"""Methods of the training-data operators against slow definitions, columns of every query, and cases that were once wrong."""

from __future__ import annotations

import math
import random
import re
import struct
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import common, exact_dedup, html_text, katz, langid, media, near_dedup, packing, queries, sentencepiece_scan, sharding, toxicity

SMALL = "/root/testdata/sf0.001"


# Columns of the queries

WANTED = {
    "op1_sentencepiece": "doc_id bigint",
    "op2_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op3_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op4_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_sharding": "doc_id bigint, slot int, shard string",
    "op7_near_dedup": "doc_id bigint, class_id bigint, kept boolean",
    "op8_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op9_html": "page_id bigint, url string, text string, n_chars bigint",
    "op10_katz": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op11_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op12_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    kinds = dict(got.dtypes)
    for column in WANTED[name].split(", "):
        n, kind = column.split()
        assert kinds[n] == kind, n
    source, key = {"op9_html": ("pages", "page_id"), "op12_clustering": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    rows = got.collect()
    table = {r[key]: r for r in spark.read.parquet(f"{SMALL}/{source}.parquet").collect()}
    assert {r[key] for r in rows} == set(table)
    if name != "op8_packing":
        assert len(rows) == len(table)
    for r in rows:
        fold = zlib.crc32(str(r[key]).encode())
        if name in ("op4_langid", "op5_toxicity", "op10_katz"):
            assert r.held_out == {"op4_langid": fold % 4 == 2, "op5_toxicity": fold % 5 == 0, "op10_katz": fold % 5 == 1}[name]
        if "score" in kinds and name != "op10_katz":
            assert 0 <= r.score <= 1
        if name == "op3_media":
            text = (table[r.doc_id].text or "").encode()
            data = text + bytes((-len(text)) % 64 if text else 64)
            assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(text), len(data), zlib.crc32(data[-64:]))
        if name == "op9_html":
            assert r.n_chars == len(r.text)


# Language


def test_predictions_by_definition(spark):
    """Cosines of vectors bundled letter by letter."""
    s = langid.Space(5, 128)
    data = [(i, t, k) for i, (t, k) in enumerate([("the people of the town", "en"), ("der hund und die katze", "de"), ("les gens de la ville", "fr")] * 3)]
    table = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    model = langid.train(table, seed=5, dimensions=128)

    def bundle(text):
        total = np.zeros(128)
        classes = [0, *(int(s.classes[ord(c)]) for c in text.lower()), 0]
        squeezed = [c for i, c in enumerate(classes) if c or not i or classes[i - 1]]
        for a, b, c in zip(squeezed, squeezed[1:], squeezed[2:]):  # noqa: B905
            if b:
                letters = s.places[2].astype(int)
                total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
        return total

    protos = {k: sum(bundle(t) for _, t, lang in data if lang == k) for k in ("de", "en", "fr")}
    for k, v in protos.items():
        assert np.allclose(model[k], v)
    texts = ["the town", "die katze", "la ville, là", "Der", None, "12", "the town"]
    asked = spark.createDataFrame([(i, t, "lang", 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang_pred string, score double")
    got = langid.classify(asked, model, ["doc_id", "lang_pred", "score"], seed=5, dimensions=128)
    assert got.columns == ["doc_id", "lang_pred", "score", "n_grams"]
    for r in got.collect():
        v = bundle(texts[r.doc_id] or "")
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cos = {k: float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for k, p in protos.items()}
        best = max(sorted(cos), key=cos.get)
        assert r.lang_pred == best and r.score == pytest.approx(max(0.0, cos[best]))


# Toxicity


def phrase_data(n):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        said = [[rng.choice(words) for _ in range(12)] for _ in range(4)]
        if i % 4 == 0:
            s, at = rng.choice(said), rng.randrange(9)
            s[at], s[at + rng.choice([1, 2])] = words[0], words[1]
        out.append((". ".join(map(" ".join, said)), int(i % 4 == 0)))
    return out


def test_phrases():
    """Two ordinary words, toxic together: no word explains it, the sentence machine learns it."""
    data = phrase_data(1000)
    texts, labels = [t for t, _ in data], [y for _, y in data]
    model = toxicity.fit(texts[:800], labels[:800])
    found = toxicity.phrases(texts[:800], labels[:800], model)
    margins = toxicity.Scorer(*model, found).margins(texts[800:])
    assert sum(m > 0 for m, y in zip(margins, labels[800:], strict=True) if y) >= 45 and not any(m > 0 for m, y in zip(margins, labels[800:], strict=True) if not y)
    rng = random.Random(1)
    assert toxicity.phrases(texts[:800], rng.sample(labels[:800], 800), model) is None  # labels at random teach nothing


def test_decision_by_definition():
    """The table over triples gives the machine's sum over landmarks; addresses give no evidence, other marks do."""
    rng = np.random.default_rng(0)
    marks, words, x = ["idiot", "moron", "town", "thing"], ["idxiot", "the", "lemon"], rng.normal(size=4)
    row, code, weight = toxicity.triples(marks)
    table = np.bincount(code, weight * x[row], toxicity.CLASSES**3)
    assert np.allclose(toxicity.decide(words, table, 0.5), toxicity.kernel(words, marks) @ x + 0.5)
    k = toxicity.kernel(marks, marks)
    root = toxicity.nystroem(k)
    assert np.allclose(root @ root.T, np.linalg.inv(k))
    assert toxicity.units("mor@on")[0] == "moron" and toxicity.units("joe@example.org") == toxicity.units("https://a.b/c") == []


def test_labels_in_conflict(spark):
    table = spark.createDataFrame([(1, "a text here"), (1, "a text here"), (None, "b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, None)], "doc_id bigint, toxic int")
    got = toxicity.classify(table.withColumn("score", F.lit("x")), toxicity.train(table, labels), ["doc_id", "score"])
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == 4


# Exact dedup, sharding, media


def test_ties_in_drop_copies(spark):
    rows = spark.createDataFrame([(1, "a b", i) for i in range(20)] + [(None, "c", i) for i in range(9)], "doc_id bigint, text string, uid int").coalesce(1)
    for k in (1, 64):
        assert sorted(r.uid for r in exact_dedup.drop_copies(rows, k=k, tracked=128).collect()) == [0, 0]


def test_assign_clashes(spark):
    rows = spark.createDataFrame([(1, "x", "y", 7), (2, None, "y", 7)], "doc_id bigint, shard string, __slot string, slot int").withColumn("a.b", F.lit(1))
    got = sharding.assign(rows, F.col("doc_id"), sharding.shard_names(4), 13)
    assert got.columns == ["doc_id", "__slot", "a.b", "slot", "shard"] and got.where("`__slot` = 'y' and slot < 13").count() == 2
    assert sharding.assign(rows.select("shard"), F.col("shard"), sharding.shard_names(4), 13).count() == 2


def test_foreign_media():
    deep = b""
    for _ in range(3000):
        deep = media.box(b"moov", deep)
    assert media.inspect(deep) == [] and len(list(media.walk(deep))) == media.DEEPEST + 1
    real = media.build(bytes(640))
    at = real.index(b"stsz") + 8
    lying = real[:at] + struct.pack(">II", 1, 0xFFFFFFFF) + real[at + 8 :]
    assert len(media.inspect(lying)[0]["samples"]) <= len(lying)
    for cut in range(0, len(real), 7):
        media.inspect(real[:cut])
    assert len(media.inspect(real[: real.index(b"mdat")])) == 1


# Near duplicates


def test_dense_group(spark):
    """Random edits of an original that is itself missing: thousands of pairs share buckets and don't align."""
    rng, texts = random.Random(9), []
    for _ in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(80):
            words = list(base)
            for _ in range(rng.randint(2, 6)):
                words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words[: rng.choice([120, 120, 118, 100])]))
    sets, label = [near_dedup.distinct_shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    buckets = [set(near_dedup.Sketcher().bands(t)[0]) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if buckets[i] & buckets[j] and near_dedup.aligned(sets[i], sets[j]) >= 0.8:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows, kept = near_dedup.classes(table)
    found = {r.key: r.keep_key for r in rows.join(kept, "digest").collect()}
    assert [found.get(i, i) for i in range(len(texts))] == [root(i) for i in range(len(texts))]


def test_only_cells_that_members_meet_in(spark):
    """Near-dedup rows for cells are made where several members meet, one of them apart: never fewer, and few others."""
    rng, rows = random.Random(5), []
    for rid in range(3000):
        shared = rng.sample(range(-400, 400), rng.randrange(3))
        rows.append((rid % 3, rid, rid % 2 == 0, [*shared, *(rng.getrandbits(62) for _ in range(20))] if rid % 7 else []))
    told = spark.createDataFrame(rows, "pivot bigint, rid bigint, apart boolean, outside array<bigint>").repartition(5)
    cells = {}
    for pivot, rid, apart, outside in rows:
        for x in outside:
            cells.setdefault((pivot, x), []).append((rid, apart))
    wanted = {(k[0], rid, k[1]) for k, v in cells.items() if len(v) > 1 and any(a for _, a in v) for rid, _ in v}
    left = near_dedup._meeting(told).collect()
    got = {(r.pivot, r.rid, x) for r in left for x in r.outside}
    assert len(left) == len(rows) and len(wanted) > 1000 and wanted <= got <= {(k[0], rid, k[1]) for k, v in cells.items() for rid, _ in v}
    assert len(got - wanted) < 0.1 * sum(len(v) for v in cells.values())
    assert near_dedup._meeting(told.where("rid < 0")).count() == 0


def test_marked_keys(spark):
    """Every row with a key of the set is hit, null among them, and few others are; also where the map is full."""
    rng = random.Random(6)
    ids = [rng.getrandbits(63) - (1 << 62) for _ in range(20_000)] + list(range(20_000))
    rows, some = spark.createDataFrame([(i,) for i in ids] + [(None,)], "key bigint"), set(ids[::5])
    keys = spark.createDataFrame([(i,) for i in some], "key bigint")
    for found, hits in ((common.marked(rows, keys, "key"), some), (common.marked(rows, keys.union(rows.where("key is null")), "key"), some | {None})):
        got = {r.key: r.hit for r in found.collect()}
        assert found.columns == ["key", "hit"] and len(got) == len(ids) + 1 and all(got[i] for i in hits)
        assert sum(got.values()) - len(hits) < 0.1 * len(ids)
    assert not common.marked(rows, keys.limit(0), "key").where("hit").count()


def test_full_map_of_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_KEY_BITS", common.ROW_BITS)
    texts = [f"{' '.join(f'w{(i // 3) * 50 + j}' for j in range(50))}{' ' * (i % 3)}" for i in range(6000)]
    table = spark.createDataFrame([(i if i % 6 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    left = near_dedup.drop_near(table).collect()
    assert sorted(r.doc_id for r in left) == sorted(3 * g + (not g % 2) for g in range(2000))


def test_few_texts_are_shuffled(spark):
    """Where copies are few, near dedup shuffles few of the texts: neither to find candidates nor to drop what goes."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.getrandbits(40)}" for _ in range(400)) for _ in range(600)]
    texts += [f"{t} more" for t in texts[:20]]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    table = common.materialize(table, "few")
    tracker = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(s.shuffleWriteBytes() for s in (lambda x: [x.apply(i) for i in range(x.size())])(tracker.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        left = near_dedup.drop_near(table)
        assert sorted(r.doc_id for r in left.collect()) == list(range(600))
        assert written() - before < 0.5 * sum(map(len, texts))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_recall_of_buckets():
    """Pairs just above the threshold, many with common shingles, share a bucket."""
    rng, sketcher, missed, true = random.Random(10), near_dedup.Sketcher(), 0, 0
    common = [f"w{rng.randrange(300)}" for _ in range(60)]
    while true < 400:
        words = common + [f"w{rng.randrange(300)}" for _ in range(rng.randint(60, 200))]
        edit = list(words)
        for _ in range(max(1, len(words) // 48)):
            edit[rng.randrange(len(edit))] = f"x{rng.randrange(10**6)}"
        x, y = " ".join(words), " ".join(edit)
        if 0.8 <= near_dedup.aligned(near_dedup.distinct_shingles(x), near_dedup.distinct_shingles(y)) < 0.86:
            true += 1
            missed += not set(sketcher.bands(x)[0]) & set(sketcher.bands(y)[0])
    assert missed <= 8


# Packing


def test_all_code_points():
    e = packing.WordEncoder(packing.default_vocabulary())
    points = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    for c in points:
        t = f"ab{c}."
        assert e.encode(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), hex(ord(c))


# HTML

PROSE = "words of the text, and more, " * 5


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>A <span class='share'>x</span> TAIL</p>", "A TAIL"),
        ("<p>A <span hidden>x <span>y</span> z</span> <b>TAIL</b></p>", "A TAIL"),
        ("<p>A <span class='ad'>x<p>B", "A\nB"),
        ("<p>A <button>x</button> B <svg><path d='m'/></svg> C", "A B C"),
        ("<p>one<p data-x=it's>two</p><p>three's</p>", "one\ntwo\nthree's"),
        ("<p title='a > b'>one <a href=x'y>two</a> three", "one two three"),
        (f"<article><p>{PROSE}</p><section class='related-work'><h2>Related</h2><p>{PROSE}</p></section></article>", f"{PROSE.strip()}\nRelated\n{PROSE.strip()}"),
        (f"<article><p>{PROSE}</p><div class='header-files'><p>{PROSE}</p></div></article>", f"{PROSE.strip()}\n{PROSE.strip()}"),
        (f"<article><p>{PROSE}</p><div class='related-links'><a href=1>one</a> <a href=2>two</a></div></article>", PROSE.strip()),
        (f"<article><p>{PROSE}</p></article><div class='comment-list'><p>{PROSE}</p></div>", PROSE.strip()),
        (f"<div class='promo'><p>{PROSE}</p></div>", PROSE.strip()),
        ("</ x><p>a</><p>b</p foo='>'>", "a\nb"),
    ],
)
def test_text_once_lost(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("html", ["</section>" * 100_000, "<div>" * 50_000 + "</section>" * 50_000, "<ul><li>" + "<figure>" * 50_000 + "<li>x" * 50_000, "<li><ul>" + "<figure>" * 50_000 + "<li>y" * 50_000, "<span hidden>" * 50_000 + "</span>" * 50_000])
def test_linear(html):
    t = time.monotonic()
    html_text.main_text(html)
    assert time.monotonic() - t < 5


def test_page_columns_clash(spark):
    pages = spark.createDataFrame([(1, "old", "<p>new")], "page_id bigint, text string, html string")
    assert html_text.extract(pages, ["page_id", "text"]).collect() == [(1, "new", 3)]


# Katz


def brute(texts, held, order):
    """log10 P of each text by the recursive definition, with dictionaries."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(low)) + ["\n"] for t in texts]
    count, past = [Counter() for _ in range(order + 1)], Counter()
    for t, h in zip(tokens, held, strict=True):
        line = ["\r"] * (order - 1) + t
        for j in range(order - 1, len(line) if not h else 0):
            for k in range(1, order + 1):
                count[k][tuple(line[j - k + 1 : j + 1])] += 1
                past[tuple(line[j - k + 1 : j])] += 1
    d = [None] + [katz.discounts([Counter(c.values())[i] for i in range(1, 7)]) for c in count[1:]]
    n = sum(count[1].values())
    unknown = sum(v * (1 - d[1].get(v, 1)) for v in count[1].values()) / n if d[1] else 1 / (n + 1)
    total, alpha = {}, {}

    def prob(gram):
        c, k = count[len(gram)].get(gram, 0), len(gram)
        if k == 1:
            return d[1].get(c, 1) * c / (n if d[1] else n + 1) if c else unknown
        if c:
            return d[k].get(c, 1) * c / total[gram[:-1]]
        return alpha.get(gram[:-1], 1.0) * prob(gram[1:])

    for k in range(2, order + 1):
        used, mass = defaultdict(float), defaultdict(float)
        for gram, c in count[k].items():
            used[gram[:-1]] += d[k].get(c, 1) * c
            mass[gram[:-1]] += prob(gram[1:])
        for h, u in used.items():
            total[h] = past[h] + (u >= past[h])
            alpha[h] = (1 - u / total[h]) / (1 - mass[h])
    for h in [h for h in past if len(h) == order - 1][:5]:
        assert sum(prob((*h, *w)) for w in count[1]) + prob((*h, "\t")) == pytest.approx(1.0)
    return [sum(math.log10(prob(tuple((["\r"] * (order - 1) + t)[j : j + order]))) for j in range(len(t))) for t in tokens]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_orders(spark, order):
    rng = random.Random(7)
    texts = [" ".join(f"W{int(rng.paretovariate(0.9)) % 40}" for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None, ""]
    texts += texts[:6]
    held = [i % 5 == 1 for i in range(len(texts))]
    table = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id bigint, text string, h boolean")
    got = sorted(katz.score(table, F.col("h"), block=300, order=order).collect(), key=lambda r: r.key)
    assert [r.score for r in got] == pytest.approx(brute(texts, held, order))


# SentencePiece


def test_giant_text(spark):
    """Cutting and joining take time in proportion; all characters come back."""
    text = "the words of a text, 12 and é 你 " * 40_000
    table = spark.createDataFrame([(1, text), (2, text[:70_000]), (3, None)], "doc_id bigint, text string")
    back = sentencepiece_scan.decode(sentencepiece_scan.encode(table), ["key", "text", "chunks"]).collect()
    assert all(r.decoded == r.text for r in back) and max(r.chunks for r in back) > 30


# Together


def test_pipeline_of_nothing(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
