"""Foreign media files, and main text against a slow scorer."""

from __future__ import annotations

import random
import struct
import time

import pyarrow as pa
import pytest

from tracewright.llm import html_text, media

PAYLOAD = random.Random(1).randbytes(media.FRAME * 70)


# Media


def sane(data):
    """inspect ends, soon, with no more samples than the file has bytes."""
    found = media.inspect(data)
    assert sum(len(t["samples"]) for t in found) <= len(data)
    for t in found:
        assert set(t["keyframes"]) <= set(t["samples"]) and t["duration"] >= 0


def test_every_byte_changed():
    data = media.build(PAYLOAD)
    head = len(data) - len(PAYLOAD)
    assert media.inspect(data)[0]["codec"] == "raw " and b"".join(data[o : o + n] for o, n in media.inspect(data)[0]["samples"]) == PAYLOAD
    for i in range(head):
        for value in (0, 1, 0x7F, 0xFF, data[i] ^ 0x80):
            sane(data[:i] + bytes([value]) + data[i + 1 :])


def test_every_cut():
    data = media.build(PAYLOAD)
    for i in range(len(data) - len(PAYLOAD) + 200):
        sane(data[:i])
        sane(data[i:])


def trak(*boxes):
    return media.box(b"trak", media.box(b"mdia", *boxes))


def test_an_empty_header_at_the_end():
    for kind in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stss", b"stco", b"co64", b"stsz"):
        for body in (b"", b"\0", b"\1\0\0", bytes(4), bytes(7)):
            data = media.box(b"moov", trak(media.box(kind, body)))
            assert media.inspect(data) == [{"handler": None, "codec": None, "duration": 0.0, "samples": [], "keyframes": []}]


def test_files_that_claim_too_much():
    """Many tracks with all of the file, sizes beyond it, and runs that go back and forth: time and samples stay in proportion to the file."""
    began = time.perf_counter()
    uniform = trak(media.box(b"minf", media.box(b"stbl", media.full(b"stsz", struct.pack(">II", 1, 1 << 31)), media.full(b"stco", struct.pack(">II", 1, 0)), media.full(b"stsc", struct.pack(">IIII", 1, 1, 1 << 31, 1)))))
    data = media.box(b"moov", uniform * 600)
    assert sum(len(t["samples"]) for t in media.inspect(data)) <= len(data)
    n = 40_000
    sizes = media.full(b"stsz", struct.pack(f">II{n}I", 0, n, *[1 << 20] * n))
    offsets = media.full(b"stco", struct.pack(f">I{n}I", n, *range(n)))
    runs = media.full(b"stsc", struct.pack(">I", n), *(struct.pack(">III", 1 + i % 2, i % 3 and 1, 1) for i in range(n)))
    data = media.box(b"moov", trak(media.box(b"minf", media.box(b"stbl", sizes, offsets, runs))))
    sane(data)
    (batch,) = media._features([pa.RecordBatch.from_pydict({"key": [1], "n_bytes": [0], "media": [data]})])
    assert batch.column("payload_bytes")[0].as_py() == 0  # 40,000 samples of a megabyte aren't read from a file of half of one
    sizes = media.full(b"stsz", struct.pack(f">II{n}I", 0, n, *[1] * n))
    data = media.box(b"moov", trak(media.box(b"minf", media.box(b"stbl", sizes, offsets, runs))))
    sane(data)
    assert time.perf_counter() - began < 20


# Pages


@pytest.mark.parametrize("name", ["comments", "navigation", "related", "menu", "footer", "sharing", "install"])
def test_headings_with_ids_of_their_words(name):
    text = "A long paragraph, with commas, that reads like prose and is kept, as it should be."
    page = f"<html><body><div class=content><h2 id={name}>{name.title()}</h2><p>{text}</p><p id={name}-2>{text}</p></div></body></html>"
    assert html_text.main_text(page) == f"{name.title()}\n{text}\n{text}"


def test_references_stay_and_menus_go():
    text = "A long paragraph, with commas, that reads like prose and is kept, as it should be. " * 3
    links = "".join(f"<li><a href=x{i}>A paper with number {i}</a></li>" for i in range(5))
    found = html_text.main_text(f"<main><article><h1>Title</h1><p>{text}</p><p>{text}</p><h2>References</h2><ol>{links}</ol></article></main>").split("\n")
    assert found[0] == "Title" and found[-6:] == ["References", *(f"A paper with number {i}" for i in range(5))]
    found = html_text.main_text(f"<main><article><ul>{links}</ul><h1>Title</h1><p>{text}</p><p>{text}</p></article></main>")
    assert found.startswith("Title\n") and "paper" not in found


def test_a_title_beside_the_best_container():
    text = "A long paragraph, with commas, that reads like prose and is kept, as it should be. " * 3
    assert html_text.main_text(f"<main><h1>Title</h1><div class=text><p>{text}</p><p>{text}</p></div></main>").startswith("Title\nA long")
    assert html_text.main_text(f"<body><div><h1>Site</h1></div><div class=text><p>{text}</p><p>{text}</p></div></body>").startswith("A long")
    assert html_text.main_text(f"<body><h1 class=x>Title</h1><div class=text><p>{text}</p></div><div><h2>More</h2></div></body>") == f"Title\n{text.strip()}"


def slow_text(page, names=True):
    """main_text's choice of blocks by its definition: every sum over all blocks, every path walked anew."""
    blocks = html_text.blocks_of(page, names)

    def path(n):
        out = []
        while n is not None:
            out.append(n)
            n = n.up
        return out

    def total(n, what):
        return sum({"chars": len(t), "links": k}[what] for b, t, k in blocks if n in path(b))

    def points(n):
        """None where no block counts for n; a block of links counts, with nothing."""
        out = None
        for b, t, k in blocks:
            if b.tag in html_text.PARAGRAPHS and len(t) >= 25:
                worth = (1 + t.count(",") + min(len(t) // 100, 3)) * (1 - k / len(t)) * (0.5 if any(x.doubt is x for x in path(b)) else 1)
                around = path(b)[1:] if b.tag in ("p", "pre", "li", "dd", "td", "figcaption") else path(b)
                for level, x in enumerate(around[:6]):
                    if x is n:
                        out = (out or 0.0) + worth * (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12, 1 / 15)[level]
        return out

    def worth(n):
        return (points(n) or 0.0) * (1 - total(n, "links") / total(n, "chars"))

    nodes = []
    for b, _, _ in blocks:
        nodes += [n for n in path(b) if n not in nodes]
    scored = [n for n in nodes if points(n) is not None]
    if not scored:
        return "\n".join(t for _, t, _ in blocks) or (slow_text(page, False) if names else "")
    most = max(worth(n) for n in scored)
    order = [n for b, t, _ in blocks if b.tag in html_text.PARAGRAPHS and len(t) >= 25 for n in path(b)]
    best = min((n for n in scored if worth(n) > most - 1e-9), key=order.index)
    bar = max(10.0, 0.2 * most)
    headed = {id(n) for (a, _, _), (b, _, _) in zip(blocks, blocks[1:], strict=False) if a.tag in html_text.HEADINGS if a.up in path(b) for n in path(b) if n not in path(a.up) and n.tag in html_text.LISTS}

    def keep(b):
        for n in path(b):
            if n is best:
                return True
            if n.doubt is n and worth(n) < 1:
                return False
            if n.up is not None and n.up is best.up:
                return worth(n) >= bar or n.tag == "p" and total(n, "chars") > 80 and total(n, "links") / total(n, "chars") < 0.25
            if n.up is None:
                return False
            if n.tag in html_text.LISTS and total(n, "chars") and total(n, "links") / total(n, "chars") > 0.5 and total(n, "links") > 1 and id(n) not in headed:
                return False
        return False

    kept = [keep(b) for b, _, _ in blocks]
    i = kept.index(True) if True in kept else 0
    while i and blocks[i - 1][0].tag in html_text.HEADINGS and not any(x.doubt is x for x in path(blocks[i - 1][0])) and blocks[i - 1][0].up in path(best)[1:]:
        i -= 1
        kept[i] = True
    return "\n".join(t for (_, t, _), k in zip(blocks, kept, strict=True) if k)


def random_page(seed):
    rng = random.Random(seed)
    words = ["word", "some", "longer,", "text", "with", "commas,", "and", "ends."]

    def text():
        return " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 12, 40])))

    def part(depth):
        kind = rng.random()
        name = rng.choice(["", "", "", " class=content", " class=related-work", " class=sidebar", " id=comments", " class='post item'"])
        if depth == 0 or kind < 0.4:
            body = f"<a href=x>{text()}</a>" if rng.random() < 0.3 else text()
            tag = rng.choice(["p", "p", "p", "h2", "h3", "td", "pre"])
            return f"<{tag}{name}>{body}</{tag}>"
        if kind < 0.6:
            return f"<ul{name}>" + "".join(f"<li>{'<a href=x>' + text() + '</a>' if rng.random() < 0.6 else text()}</li>" for _ in range(3)) + "</ul>"
        tag = rng.choice(["div", "div", "section", "article", "blockquote", "nav", "main"])
        return f"<{tag}{name}>" + "".join(part(depth - 1) for _ in range(rng.randint(1, 4))) + f"</{tag}>"

    return "<html><body>" + "".join(part(3) for _ in range(rng.randint(1, 5))) + "</body></html>"


def test_slow_scorer():
    for seed in range(400):
        page = random_page(seed)
        assert html_text.main_text(page) == slow_text(page), seed


def test_slow_scorer_on_pages(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        assert html_text.main_text(r.html or "") == slow_text(r.html or ""), r.page_id
