"""What the toxicity machines learn from rare insults, and from phrases under wrong labels; the machine against its optimum."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tracewright.llm import toxicity

SYLLABLES = "an er in the on at es or ti re nd st en of ou ha ed al is it ar te se".split()


def ordinary(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def text_of(words):
    return " ".join(words[:20]) + ". " + " ".join(words[20:])


def insulting(kinds, each, clean, seed=1):
    """(text, label) with one of several made-up insults in each toxic text, and the insults."""
    rng = random.Random(seed)
    consonant = "bcdfgjkmpqvwxz"
    insults = ["".join(rng.choice(consonant) + rng.choice("aeiou") for _ in range(rng.randint(3, 4))) + rng.choice(consonant) for _ in range(kinds)]
    rows = []
    for x in insults * each:
        words = [ordinary(rng) for _ in range(40)]
        words[rng.randrange(40)] = x
        rows.append((text_of(words), 1))
    rows += [(text_of([ordinary(rng) for _ in range(40)]), 0) for _ in range(clean)]
    rng.shuffle(rows)
    return rows, insults


@pytest.mark.parametrize("kinds, each", [(20, 50), (100, 10)])
def test_rare_insults(kinds, each):
    """Insults in ten texts each are learnt, as those in fifty are."""
    rows, insults = insulting(kinds, each, 2000)
    cut = len(rows) * 4 // 5
    model = toxicity.fit([t for t, _ in rows[:cut]], [y for _, y in rows[:cut]])
    margins = toxicity.Scorer(*model).margins([t for t, _ in rows[cut:]])
    toxic, clean = ([m > 0 for m, (_, y) in zip(margins, rows[cut:], strict=True) if y == k] for k in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    assert (toxicity.decide(insults, *model) > 0).mean() >= 0.9


def test_words_beside_insults_are_no_witnesses():
    rows, insults = insulting(100, 10, 2000)
    sentences = [(s.strip(), y, i) for i, (t, y) in enumerate(rows) for s in toxicity.SENTENCE.split(t)]
    found = toxicity.witnesses(sentences)
    assert set(found) <= set(insults) and len(found) >= 70
    rng = random.Random(2)
    assert toxicity.witnesses([(s, rng.randrange(2), i) for s, _, i in sentences]) == []  # labels by lot have none


PHRASES = ("you ought to vanish for ever", "nobody here wants your kind")


def phrased(wrong, seed):
    """Toxic by a phrase of everyday words, toxic by a word, clean; and clean-labelled rows that hold the phrases."""
    rng = random.Random(seed)
    words = [ordinary(random.Random(i)) for i in range(400)] + " ".join(PHRASES).split()
    said = lambda: [rng.choice(words) for _ in range(40)]
    rows = []
    for i in range(400):
        for y, extra in ((1, rng.choice(PHRASES)), (1, rng.choice(["idiot", "moron"])), (0, ""), (0, ""), (0, "")):
            t, at = said(), rng.randrange(15)
            rows.append((text_of(t[:at] + extra.split() + t[at:]), y, extra))
    return rows + [(text_of(said()[:3] + PHRASES[i % 2].split() + said()), 0, "") for i in range(wrong)]


@pytest.mark.parametrize("wrong", [0, 2, 6])
def test_phrases_under_wrong_labels(wrong):
    """A few clean-labelled rows with a toxic phrase don't undo what hundreds teach."""
    rows = phrased(wrong, 2)
    texts, labels = [r[0] for r in rows], [r[1] for r in rows]
    model = toxicity.fit(texts, labels)
    test = phrased(0, 9)
    margins = toxicity.Scorer(*model, toxicity.phrases(texts, labels, model)).margins([r[0] for r in test])
    hit = lambda wanted: [m > 0 for m, r in zip(margins, test, strict=True) if wanted(r)]
    assert np.mean(hit(lambda r: r[2] in PHRASES)) >= 0.9 and np.mean(hit(lambda r: r[2] in ("idiot", "moron"))) >= 0.99
    assert np.mean(hit(lambda r: r[1] == 0)) <= 0.01


@pytest.mark.parametrize("seed", range(5))
def test_the_machine_is_at_its_optimum(seed):
    """No step, along the gradient or in any of many directions, lowers the squared-hinge objective."""
    rng = np.random.default_rng(seed)
    x, y, c = rng.normal(size=(200, 8)), rng.choice([-1.0, 1.0], 200), rng.uniform(0.1, 30, 200)
    x[:, 0] += y
    w, bias = toxicity.squared_hinge(x, y, c)

    def objective(v):
        return 0.5 * v[:-1] @ v[:-1] + 0.5e-6 * v[-1] ** 2 + 0.5 * (c * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum()

    at = np.append(w, bias)
    least = objective(at)
    for scale in (1e-3, 1e-2, 0.3):
        assert all(objective(at + scale * d) >= least - 1e-9 for d in rng.normal(size=(200, 9)))


def test_chance_of_places():
    from math import comb

    for bad, clean, share in ((5, 0, 0.5), (40, 2, 0.3)):
        n = bad + clean
        assert toxicity._tail(bad, clean, share) == pytest.approx(sum(comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(bad, n + 1)))
