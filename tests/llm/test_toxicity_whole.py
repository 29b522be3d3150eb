"""Disguises that the gate before the lattice left out."""

import itertools
import random

import numpy as np
import pytest

from pulsegrid.llm import toxicity


@pytest.fixture(scope="module")
def costs(spark):
    text = "the foolish person said stupid things like an idiot and an ass would while that fool was asking us to pass"
    return toxicity.fit_characters(spark.createDataFrame([(text,)] * 400, "text string"))


@pytest.mark.parametrize(
    ("token", "word"), [("idio+", "idiot"), ("455", "ass"), ("4$$", "ass"), ("iddiot", "idiot"), ("sttupid", "stupid"), ("idiot!", "idiot")]
)
def test_every_disguise_is_decoded(costs, token, word):
    assert word in toxicity.restore_token(token, costs)


@pytest.mark.parametrize("text", ["a s s", "4 s s", "a s $", "i\td\ti\to\tt", "i\nd\ni\no\nt"])
def test_spaced_words_are_joined(costs, text):
    model = toxicity.ToxicityModel(costs, {})
    assert {"ass", "idiot"} & model.tokens(f"you said {text} again")


def test_spans_meet_every_trigram_once(monkeypatch):
    rng = random.Random(3)
    assert not list(toxicity._trigrams(""))
    texts = [" ", "a", " a", "a  b"] + ["".join(rng.choice("abÉ 漢.\n1") for _ in range(rng.randrange(1, 50))) for _ in range(200)]
    for text in texts:
        whole = np.concatenate(list(toxicity._trigrams(text)))
        kinds = [toxicity._class(c) for c in text]
        kept = [k for i, k in enumerate(kinds) if k or (i and kinds[i - 1])]
        framed = [0, 0, *kept, 0]
        size = toxicity.CLASSES
        want = [(a * size + b) * size + c for a, b, c in zip(framed, framed[1:], framed[2:])]
        assert whole.tolist() == want
        for span in (1, 2, 3, 7):
            monkeypatch.setattr(toxicity, "SPAN", span)
            assert np.concatenate(list(toxicity._trigrams(text))).tolist() == want
        monkeypatch.setattr(toxicity, "SPAN", 1 << 19)


def test_decoded_readings_are_the_cheapest_of_all():
    """Every reading of short lattices is spelled out and priced."""
    rng = np.random.default_rng(1)
    costs = rng.random(toxicity.CLASSES**3) * 4
    size = toxicity.CLASSES

    def price(letters, paid):
        total, x, y = paid, 0, 0
        for char in letters:
            kind = toxicity._class(char)
            if kind or y:
                total += costs[(x * size + y) * size + kind]
                x, y = y, kind
        return total + costs[(x * size + y) * size]

    draw = random.Random(2)
    for _ in range(60):
        text = "".join(draw.choice("ab10@$!.- ") for _ in range(draw.randrange(1, 6)))
        ways = list(itertools.product(*toxicity.lattice(text)))
        best = min(price("".join(letters for letters, _ in way), sum(cost for _, cost in way)) for way in ways)
        found, reading = toxicity._cheapest(text, costs)
        assert abs(found - best) < 1e-9
        assert any("".join(letters for letters, _ in way) == reading for way in ways)


def test_frequent_tokens_are_restored_once(monkeypatch):
    """Rare tokens that fill the memory do not push out those met in every text; scores stay those of an empty memory."""
    monkeypatch.setattr(toxicity, "CLEAN", 40)
    costs = np.random.default_rng(6).random(toxicity.CLASSES**3) * 4
    met, restore = [], toxicity.restore_token
    monkeypatch.setattr(toxicity, "restore_token", lambda token, costs: met.append(token) or restore(token, costs))
    model = toxicity.ToxicityModel(costs, {"=idiot": 2.0})
    texts = [f"often seen word{i} other{i}" + " idiot" * (i % 3 == 0) for i in range(300)]
    scores = [model.score(t) for t in texts]
    assert met.count("often") == met.count("seen") == 1
    assert scores == [toxicity.ToxicityModel(costs, {"=idiot": 2.0}).score(t) for t in texts]


def test_spaced_words_pass_the_quick_look():
    """No text with a spaced-out word is passed over by the expression tried first."""
    signs, rng = "aabs01@$!|+.-_*~  \t\né二²€", np.random.default_rng(7)
    texts = ["".join(rng.choice(list(signs), rng.integers(3, 30))) for _ in range(4000)]
    spaced = [t for t in texts if toxicity._SPACED.search(t)]
    assert len(spaced) > 200 and all(toxicity._PERHAPS_SPACED.search(t) for t in spaced)
