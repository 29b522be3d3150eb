"""Language scores against a plain naive Bayes, and long texts against their whole."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from pulsegrid.llm import language


def plain_grams(text):
    """All n-grams of a framed text, as strings."""
    letters, out = [], Counter()
    for char in text:
        small = char.lower() if char.isalpha() else " "
        small = char if len(small) != 1 else small
        if small != " " or (letters and letters[-1] != " "):
            letters.append(small)
    framed = [" ", *letters, " "]
    if any(c != " " for c in letters):
        for n in language.ORDERS:
            out.update("".join(framed[i : i + n]) for i in range(len(framed) - n + 1))
    return out


def texts():
    rng = random.Random(4)
    signs = "abc ÀÉ  .\n1漢ﬁİ\t-"
    return ["", " ", "..1", "a", " a", "a ", "a.b", *("".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(300))]


@pytest.mark.parametrize("span", [1, 2, 3, 7, 1 << 19])
def test_spans_meet_every_ngram_once(monkeypatch, span):
    known = {}
    for text in texts():
        monkeypatch.setattr(language, "SPAN", span)
        found = [b for part in language._rows_of(text, 30) for b in part.tolist()]
        monkeypatch.setattr(language, "SPAN", 1 << 19)
        whole = [b for part in language._rows_of(text, 30) for b in part.tolist()]
        assert Counter(found) == Counter(whole)
        grams = plain_grams(text)
        assert sorted(Counter(found).values()) == sorted(grams.values())
        known[text] = grams


def test_scores_equal_plain_naive_bayes(spark):
    rng = random.Random(9)
    alphabets = {"x": "abcde ", "y": "cdefg ", "z": "éàabc "}
    rows = [(i, "".join(rng.choice(alphabets[k]) for _ in range(40)), k) for i, k in enumerate(rng.choice("xyz") for _ in range(90))]
    model = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), bits=22)
    counts = {k: Counter() for k in "xyz"}
    for _, text, k in rows:
        counts[k].update(plain_grams(text))
    cells = 1 << 22
    prior = Counter(k for _, _, k in rows)
    for _ in range(40):
        text = "".join(rng.choice("abcdefgéà ") for _ in range(25))
        score = {}
        for k in "xyz":
            total = sum(counts[k].values()) + 0.5 * cells
            score[k] = math.log(prior[k] / len(rows)) + sum(n * math.log((counts[k][g] + 0.5) / total) for g, n in plain_grams(text).items())
        order = sorted(score.values())
        if order[-1] - order[-2] > 0.01:
            assert model.predict([text])[0] == [max(score, key=score.get)]
    assert np.isfinite(model.log_prob).all()
