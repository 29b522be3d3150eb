"""Toxicity of whole texts after noisy-channel deobfuscation.

Obfuscated spellings (letters replaced by look-alikes, spaced out, repeated)
form a lattice of possible letters. A Viterbi search under a character
trigram model of the corpus picks the likeliest reading, and a model of
labelled documents scores the restored words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.rows import add_columns, neutral

CLASSES = 64
SPAN = 1 << 19
CLEAN, KNOWN = 400_000, 100_000
# What a sign can stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = " ._*~-"
SUBSTITUTED, DROPPED, BROKEN, KEPT, HALVED = 1.0, 0.2, 2.5, 6.0, 0.7
_EDGE = " .,;:?\"'()[]{}<>#%&*_~^`/\\=-…“”‘’«»"
_SIGNS = "".join(map(re.escape, LOOKALIKE))
_MARKS = "".join(re.escape(c) for c in LOOKALIKE if not c.isalnum())
_SUSPECT = re.compile(rf"[{_SIGNS}]|([^\W\d_])\1|(?:[^\W\d_][._*~-]+){{2}}[^\W\d_]")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_SPACED = re.compile(rf"(?<![\w{_SIGNS}])(?:[^\W_](?:\s|[._*~-]){{1,2}}|[{_MARKS}]\s){{2,}}(?:[^\W_]|[{_MARKS}])(?![\w])")
# Every spaced-out word holds this, and few other texts do.
_PERHAPS_SPACED = re.compile(rf"[\s._*~-](?:[^\W_]|[{_MARKS}])(?:\s|[._*~-]){{1,2}}(?:[^\W_]|[{_MARKS}])(?![\w])")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: 0 no letter, 1-26 a-z without accents, others by remainder."""
    table = np.zeros(0x110000, dtype=np.int32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            base = unicodedata.normalize("NFKD", char.lower())[0]
            table[code] = ord(base) - 96 if "a" <= base <= "z" else 27 + code % (CLASSES - 27)
    return table


@lru_cache(maxsize=4096)
def _class(char: str) -> int:
    return int(_classes()[ord(char)])


def _trigrams(text: str) -> Iterator[np.ndarray]:
    """Cells of all letter trigrams of a whole text, some at a time; the last two letters go before the next span."""
    if not text:
        return
    before, letter = np.zeros(2, dtype=np.int32), False
    for at in range(0, len(text), SPAN):
        codes = np.frombuffer(text[at : at + SPAN].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = _classes()[codes]
        keep = kinds > 0
        keep[1:] |= kinds[:-1] > 0
        keep[0] |= letter
        letter = bool(kinds[-1] > 0)
        stream = np.concatenate((before, kinds[keep]))
        yield _cells(stream)
        before = stream[-2:]
    yield _cells(np.append(before, np.int32(0)))


def _cells(kinds: np.ndarray) -> np.ndarray:
    return (kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:]


def fit_characters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Costs (negative log probabilities) of a letter class after two others, over all texts.

    Each partition adds up its counts, so at most 64**3 cells a partition are
    shuffled and at most 64**3 reach the driver. Null texts add nothing.
    """

    def count(frames):
        cells, held, size = np.zeros(CLASSES**3, dtype=np.int64), [], 0
        for frame in frames:
            for body in frame["text"]:
                if isinstance(body, str):
                    for found in _trigrams(body):
                        if len(found):
                            held.append(found)
                            size += len(found)
                    if size > SPAN:
                        cells += np.bincount(np.concatenate(held), minlength=CLASSES**3)
                        held, size = [], 0
        if held:
            cells += np.bincount(np.concatenate(held), minlength=CLASSES**3)
        where = np.flatnonzero(cells)
        yield pd.DataFrame({"cell": where, "n": cells[where]})

    rows = docs.select(F.col(text).alias("text")).mapInPandas(count, "cell long, n long")
    found = rows.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(CLASSES**3)
    cells[found["cell"].to_numpy(dtype=np.int64)] = found["n"]
    three = cells.reshape(CLASSES, CLASSES, CLASSES)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    unigram = (one + 0.5) / (one.sum() + 0.5 * CLASSES)
    bigram = (two + 20 * unigram) / (two.sum(axis=1, keepdims=True) + 20)
    trigram = (three + 20 * bigram[None]) / (three.sum(axis=2, keepdims=True) + 20)
    return -np.log(trigram).ravel()


def _readings(char: str, n: int) -> list[tuple[str, float]]:
    if char.isalpha():
        return [(char, 0.0)] if n == 1 else [(char * 2, 0.0 if n == 2 else HALVED), (char, HALVED)]
    if char in SEPARATORS or char.isspace():
        return [("", DROPPED), (" ", BROKEN if n == 1 else DROPPED)]
    if char in LOOKALIKE:
        readings = [(c * k, SUBSTITUTED) for c in LOOKALIKE[char] for k in range(1, min(n, 2) + 1)]
        return [*readings, (" ", KEPT), ("", KEPT)]
    return [(" ", 0.0)]


@lru_cache(maxsize=4096)
def _steps(char: str, n: int) -> list[tuple[str, float, list[int]]]:
    """Readings of a run with the classes of their letters."""
    return [(letters, price, [_class(c) for c in letters]) for letters, price in _readings(char, n)]


def lattice(text: str) -> list[list[tuple[str, float]]]:
    """Readings of each run of equal characters: (letters, cost)."""
    return [_readings(char, len(list(same))) for char, same in groupby(text)]


def _cheapest(text: str, costs: np.ndarray) -> tuple[float, str]:
    """Cost and letters of the cheapest reading of a lattice; the state is the last two letter classes."""
    prices = memoryview(costs)  # plain numbers, not copied
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # the class before the last times CLASSES, and the last
    for char, same in groupby(text):
        following: dict[int, tuple[float, tuple | None]] = {}
        steps = _steps(char, min(3, len(list(same))))  # a fourth equal character adds no reading
        for state, (cost, trail) in states.items():
            for letters, price, kinds in steps:
                total, at = cost + price, state
                for kind in kinds:
                    last = at % CLASSES
                    if kind or last:
                        total += prices[at * CLASSES + kind]
                        at = last * CLASSES + kind
                if at not in following or total < following[at][0]:
                    following[at] = (total, (trail, letters))
        states = following
    whole = {s: cost + prices[s * CLASSES] for s, (cost, _) in states.items()}
    end = min(whole, key=whole.get)
    trail, out = states[end][1], []
    while trail is not None:
        out.append(trail[1])
        trail = trail[0]
    return float(whole[end]), "".join(reversed(out))


def decode(text: str, costs: np.ndarray) -> str:
    """Cheapest reading of a lattice."""
    return _cheapest(text, costs)[1]


def _forms(token: str) -> list[str]:
    """A token without signs around it: without final ! | + and, if it had any, also with them, as they may be letters."""
    whole = token.strip(_EDGE)
    plain = whole.rstrip("!|+")
    return [plain, whole] if whole != plain else [plain]


def restore_token(token: str, costs: np.ndarray) -> list[str]:
    """Words that a lower-case token may stand for: as written, and as decoded if it may be disguised."""
    if token.isalpha():  # letters alone: no sign to strip or to split at
        return [token, *decode(token, costs).split()] if _DOUBLED.search(token) else [token]
    forms = _forms(token)
    words = [w for w in _NO_LETTERS.split(forms[0]) if w]
    for form in forms:
        if _SUSPECT.search(form):
            words += decode(form, costs).split()
    return words


def restore_text(text: str, costs: np.ndarray) -> str:
    """The text with spaced-out and disguised words replaced by their likeliest reading."""
    joined = _SPACED.sub(lambda m: decode(m[0].lower(), costs), text)

    def one(match):
        forms = _forms(match[0].lower())
        return min(_cheapest(f, costs) for f in forms)[1] if any(map(_SUSPECT.search, forms)) else match[0]

    return re.sub(r"\S+", one, joined)


def _features(word: str) -> list[str]:
    return ["=" + word, *[word[:n] for n in (4, 5, 6)[: max(0, len(word) - 4)]]]


@dataclass
class ToxicityModel:
    """Character costs, weights of word features, and the bias of the logistic link."""

    costs: np.ndarray
    weights: dict[str, float]
    bias: float = -1.0
    _clean: set = field(default_factory=set, repr=False)
    _older: set = field(default_factory=set, repr=False)
    _known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_clean": set(), "_older": set(), "_known": {}}

    def tokens(self, text: str) -> set[str]:
        low = text.lower()
        found = set(low.split())
        if _PERHAPS_SPACED.search(low):
            for match in _SPACED.finditer(low):
                found.update(decode(match[0], self.costs).split())
        return found

    def hits(self, text: str | None) -> set[str]:
        """Distinct weighted features of a text; tokens without any are remembered, in two generations."""
        out: set[str] = set()
        if not isinstance(text, str):
            return out
        new = self.tokens(text) - self._clean
        again = new & self._older
        self._clean |= again
        for token in new - again:
            names = self._known.get(token)
            if names is None:
                words = restore_token(token, self.costs)
                names = tuple(n for w in words for n in _features(w) if n in self.weights)
                if not names:
                    self._clean.add(token)
                    continue
                if len(self._known) > KNOWN:
                    self._known.clear()
                self._known[token] = names
            out.update(names)
        if len(self._clean) > CLEAN // 2:
            self._clean, self._older = set(), self._clean
        return out

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[n] for n in sorted(self.hits(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit_weights(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, size: int, penalty: float) -> tuple[np.ndarray, float]:
    """Non-negative weights and bias of a logistic model with an L1 penalty.

    The penalty makes copies of one document explain themselves by what they
    share with other documents, not by their own rare words. Coordinates that
    violate the optimum most are moved first.
    """
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    cuts = np.searchsorted(columns, np.arange(size + 1))
    w, bias, z = np.zeros(size), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), np.zeros(len(y))
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(z + bias, -30, 30)))
        grad = np.bincount(columns, weights=(p - y)[rows], minlength=size) + penalty
        off = np.where(w > 0, np.abs(grad), np.maximum(0.0, -grad))
        step = float(np.clip((p - y).sum() / max(1e-9, (p * (1 - p)).sum()), -1, 1))
        bias -= step
        if off.max(initial=0.0) < 0.05 * penalty and abs(step) < 1e-3:
            break
        for j in np.argsort(-off, kind="stable")[:32]:
            if off[j] <= 0:
                break
            own = rows[cuts[j] : cuts[j + 1]]
            q = 1 / (1 + np.exp(-np.clip(z[own] + bias, -30, 30)))
            move = ((y[own] - q).sum() - penalty) / max(1e-3, (q * (1 - q)).sum())
            new = max(0.0, w[j] + float(np.clip(move, -2, 2)))
            z[own] += new - w[j]
            w[j] = new
    return w, bias


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    learn: Column | None = None, sample: int = 15_000, size: int = 20_000, support: int = 3, penalty: float = 1.0,
) -> ToxicityModel:
    """Learn the character model from all texts and the word weights from labelled ones.

    ``learn`` restricts the labelled rows that are learned from. ``sample``
    bounds the expected number of labelled rows of each class, thinned by a
    hash of the key; ``size`` bounds the number of word features that are candidates, those
    of largest likelihood ratio, and ``penalty`` is in documents. A document labelled more than once is toxic
    if any label says so; rows without key, text or a label of 0 or 1 teach
    nothing. Without both classes every text scores one half or less.
    """
    spark = docs.sparkSession
    costs = fit_characters(docs, text)
    shared_costs = spark.sparkContext.broadcast(costs)
    marks = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (F.lit(True) if learn is None else learn)
    )
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    counted = {int(y): n for y, n in marks.groupBy("y").count().collect()}
    if len(counted) < 2:
        return ToxicityModel(costs, {})
    share = F.when(F.col("y") == 1, min(1.0, sample / counted[1])).otherwise(min(1.0, sample / counted[0]))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = marks.where(unit < share).select(F.col("doc_id").alias("_id"), "y")  # at most about 2 x sample rows
    bodies = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    learned = bodies.join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("y", "text")

    def count(frames):
        reader, seen = ToxicityModel(shared_costs.value, {}), (Counter(), Counter())
        sizes, words = [0, 0], {}
        for frame in frames:
            for y, body in zip(frame["y"], frame["text"]):
                names = set()
                for token in reader.tokens(body):
                    if token not in words:
                        if len(words) > KNOWN:
                            words.clear()
                        words[token] = tuple(n for w in restore_token(token, reader.costs) for n in _features(w))
                    names.update(words[token])
                seen[y].update(names)
                sizes[y] += 1
        names = list(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame(
            {"name": [""] + names, "clean": [sizes[0]] + [seen[0][n] for n in names], "toxic": [sizes[1]] + [seen[1][n] for n in names]}
        )

    totals = learned.mapInPandas(count, "name string, clean long, toxic long").groupBy("name").agg(
        F.sum("clean").alias("a"), F.sum("toxic").alias("b")
    )
    sizes = learned.groupBy("y").count().collect()
    n = {0: 1, 1: 1} | {int(y): c for y, c in sizes}
    expected = (F.col("a") + F.col("b")) * (n[1] / (n[0] + n[1]))
    gain = F.col("b") * F.log(F.col("b") / expected)
    best = totals.where((F.col("name") != "") & (F.col("b") >= support) & (F.col("b") > 2 * expected))
    names = [r.name for r in best.orderBy(gain.desc(), "name").limit(size).select("name").collect()]
    place = {name: i for i, name in enumerate(names)}
    shared = spark.sparkContext.broadcast(ToxicityModel(costs, dict.fromkeys(names, 1.0)))

    def match(frames):
        for frame in frames:
            yield pd.DataFrame({"y": frame["y"], "at": [sorted(place[h] for h in shared.value.hits(t)) for t in frame["text"]]})

    cells = learned.mapInPandas(match, "y int, at array<int>").toPandas()  # rows bounded by the sample
    rows = np.repeat(np.arange(len(cells)), cells["at"].map(len).to_numpy(dtype=np.int64))
    columns = np.concatenate([np.zeros(0, dtype=np.int64), *cells["at"]]).astype(np.int64)
    w, bias = _fit_weights(rows, columns, cells["y"].to_numpy(dtype=float), len(names), penalty)
    # The classes were thinned at different rates; the bias returns to the rates of the table.
    bias += math.log(counted[1] / n[1]) - math.log(counted[0] / n[0])
    return ToxicityModel(costs, {name: float(w[i]) for name, i in place.items() if w[i] > 0}, bias)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, text: str = "text", keep: dict[str, Column] | None = None
) -> DataFrame:
    """Add ``score`` and ``predicted`` to the ``keep`` columns of every row.

    Null and empty texts get the score of no evidence. Repeated rows get equal
    scores; only the text is read.
    """
    keep = {"doc_id": F.col("doc_id")} if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = add_columns(docs, F.col(text), keep, "score double", lambda texts: {"score": [shared.value.score(t) for t in texts]})
    return scored.select(*scored.columns, (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Documents that score below one half, with all their columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given, names = neutral(docs)
    kept = {c: F.col(c) for c in given.columns}
    scored = add_columns(given, F.col(names[text]), kept, "_toxic double", lambda texts: {"_toxic": [shared.value.score(t) for t in texts]})
    return scored.where(F.col("_toxic") < 0.5).drop("_toxic").toDF(*docs.columns)
