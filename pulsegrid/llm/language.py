"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.rows import add_columns

ORDERS = (1, 2, 3)
BUCKET_BITS = 15
SPAN = 1 << 19
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Lower-case letter of every code point; 32 for all that is no letter."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            small = char.lower()
            table[code] = ord(small) if len(small) == 1 else code
    return table


def _buckets(before: np.ndarray, codes: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of every n-gram of all orders that ends within ``codes``; ``before`` are the letters ahead of them."""
    stream = np.concatenate((before, codes)).astype(np.uint64)
    parts = []
    value = np.zeros(len(stream), dtype=np.uint64)
    for order in range(1, max(ORDERS) + 1):
        size = len(stream) - order + 1
        if size <= 0:
            break
        value = value[:size] * np.uint64(0x100000001B3) + stream[order - 1 :] + np.uint64(1)
        if order in ORDERS:
            new = value[max(0, len(before) - order + 1) :]
            mixed = (new ^ np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            parts.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(parts)


def _rows_of(text: str | None, bits: int):
    """Buckets of a whole text, some letters at a time; nothing if it holds no letter.

    The text is framed by one space at either end, and runs of other signs
    are one space. The last letters of a span go before the next, so every
    n-gram is met once, wherever the spans end.
    """
    if not isinstance(text, str):
        return
    frame = np.array([32], dtype=np.uint32)
    before, spaced = None, True
    for at in range(0, len(text), SPAN):
        codes = _folding()[np.frombuffer(text[at : at + SPAN].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        space = codes == 32
        keep = ~space
        keep[1:] |= ~space[:-1]
        keep[0] |= not spaced
        spaced = bool(space[-1])
        codes = codes[keep]
        if before is None:
            if not len(codes):
                continue
            before, codes = frame[:0], np.concatenate((frame, codes))
        if len(codes):
            yield _buckets(before, codes, bits)
            before = np.concatenate((before, codes))[1 - max(ORDERS) :]
    if before is not None:
        yield _buckets(before, frame, bits)


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities, one row per bucket and one column per language."""

    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray
    bits: int

    def predict(self, texts) -> tuple[list[str], list[float]]:
        """Most likely language and its tempered posterior for each text.

        Bucket lists of a batch form a sparse matrix (row bounds and column
        indices) that is multiplied by the dense log-probability matrix.
        """
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        total = np.tile(self.log_prior, (len(texts), 1)).astype(np.float64)
        size = np.zeros(len(texts))
        rows, columns, held = [], [], 0

        def flush():
            bounds = np.cumsum([0] + [len(c) for c in columns[:-1]])
            part = np.add.reduceat(self.log_prob[np.concatenate(columns)], bounds, axis=0, dtype=np.float64)
            np.add.at(total, rows, part)
            np.add.at(size, rows, [len(c) for c in columns])
            rows.clear()
            columns.clear()

        for i, text in enumerate(texts):
            for found in _rows_of(text, self.bits):
                rows.append(i)
                columns.append(found)
                held += len(found)
                if held > SPAN:
                    flush()
                    held = 0
        if rows:
            flush()
        if self.languages:
            scaled = total / np.sqrt(np.maximum(size, 1.0))[:, None]
            odds = np.exp(scaled - scaled.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            best = total.argmax(axis=1)
            for i in np.flatnonzero(size):
                names[i], scores[i] = self.languages[best[i]], float(odds[i, best[i]])
        return names, scores


def fit_language(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    sample: int = 4000,
    bits: int = BUCKET_BITS,
    alpha: float = 0.5,
    max_languages: int = 1000,
) -> LanguageModel:
    """Learn n-gram counts from labelled rows.

    ``sample`` bounds the expected number of rows read per language: a
    language with more labelled rows is thinned by a hash of ``key``, so that a
    rerun takes the same rows. Rows without language, text or key are not
    learned from. More than ``max_languages`` languages are an error, since the
    matrix of 2**bits rows is broadcast. No labelled row at all gives a model
    that answers ``und``.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("k").isNotNull()
    )
    sizes = known.groupBy("lang").count()
    found = sorted(map(tuple, sizes.limit(max_languages + 1).collect()))
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    names = tuple(name for name, _ in found)
    place = {name: i for i, name in enumerate(names)}
    if not names:
        return LanguageModel((), np.zeros(0), np.zeros((1 << bits, 0), dtype=np.float32), bits)
    limits = spark.createDataFrame([(n, min(1.0, sample / c)) for n, c in found], "lang string, share double")
    unit = F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.join(F.broadcast(limits), "lang").where(unit < F.col("share")).select("lang", "text")

    def count(frames):
        counts = np.zeros((len(names), 1 << bits), dtype=np.int64)
        for frame in frames:
            for name, body in zip(frame["lang"], frame["text"]):
                for rows in _rows_of(body, bits):
                    counts[place[name]] += np.bincount(rows, minlength=1 << bits)
        where, bucket = np.nonzero(counts)
        yield pd.DataFrame({"lang": where.astype(np.int32), "bucket": bucket.astype(np.int32), "n": counts[where, bucket]})

    cells = chosen.mapInPandas(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = cells.toPandas()  # at most languages x buckets cells
    counts = np.full((1 << bits, len(names)), alpha)
    counts[table["bucket"].to_numpy(dtype=np.int64), table["lang"].to_numpy(dtype=np.int64)] += table["n"].to_numpy(dtype=float)
    log_prob = np.log(counts) - np.log(counts.sum(axis=0, keepdims=True))
    share = np.array([c for _, c in found], dtype=float)
    return LanguageModel(names, np.log(share / share.sum()), log_prob.astype(np.float32), bits)


def predict_language(
    docs: DataFrame, model: LanguageModel, text: str = "text", keep: dict[str, Column] | None = None
) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the ``keep`` columns of every row.

    Whole texts are scored, long ones span by span. A null text, or one without
    a letter, is ``und`` with score 0; so is every text if nothing was learned.
    Repeated rows each get the same answer, ties go to the first language in
    code point order, and no column but the text reaches the model.
    """
    keep = {"doc_id": F.col("doc_id")} if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        return dict(zip(("lang_pred", "score"), shared.value.predict(texts)))

    return add_columns(docs, F.col(text), keep, "lang_pred string, score double", score)
