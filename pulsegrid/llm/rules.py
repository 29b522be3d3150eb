"""Quality rules whose cutoffs carry a bound on false rejection.

Every rule compares one feature of a text with a cutoff. Labelled documents
are split in two: one half proposes, the other, the holdout, certifies. A
cutoff is certified when the exact binomial test rejects "good documents are
refused at a rate of ``risk`` or more" at the level left after Bonferroni
correction over all (stratum, rule) pairs. Within a pair, cutoffs are tested
from the mildest on and testing ends at the first failure, which needs no
further correction.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.hashing import WHITE, as_bytes, batches, windows, word_hashes
from pulsegrid.llm.rows import add_columns
from pulsegrid.session import cut

WIDTH = 5
BINS = 64
# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SPACE = np.isin(np.arange(256), list(WHITE))
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_MARK = np.isin(np.arange(256), list(b"!?;:,.\"'()[]{}_=+~^@/\\`-"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_HEAD = (np.arange(256) & 0xC0) != 0x80
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper")


def _per_word(name: str) -> Column:
    return F.col(name) / F.greatest(F.col("n_words"), F.lit(1))


# Each rule refuses where its feature, cut into bins between zero and a top, is high.
RULES = {
    "symbols": (lambda: _per_word("n_symbols"), 2.0),
    "marks": (lambda: _per_word("n_marks"), 4.0),
    "upper": (lambda: F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), 1.0),
    "dup_lines": (lambda: _per_word("n_dup_lines"), 0.5),
    "repeats": (lambda: _per_word("n_repeat_words"), 1.0),
    "word_length": (lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), 32.0),
}


def _repeated(hashes: np.ndarray, width: int) -> int:
    """Words inside windows that occur twice or more; every occurrence counts."""
    found, at = windows(hashes, np.array([0, len(hashes)]), width)
    if len(found) < 2:
        return 0
    _, back, n = np.unique(found, return_inverse=True, return_counts=True)
    hit = at[n[back] > 1]
    if not len(hit):
        return 0
    step = np.zeros(len(hashes) + 1, dtype=np.int64)
    step[hit] += 1
    np.subtract.at(step, hit + width, 1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def text_stats(data: list[bytes], width: int = WIDTH) -> dict[str, list[int]]:
    """Counts of each whole text, see ``document_stats``."""
    out: dict[str, list[int]] = {name: [] for name in STATS}
    for first, last in batches(data):
        hashes, bounds = word_hashes(data[first:last])
        for i in range(first, last):
            raw = data[i]
            own = hashes[bounds[i - first] : bounds[i - first + 1]]
            counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
            out["n_words"].append(len(own))
            out["word_chars"].append(int(counts[_HEAD & ~_SPACE].sum()))
            for name, members in (("n_symbols", _SYMBOL), ("n_marks", _MARK), ("n_upper", _UPPER)):
                out[name].append(int(counts[members].sum()))
            lines = [line for line in raw.split(b"\n") if line.strip(WHITE)]
            out["n_dup_lines"].append(len(lines) - len(set(lines)))
            out["n_repeat_words"].append(_repeated(own, width) if len(own) > width else 0)
    return out


def document_stats(docs: DataFrame, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """Add the counts of ``STATS`` to the ``keep`` columns of every row.

    Words are runs of characters other than space and 0x09 to 0x0D;
    ``n_dup_lines`` counts lines with a word that equal an earlier line,
    ``n_repeat_words`` the words inside five-word windows that the text holds
    twice or more, ``n_marks`` other punctuation, ``n_upper`` capitals A-Z. A
    null text counts as empty: all counts are zero. Repeated rows stay.
    """
    keep = {"doc_id": F.col("doc_id")} if keep is None else keep
    schema = ", ".join(f"{name} long" for name in STATS)
    return add_columns(docs, F.col(text), keep, schema, lambda texts: text_stats([as_bytes(t) for t in texts]))


def tail_probability(k: int, n: int, rate: float) -> float:
    """P(X <= k) for n trials at ``rate``, exact up to rounding."""
    if n == 0 or k >= n:
        return 1.0
    at = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in at])
    logs += at * math.log(rate) + (n - at) * math.log1p(-rate)
    return float(min(1.0, np.exp(logs).sum()))


def select_cutoffs(
    counts: pd.DataFrame, risk: float, error: float, weight: float = 20.0
) -> dict[tuple[str, str], int]:
    """First refused bin for each (stratum, rule) that has a certified, useful cutoff.

    ``counts`` has (stratum, rule, bin, good, holdout, n). Cutoffs are certified
    on the holdout; of those, the one with the largest share of bad documents
    refused, less ``weight`` times the share of good ones, on the other half
    is taken, the mildest among equals. A pair without labels, or where no
    certified cutoff refuses a bad document, gets none.
    """
    out: dict[tuple[str, str], int] = {}
    groups = list(counts.groupby(["stratum", "rule"], sort=True))
    for key, part in groups:
        cells = np.zeros((2, 2, BINS), dtype=np.int64)  # good, holdout, bin
        np.add.at(cells, (part["good"].to_numpy(), part["holdout"].to_numpy(), part["bin"].to_numpy()), part["n"].to_numpy())
        refused = cells[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]
        total = cells.sum(axis=2)
        level, best = error / len(groups), 0.0
        for at in range(BINS - 1, 0, -1):
            if tail_probability(int(refused[1, 1, at]), int(total[1, 1]), risk) > level:
                break
            gain = refused[0, 0, at] / max(1, total[0, 0]) - weight * refused[1, 0, at] / max(1, total[1, 0])
            if gain > best:
                out[key], best = at, gain
    return out


def bin_of(value: Column, top: float) -> Column:
    return F.least(F.floor(value * F.lit(BINS / top)), F.lit(BINS - 1)).cast("int")


def certified_verdict(
    stats: DataFrame,
    labels: DataFrame,
    risk: float = 0.01,
    error: float = 0.05,
    key: str = "doc_id",
    stratum: str = "stratum",
    label: str = "quality",
    max_strata: int = 2000,
) -> DataFrame:
    """``stats`` with a boolean ``accepted``.

    At most a share ``risk`` of the good documents of a stratum is refused by
    any one rule, with confidence 1 - ``error`` for all strata and rules
    together (so at most rules x risk by all rules). All labelled rows are
    counted; a null stratum is a stratum of its own, null labels and keys are
    not counted, a document labelled twice counts twice. Without a certified
    cutoff documents are accepted, so empty tables of labels refuse nothing.
    """
    spark = stats.sparkSession
    name = F.coalesce(F.col(stratum).cast("string"), F.lit("\x00"))
    marks = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("good")).where(F.col("good").isin(0, 1))
    judged = stats.join(marks, stats[key] == marks["_key"])
    bins = F.array(*[F.struct(F.lit(r).alias("rule"), bin_of(value(), top).alias("bin")) for r, (value, top) in RULES.items()])
    holdout = (F.crc32(F.col("_key").cast("string")) % 2).cast("int").alias("holdout")
    cells = (
        judged.select(name.alias("stratum"), "good", holdout, F.explode(bins).alias("b"))
        .groupBy("stratum", "good", "holdout", "b.rule", "b.bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    limit = max_strata * len(RULES) * BINS * 4
    counts = cells.limit(limit + 1).toPandas()
    if len(counts) > limit:
        raise ValueError(f"more than {max_strata} strata")
    cutoffs = select_cutoffs(counts, risk, error)
    if not cutoffs:
        return stats.withColumn("accepted", F.lit(True))
    table = pd.DataFrame([(s, *[cutoffs.get((s, r), BINS) for r in RULES]) for s in sorted({s for s, _ in cutoffs})])
    limits = spark.createDataFrame(table, "_stratum string, " + ", ".join(f"_c_{r} int" for r in RULES))
    joined = stats.withColumn("_name", name).join(F.broadcast(limits), F.col("_name") == F.col("_stratum"), "left")
    passes = [bin_of(value(), top) < F.coalesce(F.col(f"_c_{r}"), F.lit(BINS)) for r, (value, top) in RULES.items()]
    accepted = passes[0]
    for p in passes[1:]:
        accepted = accepted & p
    return joined.select(*[stats[c] for c in stats.columns], accepted.alias("accepted"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05, stratum: str = "lang") -> DataFrame:
    """Counts, base rules and certified verdict of every document.

    The counts are checkpointed (a few numbers a row), so texts are read once.
    """
    stats = document_stats(docs, keep={"doc_id": F.col("doc_id"), "stratum": F.col(stratum)})
    stats = cut(stats)
    verdict = certified_verdict(stats, labels, risk, error)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return verdict.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("accepted")).alias("kept"),
    )
