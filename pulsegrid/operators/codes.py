"""Vocabularies and hierarchical code labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.labels import code_prefixes, pick_categories, truncate_codes
from pulsegrid.operators.joins import left_with_lists
from pulsegrid.scale import position


def label_counts(df: DataFrame, labels: str, per_record: bool = False) -> DataFrame:
    """A1: occurrences per label; duplicates inside a list count twice."""
    values = F.array_distinct(labels) if per_record else F.col(labels)
    return df.select(F.explode(values).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def vocabulary(
    df: DataFrame, labels: str, min_count: int = 0, by_count: bool = False, per_record: bool = False
) -> DataFrame:
    """A1, A2: (label, count, idx) of the frequent labels.

    Indexed alphabetically, or by count (largest first, ties by label).
    """
    kept = label_counts(df, labels, per_record).where(F.col("count") >= min_count)
    order: list[Column] = [F.col("count").desc(), F.col("label")] if by_count else [F.col("label")]
    return position(kept, [], order, "idx")


def map_labels(df: DataFrame, key: Sequence[str], labels: str, vocab: DataFrame) -> DataFrame:
    """A1: add ``<labels>_filtered`` and ``<labels>_filtered_numeric``.

    List order and duplicates are kept; a row left without labels keeps empty
    lists.
    """
    long = df.select(*key, F.posexplode(labels).alias("place", "label")).join(
        vocab.select("label", F.col("idx").cast("int").alias("idx")), "label"
    )
    cells = F.array_sort(F.collect_list(F.struct("place", "label", "idx")))
    lists = long.groupBy(*key).agg(cells.alias("cells")).select(
        *key,
        F.transform("cells", lambda x: x["label"]).alias(f"{labels}_filtered"),
        F.transform("cells", lambda x: x["idx"]).alias(f"{labels}_filtered_numeric"),
    )
    return left_with_lists(df, lists, key, [f"{labels}_filtered", f"{labels}_filtered_numeric"])


def known_prefixes(df: DataFrame, key: Sequence[str], codes: str, known: DataFrame) -> DataFrame:
    """replace each code by its prefixes that occur in ``known(label)``."""
    cells = df.select(*key, F.explode(code_prefixes(F.col(codes))).alias("label"))
    kept = cells.join(known.select("label").distinct(), "label", "left_semi")
    lists = kept.groupBy(*key).agg(F.array_sort(F.collect_set("label")).alias(codes))
    return left_with_lists(df.drop(codes), lists, key, [codes])


# --- fixed values -----------------------------------------------------------
LABEL_SOURCES = {"hosp": "all_diag_hosp", "ed": "ed_diag_ed", "all": "all_diag_all"}
SUBSET_FLAGS = {"all": "ecg_taken_in_ed_or_hosp", "ed": "ecg_taken_in_ed", "hosp": "ecg_taken_in_hosp"}
# -----------------------------------------------------------------------------


def _after_prefix(text: str, table: dict[str, str]) -> tuple[str, str]:
    for prefix, column in table.items():
        if text.startswith(prefix):
            return column, text[len(prefix):]
    raise ValueError(f"{text!r} starts with none of {sorted(table)}")


@dataclass(frozen=True)
class CohortSpec:
    """F8: which rows and which codes make the training and test labels."""

    train_flag: str
    train_first: bool
    train_codes: str
    category: str
    test_flag: str
    test_first: bool
    test_codes: str
    min_count: int
    digits: int | None = None
    ancestors: bool = False

    @classmethod
    def parse(cls, text: str) -> "CohortSpec":
        """``name_trainrows_trainlabels_testrows_testlabels_mincount[_digits[A]]``."""
        _, rows, labels, test_rows, test_labels, min_count, *rest = text.split("_")
        train_flag, _ = _after_prefix(rows, SUBSET_FLAGS)
        train_codes, category = _after_prefix(labels, LABEL_SOURCES)
        test_flag, _ = _after_prefix(test_rows, SUBSET_FLAGS)
        test_codes, _ = _after_prefix(test_labels, LABEL_SOURCES)
        digits = rest[0] if rest else ""
        ancestors = digits.endswith("A")
        digits = digits.removesuffix("A")
        return cls(
            train_flag, rows.endswith("first"), train_codes, category,
            test_flag, test_rows.endswith("first"), test_codes,
            int(min_count), int(digits) if digits else None, ancestors,
        )


def cohort_labels(
    df: DataFrame, spec: CohortSpec, key: str = "study_id", fold: str = "fold", visit: str = "ecg_no_within_stay"
) -> tuple[DataFrame, DataFrame]:
    """F8: selected rows with ``label`` (code list) and ``label_idx``, and the vocabulary.

    The last two folds take test codes, all earlier ones training codes. The
    vocabulary counts training codes over every row. Rows are dropped when
    they had no code at all before truncation, not when none survives.
    """

    def prepare(codes: Column, category: str) -> Column:
        return pick_categories(truncate_codes(codes, spec.digits), category)

    work = df.withColumns(
        {
            "label_train": prepare(F.col(spec.train_codes), spec.category),
            "label_test": prepare(F.col(spec.test_codes), ""),
        }
    )
    if spec.ancestors:
        work = work.withColumns({c: code_prefixes(F.col(c)) for c in ("label_train", "label_test")})
    else:
        known = work.select(F.explode("label_train").alias("label")).distinct()
        work = known_prefixes(work, [key], "label_train", known)
        work = known_prefixes(work, [key], "label_test", known)
    vocab = vocabulary(work, "label_train", spec.min_count, by_count=True)
    top = df.agg(F.max(fold)).scalar()
    testing = F.col(fold) >= top - 1
    first = F.col(visit) == 0
    train_rows = F.col(spec.train_flag) & (F.size(spec.train_codes) > 0)
    test_rows = F.col(spec.test_flag) & (F.size(spec.test_codes) > 0)
    if spec.train_first:
        train_rows = train_rows & first
    if spec.test_first:
        test_rows = test_rows & first
    picked = work.where(F.when(testing, test_rows).otherwise(train_rows)).withColumn(
        "label", F.when(testing, F.col("label_test")).otherwise(F.col("label_train"))
    )
    out = map_labels(picked.drop("label_train", "label_test"), [key], "label", vocab)
    out = out.drop("label").withColumnsRenamed(
        {"label_filtered": "label", "label_filtered_numeric": "label_idx"}
    )
    return out, vocab
