"""Probe export plan: dataset rules, multi-hot labels, ids and splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import clean
from pulsegrid.functions.labels import split_targets
from pulsegrid.operators.reshape import probe_pairs
from pulsegrid.operators.splits import fold_split
from pulsegrid.sources.sinks import write_by_split
from pulsegrid.sources.tables import record_id, usable_id


@dataclass(frozen=True)
class DatasetSpec:
    """Which columns and rows of a dataset enter the probe tables.

    ``names`` and ``label`` always come from the same vocabulary.
    """

    label: str = "label"
    names: str | None = None
    min_length: int | None = None
    needs_fold: bool = False
    split: str | None = None
    splits: tuple[str, ...] = ()


def _filtered(column: str, min_length: int | None = None) -> DatasetSpec:
    return DatasetSpec(f"{column}_filtered_numeric", f"{column}_filtered", min_length)


# --- fixed values -----------------------------------------------------------
DATASETS = {
    "ptb": DatasetSpec(),
    "ningbo": _filtered("label"),
    "cpsc2018": _filtered("label", 5000),
    "cpsc_extra": _filtered("label", 5000),
    "georgia": _filtered("label", 5000),
    "chapman": _filtered("label_all"),
    "sph": _filtered("label_primary"),
    "code15_diag": DatasetSpec(min_length=4000, needs_fold=True),
    "ptbxl_super": _filtered("label_diag_superclass"),
    "ptbxl_sub": _filtered("label_diag_subclass"),
    "ptbxl_all": _filtered("label_all"),
    "echonext": DatasetSpec(split="split", splits=("train", "val", "test")),
    "zzu_pecg": _filtered("aha_description", 5000),
}
ALIASES = {"code15": "code15_diag"}
NUMERIC_TARGETS = 35
# -----------------------------------------------------------------------------


def dataset_rows(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Rows the dataset rules keep; a missing rule column is an error."""
    needed = [spec.split, "strat_fold" if spec.needs_fold else None, "data_length" if spec.min_length else None, spec.label]
    missing = [c for c in needed if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.where(
        clean.in_cohort(
            spec.split, spec.splits, "strat_fold" if spec.needs_fold else None,
            "data_length" if spec.min_length else None, spec.min_length or 0,
        )
    )


def with_split(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Split by the dataset's own column, else by fold, else one split ``all``."""
    if spec.split is not None and spec.split in df.columns:
        return df.withColumn("_split", F.col(spec.split).cast("string"))
    if "strat_fold" not in df.columns:
        return df.withColumn("_split", F.lit("all"))
    return fold_split(df, "strat_fold", "_split")


def build_pairs(df: DataFrame, spec: DatasetSpec, names: Sequence[str]) -> DataFrame:
    """Probe table: record id, split, joined names and one column per class."""
    rows = with_split(dataset_rows(df, spec), spec)
    present = {f.name: f.dataType.simpleString() for f in rows.schema}
    is_list = rows.schema[spec.label].dataType.typeName() == "array"
    value = F.col(spec.label)
    indices = value.cast("array<int>") if is_list else F.array_compact(F.array(value.cast("int")))
    indices = F.coalesce(indices, F.array().cast("array<int>"))
    return probe_pairs(rows, record_id(present, usable_id(rows)), F.col("_split"), indices, names)


def vocabulary_names(vocab: DataFrame, label_set: str | None) -> list[str]:
    """Class names of one label set in index order; the array layout of the table."""
    rows = vocab if label_set is None else vocab.where(F.col("label_set") == label_set)
    return [r["label"] for r in rows.orderBy("idx").select("label").collect()]


def write_pairs(pairs: DataFrame, root: str, pairs_only: bool = False) -> None:
    """One text file set per split."""
    out = pairs.select("record_id", "split", "label") if pairs_only else pairs
    write_by_split(out, root)


def target_tables(df: DataFrame, names: Sequence[str], record: Column, numeric: int = NUMERIC_TARGETS) -> tuple[DataFrame, DataFrame]:
    """Classification and regression tables of a joint label array.

    Class cells are integers, numeric cells doubles; null is written as empty.
    """
    rows = fold_split(df, "strat_fold", "_split")
    classes, numbers = split_targets(F.col("label_all"), numeric)
    class_names, number_names = list(names[: len(names) - numeric]), list(names[len(names) - numeric :])
    lookup = F.array(*[F.lit(n) for n in class_names])
    positive = F.filter(F.transform(classes, lambda x, i: F.when(x == 1.0, F.get(lookup, i))), lambda x: x.isNotNull())
    head = [record.alias("record_id"), F.col("_split").alias("split")]
    table = rows.select(
        *head, F.array_join(positive, ";").alias("label"),
        *[F.get(classes, F.lit(i)).cast("int").alias(n) for i, n in enumerate(class_names)],
    )
    return table, rows.select(*head, *[F.get(numbers, F.lit(i)).alias(n) for i, n in enumerate(number_names)])
