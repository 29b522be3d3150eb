"""Scans and record catalogues."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.joins import drop_known, flag_lookup, keep_known
from pulsegrid.operators.reshape import align_union, sample_exact
from pulsegrid.operators.splits import SPLIT_FOLDS
from pulsegrid.scale import position


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text (also gzip) under a fixed schema, quotes respected."""
    return spark.read.schema(schema).csv(path, sep=sep, header=header, escape='"', multiLine=False)


def read_members(spark: SparkSession, path: str, columns: int = 1, key_type: str = "string") -> DataFrame:
    """Headerless split file, ids only or id and subset."""
    names = [f"name {key_type}", "subset int"][:columns]
    return spark.read.schema(", ".join(names)).csv(path, header=False)


def frequent_rows(
    events: DataFrame, items: DataFrame, subjects: DataFrame, min_count: int = 1000,
    drop: Sequence[str] = ("Safety Measures",), item: str = "itemid", label: str = "label", subject: str = "subject_id",
) -> DataFrame:
    """S3: rows of known subjects whose label is frequent.

    Both passes over the event table are in one plan: the label counts are a
    small aggregate joined back as a semi join. A row without an item label
    has no count and drops out.
    """
    named = keep_known(events, subjects.select(subject).distinct(), [subject]).join(
        items.select(item, label), item, "left"
    )
    named = named.where(~F.col(label).isin(*drop)) if drop else named.where(F.col(label).isNotNull())
    frequent = named.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    return keep_known(named, frequent, [label])


def infer_split(name: Column) -> Column:
    """Split from a file stem; ``valid`` is tested before ``val``."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(name, "([^/]+)$", 1), r"\.[^.]*$", ""))
    return (
        F.when(stem.contains("train"), "train")
        .when(stem.contains("valid"), "valid")
        .when(stem.contains("val"), "val")
        .when(stem.contains("test"), "test")
        .otherwise(stem)
    )


def load_splits(
    frames: Mapping[str, DataFrame], required: Sequence[str], split_folds: Mapping[str, int] = SPLIT_FOLDS,
    limit: int | None = None, key: str = "NAME", seed: int = 42,
) -> DataFrame:
    """Stack split tables after a column check; an unknown split is fold 0.

    ``limit`` is the optional seeded sample size per split.
    """
    parts = []
    for split, frame in frames.items():
        missing = sorted(set(required) - set(frame.columns))
        if missing:
            raise ValueError(f"{split} lacks the columns {missing}")
        if limit is not None:
            frame = sample_exact(frame, limit, key, seed)
        parts.append(
            frame.withColumns({"split": F.lit(split), "strat_fold": F.lit(split_folds.get(split, 0))})
        )
    return align_union(*parts)


def record_catalogue(spark: SparkSession, root: str, suffix: str = ".hea") -> DataFrame:
    """Path, size and derived ids of all files below ``root`` with a suffix.

    Only file status is read, never content.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .load(root)
        .select("path", "length")
    )
    parts = F.split("path", "/")
    return files.select(
        "path", "length",
        path_stem(F.col("path")).alias("record_name"),
        F.try_element_at(parts, F.lit(-2)).alias("folder"),
        F.regexp_extract(F.try_element_at(parts, F.lit(-2)), r"(\d+)$", 1).try_cast("long").alias("folder_id"),
    )


# --- fixed values -----------------------------------------------------------
WAVEFORM_SUFFIXES = ("hea", "dat")
FOLDER_STEP = 1000
FOLDER_DIGITS = 5
# -----------------------------------------------------------------------------


def path_stem(path: Column) -> Column:
    """File name without folder and last suffix; null gives empty text."""
    name = F.regexp_extract(path.cast("string"), "([^/]*)/*$", 1)
    return F.coalesce(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(""))


def strip_waveform_suffix(path: Column) -> Column:
    """Drop a header or data suffix in any case."""
    return F.regexp_replace(path, r"(?i)\.(" + "|".join(WAVEFORM_SUFFIXES) + ")$", "")


def flat_name(path: Column) -> Column:
    """One output name from a relative or absolute record path."""
    return F.regexp_replace(F.regexp_replace(strip_waveform_suffix(path), "^/+", ""), "/+", "__")


def folder_bucket(record_id: Column) -> Column:
    """Zero-padded folder of a thousand ids."""
    number = F.substring_index(record_id.cast("string"), "_", 1).try_cast("long")
    folder = (F.floor(number / FOLDER_STEP) * FOLDER_STEP).cast("string")
    return F.when(F.length(folder) < FOLDER_DIGITS, F.lpad(folder, FOLDER_DIGITS, "0")).otherwise(folder)


def partition_name(path: Column) -> Column:
    """Second and third path part joined by a dash."""
    return F.concat_ws("-", F.slice(F.split(path, "/"), 2, 2))


# --- fixed values: id columns in order of preference, numeric types ---
ID_COLUMNS = ("ecg_id", "data_original", "data", "filename")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def record_id(candidates: Mapping[str, str], usable: Column | None = None) -> Column:
    """Stem of one id column for the whole table; numeric ``data`` is skipped.

    ``candidates`` maps the present columns to their simple type. ``usable``
    names the column to take (see ``usable_id``); without it the first of
    them is taken.
    """
    known = [c for c in ID_COLUMNS if c in candidates and not (c == "data" and candidates[c] in NUMERIC)]
    if not known:
        raise ValueError(f"none of {ID_COLUMNS} is present")
    if usable is None:
        return path_stem(F.col(known[0]))
    out = F.raise_error(F.lit(f"no id column of {known} is filled in every row"))
    for c in reversed(known):
        out = F.when(usable == c, path_stem(F.col(c))).otherwise(out)
    return out


def usable_id(df: DataFrame) -> Column:
    """Name of the first id column with a usable value in every row, as a scalar subquery."""
    kinds = dict(df.dtypes)
    known = [c for c in ID_COLUMNS if c in kinds and not (c == "data" and kinds[c] in NUMERIC)]
    filled = [F.when(F.count_if(path_stem(F.col(c)) == "") == 0, F.lit(c)) for c in known]
    return df.agg(F.coalesce(*filled, F.lit(None).cast("string")).alias("name")).scalar()


def align_blocks(
    blocks: DataFrame, meta: DataFrame, splits: Sequence[str], order: Sequence[str], meta_order: Sequence[str],
    split: str = "split",
) -> DataFrame:
    """Match block rows to metadata rows by position.

    Blocks are laid out in the given split order, rows inside by ``order``;
    the metadata is numbered by ``meta_order``. Both orders are unique keys
    with names of their own. Rows past the metadata drop.
    """
    known = blocks.where(F.col(split).isin(*splits))
    rank = F.lit(len(splits))
    for i, s in reversed(list(enumerate(splits))):
        rank = F.when(F.col(split) == s, i).otherwise(rank)
    # Rank the keys alone: blocks may carry whole waveforms.
    keys = [split, *order]
    placed = position(known.select(*keys).withColumn("_split_rank", rank), [], ["_split_rank", *order], "meta_idx")
    numbered = position(meta.select(*meta_order), [], list(meta_order), "meta_idx")
    rows = meta.drop(*[c for c in meta.columns if c in blocks.columns and c not in meta_order])
    matched = placed.drop("_split_rank").join(numbered, "meta_idx").join(rows, list(meta_order))
    return matched.join(known, keys)


def pending(tasks: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Tasks without an output yet."""
    return drop_known(tasks, done, key)


def split_failures(
    results: DataFrame, order: Sequence[str], error: str = "error", skip_errors: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Finished rows in input order, and the failure list.

    Without ``skip_errors`` a failed row fails the job.
    """
    failed = results.where(F.col(error).isNotNull())
    if not skip_errors:
        # In a filter, so dropping the column cannot prune the check away.
        clean = F.when(F.col(error).isNull(), True).otherwise(F.raise_error(F.col(error)).cast("boolean"))
        return results.where(clean).drop(error).orderBy(*order), failed
    return results.where(F.col(error).isNull()).drop(error).orderBy(*order), failed


def audit_files(files: DataFrame, check, suffix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run ``check(bytes)`` over whole files; returns counts by error and the quarantine list.

    ``check`` raises for a corrupt file. Files are listed, never deleted.
    """
    if suffix is not None:
        files = files.where(F.col("path").endswith(suffix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds, texts = [], []
            for content in batch["content"]:
                try:
                    check(bytes(content))
                    kinds.append(None)
                    texts.append(None)
                except Exception as problem:  # noqa: BLE001 - every failure is a finding
                    kinds.append(type(problem).__name__)
                    texts.append(str(problem))
            yield pd.DataFrame({"path": batch["path"], "error": kinds, "message": texts})

    checked = files.select("path", "content").mapInPandas(run, "path string, error string, message string")
    counts = checked.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("files"))
    return counts, checked.where("error is not null")


def mark_done(tasks: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Flag tasks whose output exists."""
    return flag_lookup(tasks, done.select(*key).distinct(), key, "done")
