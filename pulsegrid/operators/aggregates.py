"""Grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.scale import exact_quantiles


def group_label_counts(df: DataFrame, group: str, labels: str) -> tuple[DataFrame, DataFrame]:
    """A3: occurrences per (group, label) and rows per group.

    The long form stands for the concatenated label list of a group, so a
    group of any size is combined before the shuffle.
    """
    counts = (
        df.select(group, F.explode(labels).alias("label"))
        .groupBy(group, "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("samples"))
    return counts, sizes


def dominant(df: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """A4: most frequent item per group; a tie goes to the smaller item."""
    counts = df.where(F.col(item).isNotNull()).groupBy(*by, item).agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct(-F.col("n"), F.col(item))
    return counts.groupBy(*by).agg(F.min_by(item, rank).alias(item), F.max("n").alias("n"))


def trim_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    low: float = 0.01,
    high: float = 0.99,
    sequential: bool = False,
) -> DataFrame:
    """A5: keep values inside the group's quantiles, bounds included.

    ``sequential`` cuts the top first and takes the low quantile of what is
    left. Null values drop out, as do the quantile columns.
    """

    def bounded(frame: DataFrame, wanted: dict[str, float]) -> DataFrame:
        limits = exact_quantiles(frame, by, value, wanted)
        out = frame.join(limits, list(by))
        for side in wanted:
            inside = F.col(value) <= F.col(side) if side == "_hi" else F.col(value) >= F.col(side)
            out = out.where(inside)
        return out.drop(*wanted)

    if sequential:
        return bounded(bounded(df, {"_hi": high}), {"_lo": low})
    return bounded(df, {"_lo": low, "_hi": high})


def record_stats(sig: DataFrame, by: Sequence[str] = ("record_id", "channel"), value: str = "value") -> DataFrame:
    """Mean, population std, median, interquartile range and length."""
    plain = sig.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.count(value).alias("length"),
    )
    quartiles = exact_quantiles(sig, by, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return plain.join(quartiles, list(by)).select(
        *by, "mean", "std", "length", "median", (F.col("q75") - F.col("q25")).alias("iqr")
    )


def distinct_labels(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Sorted distinct labels per record."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def dataset_stats_simple(stats: DataFrame, by: Sequence[str] = ("channel",)) -> DataFrame:
    """Mean of the record means and of the record stds."""
    return stats.groupBy(*by).agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def dataset_stats_pooled(stats: DataFrame, by: Sequence[str] = ("channel",)) -> DataFrame:
    """Length-weighted mean and std with the between-record term.

    The second moment is taken around the plain mean of the record means, so
    large offsets do not cancel.
    """
    center = stats.groupBy(*by).agg(F.avg("mean").alias("_c"))
    shifted = stats.join(center, list(by)).withColumn("_d", F.col("mean") - F.col("_c"))
    n = F.sum("length")
    drift = F.sum(F.col("length") * F.col("_d")) / n
    second = F.sum(F.col("length") * (F.col("std") * F.col("std") + F.col("_d") * F.col("_d"))) / n
    return shifted.groupBy(*by).agg(
        (F.max("_c") + drift).alias("mean"),
        F.sqrt(F.greatest(second - drift * drift, F.lit(0.0))).alias("std"),
        n.alias("length"),
    )


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Zero-filled counts of ``column`` values per ``row``."""
    return df.groupBy(row).pivot(column, list(values)).count().fillna(0)


def prevalence(long: DataFrame, by: Sequence[str] = ("label",), target: str = "target") -> DataFrame:
    """A10: positives, valid targets and their ratio; masked targets skipped."""
    return long.groupBy(*by).agg(
        F.sum(target).cast("double").alias("positives"),
        F.count(target).alias("valid"),
        F.avg(target).alias("prevalence"),
    )


def aggregate_predictions(
    pred: DataFrame,
    by: Sequence[str] = ("record_id", "label"),
    score: str = "score",
    target: str | None = "target",
    how: str = "mean",
) -> DataFrame:
    """One score per record and label; differing targets fail the job."""
    combine = {"mean": F.avg, "max": F.max}[how]
    aggs: list[Column] = [combine(score).alias(score)]
    if target is not None:
        agree = (F.count(target) == F.count(F.lit(1))) | (F.count(target) == 0)
        agree = agree & (F.min(target).eqNullSafe(F.max(target)))
        differ = F.raise_error(F.lit("targets of one record differ")).cast("double")
        aggs.append(F.when(agree, F.max(target).cast("double")).otherwise(differ).alias(target))
    return pred.groupBy(*by).agg(*aggs)


def stitch_overlap(chunks: DataFrame, by: Sequence[str], stride: int, chunk: str = "chunk", values: str = "values") -> DataFrame:
    """Place chunk ``i`` at ``i * stride`` and average what overlaps."""
    placed = chunks.select(*by, chunk, F.posexplode(values).alias("offset", "value"))
    at = (F.col(chunk) * F.lit(stride) + F.col("offset")).cast("long")
    return placed.groupBy(*by, at.alias("pos")).agg(F.avg("value").alias("value"))


def duration_by(chunks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Summed chunk lengths per class or group."""
    return chunks.groupBy(*by).agg(F.sum(F.col("end_idx") - F.col("start_idx")).alias("duration"))


def feature_summary(long: DataFrame, by: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """Median, quartiles, range and null count of static features."""
    plain = long.groupBy(*by).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.count_if(F.col(value).isNull()).alias("nulls")
    )
    marks = exact_quantiles(long, by, value, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return plain.join(marks, list(by), "left")


def class_validity(
    df: DataFrame, fold: str, values: str, regression: bool = False, key: str = "place"
) -> DataFrame:
    """Positions of a label array with too few values, per fold.

    Binary positions need two positives and two negatives, numeric ones need
    three values.
    """
    cells = df.select(fold, F.posexplode(values).alias(key, "cell"))
    cell = F.col("cell").cast("double")
    if regression:
        good = F.count_if(cell.isNotNull() & ~F.isnan(cell)) >= 3
    else:
        good = (F.count_if(cell == 1) >= 2) & (F.count_if(cell == 0) >= 2)
    return cells.groupBy(fold, key).agg(good.alias("ok")).where(~F.col("ok")).select(fold, key)


def value_counts(df: DataFrame, column: str, expected: Sequence) -> DataFrame:
    """Row counts for the expected values, zero where absent."""
    kind = df.schema[column].dataType.simpleString()
    cases = F.explode(F.array(*[F.lit(v).cast(kind) for v in expected]))
    listed = df.sparkSession.range(1).select(cases.alias(column))
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counts, column, "left").fillna(0, ["n"])


def distinct_count(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column, exact unless asked otherwise."""
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns])
