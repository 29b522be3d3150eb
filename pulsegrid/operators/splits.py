"""Stratified, group-aware and provided splits."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from pulsegrid.functions.clean import age_twenty_name
from pulsegrid.operators.aggregates import group_label_counts
from pulsegrid.operators.joins import attach_split, flag_lookup
from pulsegrid.operators.reshape import align_union, duplicate_flag, first_per_patient, sample_exact
from pulsegrid.scale import position, seeded_hash, unit_interval
from pulsegrid.session import cut, small_rows

# --- fixed values -----------------------------------------------------------
GOLDEN = 0.6180339887498949
SPLIT_FOLDS = {"train": 0, "val": 8, "valid": 8, "validation": 8, "test": 9}
UNLABELLED_FOLD = -1
UNASSIGNED_FOLD = -2
# -----------------------------------------------------------------------------
HEAVY = 16
HALVES = 3
RESERVE = 4_000
SWEEPS = 20
PARTNERS = 16
CLOSE = 0.03
MAX_LABELS = 100_000


def _check_ratios(ratios: Sequence[float]) -> None:
    if not ratios or min(ratios) < 0 or abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("ratios must be non-negative and sum to one")


def water_fill(need: np.ndarray, ratios: np.ndarray, amount: float) -> np.ndarray:
    """Shares of ``amount`` per subset that leave what is still needed in the ratio of the subsets.

    Subset i gets need[i] - level * ratios[i], never less than nothing; the
    level is the one at which the parts add up to ``amount``.
    """
    use = ratios > 0
    if amount <= 0 or not use.any():
        return ratios / ratios.sum()
    per = np.where(use, need / np.where(use, ratios, 1.0), -np.inf)
    order = np.argsort(-per, kind="stable")
    order = order[use[order]]
    sums, widths = np.cumsum(need[order]), np.cumsum(ratios[order])
    levels = (sums - amount) / widths
    last = np.flatnonzero(per[order] > levels)[-1]  # the first subset always lies above its own level
    parts = np.where(use, np.maximum(need - levels[last] * ratios, 0.0), 0.0)
    return parts / parts.sum()


def place_heavy(rows: Sequence[tuple], totals: dict, need: dict, seed: int) -> dict:
    """Subset of every group of ``rows`` (group, label, n); ``need`` goes down by what is placed.

    The groups that hold most of some label come first, so those of rare
    labels and those of many rows. A group goes where its labels are needed
    most, each counted by its share of the label, so that the squared
    shortfall of all labels is least afterwards; equal subsets are drawn from.
    Then groups move, or change places with one of ``PARTNERS`` drawn others
    while a label is off by more than ``CLOSE`` of its rows, as long as that
    lowers the shortfall, ``SWEEPS`` times over all of them at most.
    """
    groups = defaultdict(dict)
    for group, label, n in rows:
        groups[group][label] = n
    rng, placed = np.random.default_rng(seed), {}
    part = {g: max(n / totals[label] for label, n in held.items()) for g, held in groups.items()}
    for group in sorted(groups, key=lambda g: (-part[g], str(g))):
        held = groups[group]
        pull = sum(n * need[label] / totals[label] ** 2 for label, n in held.items())
        best = np.flatnonzero(pull >= pull.max() - 1e-12)
        subset = int(best[rng.integers(len(best))])
        placed[group] = subset
        for label, n in held.items():
            need[label][subset] -= n
    everyone = sorted(groups, key=str)

    def shift(held: dict, at: int, to: int) -> None:
        for label, n in held.items():
            need[label][at] += n
            need[label][to] -= n

    for _ in range(SWEEPS):
        moved = False
        for group in everyone:
            held, at = groups[group], placed[group]
            gain = sum(n * (need[label] - need[label][at] - n) / totals[label] ** 2 for label, n in held.items())
            gain[at] = 0.0
            to = int(gain.argmax())
            if gain[to] > 1e-12:
                moved, placed[group] = True, to
                shift(held, at, to)
                continue
            if all(np.abs(need[label]).max() <= max(CLOSE * totals[label], 1.0) for label in held):
                continue
            for other in (everyone[i] for i in rng.integers(len(everyone), size=PARTNERS)):
                if (to := placed[other]) == at:
                    continue
                change = defaultdict(int, held)
                for label, n in groups[other].items():
                    change[label] -= n
                if sum(n * (need[label][to] - need[label][at] - n) / totals[label] ** 2 for label, n in change.items()) > 1e-12:
                    moved, placed[group], placed[other] = True, to, at
                    shift(change, at, to)
                    break
        if not moved:
            break
    return placed


def stratify(counts: DataFrame, group: str, ratios: Sequence[float], seed: int, buckets: int = 1) -> DataFrame:
    """K1-K3: (group, subset) for the groups of ``counts(group, label, n)``.

    A table of what every label still needs in every subset is kept, with one
    row per label. First come heavy groups, those with more than one part in
    ``HEAVY`` of what a subset needs of some label; they are placed one by
    one, and no label has more than ``HEAVY`` of them per subset. All other
    groups join the stratum of their rarest label and are placed in batches
    by a hash. In a batch, each stratum is dealt over the subsets so that its
    label's remaining need becomes proportional again; it is walked by falling
    weight on a golden-ratio sequence, in slices, so every prefix is dealt
    alike. What a batch placed of all labels is taken off the needs before
    the next, so totals are carried from batch to batch and the smaller ones
    settle what secondary labels have moved. ``buckets`` is the number of
    equal batches; the last one is halved ``HALVES`` times. A reserve of about
    ``RESERVE`` groups, drawn by a hash, is kept back and placed one by one at the
    end like heavy groups, which settles what is left.

    More than ``MAX_LABELS`` labels are an error. Groups without labels are
    not in ``counts``; a null group is placed like any other.
    """
    _check_ratios(ratios)
    spark, k = counts.sparkSession, len(ratios)
    shares = np.array(ratios, dtype=float)
    counts = cut(counts.where(F.col("n") > 0))
    totals = counts.groupBy("label").agg(F.sum("n").alias("_total"))
    found = {r["label"]: r["_total"] for r in small_rows(totals, MAX_LABELS)}
    need = {label: shares * n for label, n in found.items()}

    unit = unit_interval(seeded_hash(seed + 7, group))
    last = F.lit(float(buckets)) * unit - (buckets - 1)
    halved = F.least(F.floor(-F.log2(F.greatest(1.0 - last, F.lit(2.0**-40)))), F.lit(HALVES))
    batch = F.when(last < 0, F.floor(unit * buckets)).otherwise(buckets - 1 + halved).cast("int")
    per_group = (
        counts.join(F.broadcast(totals.withColumnRenamed("label", "_label")), F.col("label").eqNullSafe(F.col("_label")))
        .groupBy(group)
        .agg(
            F.min_by(F.struct("label", "n"), F.struct("_total", "label")).alias("_pick"),
            F.bool_or(F.col("n") * (HEAVY * k) > F.col("_total")).alias("_heavy"),
            F.collect_list(F.struct("label", "n")).alias("_held"),  # at most one cell per label
        )
        .select(group, F.col("_pick.label").alias("_stratum"), (-F.col("_pick.n")).alias("_weight"), "_heavy", "_held", batch.alias("_batch"))
    )
    per_group = cut(per_group)
    heavy = per_group.where("_heavy").select(group, F.explode("_held").alias("_c")).select(group, "_c.label", "_c.n")
    placed = place_heavy([tuple(r) for r in small_rows(heavy, HEAVY * k * len(found) ** 2)], found, need, seed)
    kind = counts.schema[group].dataType
    fields = StructType([StructField(group, kind), StructField("subset", IntegerType())])
    done = [spark.createDataFrame(list(placed.items()), fields)]

    light = per_group.where("not _heavy").withColumn("_hash", seeded_hash(seed, group))
    kept_back = unit_interval(seeded_hash(seed + 9, group)) < min(1.0, RESERVE / max(light.count(), 1))
    reserve = light.where(kept_back).select(group, F.explode("_held").alias("_c")).select(group, "_c.label", "_c.n")
    light = light.where(~kept_back)
    walked = cut(position(light, ["_batch", "_stratum"], ["_weight", "_hash", group], "_pos"))
    turn = unit_interval(seeded_hash(seed + 1, "_batch", "_stratum"))
    at = F.col("_pos") * F.lit(GOLDEN) + turn
    walked = walked.select(group, "_stratum", "_batch", "_held", (-F.col("_weight")).alias("_weight"), (at - F.floor(at)).alias("_at"))
    amounts = defaultdict(dict)
    for r in small_rows(walked.groupBy("_batch", "_stratum").agg(F.sum("_weight").alias("n")), (buckets + HALVES) * len(found)):
        amounts[r["_batch"]][r["_stratum"]] = r["n"]
    label_type = counts.schema["label"].dataType
    edge_type = StructType([StructField("_label", label_type), StructField("_edges", ArrayType(DoubleType()))])
    for b in sorted(amounts):  # none if all light groups are in the reserve
        edges = [
            (label, [float(x) for x in np.cumsum(water_fill(need[label], shares, n))[:-1]]) for label, n in amounts[b].items()
        ]
        table = F.broadcast(spark.createDataFrame(edges, edge_type))  # at most MAX_LABELS rows
        rows = walked.where(F.col("_batch") == b)
        subset = F.size(F.filter("_edges", lambda e: e <= F.col("_at")))
        dealt = rows.join(table, F.col("_stratum").eqNullSafe(F.col("_label"))).select(group, subset.alias("subset"), "_held")
        done.append(dealt.drop("_held"))
        cells = dealt.select("subset", F.explode("_held").alias("_c")).groupBy("_c.label", "subset").agg(F.sum("_c.n").alias("n"))
        for r in small_rows(cells, k * len(found)):
            need[r["label"]][r["subset"]] -= r["n"]
    last = place_heavy([tuple(r) for r in small_rows(reserve, 2 * RESERVE * len(found))], found, need, seed + 1)
    done.append(spark.createDataFrame(list(last.items()), fields))
    return reduce(DataFrame.union, done)


def stratified_folds(
    df: DataFrame, record: str, labels: str, ratios: Sequence[float], seed: int,
    group: str | None = None, out: str = "strat_fold", buckets: int = 1,
) -> DataFrame:
    """K1-K3: add a fold; rows of a group share it, unlabelled groups get -1."""
    key = group or record
    counts, _ = group_label_counts(df, key, labels)
    folds = stratify(counts, key, ratios, seed, buckets).withColumnRenamed("subset", out)
    folds = folds.withColumnRenamed(key, "_key")
    joined = df.join(folds, df[key].eqNullSafe(folds["_key"]), "left").drop("_key")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(UNLABELLED_FOLD)))


def strata_labels(labels: Column, sex: Column, age: Column, race: Column | None = None) -> Column:
    """K4: labels extended by demographic strings."""
    extra = [F.concat(F.lit("sex_"), F.coalesce(sex, F.lit("Unknown"))), age]
    if race is not None:
        extra.insert(1, F.concat(F.lit("race_"), F.coalesce(race, F.lit("Unavailable"))))
    return F.concat(labels.cast("array<string>"), F.array_compact(F.array(*extra)))


def stratified_subset(
    df: DataFrame, ratio: float, record: str, patient: str, labels: str, sex: str, age: str, seed: int
) -> DataFrame:
    """K5: one record per patient, then a stratified share ``ratio`` of them."""
    single = first_per_patient(df, patient, record, seed)
    strata = strata_labels(F.col(labels), F.col(sex), age_twenty_name(age))
    marked = stratified_folds(
        single.withColumn("_strata", strata), record, "_strata", [ratio, 1.0 - ratio], seed, out="_subset"
    )
    return marked.where("_subset = 0").drop("_subset", "_strata")


def label_efficiency(
    df: DataFrame, ratio: float, record: str, patient: str, labels: str, sex: str, age: str, seed: int,
    split: str = "split",
) -> DataFrame:
    """K5: reduced train and validation splits, test untouched."""
    reduced = [
        stratified_subset(df.where(F.col(split) == s), ratio, record, patient, labels, sex, age, seed)
        for s in ("train", "val")
    ]
    return align_union(*reduced, df.where(F.col(split) == "test"))


def patient_kfold(df: DataFrame, patient: str, k: int, seed: int, out: str = "strat_fold") -> DataFrame:
    """K6: near-equal random groups of patients."""
    patients = df.select(patient).distinct().withColumn("_h", seeded_hash(seed, patient))
    ranked = position(patients, [], ["_h", patient], "_rank")
    size = patients.agg(F.count(F.lit(1))).scalar()
    folds = ranked.select(patient, F.floor(F.col("_rank") * k / size).cast("int").alias(out))
    return df.join(folds, patient)


def fold_split(df: DataFrame, fold: str, out: str = "split") -> DataFrame:
    """K7: last fold is test, the one before is validation, the rest is training."""
    top = df.agg(F.max(fold)).scalar()
    name = F.when(F.col(fold) == top, "test").when(F.col(fold) == top - 1, "val").otherwise("train")
    return df.withColumn(out, name)


def provided_split_fold(
    df: DataFrame, split: str, labels: str, train_fold: Column, folds: int = 10, out: str = "strat_fold"
) -> DataFrame:
    """K8: named splits to folds, in order of precedence.

    Training rows take ``train_fold`` (patients' fold among the first
    ``folds - 2``) even without labels; other rows without labels are -1;
    validation and test take the last two folds; anything else is -2. Only
    training rows are overwritten by a patient's fold.
    """
    name = F.col(split)
    fold = (
        F.when((name == "train") & train_fold.isNotNull(), train_fold)
        .when(F.size(labels) == 0, UNLABELLED_FOLD)
        .when(name == "val", folds - 2)
        .when(name == "test", folds - 1)
        .otherwise(UNASSIGNED_FOLD)
    )
    return df.withColumn(out, fold.cast("int"))


def split_leaks(df: DataFrame, patient: str, split: str) -> DataFrame:
    """Patients that occur in more than one split."""
    return df.groupBy(patient).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def holdout_repeats(df: DataFrame, record: str, patient: str, share: float, seed: int, out: str = "orig_fold") -> DataFrame:
    """K9: every record of a repeated patient is test, filled to ``share`` of all rows."""
    flagged = duplicate_flag(df, [patient], "_multi")
    sizes = flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if("_multi").alias("m")).first()
    fill = max(int(sizes["n"] * share) - sizes["m"], 0)
    extra = sample_exact(flagged.where("not _multi").select(record), fill, record, seed)
    marked = flag_lookup(flagged, extra, [record], "_extra")
    return marked.withColumn(out, (F.col("_multi") | (F.col("_extra") == 1)).cast("int")).drop("_multi", "_extra")


def fixed_split(df: DataFrame, path: str, key: str, make, subset: str = "subset") -> DataFrame:
    """Reuse a saved split, else build it with ``make(df)`` and save it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    if not found:
        make(df).select(key, subset).write.csv(path, header=False)
    kind = df.schema[key].dataType.simpleString()
    saved = spark.read.schema(f"`{key}` {kind}, `{subset}` int").csv(path, header=False)
    return attach_split(df, saved, key, subset)
