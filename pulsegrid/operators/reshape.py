"""Row order, unions, sampling and layout changes (W*, O*, R*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.labels import index_names, multi_hot
from pulsegrid.scale import carry, position, running_sum, seeded_hash


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide measures to long rows."""
    return df.unpivot(list(ids), list(values), name, value)


def align_union(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; absent columns are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def remap_union(frames: Sequence[DataFrame], key: str, order: str | None = None) -> DataFrame:
    """Stack datasets; record ids become dense and shifted by rows before.

    As in the source data model the shift is the number of *rows* (samples) of
    the earlier datasets, while ids are dense inside each one, by the
    smallest ``order`` of an id (the id itself without one). A null id is an id.
    """
    parts = []
    shift = F.lit(0).cast("long")
    for frame in frames:
        first = frame.groupBy(key).agg(F.min(order or key).alias("_order"))
        dense = position(first, [], ["_order", key], "_dense").select(F.col(key).alias("_key"), "_dense")
        joined = frame.join(dense, F.col(key).eqNullSafe(F.col("_key")))
        parts.append(joined.withColumn("record_id", F.col("_dense") + shift).drop("_dense", "_key"))
        shift = shift + frame.agg(F.count(F.lit(1))).scalar()
    return align_union(*parts)


def duplicate_flag(df: DataFrame, by: Sequence[str], out: str = "is_duplicate") -> DataFrame:
    """True on every row of a key that occurs more than once."""
    repeated = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*by, F.lit(True).alias(out))
    return df.join(repeated, list(by), "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def first_by(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order, map-side combined."""
    row = F.struct(*df.columns)
    picked = df.groupBy(*by).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


def first_per_patient(df: DataFrame, patient: str, record: str, seed: int) -> DataFrame:
    """One record per patient, the first in a seeded order."""
    return first_by(df, [patient], [seeded_hash(seed, record).alias("h"), F.col(record).alias("r")])


def first_in_stay(df: DataFrame, stay: str, order: Sequence[str], number: str | None = None) -> DataFrame:
    """First record of a stay, by its number column or by order."""
    if number is not None:
        return df.where(F.col(number) == 0)
    return first_by(df, [stay], [F.col(c).alias(f"o{i}") for i, c in enumerate(order)])


def fraction_slice(df: DataFrame, patient: str, order: str, low: float, high: float, labelled: Column) -> DataFrame:
    """Rows of patients ``[low*n, high*n)`` in first-seen order.

    Unlabelled rows are sliced the same way by their own row order.
    """
    seen = df.groupBy(patient).agg(F.min(order).alias("_seen"))
    ranked = position(seen, [], ["_seen", patient], "_rank")
    n = seen.agg(F.count(F.lit(1))).scalar()

    def inside(rank: Column, size: Column) -> Column:
        lo, hi = (F.floor(F.lit(float(x)) * size) for x in (low, high))
        return (rank >= lo) & (rank < hi)

    chosen = ranked.where(inside(F.col("_rank"), n)).select(patient)
    kept = df.where(labelled).join(chosen, patient, "left_semi")
    rest = df.where(~labelled)
    m = rest.agg(F.count(F.lit(1))).scalar()
    # Only the order column is ranked; its two limits then filter the rows.
    span = position(rest.select(order), [], [order], "_rank").where(inside(F.col("_rank"), m))
    limits = rest.withColumn("_span", span.agg(F.struct(F.min(order).alias("lo"), F.max(order).alias("hi"))).scalar())
    others = limits.where(F.col(order).between(F.col("_span.lo"), F.col("_span.hi"))).drop("_span")
    return align_union(kept, others)


def sample_exact(df: DataFrame, n: int, record: str, seed: int) -> DataFrame:
    """O2: exactly ``n`` rows (or all) without replacement, in any cluster.

    The rows with the smallest hashes are taken. Counts per hash prefix (at
    most 65,536) show where the sample ends; only rows of that one prefix are
    ranked, all others pass a plain filter.
    """
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn("_h", seeded_hash(seed, record)).withColumn("_p", F.shiftright("_h", 44))
    sizes = hashed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    cut_row = (
        sizes.withColumn("_upto", F.sum("_n").over(upto))
        .where(F.col("_upto") >= n)
        .agg(F.min_by(F.struct("_p", (F.lit(n) - F.col("_upto") + F.col("_n")).alias("left")), "_p"))
        .first()[0]
    )
    if cut_row is None:
        return df
    inside = hashed.where(F.col("_p") < cut_row["_p"])
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_h", record))
    edge = hashed.where(F.col("_p") == cut_row["_p"]).withColumn("_r", rank).where(F.col("_r") <= cut_row["left"])
    return inside.unionByName(edge.drop("_r")).drop("_h", "_p")


def ordered(df: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """O1: global sort on several keys."""
    return df.orderBy(*columns)


def gap_fill(
    sig: DataFrame,
    by: Sequence[str] = ("record_id", "channel"),
    t: str = "t",
    value: str = "value",
    clip: float = 0.0,
    block: int = 65536,
) -> DataFrame:
    """Linear fill between known samples.

    A leading gap stays null and a trailing gap repeats the last value; a
    positive ``clip`` bounds the result. A long record is worked in blocks.
    """
    place = F.floor(F.col(t) / F.lit(block)).cast("long")
    known = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    both = carry(sig, by, place, [t], last={"_prev": known}, following={"_next": known})
    prev, nxt = F.col("_prev"), F.col("_next")
    share = (F.col(t) - prev["t"]) / (nxt["t"] - prev["t"])
    filled = (
        F.when(prev.isNull(), F.lit(None))
        .when(nxt.isNull() | (nxt["t"] == prev["t"]), prev["v"])
        .otherwise(prev["v"] + (nxt["v"] - prev["v"]) * share)
    )
    if clip > 0:
        # Comparing a null must stay null: greatest/least skip nulls.
        filled = F.when(filled.isNotNull(), F.least(F.greatest(filled, F.lit(-float(clip))), F.lit(float(clip))))
    return both.withColumn(value, filled).drop("_prev", "_next")


def sampling_weights(
    chunks: DataFrame, label: str, class_weights: dict | None = None, total_by: str | None = None
) -> DataFrame:
    """Class weight times the share of the class (or group) duration.

    ``total_by`` names the one column whose total duration divides the chunk
    length; the smallest weight becomes one.
    """
    weight = F.lit(1.0)
    if class_weights:
        pairs = [F.lit(x) for k, v in class_weights.items() for x in (k, float(v))]
        weight = F.create_map(*pairs)[F.col(label)]
    out = chunks.withColumn("weight", weight)
    length = F.col("end_idx") - F.col("start_idx")
    if total_by is not None:
        totals = chunks.groupBy(total_by).agg(F.sum(length).alias("_total"))
        out = out.join(totals, total_by).withColumn("weight", length / F.col("_total") * F.col("weight")).drop("_total")
    smallest = out.agg(F.min("weight")).scalar()
    return out.withColumn("weight", F.col("weight") / smallest)


def start_offsets(df: DataFrame, by: Sequence[str], order: Sequence[str], length: str, out: str = "start") -> DataFrame:
    """Exclusive running sum of lengths."""
    return running_sum(df, by, order, {out: F.col(length).cast("long")})


def probe_pairs(
    df: DataFrame, record: Column, split: Column, indices: Column, names: Sequence[str], label: str = "label"
) -> DataFrame:
    """Id, split, joined names and one 0/1 column per class."""
    base = df.select(
        record.alias("record_id"),
        split.alias("split"),
        index_names(indices, names).alias(label),
        multi_hot(indices, len(names)).alias("_hot"),
    )
    return base.select("record_id", "split", label, *[F.col("_hot")[i].alias(n) for i, n in enumerate(names)])
