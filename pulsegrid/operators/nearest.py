"""Nearest-in-time join (J6, W3) without pairing every anchor with every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.clean import to_micros

HOUR = 3_600_000_000
DAY = 24 * HOUR


def _neighbours(points: DataFrame, probes: DataFrame, width: int) -> DataFrame:
    """Last point at or before and first point at or after each probe.

    ``points``: key, name, at, value; ``probes``: key, name, at, plus payload
    ``anchor``. Only points less than ``width`` away are certain to be found.
    Time is cut into buckets of ``width``; a probe visits its own bucket and
    the two beside it, so a busy subject is spread over its buckets and every
    row is sorted once instead of being matched with all others.
    """
    slot = F.floor(F.col("at") / F.lit(width)).cast("long")
    left = points.select("key", "name", "at", "value", slot.alias("slot"), F.lit(0).alias("kind"))
    visits = F.explode(F.sequence(slot - 1, slot + 1))
    right = probes.select("key", "name", "at", "anchor", visits.alias("slot"), F.lit(1).alias("kind"))
    both = left.unionByName(right, allowMissingColumns=True)
    lane = Window.partitionBy("key", "name", "slot")
    grow = (Window.unboundedPreceding, 0)
    # Equal times: the smallest value must be the last one seen in each sort.
    up = lane.orderBy("at", "kind", F.col("value").desc_nulls_last()).rowsBetween(*grow)
    down = lane.orderBy(F.col("at").desc(), "kind", F.col("value").desc_nulls_last()).rowsBetween(*grow)
    point = F.when(F.col("kind") == 0, F.struct("at", "value"))
    return (
        both.withColumn("before", F.last(point, ignorenulls=True).over(up))
        .withColumn("after", F.last(point, ignorenulls=True).over(down))
        .where("kind = 1")
    )


def nearest_long(
    anchors: DataFrame,
    points: DataFrame,
    names: Sequence[str],
    tolerance_micros: int,
    subject: str = "subject_id",
    anchor_time: str = "anchor_time",
    name: str = "name",
    time: str = "time",
    value: str = "value",
    whole_days: bool = False,
) -> DataFrame:
    """For each (subject, anchor time, name) the closest row in time.

    Exact mode keeps ``|difference| <= tolerance`` and breaks ties by earlier
    time, then smaller value. With ``whole_days`` differences are floored to
    days before they are compared, so the earliest row of the closest day wins.
    Result: subject, anchor time, name, time_diff (micros or days), value.
    """
    marks = (
        anchors.where(F.col(subject).isNotNull() & F.col(anchor_time).isNotNull())
        .select(F.col(subject).alias("key"), F.col(anchor_time).alias("anchor"))
        .distinct()
    )
    probes = marks.select(
        "key",
        F.explode(F.array(*[F.lit(n) for n in names])).alias("name"),
        to_micros("anchor").alias("at"),
        "anchor",
    )
    rows = points.where(
        F.col(name).isin(*names) & F.col(value).isNotNull() & F.col(time).isNotNull()
    ).select(
        F.col(subject).alias("key"),
        F.col(name).alias("name"),
        to_micros(time).alias("at"),
        F.col(value).cast("double").alias("value"),
    )
    limit = tolerance_micros + DAY - 1 if whole_days else tolerance_micros
    near = _neighbours(rows, probes, limit + 1)

    def gap(side: str) -> Column:
        return F.abs(F.col(f"{side}.at") - F.col("at"))

    def candidate(side: str) -> Column:
        return F.when(
            gap(side) <= limit,
            F.struct(gap(side).alias("gap"), F.col(f"{side}.at").alias("at"), F.col(f"{side}.value").alias("value")),
        )

    best = near.groupBy("key", "anchor", "name").agg(
        F.min(F.least(candidate("before"), candidate("after"))).alias("best"),
        F.min(candidate("before")).alias("back"),
        F.min(candidate("after")).alias("fore"),
    )
    best = best.where("best is not null")
    if not whole_days:
        return best.select(
            F.col("key").alias(subject),
            F.col("anchor").alias(anchor_time),
            F.col("name").alias("name"),
            F.col("best.gap").alias("time_diff"),
            F.col("best.value").alias("value"),
        )

    # The earliest row whose floored difference equals the best one: behind
    # the anchor it is the first row after (days + 1) days before it.
    days = F.floor(F.col("best.gap") / DAY).cast("long")
    best = best.withColumn("days", days)
    behind = F.floor(F.col("back.gap") / DAY) == F.col("days")
    edge = best.where(behind).select(
        "key",
        "name",
        (to_micros("anchor") - (F.col("days") + 1) * DAY + 1).alias("at"),
        F.struct("anchor", "days").alias("anchor"),
    )
    earliest = (
        _neighbours(rows, edge, limit + 1)
        .groupBy("key", "name", "anchor")
        .agg(F.min("after").alias("pick"))
        .select("key", "name", "anchor.anchor", "anchor.days", F.col("pick.value").alias("value"))
    )
    ahead = best.where(~F.coalesce(behind, F.lit(False))).select(
        "key", "name", "anchor", "days", F.col("fore.value").alias("value")
    )
    return earliest.unionByName(ahead).select(
        F.col("key").alias(subject),
        F.col("anchor").alias(anchor_time),
        "name",
        F.col("days").alias("time_diff"),
        "value",
    )


def pivot_names(
    long: DataFrame, keys: Sequence[str], names: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """R2: one column per listed name, mean over duplicates.

    Conditional means in one aggregation: the rows are shuffled once.
    """
    cells = [F.avg(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    return long.where(F.col(name).isin(*names)).groupBy(*keys).agg(*cells)


def nearest_wide(base: DataFrame, wide: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Attach wide feature tables to the base rows on subject and time."""
    out = base
    for features in wide:
        out = out.join(features, list(keys), "left")
    return out
