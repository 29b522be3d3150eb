"""Running sums, ranks and fills that never put one group into one task.

A plain ``Window`` sends all rows of a partition key to one task. The helpers
here split every key into *slices*: a slice is worked by one task, slice totals
(a few rows per key) are scanned, and the offsets are joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.session import cut

SLICE = "_slice"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def same_slice(rows: DataFrame, slices: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join values of a slice to its rows; a null key is a group like any other."""
    names = {k: f"_at_{i}" for i, k in enumerate([*by, SLICE])}
    right = slices.withColumnsRenamed(names)
    condition = F.lit(True)
    for k, other in names.items():
        condition = condition & rows[k].eqNullSafe(right[other])
    return rows.join(right, condition).drop(*names.values())


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    sums: Mapping[str, Column],
    inclusive: bool = False,
    slice_by: Column | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add running sums per ``by`` group in ``order``.

    With ``totals`` each sum also gets a ``<name>_total`` column for its group,
    taken from the slice totals, so the input is not read again.

    ``slice_by`` is an integer expression that never decreases along ``order``
    (a day number, a block of a position); it is evaluated in place. Without
    it the rows are range-partitioned on ``by + order`` and the layout is
    checkpointed, so totals and rows agree even after a lost executor. Rows
    with a null key form a group of their own.
    """
    by = list(by)
    weights = {f"_w_{out}": w for out, w in sums.items()}
    work = df.withColumns(weights)
    keys = [F.col(k) for k in by]
    order = [_col(c) for c in order]
    if slice_by is None:
        # No fixed number: adaptive execution sizes the slices by their bytes.
        work = cut(work.repartitionByRange(*keys, *order).withColumn(SLICE, F.spark_partition_id()))
    else:
        work = work.withColumn(SLICE, slice_by)

    # A constant key stands in for "one group"; only slice totals reach it.
    one = "_one"
    grouped = by or [one]
    if not by:
        work = work.withColumn(one, F.lit(0))
    parts = work.groupBy(*grouped, SLICE).agg(*[F.sum(w).alias(w) for w in weights])
    before = Window.partitionBy(*grouped).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    extra = []
    if totals:
        whole = Window.partitionBy(*grouped).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        extra = [F.sum(w).over(whole).alias(f"_t{w}") for w in weights]
    offsets = parts.select(
        *grouped, SLICE, *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"_o{w}") for w in weights], *extra
    )
    inner = (
        Window.partitionBy(*grouped, SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = work.withColumns({f"_l{w}": F.coalesce(F.sum(w).over(inner), F.lit(0)) for w in weights})
    joined = same_slice(local, offsets, grouped)
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_w_{out}") + F.col(f"_o_w_{out}")).alias(out) for out in sums],
        *([F.col(f"_t_w_{out}").alias(f"{out}_total") for out in sums] if totals else []),
    )


def position(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    out: str = "pos",
    slice_by: Column | None = None,
) -> DataFrame:
    """Zero-based rank of each row inside its group."""
    return running_sum(df, by, order, {out: F.lit(1).cast("long")}, slice_by=slice_by)


def carry(
    df: DataFrame,
    by: Sequence[str],
    slice_by: Column,
    order: Sequence[str | Column],
    last: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Last non-null value at or before a row, first one at or after it, or both.

    ``slice_by`` must not decrease along ``order`` (given ascending). Looking
    ahead uses a descending sort, so every frame only grows; both directions
    share one shuffle and one join of slice ends.
    """
    grouped = list(by) or ["_one"]
    wanted = [(o, v, False) for o, v in (last or {}).items()] + [(o, v, True) for o, v in (following or {}).items()]
    work = df.withColumn(SLICE, slice_by).withColumns({f"_v_{o}": v for o, v, _ in wanted})
    if not by:
        work = work.withColumn("_one", F.lit(0))
    grow = (Window.unboundedPreceding, 0)
    lane = Window.partitionBy(*grouped, SLICE)
    inner = {
        False: lane.orderBy(*[_col(c).asc() for c in order]).rowsBetween(*grow),
        True: lane.orderBy(*[_col(c).desc() for c in order]).rowsBetween(*grow),
    }
    local = work
    for ahead in (False, True):
        cells = {f"_l_{o}": F.last(f"_v_{o}", ignorenulls=True).over(inner[ahead]) for o, _, d in wanted if d == ahead}
        local = local.withColumns(cells) if cells else local

    key = F.struct(*[_col(c) for c in order])
    ends = work.groupBy(*grouped, SLICE).agg(
        *[
            (F.min_by if ahead else F.max_by)(F.col(f"_v_{o}"), F.when(F.col(f"_v_{o}").isNotNull(), key)).alias(f"_e_{o}")
            for o, _, ahead in wanted
        ]
    )
    edge = (Window.unboundedPreceding, -1)
    outer = {
        False: Window.partitionBy(*grouped).orderBy(F.col(SLICE).asc()).rowsBetween(*edge),
        True: Window.partitionBy(*grouped).orderBy(F.col(SLICE).desc()).rowsBetween(*edge),
    }
    ends = ends.select(
        *grouped, SLICE, *[F.last(f"_e_{o}", ignorenulls=True).over(outer[ahead]).alias(f"_c_{o}") for o, _, ahead in wanted]
    )
    joined = same_slice(local, ends, grouped)
    return joined.select(*df.columns, *[F.coalesce(f"_l_{o}", f"_c_{o}").alias(o) for o, _, _ in wanted])


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per group, exact for groups of any size.

    Equal values are merged first; the two neighbours of each quantile are
    found from running counts instead of holding a group in memory.
    """
    by = list(by)
    counts = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*by, F.col(value).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_sum(counts, by, ["_x"], {"_before": F.col("_n")}, totals=True)
    ranked = ranked.withColumnRenamed("_before_total", "_size")
    aggs = []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("_size") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
            aggs.append(F.max(F.when(inside, F.col("_x"))).alias(f"_{name}_{side}"))
    found = ranked.groupBy(*by).agg(F.max("_size").alias("_size"), *aggs)
    out = []
    for name, q in quantiles.items():
        at = F.lit(float(q)) * (F.col("_size") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.select(*by, *out)


def seeded_hash(seed: int, *cols: str | Column) -> Column:
    """60-bit number, never negative, of the columns as text under a seed; a stable random order.

    It is the head of an MD5 digest, so any other engine can draw the same.
    """
    parts = [F.coalesce(_col(c).cast("string"), F.lit("\\N")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(int(seed))), *parts)), 1, 15), 16, 10).cast("bigint")


def fast_hash(seed: int, *cols: str | Column) -> Column:
    """64-bit hash for draws in bulk, where only their distribution counts."""
    return F.xxhash64(*[_col(c) for c in cols], F.lit(int(seed)).cast("long"))


def unit_interval(hashed: Column) -> Column:
    """Map a hash to [0, 1) by its last 52 bits."""
    return F.pmod(hashed, F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
