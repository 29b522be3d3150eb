"""Signal transforms on the long table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import kernels
from pulsegrid.scale import seeded_hash, unit_interval

# --- fixed values -----------------------------------------------------------
LEADS_BY_SOURCE = (
    "i", "ii", "v1", "v2", "v3", "v4", "v5", "v6", "iii", "avr", "avl", "avf", "vx", "vy", "vz",
)
LEADS_CANONICAL = (
    "i", "ii", "iii", "avr", "avl", "avf", "v1", "v2", "v3", "v4", "v5", "v6", "vx", "vy", "vz",
)
EPSILON = 1e-8
# -----------------------------------------------------------------------------

RECORD = ("record_id", "channel")


def lead_fill(
    sig: DataFrame, leads: Sequence[str] = LEADS_CANONICAL[:12], record: str = "record_id", t: str = "t"
) -> DataFrame:
    """Every listed lead at every step, in canonical order, absent ones 0."""
    name = F.lower("channel")
    cells = [F.coalesce(F.max(F.when(name == lead, F.col("value"))), F.lit(0.0)) for lead in leads]
    steps = sig.groupBy(record, t).agg(F.array(*cells).alias("_cells"))
    return steps.select(record, t, F.posexplode("_cells").alias("channel", "value"))


def select_channels(sig: DataFrame, channels: Sequence) -> DataFrame:
    """Keep listed channels."""
    return sig.where(F.col("channel").isin(*channels))


def zero_trim(sig: DataFrame, record: str = "record_id", t: str = "t", value: str = "value") -> DataFrame:
    """Cut half of the number of all-zero steps from both ends."""
    steps = sig.groupBy(record, t).agg((F.sum(F.abs(value)) == 0).alias("_zero"))
    sizes = steps.groupBy(record).agg(
        F.count(F.lit(1)).alias("_n"), F.floor(F.count_if("_zero") / 2).alias("_cut")
    )
    inside = (F.col(t) >= F.col("_cut")) & (F.col(t) < F.col("_n") - F.col("_cut"))
    return sig.join(sizes, record).where(inside).withColumn(t, F.col(t) - F.col("_cut")).drop("_n", "_cut")


def fill_and_clip(value: str | Column, clip: float | None = None) -> Column:
    """Null and NaN become 0, then the amplitude is always bounded."""
    value = F.col(value) if isinstance(value, str) else value
    filled = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    if clip is None:
        return filled
    return F.least(F.greatest(filled, F.lit(-float(clip))), F.lit(float(clip)))


def normalise_dataset(sig: DataFrame, stats: DataFrame, channels: Sequence | None = None) -> DataFrame:
    """(x - mean) / (std + 1e-8) with stored channel statistics."""
    scaled = (F.col("value") - F.col("mean")) / (F.col("std") + F.lit(EPSILON))
    if channels is not None:
        scaled = F.when(F.col("channel").isin(*channels), scaled).otherwise(F.col("value"))
    joined = sig.join(stats.select("channel", "mean", "std"), "channel", "left")
    return joined.withColumn("value", F.when(F.col("mean").isNull(), F.col("value")).otherwise(scaled)).drop("mean", "std")


def normalise_record(sig: DataFrame, by: Sequence[str] = RECORD, skip: Sequence = ()) -> DataFrame:
    """Scale each channel of a record by its own mean and std.

    Statistics are combined map-side and joined back rather than windowed, so
    a long record does not sit in one task. Channels in ``skip`` stay as is.
    """
    stats = sig.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    scaled = (F.col("value") - F.col("_m")) / (F.col("_s") + F.lit(EPSILON))
    if skip:
        scaled = F.when(F.col("channel").isin(*skip), F.col("value")).otherwise(scaled)
    keys = {k: f"_by_{k}" for k in by}
    right = stats.withColumnsRenamed(keys)
    same = F.lit(True)
    for k, other in keys.items():
        same = same & sig[k].eqNullSafe(right[other])
    return sig.join(right, same).withColumn("value", scaled).drop("_m", "_s", *keys.values())


def fit_apply_scaler(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Standardise with the mean and population std of training rows."""
    fits = F.struct(
        *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(columns)],
    )
    # One struct column: the subquery appears once, however many columns scale.
    fitted = df.withColumn("_fit", df.where(train).agg(fits.alias("fit")).scalar())
    scaled = {}
    for i, c in enumerate(columns):
        std = F.col(f"_fit.s{i}")
        scaled[c] = (F.col(f"`{c}`") - F.col(f"_fit.m{i}")) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    return fitted.withColumns(scaled).drop("_fit")


def resample_linear(
    sig: DataFrame, fs: int, target: int, by: Sequence[str] = RECORD, t: str = "t", value: str = "value"
) -> DataFrame:
    """Linear resampling to ``n * target // fs`` samples.

    Each input sample adds its share to the outputs on both sides of it, so
    there is no neighbour lookup and shares combine map-side. An output that
    needs a null or missing sample is null.
    """
    if fs <= 0 or target <= 0:
        raise ValueError("rates must be positive")
    sizes = sig.groupBy(*by).agg(F.max(t).alias("_last"))
    rows = sig.join(sizes, list(by))
    step, pace = F.lit(fs).cast("long"), F.lit(target).cast("long")
    at = F.col(t).cast("long")

    def first_output(k: Column) -> Column:
        return F.floor((k * pace + step - 1) / step).cast("long")

    begin = F.greatest(first_output(at - 1), F.lit(0).cast("long"))
    total = F.floor((F.col("_last") + 1) * pace / step).cast("long")
    end = F.least(first_output(at + 1), total) - 1
    outputs = rows.where(end >= begin).withColumn("_j", F.explode(F.sequence(begin, end)))
    place = F.col("_j") * step
    base = F.floor(place / pace).cast("long")
    share = (place - base * pace) / pace.cast("double")
    weight = F.when(base < at, share).when(at == F.col("_last"), F.lit(1.0)).otherwise(1.0 - share)
    given = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    shares = outputs.groupBy(*by, F.col("_j").alias(t)).agg(
        F.sum(F.when(given, F.col(value) * weight)).alias("_sum"), F.sum(F.when(given, weight)).alias("_have")
    )
    return shares.select(*by, t, F.when(F.abs(F.col("_have") - 1.0) < 1e-9, F.col("_sum")).alias(value))


def context_blocks(
    sig: DataFrame, block: int, left: int, right: int, by: Sequence[str] = RECORD, t: str = "t", value: str = "value"
) -> DataFrame:
    """Rows (by, block, first, last, values): bounded arrays with context.

    A block holds its own ``block`` samples plus ``left`` and ``right``
    neighbours; ``last`` is the last sample index of the record. Samples of a
    block must follow each other without a hole or a repeat, else the block
    raises an error.
    """
    sizes = sig.groupBy(*by).agg(F.max(t).alias("last"))
    at = F.col(t).cast("long")
    low = F.greatest(F.floor((at - right) / block), F.lit(0))
    high = F.least(F.floor((at + left) / block), F.floor(F.col("last") / block))
    spread = sig.join(sizes, list(by)).withColumn("block", F.explode(F.sequence(low, high)))
    cells = F.array_sort(F.collect_list(F.struct(at.alias("t"), F.col(value).cast("double").alias("v"))))
    grouped = spread.groupBy(*by, "block").agg(F.max("last").alias("last"), cells.alias("_cells"))
    span = F.element_at("_cells", -1)["t"] - F.col("_cells")[0]["t"] + 1
    begins = F.greatest(F.col("block") * block - left, F.lit(0))
    ends = F.least((F.col("block") + 1) * block + right - 1, F.col("last"))
    dense = (F.size("_cells") == span) & (F.col("_cells")[0]["t"] == begins) & (F.element_at("_cells", -1)["t"] == ends)
    return grouped.select(
        *by,
        F.col("block").cast("long").alias("block"),
        F.col("last").cast("long").alias("last"),
        F.col("_cells")[0]["t"].alias("first"),
        F.when(dense, F.transform("_cells", lambda x: x["v"]))
        .otherwise(F.raise_error(F.concat(F.lit("samples are missing or repeated in block "), F.col("block").cast("string"))))
        .alias("values"),
    )


def _map_blocks(blocks: DataFrame, by: Sequence[str], work, out_type: str = "array<double>") -> DataFrame:
    """Run ``work(row) -> (begin, outputs)`` on each block row."""
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if f.name in by]
    names = [f.name for f in blocks.schema if f.name in by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [work(row) for row in batch.itertuples(index=False)]
            out = batch[names].copy()
            out["begin"] = [d[0] for d in done]
            out["outputs"] = [d[1] for d in done]
            yield out

    return blocks.mapInPandas(run, ", ".join([*keys, "begin long", f"outputs {out_type}"]))


def resample_sinc(
    sig: DataFrame, fs: int, target: int, by: Sequence[str] = RECORD, block: int = 4096
) -> DataFrame:
    """Band-limited resampling with a Kaiser-windowed sinc, block by block, to a lower or a higher rate.

    Output ``n`` lies at source position n * fs / target; there are
    floor(length * target / fs) of them.
    """
    if fs <= 0 or target <= 0:
        raise ValueError("rates must be positive")
    reach = kernels.sinc_reach(fs, target) + int(np.ceil(fs / target))
    blocks = context_blocks(sig, block, reach, reach, by)

    def work(row):
        lo, hi = row.block * block, min((row.block + 1) * block, row.last + 1)
        total = (row.last + 1) * target // fs
        begin = -(-lo * target // fs)
        end = min(-(-hi * target // fs), total)
        x = np.asarray(row.values, dtype=np.float64)
        return begin, kernels.sinc_resample(x, row.first, begin, max(begin, end), fs, target).tolist()

    done = _map_blocks(blocks, by, work)
    spread = done.select(*by, "begin", F.posexplode("outputs").alias("_i", "value"))
    return spread.select(*by, (F.col("begin") + F.col("_i")).alias("t"), "value")


def butter_filter(
    sig: DataFrame,
    fs: float,
    low: float | None = None,
    high: float | None = None,
    order: int = 5,
    zero_phase: bool = True,
    by: Sequence[str] = RECORD,
    block: int = 16384,
) -> DataFrame:
    """Butterworth low-, high- or band-pass per channel.

    The recursive filter is used through its impulse response, cut at 1e-12.
    Blocks carry that much context, so every output equals that of the whole
    record to the same tolerance and no task holds a record.
    """
    h = kernels.impulse_response(order, low, high, fs)
    pad = kernels.edge_padding(order, low, high)
    reach = len(h) + pad
    blocks = context_blocks(sig, block, reach, reach if zero_phase else 0, by)

    def work(row):
        x = np.asarray(row.values, dtype=np.float64)
        y = kernels.filter_block(x, row.first == 0, row.first + len(x) - 1 == row.last, h, pad, zero_phase)
        lo = row.block * block - row.first
        return row.block * block, y[lo : lo + block].tolist()

    done = _map_blocks(blocks, by, work)
    spread = done.select(*by, "begin", F.posexplode("outputs").alias("_i", "value"))
    return spread.select(*by, (F.col("begin") + F.col("_i")).alias("t"), "value")


def spectrogram(
    sig: DataFrame,
    fs: float,
    size: int = kernels.FRAME,
    overlap: int = kernels.OVERLAP,
    pad: str | None = "reflect",
    log: bool = True,
    by: Sequence[str] = RECORD,
    frames_per_block: int = 32,
) -> DataFrame:
    """Rows (by, frame, power array) of the short-time spectrum.

    Reflection at the record ends is a relabelling of sample positions, so a
    block only needs one frame of context to its right.
    """
    hop = size - overlap
    rows = sig
    if pad == "reflect":
        half = size // 2
        sizes = sig.groupBy(*by).agg(F.max("t").alias("_last"))
        at = F.col("t").cast("long")
        places = F.array(
            at + half,
            F.when((at >= 1) & (at <= half), half - at),
            F.when((at < F.col("_last")) & (at >= F.col("_last") - half), 2 * F.col("_last") + half - at),
        )
        rows = sig.join(sizes, list(by)).withColumn("t", F.explode(F.array_compact(places))).drop("_last")
    elif pad is not None:
        raise ValueError(f"unknown padding {pad!r}")
    block = hop * frames_per_block
    blocks = context_blocks(rows, block, 0, overlap, by)

    def work(row):
        x = np.asarray(row.values, dtype=np.float64)
        power = kernels.spectrogram_frames(x, fs, size, hop, log)
        return row.block * frames_per_block, power[:frames_per_block].tolist()

    done = _map_blocks(blocks, by, work, "array<array<double>>")
    spread = done.select(*by, "begin", F.posexplode("outputs").alias("_i", "power"))
    return spread.select(*by, (F.col("begin") + F.col("_i")).alias("frame"), "power")


def gaussian_noise(
    value: str | Column, scale: float, seed: int, keys: Sequence[str] = ("record_id", "channel", "t")
) -> Column:
    """Add normal noise drawn from the row key, equal on every rerun."""
    value = F.col(value) if isinstance(value, str) else value
    if scale == 0:
        return value
    u = unit_interval(seeded_hash(seed, *keys))
    v = unit_interval(seeded_hash(seed + 1, *keys))
    normal = F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(F.lit(2 * np.pi) * v)
    return value + F.lit(float(scale)) * normal


def static_vector(df: DataFrame, columns: Sequence[str]) -> Column:
    """Scalar and array columns joined into one array of doubles."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    parts = [
        F.col(c).cast("array<double>") if kinds[c] == "array" else F.array(F.col(c).cast("double")) for c in columns
    ]
    return F.concat(*parts)

