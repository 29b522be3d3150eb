"""Chunk index, crops and segment labels over long signal tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.clean import to_number
from pulsegrid.scale import seeded_hash

_STEP = 8192


def explode_range(df: DataFrame, count: Column, out: str) -> DataFrame:
    """One row per integer in ``[0, count)``, built in bounded pieces."""
    n = F.when(count > 0, count.cast("long"))
    pieces = df.withColumn("_n", n).where("_n is not null")
    pieces = pieces.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(_STEP).cast("long"))))
    last = F.least(F.col("_from") + (_STEP - 1), F.col("_n") - 1)
    return pieces.withColumn(out, F.explode(F.sequence("_from", last))).drop("_n", "_from")


def record_bounds(
    length: Column, start: int = 0, row_start: Column | None = None, row_end: Column | None = None
) -> tuple[Column, Column]:
    """Usable range of a record; an inverted range is empty at its start."""
    lo = F.lit(start).cast("long")
    hi = length.cast("long")
    if row_start is not None:
        lo = F.greatest(lo, F.bround(to_number(row_start)).cast("long"))
    if row_end is not None:
        hi = F.least(hi, F.bround(to_number(row_end)).cast("long"))
    return lo, F.greatest(lo, hi)


def chunk_index(
    records: DataFrame,
    length: str = "data_length",
    chunk_length: int = 0,
    stride: int | None = None,
    min_chunk_length: int = 0,
    start: int = 0,
    copies: int = 0,
    row_start: str | None = None,
    row_end: str | None = None,
) -> DataFrame:
    """Rows with ``copy``, ``chunk``, ``start_idx`` and ``end_idx``.

    Chunk lengths never grow along a record, so dropping short chunks equals
    cutting everything from the first short one. ``chunk_length`` 0 keeps the
    record whole.
    """
    lo, hi = record_bounds(
        F.col(length), start,
        None if row_start is None else F.col(row_start),
        None if row_end is None else F.col(row_end),
    )
    base = records.withColumns({"_lo": lo, "_hi": hi}).drop("start_idx", "end_idx")
    if chunk_length == 0:
        out = base.withColumns({"chunk": F.lit(0).cast("long"), "start_idx": F.col("_lo"), "end_idx": F.col("_hi")})
    else:
        step = chunk_length if stride is None else stride
        count = F.ceil((F.col("_hi") - F.col("_lo")) / F.lit(step))
        out = explode_range(base, count, "chunk")
        begin = F.col("_lo") + F.col("chunk") * F.lit(step)
        out = out.withColumn("start_idx", begin).withColumn(
            "end_idx", F.least(F.col("start_idx") + F.lit(chunk_length), F.col("_hi"))
        )
    out = out.where(F.col("end_idx") - F.col("start_idx") >= min_chunk_length).drop("_lo", "_hi")
    if copies > 0:
        return out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    return out.withColumn("copy", F.lit(0))


def center_crop(chunks: DataFrame, size: int) -> DataFrame:
    """T4: ``size`` samples around the middle of each chunk."""
    start = F.col("start_idx") + F.floor((F.col("end_idx") - F.col("start_idx") - size) / 2)
    return _crop(chunks, start, size)


def fixed_crop(chunks: DataFrame, start: int, end: int) -> DataFrame:
    """``[start, end)`` relative to the chunk start; the chunk must be longer."""
    fits = F.col("end_idx") - F.col("start_idx") > end
    begin = F.when(fits, F.col("start_idx") + start).otherwise(
        F.raise_error(F.lit("fixed crop reaches past its chunk")).cast("long")
    )
    return _crop(chunks, begin, end - start)


def random_crop(chunks: DataFrame, size: int, keys: Sequence[str], seed: int, items: int = 1) -> DataFrame:
    """T5: ``items`` seeded crops per chunk; the last possible start is never drawn."""
    room = F.col("end_idx") - F.col("start_idx") - size
    drawn = chunks.withColumn("item", F.explode(F.sequence(F.lit(0), F.lit(items - 1))))
    shift = F.when(room <= 0, 0).otherwise(F.pmod(seeded_hash(seed, *keys, "start_idx", "item"), room))
    return _crop(drawn, F.col("start_idx") + shift, size)


def _crop(chunks: DataFrame, start: Column, size: int) -> DataFrame:
    fits = F.col("end_idx") - F.col("start_idx") >= size
    begin = F.when(fits, start).otherwise(F.raise_error(F.lit("chunk shorter than its crop")).cast("long"))
    return chunks.withColumn("start_idx", begin.cast("long")).withColumn("end_idx", F.col("start_idx") + F.lit(size).cast("long"))


def take_samples(
    sig: DataFrame, spans: DataFrame, by: Sequence[str] = ("record_id",), t: str = "t", block: int = 4096
) -> DataFrame:
    """Samples of each span, with ``rel`` counted from the span start.

    Spans are cut at block borders first, so the join key is (record, block)
    and a long record meets only the spans that touch each block.
    """
    pieces = spans.where("end_idx > start_idx").withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("start_idx") / block), F.floor((F.col("end_idx") - 1) / block)))
    )
    rows = sig.withColumn("_block", F.floor(F.col(t) / block))
    joined = rows.join(pieces, [*by, "_block"]).where((F.col(t) >= F.col("start_idx")) & (F.col(t) < F.col("end_idx")))
    return joined.withColumn("rel", F.col(t) - F.col("start_idx")).drop("_block")


def annotation_span(ratio: float, size: int) -> tuple[Column, Column]:
    """Label range for a crop at another rate, rounded half-even."""
    start = F.bround(F.col("start_idx").cast("double") * F.lit(float(ratio))).cast("long")
    return start, start + F.bround(F.lit(float(size * ratio))).cast("long")


def segment_labels(
    sig: DataFrame,
    classes: Sequence[int],
    epoch_length: int,
    mode: str = "majority",
    by: Sequence[str] = ("record_id",),
    t: str = "t",
    label: str = "label",
) -> DataFrame:
    """Per epoch the majority class, or per class presence or fraction.

    A tie goes to the first class. ``epoch_length`` 0 takes a record as one
    epoch. Fractions divide by the labels an epoch has, so a short last epoch
    of one class has fraction 1.
    """
    epoch = F.floor(F.col(t) / epoch_length).cast("long") if epoch_length > 0 else F.lit(0).cast("long")
    counts = sig.groupBy(*by, epoch.alias("epoch")).agg(
        F.array(*[F.count_if(F.col(label) == c) for c in classes]).alias("_counts"), F.count(F.lit(1)).alias("_n")
    )
    if mode == "majority":
        named = F.array(*[F.lit(c) for c in classes])
        top = F.array_position("_counts", F.array_max("_counts"))
        return counts.select(*by, "epoch", F.get(named, (top - 1).cast("int")).alias("label"))
    if mode == "presence":
        cell = F.transform("_counts", lambda x: (x > 0).cast("double"))
    elif mode == "fraction":
        cell = F.transform("_counts", lambda x: x / F.col("_n"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return counts.select(*by, "epoch", cell.alias("label"))
