"""Packed-signal manifests and their metadata."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.scale import carry, running_sum
from pulsegrid.session import cut

# --- fixed values -----------------------------------------------------------
FILE_CAP = 900_000_000
VERSION_KEY = "version"
ANNOTATION_PREFIX = "annotation_"
REPLACED_KEYS = ("fs", "meta")
# -----------------------------------------------------------------------------


def pack_manifest(df: DataFrame, order: Sequence[str], length: str, max_len: int = FILE_CAP) -> DataFrame:
    """Add ``file_idx`` and ``start``; a file closes once it exceeds ``max_len``.

    Where a file starts depends on where the one before it started. Instead
    of walking the rows one by one, every running length is linked to the
    place where a file begun there would close; doubling these links reaches
    all file starts in log2(files) joins. ``max_len`` 0 keeps one file.
    """
    laid = running_sum(df, [], order, {"_s": F.col(length).cast("long")})
    if max_len <= 0:
        return laid.withColumn("file_idx", F.lit(0).cast("long")).withColumnRenamed("_s", "start")
    laid = cut(laid)
    marks = cut(laid.select("_s").distinct())
    lane = F.floor(F.col("x") / F.lit(max_len)).cast("long")
    points = marks.select(F.col("_s").alias("x"), F.lit(0).alias("kind"), F.col("_s").alias("at"))
    probes = marks.select((F.col("_s") + F.lit(max_len)).alias("x"), F.lit(1).alias("kind"), F.col("_s").alias("src"))
    seen = carry(
        points.unionByName(probes, allowMissingColumns=True), [], lane, ["x", "kind"], following={"next": F.col("at")}
    )
    links = cut(seen.where("kind = 1 and next is not null").select("src", "next"))
    total = marks.agg(F.max("_s")).first()[0] or 0
    starts = cut(marks.agg(F.min("_s").alias("at")))
    for step in range(math.ceil(math.log2(total // max_len + 2))):
        reached = starts.join(links, starts["at"] == links["src"]).select(F.col("next").alias("at"))
        starts = cut(starts.unionByName(reached).distinct())
        if step + 1 < math.ceil(math.log2(total // max_len + 2)):
            further = links.select(F.col("src").alias("next"), F.col("next").alias("hop"))
            links = cut(links.join(further, "next").select("src", F.col("hop").alias("next")))
    place = F.floor(F.col("_s") / F.lit(max_len)).cast("long")
    opened = marks.join(starts.select(F.col("at").alias("_s"), F.lit(1).alias("_open")), "_s", "left")
    numbered = running_sum(opened, [], ["_s"], {"_file": F.coalesce(F.col("_open"), F.lit(0)).cast("long")}, inclusive=True, slice_by=place)
    based = carry(numbered, [], place, ["_s"], {"_base": F.when(F.col("_open") == 1, F.col("_s"))})
    return laid.join(based.select("_s", "_file", "_base"), "_s").select(
        *df.columns, (F.col("_file") - 1).alias("file_idx"), (F.col("_s") - F.col("_base")).alias("start")
    )


def pack_bins(df: DataFrame, order: Sequence[str], length: str, max_len: int = FILE_CAP) -> DataFrame:
    """S8 without dependence between files: ``file_idx`` is the running length over the cap."""
    laid = running_sum(df, [], order, {"_s": F.col(length).cast("long")})
    laid = laid.withColumn("file_idx", F.floor(F.col("_s") / F.lit(max_len)).cast("long"))
    bases = laid.groupBy("file_idx").agg(F.min("_s").alias("_base"))
    return laid.join(bases, "file_idx").select(*df.columns, "file_idx", (F.col("_s") - F.col("_base")).alias("start"))


def write_packed(sig: DataFrame, manifest: DataFrame, path: str, key: str = "record_id") -> None:
    """Signal rows partitioned by their file, sorted by place inside it."""
    rows = sig.join(manifest.select(key, "file_idx", "start"), key).withColumn("at", F.col("start") + F.col("t"))
    width = F.floor(F.col("at") / F.lit(1 << 22))
    rows.repartition("file_idx", width).sortWithinPartitions("file_idx", "at").write.mode("overwrite").partitionBy("file_idx").parquet(path)


def append_manifest(
    first: DataFrame, second: DataFrame, file_first: int = 0, file_second: int = 0,
    shape_first: Sequence[int] = (), shape_second: Sequence[int] = (),
    dtype_first: str = "float32", dtype_second: str = "float32", key: str = "data",
) -> DataFrame:
    """Append one file of a second manifest to a file of the first.

    Starts continue after the first file's content; ids continue after the
    last id up to that file, and later ids of the first manifest move up.
    """
    if list(shape_first) != list(shape_second):
        raise ValueError("channel shapes differ")
    if dtype_first != dtype_second:
        raise ValueError("sample types differ")
    added = second.where(F.col("file_idx") == file_second)
    used = first.where(F.col("file_idx") == file_first).agg(F.coalesce(F.max(F.col("start") + F.col("length")), F.lit(0))).scalar()
    room = F.coalesce(first.where(F.col("file_idx") <= file_first).agg(F.max(key)).scalar() + 1, F.lit(0))
    count = added.agg(F.count(F.lit(1))).scalar()
    lowest = added.agg(F.min(key)).scalar()
    moved = first.withColumn(key, F.when(F.col(key) >= room, F.col(key) + count).otherwise(F.col(key)))
    placed = added.withColumns(
        {
            key: F.col(key) - lowest + room,
            "start": F.col("start") + used,
            "file_idx": F.lit(file_first).cast("long"),
        }
    )
    return moved.unionByName(placed)


def merged_meta(meta: Column, annotation: Column | None = None) -> Column:
    """Signal metadata plus annotation keys under a prefix, without its version."""
    if annotation is None:
        return meta
    kept = F.map_filter(annotation, lambda k, v: k != VERSION_KEY)
    return F.map_concat(meta, F.transform_keys(kept, lambda k, v: F.concat(F.lit(ANNOTATION_PREFIX), k)))


def upgraded_meta(arrays: Column, new_meta: Mapping[str, str]) -> Column:
    """Drop the old rate and metadata entries, add the new ones."""
    kept = F.map_filter(arrays, lambda k, v: ~k.isin(*REPLACED_KEYS))
    pairs = [F.lit(x) for k, v in new_meta.items() for x in (f"meta.{k}", v)]
    return F.map_concat(kept, F.create_map(*pairs))
