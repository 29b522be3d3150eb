"""Sinks: datasets, probe tables, exports and replicate logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
DATASET_TABLE = "records_packed"
FALLBACK_TABLE = "records"
PROBE_SPLITS = ("train", "val", "test")
# -----------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _children(spark: SparkSession, path: str) -> list[str]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    return [s.getPath().getName() for s in system.listStatus(where) if s.isDirectory()]


def save_dataset(
    df: DataFrame, root: str, vocab: DataFrame | None = None, stats: DataFrame | None = None, table: str = FALLBACK_TABLE
) -> None:
    """Records with optional vocabulary and statistics beside them."""
    df.write.mode("overwrite").parquet(f"{root}/{table}")
    if vocab is not None:
        vocab.write.mode("overwrite").parquet(f"{root}/vocabulary")
    if stats is not None:
        stats.write.mode("overwrite").parquet(f"{root}/statistics")


def load_dataset(
    spark: SparkSession, root: str, table: str = DATASET_TABLE
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Saved records, vocabulary and statistics; plain records as fallback."""
    path = f"{root}/{table}"
    if not _exists(spark, path) and table == DATASET_TABLE:
        path = f"{root}/{FALLBACK_TABLE}"
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    side = [f"{root}/{n}" for n in ("vocabulary", "statistics")]
    return (spark.read.parquet(path), *[spark.read.parquet(p) if _exists(spark, p) else None for p in side])


def write_by_split(df: DataFrame, root: str, split: str = "split", splits: Sequence[str] = PROBE_SPLITS) -> None:
    """Delimited files in one folder per split, the split column dropped."""
    df.where(F.col(split).isin(*splits)).write.mode("overwrite").partitionBy(split).csv(root, header=True)


def next_version(spark: SparkSession, root: str, name: str) -> int:
    """One above the largest ``<name>_version_<n>`` folder."""
    numbers = []
    for folder in _children(spark, root):
        if folder.startswith(f"{name}_version_"):
            text = folder.rsplit("_", 1)[-1]
            if not text.isdigit():
                raise ValueError(f"unexpected folder {folder!r}")
            numbers.append(int(text))
    return max(numbers) + 1 if numbers else 0


def export_predictions(
    plain: DataFrame, aggregated: DataFrame, root: str, name: str, epoch: int, loader: int = 0
) -> str:
    """Both prediction tables under the next version; returns its path."""
    spark = plain.sparkSession
    base = f"{root}/{name}_version_{next_version(spark, root, name)}"
    for kind, frame in (("noagg", plain), ("agg", aggregated)):
        frame.withColumn("epoch", F.lit(epoch)).write.parquet(f"{base}/{kind}/test_{loader}_epoch_{epoch}")
    return base


def replicate_rows(
    replicates: DataFrame, epoch: int, split: str, aggregation: str, loader: int, area: bool = True
) -> DataFrame:
    """Replicate values in log form, brackets in names replaced."""
    metric = F.regexp_replace("label", "[()]", "_")
    tail = ("_auc" if area else "") + f"_{aggregation}_{split}{loader}"
    return replicates.select(
        F.lit(epoch).alias("epoch"),
        F.lit(split).alias("split"),
        F.lit(aggregation).alias("aggregation"),
        F.lit(loader).alias("dataloader_idx"),
        F.col("replicate").alias("bootstrap_iteration"),
        metric.alias("metric"),
        F.concat(metric, F.lit(tail)).alias("logged_metric"),
        F.col("value").cast("double").alias("value"),
    )


def append_replicates(rows: DataFrame, path: str) -> None:
    """Append to the replicate log."""
    rows.write.mode("append").parquet(path)
