"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession


def get_session(app_name: str = "pulsegrid", cpus: str | int | None = None) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, taken from ``spark.checkpoint.dir``.

    A temporary folder is used only on a local master, where driver and
    executors are one process.
    """
    conf = spark.sparkContext.getConf()
    configured = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="pulsegrid-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages see one frozen row layout."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def park(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet below the shared folder, read back.

    Like ``cut`` for tables as large as the input: compressed, and the shuffle
    files of the job are freed as soon as it ends. The session's own choice
    for them is put back.
    """
    return park_all([df])


def park_all(frames: Iterable[DataFrame]) -> DataFrame:
    """The rows of all frames in one parked table. One frame is asked for and written after the other.

    A union of parked parts would carry a scan for each of them through every
    later plan, and the driver keeps the plans.
    """
    path = None
    for df in frames:
        spark = df.sparkSession
        if path is None:
            path, schema = scratch_path(spark, "rows"), df.schema
        before = spark.conf.get(FREE_SHUFFLES, "false")
        spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(schema).parquet(path)
    out.parked_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Frees the disk of parked tables that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.parked_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_rows(df: DataFrame, most: int) -> list[Row]:
    """All rows of a result whose size has a bound that does not grow with the data; more are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where at most that many can be")
    return rows
