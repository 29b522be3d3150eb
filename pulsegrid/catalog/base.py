"""Registry of queries over the driver tables and the views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.scale import position

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under its function name, with its SQL twin if any."""

    def add(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def hash_sql(seed: int, *columns: str) -> str:
    """The number that ``seeded_hash`` draws, in SQL."""
    parts = "".join(f" || '|' || coalesce(CAST({c} AS VARCHAR), '\\N')" for c in columns)
    return f"CAST('0x' || substr(md5('{seed}'{parts}), 1, 15) AS BIGINT)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def text_list(c: str | Column) -> Column:
    """An array as comma-separated text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c.cast("array<string>"), ",")


def meas(spark: SparkSession, sf: str) -> DataFrame:
    """Measurements: (event_id, subject_id, time, name, value)."""
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("subject_id"), F.col("ts").alias("time"),
        F.col("event_type").alias("name"), "value",
    )


def sig(spark: SparkSession, sf: str) -> DataFrame:
    """Signal: events of a user in time order; days are the slices of a user."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("record_id"), "ts", "event_id", "event_type", "value"
    )
    return position(rows, ["record_id"], ["ts", "event_id"], "t", slice_by=F.unix_date(F.to_date("ts"))).drop("ts", "event_id")


SIG = (
    "sig AS (SELECT user_id AS record_id, event_type, value, "
    "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)"
)


def sig_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("record_id")).agg(
        F.count(F.lit(1)).alias("data_length")
    )


LENGTHS = "lengths AS (SELECT user_id AS record_id, count(*) AS data_length FROM events GROUP BY user_id)"


def lab(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled records: name words as labels, brand as group."""
    return table(spark, sf, "part").select(
        "p_partkey", "p_brand", "p_size", "p_type", F.split("p_name", " ").alias("labels")
    )


LAB = "lab AS (SELECT p_partkey, p_brand, p_size, p_type, string_split(p_name, ' ') AS labels FROM part)"
LAB_LONG = LAB + ", lab_long AS (SELECT p_partkey, p_brand, unnest(labels) AS label, unnest(range(len(labels))) AS place FROM lab)"


def codes(spark: SparkSession, sf: str) -> DataFrame:
    """Records with two hierarchical codes of two to six characters."""
    part = table(spark, sf, "part")
    head = F.substring("p_type", 1, 1)
    size = F.lpad(F.col("p_size").cast("string"), 2, "0")
    tail = F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0")
    return part.select(
        "p_partkey", "p_size",
        F.array(F.concat(head, size, tail, F.lit("X")), F.concat(head, F.substring(tail, 1, 1))).alias("codes"),
    )


CODES = (
    "codes AS (SELECT p_partkey, p_size, [substr(p_type,1,1) || lpad(CAST(p_size AS VARCHAR),2,'0') || "
    "lpad(CAST(p_partkey % 100 AS VARCHAR),2,'0') || 'X', "
    "substr(p_type,1,1) || substr(lpad(CAST(p_partkey % 100 AS VARCHAR),2,'0'),1,1)] AS codes FROM part)"
)


def pred(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions (sample_id, label, target, score); unlabelled targets are null."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    marks = table(spark, sf, "labels")
    joined = docs.join(marks, "doc_id", "left")
    quality = F.struct(
        F.lit("quality").alias("label"), F.col("quality").alias("target"),
        ((F.col("n_chars") % 997) / 997.0).alias("score"),
    )
    toxic = F.struct(
        F.lit("toxic").alias("label"), F.col("toxic").alias("target"),
        (((F.col("doc_id") * 7919) % 1009) / 1009.0).alias("score"),
    )
    return joined.select(F.col("doc_id").alias("sample_id"), F.explode(F.array(quality, toxic)).alias("c")).select(
        "sample_id", "c.label", "c.target", "c.score"
    )


PRED = (
    "pred AS (SELECT d.doc_id AS sample_id, 'quality' AS label, l.quality AS target, (d.n_chars % 997) / 997.0::DOUBLE AS score "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id UNION ALL "
    "SELECT d.doc_id, 'toxic', l.toxic, ((d.doc_id * 7919) % 1009) / 1009.0::DOUBLE "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)
KNOWN = PRED + ", known AS (SELECT * FROM pred WHERE target IS NOT NULL)"
