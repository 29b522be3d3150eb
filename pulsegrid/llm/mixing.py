"""Mixing sources to target weights by hash-ordered prefix sums. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.rows import neutral

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
DIGITS = 3


def word_count(text: str | Column) -> Column:
    """Words of a text; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(skey, source_size, target) from (skey, source, source_size), one row per source.

    Sources in code point order, null last, weigh 1, 2, 3 and so on again.
    Together they share the sum of all sizes; no target passes ``cap`` times
    its source. Sorted by size per weight, the capped sources come first, so
    the level of the others follows from running sums over this small table.
    """
    one = Window.partitionBy(F.lit(0))
    named = sizes.withColumn("w", 1 + (F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % 3)
    named = named.withColumn("cap", F.col("source_size") * cap).withColumn("ratio", F.col("cap") / F.col("w"))
    order = one.orderBy("ratio", "w", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(one)
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = named.withColumn("level", (total - capped) / rest)
    top = F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(one)
    target = F.least(F.col("cap").cast("double"), F.col("w") * F.coalesce(top, F.lit(0.0)))
    return level.withColumn("target", target.cast("double")).select("skey", "source_size", "target")


def _plan(docs: DataFrame, key: str, text: str, source: str, seed: int, cap: int, carry: bool) -> DataFrame:
    """Internal columns ``_key, _size, _total, _target, _epochs, _rest`` and, if wanted, the row itself as ``_row``."""
    skey = F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source)))
    rows = docs.select(
        F.col(key).alias("_key"), skey.alias("skey"), F.col(source).alias("source"), word_count(F.col(text)).alias("_size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))).alias("digest"),
        *([F.struct(*[F.col(c) for c in docs.columns]).alias("_row")] if carry else []),
    ).withColumn("slice", F.substring("digest", 1, DIGITS))
    sums = rows.groupBy("skey", "source", "slice").agg(F.sum("_size").alias("slice_size"))
    sizes = sums.groupBy("skey", "source").agg(F.sum("slice_size").alias("source_size"))
    before = Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.select("skey", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("ahead")).join(
        source_targets(sizes, cap), "skey"
    )
    inside = Window.partitionBy("skey", "slice").orderBy("digest", "_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    joined = local.join(places, ["skey", "slice"])
    budget = F.round("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(budget / size).cast("long")
    left = budget - epochs * size - F.col("before") - F.col("ahead")
    return joined.select(
        "_key", "_size", F.col("source_size").alias("_total"), F.col("target").alias("_target"), epochs.alias("_epochs"),
        F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), left)).alias("_rest"), *(["_row"] if carry else []),
    )


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, cap: int = CAP
) -> DataFrame:
    """(key, size, source_size, target, taken) for every row.

    Every row gets the digest of its seeded key. The leading digits split a
    source into slices of equal expected size; slice totals give each slice
    its place and a window inside the slice gives each row the words before
    it. A source is read whole as often as its budget (the rounded target)
    allows and then up to the exact word where the budget ends.

    Null texts have size 0, a null source is a source of its own, a null key
    has its own digest; equal digests are ordered by key and size. Repeated
    rows are separate rows. An empty table gives no rows.
    """
    plan = _plan(docs, key, text, source, seed, cap, carry=False)
    taken = F.col("_epochs") * F.col("_size") + F.col("_rest")
    return plan.select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_total").alias("source_size"),
        F.col("_target").alias("target"), taken.alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, cap: int = CAP
) -> DataFrame:
    """The rows as the mix reads them, with the columns of the input.

    One row for each whole pass and one for the pass in which the budget ends;
    the document at that end keeps its first words, joined by single spaces.
    A text without words costs nothing and is kept once.
    """
    given = docs.columns
    docs, names = neutral(docs)
    key, text, source = names[key], names[text], names[source]
    plan = _plan(docs, key, text, source, seed, cap, carry=True)
    body = F.col("_row").getField(text)
    size, epochs, rest = F.col("_size"), F.col("_epochs"), F.col("_rest")
    full = epochs + F.when(rest == size, 1).otherwise(0)
    cut = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), F.lit(1), rest.cast("int")), " ")
    texts = F.when(size == 0, F.array(body)).when(
        (rest > 0) & (rest < size), F.concat(F.array_repeat(body, full.cast("int")), F.array(cut))
    ).otherwise(F.array_repeat(body, full.cast("int")))
    rows = plan.select("_row", F.explode(texts).alias("_text"))
    return rows.select(*[F.col("_text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns]).toDF(*given)


def mix_sql(seed: int = 7, cap: int = CAP) -> str:
    """The same rows in plain SQL."""
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    md5('{seed}|' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
r AS (SELECT *, (source_size * {cap}) / w::DOUBLE AS ratio, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(source_size * {cap}) OVER (ORDER BY ratio, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY ratio, w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM r),
t AS (SELECT source, source_size, least((source_size * {cap})::DOUBLE, w * coalesce(max(CASE WHEN lv < ratio THEN lv END) OVER (), 0.0))::DOUBLE AS target FROM l),
b AS (SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    ((budget // greatest(source_size, 1)) * size + greatest(0, least(size, budget % greatest(source_size, 1) - ahead)))::BIGINT AS taken
FROM b"""
