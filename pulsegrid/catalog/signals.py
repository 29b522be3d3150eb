"""Queries on chunks, crops, signal transforms and record statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.base import LENGTHS, SIG, hash_sql, query, r6, sig, sig_lengths, table
from pulsegrid.operators import aggregates as A
from pulsegrid.operators import chunks as C
from pulsegrid.operators import kernels
from pulsegrid.operators import reshape as R
from pulsegrid.operators import signal as G
from pulsegrid.operators.joins import attach_intervals
from pulsegrid.operators.scoring import export_features

REC = ["record_id"]
_CHUNKS = LENGTHS + (
    ", c AS (SELECT record_id, data_length, unnest(range(0, data_length, {step})) AS start_idx FROM lengths),"
    " chunks AS (SELECT record_id, start_idx, least(start_idx + {size}, data_length) AS end_idx, start_idx // {step} AS chunk"
    " FROM c WHERE least(start_idx + {size}, data_length) - start_idx >= {least})"
)


@query("WITH " + _CHUNKS.format(step=5, size=10, least=10) + " SELECT record_id, chunk, start_idx, end_idx FROM chunks")
def chunk_index(spark, sf):
    """Strided chunks, short ones cut."""
    out = C.chunk_index(sig_lengths(spark, sf), chunk_length=10, stride=5, min_chunk_length=10)
    return out.select("record_id", "chunk", "start_idx", "end_idx")


@query(
    "WITH " + _CHUNKS.format(step=20, size=20, least=6)
    + " SELECT record_id, chunk, start_idx, end_idx, CAST(k.copy AS INTEGER) AS copy FROM chunks, (SELECT unnest([0, 1, 2]) AS copy) k"
)
def chunk_copies(spark, sf):
    """Every chunk listed three times."""
    out = C.chunk_index(sig_lengths(spark, sf), chunk_length=20, min_chunk_length=6, copies=2)
    return out.select("record_id", "chunk", "start_idx", "end_idx", "copy")


@query(
    "WITH " + LENGTHS + """, r AS (SELECT record_id, data_length, record_id % 50 AS s, CASE WHEN record_id % 4 <> 0 THEN record_id % 60 END AS e FROM lengths),
b AS (SELECT record_id, greatest(5, s) AS lo, least(data_length, coalesce(e, data_length)) AS hi FROM r)
SELECT record_id, lo AS start_idx, greatest(lo, hi) AS end_idx FROM b"""
)
def record_clamp(spark, sf):
    """Records kept whole between row bounds given as text."""
    k = F.col("record_id")
    rows = sig_lengths(spark, sf).withColumns(
        {"start_idx": (k % 50).cast("string"), "end_idx": F.when(k % 4 != 0, (k % 60).cast("string")).otherwise("n/a")}
    )
    out = C.chunk_index(rows, start=5, row_start="start_idx", row_end="end_idx")
    return out.select("record_id", "start_idx", "end_idx")


_FIRST = "first AS (SELECT record_id, min(t) AS t0 FROM sig WHERE event_type = 'error' GROUP BY record_id)"


@query(
    "WITH " + SIG + ", " + _FIRST + ", " + LENGTHS
    + """ SELECT CAST(l.record_id AS VARCHAR) AS record_name, t0 + 20 - 5 AS start_idx, t0 + 20 AS end_idx, data_length
FROM lengths l JOIN first f USING (record_id)"""
)
def interval_attach(spark, sf):
    """Lookback intervals anchored after the first error."""
    first = sig(spark, sf).where("event_type = 'error'").groupBy("record_id").agg(F.min("t").alias("t0"))
    spans = first.select(F.col("record_id").cast("string").alias("NAME"), (F.col("t0") + 20).cast("string").alias("abnormal_start"))
    records = sig_lengths(spark, sf).select(F.col("record_id").alias("record_name"), "data_length")
    return attach_intervals(records, spans, 2.5, lookback_seconds=2.0).select("record_name", "start_idx", "end_idx", "data_length")


@query(
    "WITH " + LENGTHS + """, i AS (SELECT e.user_id, CAST(round_even(e.value * 2.5, 0) AS BIGINT) AS start_idx, CAST(round_even((e.value + e.event_id % 5) * 2.5, 0) AS BIGINT) AS end_idx
  FROM events e WHERE e.event_type = 'view' AND e.event_id % 7 <> 0)
SELECT CAST(l.record_id AS VARCHAR) AS record_name, i.start_idx, i.end_idx FROM lengths l JOIN i ON i.user_id = l.record_id WHERE i.end_idx > i.start_idx"""
)
def interval_seconds(spark, sf):
    """Intervals in seconds, filtered by split, bad numbers dropped."""
    ev = table(spark, sf, "events")
    start = F.when(F.col("event_id") % 7 != 0, F.col("value").cast("string")).otherwise("?")
    spans = ev.select(
        F.col("user_id").alias("name"), start.alias("start_sec"), (F.col("value") + F.col("event_id") % 5).alias("end_sec"),
        F.when(F.col("event_type") == "view", "Valid").otherwise("train").alias("split"),
    )
    records = sig_lengths(spark, sf).select(F.col("record_id").alias("record_name"), "data_length")
    return attach_intervals(records, spans, 2.5, split="val").select("record_name", "start_idx", "end_idx")


@query(
    "WITH " + SIG + ", " + _CHUNKS.format(step=16, size=16, least=9)
    + """, k AS (SELECT record_id, start_idx + (end_idx - start_idx - 9) // 2 AS s FROM chunks)
SELECT k.record_id, k.s AS start_idx, g.t - k.s AS rel, g.value FROM k JOIN sig g ON g.record_id = k.record_id AND g.t >= k.s AND g.t < k.s + 9"""
)
def center_crop(spark, sf):
    """T4: nine samples around the middle of each chunk."""
    chunks = C.chunk_index(sig_lengths(spark, sf), chunk_length=16, min_chunk_length=9).drop("data_length")
    out = C.take_samples(sig(spark, sf), C.center_crop(chunks, 9), block=64)
    return out.select("record_id", "start_idx", "rel", "value")


@query(
    "WITH " + SIG + ", " + _CHUNKS.format(step=16, size=16, least=16)
    + """ SELECT c.record_id, c.start_idx + 3 AS start_idx, g.t - c.start_idx - 3 AS rel, g.value
FROM chunks c JOIN sig g ON g.record_id = c.record_id AND g.t >= c.start_idx + 3 AND g.t < c.start_idx + 8"""
)
def fixed_crop(spark, sf):
    """Samples three to eight of each chunk."""
    chunks = C.chunk_index(sig_lengths(spark, sf), chunk_length=16, min_chunk_length=16).drop("data_length")
    out = C.take_samples(sig(spark, sf), C.fixed_crop(chunks, 3, 8), block=64)
    return out.select("record_id", "start_idx", "rel", "value")


@query(
    "WITH " + _CHUNKS.format(step=16, size=16, least=9)
    + f""", d AS (SELECT *, end_idx - start_idx - 9 AS room, {hash_sql(42, "record_id", "start_idx", "item")} AS h
    FROM chunks, (SELECT unnest([0, 1]) AS item)),
s AS (SELECT record_id, chunk, item, CAST(start_idx + CASE WHEN room <= 0 THEN 0 ELSE h % room END AS BIGINT) AS start_idx FROM d)
SELECT record_id, chunk, CAST(item AS INTEGER) AS item, start_idx, start_idx + 9 AS end_idx FROM s"""
)
def random_crop(spark, sf):
    """T5: two seeded crops per chunk."""
    chunks = C.chunk_index(sig_lengths(spark, sf), chunk_length=16, min_chunk_length=9).drop("data_length")
    return C.random_crop(chunks, 9, ["record_id"], 42, items=2).select("record_id", "chunk", "item", "start_idx", "end_idx")


_HOLES = "holes AS (SELECT record_id, t, CASE WHEN t % 7 NOT IN (0, 1, 5) THEN value END AS value FROM sig)"


@query(
    "WITH " + SIG + ", " + _HOLES + """, n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER w AS pt,
  last_value(value IGNORE NULLS) OVER w AS pv, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER v AS nt,
  first_value(value IGNORE NULLS) OVER v AS nv FROM holes
  WINDOW w AS (PARTITION BY record_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  v AS (PARTITION BY record_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT record_id, t, CASE WHEN pt IS NULL THEN NULL WHEN nt IS NULL OR nt = pt THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END AS x FROM n)
SELECT record_id, t, CASE WHEN x IS NOT NULL THEN round(least(greatest(x, -100), 100), 6) + 0.0 END AS value FROM f"""
)
def gap_fill_linear(spark, sf):
    """Linear fill over missing samples, clipped."""
    holes = sig(spark, sf).withColumn("value", F.when(~(F.col("t") % 7).isin(0, 1, 5), F.col("value")))
    out = R.gap_fill(holes, REC, clip=100.0, block=16)
    return out.select("record_id", "t", r6("value").alias("value"))


@query(
    "WITH " + SIG + ", " + _HOLES + " SELECT record_id, t, least(greatest(coalesce(value, 0), -50), 50) AS value FROM holes"
)
def zero_fill_clip(spark, sf):
    """Missing samples to zero, then clipped."""
    holes = sig(spark, sf).withColumn("value", F.when(~(F.col("t") % 7).isin(0, 1, 5), F.col("value")).otherwise(F.lit(float("nan"))))
    return holes.select("record_id", "t", G.fill_and_clip("value", 50.0).alias("value"))


_RESAMPLE = """, n AS (SELECT record_id, max(t) + 1 AS n FROM sig GROUP BY 1),
g AS (SELECT record_id, n, unnest(range(0, n * {to} // {fs})) AS j FROM n)
SELECT g.record_id, g.j AS t, round(a.value * (1 - (g.j * {fs} % {to}) / {to}.0::DOUBLE) + coalesce(b.value, a.value) * ((g.j * {fs} % {to}) / {to}.0::DOUBLE), 6) + 0.0 AS value
FROM g JOIN sig a ON a.record_id = g.record_id AND a.t = g.j * {fs} // {to}
LEFT JOIN sig b ON b.record_id = g.record_id AND b.t = g.j * {fs} // {to} + 1"""


@query("WITH " + SIG + _RESAMPLE.format(fs=5, to=2))
def resample_linear(spark, sf):
    """Linear resampling to a lower rate."""
    return G.resample_linear(sig(spark, sf), 5, 2, REC).select("record_id", "t", r6("value").alias("value"))


@query("WITH " + SIG + _RESAMPLE.format(fs=2, to=3))
def resample_linear_up(spark, sf):
    """Linear resampling to a higher rate, the last value held."""
    return G.resample_linear(sig(spark, sf), 2, 3, REC).select("record_id", "t", r6("value").alias("value"))


def _bessel_sql(x):
    """The modified Bessel function of order zero, as its power series."""
    return f"list_sum(list_transform(range(0, 60), lambda k: pow(({x}) * ({x}) / 4, k) / pow(gamma(k + 1), 2)))"


def _sinc_sql(fs, target):
    """Every output as a sum over all samples within the window."""
    zeros, rolloff, beta, scale = kernels.SINC_ZEROS, kernels.SINC_ROLLOFF, kernels.SINC_BETA, min(1.0, target / fs)
    return f"""WITH {SIG}, l AS (SELECT record_id, max(t) + 1 AS n FROM sig GROUP BY 1),
o AS (SELECT record_id, unnest(range(0, n * {target} // {fs})) AS t FROM l),
w AS (SELECT o.record_id, o.t, g.value, {scale!r}::DOUBLE * (o.t * {fs / target!r}::DOUBLE - g.t) AS u FROM o JOIN sig g ON g.record_id = o.record_id
  AND abs({scale!r}::DOUBLE * (o.t * {fs / target!r}::DOUBLE - g.t)) < {zeros}),
b AS MATERIALIZED (SELECT {_bessel_sql(repr(float(beta)) + "::DOUBLE")} AS whole)
SELECT record_id, t, round(sum(value * {scale!r}::DOUBLE * {rolloff!r}::DOUBLE * CASE WHEN u = 0 THEN 1.0 ELSE sin(pi() * {rolloff!r}::DOUBLE * u) / (pi() * {rolloff!r}::DOUBLE * u) END
  * {_bessel_sql(f"{float(beta)!r}::DOUBLE * sqrt(1 - (u / {zeros}) * (u / {zeros}))")} / whole), 6) + 0.0 AS value FROM w, b GROUP BY record_id, t"""


@query(_sinc_sql(5, 2))
def resample_sinc(spark, sf):
    """Band-limited resampling in blocks."""
    return G.resample_sinc(sig(spark, sf), 5, 2, REC, block=64).select("record_id", "t", r6("value").alias("value"))


@query(_sinc_sql(3, 4))
def resample_sinc_up(spark, sf):
    """Band-limited resampling to a higher rate."""
    return G.resample_sinc(sig(spark, sf), 3, 4, REC, block=64).select("record_id", "t", r6("value").alias("value"))


_LEADS = ["click", "view", "missing", "error"]


@query(
    "WITH s AS (SELECT user_id AS record_id, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS t, event_type, max(value) AS value FROM events GROUP BY 1, 2, 3),"
    " k AS (SELECT DISTINCT record_id, t FROM s), l AS (SELECT unnest(['click', 'view', 'missing', 'error']) AS lead, unnest([0, 1, 2, 3]) AS channel)"
    " SELECT k.record_id, k.t, CAST(l.channel AS INTEGER) AS channel, coalesce(s.value, 0) AS value FROM k, l"
    " LEFT JOIN s ON s.record_id = k.record_id AND s.t = k.t AND s.event_type = l.lead"
)
def lead_fill(spark, sf):
    """Listed leads in order at every step, absent ones zero."""
    ev = table(spark, sf, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 3_600_000_000)
    rows = ev.groupBy(F.col("user_id").alias("record_id"), hour.cast("long").alias("t"), F.upper("event_type").alias("channel")).agg(F.max("value").alias("value"))
    return G.lead_fill(rows, _LEADS)


@query("WITH " + SIG + " SELECT record_id, t, value FROM sig WHERE event_type IN ('click', 'error')")
def channel_select(spark, sf):
    """Keep two channels."""
    rows = sig(spark, sf).withColumnRenamed("event_type", "channel")
    return G.select_channels(rows, ["click", "error"]).select("record_id", "t", "value")


@query(
    "WITH " + SIG + """, z AS (SELECT s.record_id, s.t, CASE WHEN s.t < s.record_id % 4 OR s.t >= n.n - s.record_id % 3 THEN 0.0 ELSE s.value END AS value, n.n
  FROM sig s JOIN (SELECT record_id, count(*) AS n FROM sig GROUP BY 1) n USING (record_id)),
c AS (SELECT record_id, count(*) FILTER (value = 0) // 2 AS cut FROM z GROUP BY 1)
SELECT z.record_id, z.t - c.cut AS t, z.value FROM z JOIN c USING (record_id) WHERE z.t >= c.cut AND z.t < z.n - c.cut"""
)
def zero_trim(spark, sf):
    """Half of the all-zero steps cut from both ends."""
    rows = sig(spark, sf).join(sig_lengths(spark, sf), "record_id")
    head = F.col("t") < F.col("record_id") % 4
    tail = F.col("t") >= F.col("data_length") - F.col("record_id") % 3
    rows = rows.withColumn("value", F.when(head | tail, 0.0).otherwise(F.col("value")))
    return G.zero_trim(rows.select("record_id", "t", "value"))


@query(
    "WITH " + SIG + """, s AS (SELECT record_id, avg(value) AS m, stddev_pop(value) AS s FROM sig GROUP BY 1)
SELECT g.record_id, g.t, round((g.value - s.m) / (s.s + 1e-8), 6) + 0.0 AS value FROM sig g JOIN s USING (record_id)"""
)
def sample_normalise(spark, sf):
    """Scale a record by its own statistics."""
    out = G.normalise_record(sig(spark, sf), REC)
    return out.select("record_id", "t", r6("value").alias("value"))


@query(
    "WITH " + SIG + """, r AS (SELECT record_id, event_type, avg(value) AS m, stddev_pop(value) AS s FROM sig GROUP BY 1, 2),
d AS (SELECT event_type, avg(m) AS m, avg(s) AS s FROM r GROUP BY 1)
SELECT g.record_id, g.t, round((g.value - d.m) / (d.s + 1e-8), 6) + 0.0 AS value FROM sig g JOIN d USING (event_type)"""
)
def dataset_normalise(spark, sf):
    """Scale channels by dataset statistics."""
    rows = sig(spark, sf).withColumnRenamed("event_type", "channel")
    stats = A.dataset_stats_simple(rows.groupBy("record_id", "channel").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))
    return G.normalise_dataset(rows, stats).select("record_id", "t", r6("value").alias("value"))


_STATS = """ SELECT user_id AS record_id, event_type AS channel, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std, count(value) AS length,
  round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) + 0.0 AS iqr FROM events GROUP BY 1, 2"""


def _stats(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("channel"), "value")
    return A.record_stats(rows)


@query(_STATS)
def record_stats(spark, sf):
    """Statistics per record and channel."""
    out = _stats(spark, sf)
    return out.select("record_id", "channel", r6("mean").alias("mean"), r6("std").alias("std"), "length", r6("median").alias("median"), r6("iqr").alias("iqr"))


_RAW = "WITH r AS (SELECT user_id, event_type AS channel, avg(value) AS m, stddev_pop(value) AS s, count(value) AS n FROM events GROUP BY 1, 2)"


@query(_RAW + " SELECT channel, round(avg(m), 6) + 0.0 AS mean, round(avg(s), 6) + 0.0 AS std FROM r GROUP BY 1")
def dataset_stats_simple(spark, sf):
    """Means of record statistics."""
    return A.dataset_stats_simple(_stats(spark, sf)).select("channel", r6("mean").alias("mean"), r6("std").alias("std"))


@query("SELECT event_type AS channel, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS std, count(value) AS length FROM events GROUP BY 1")
def dataset_stats_pooled(spark, sf):
    """Pooled statistics equal those of all samples together."""
    return A.dataset_stats_pooled(_stats(spark, sf)).select("channel", r6("mean").alias("mean"), r6("std").alias("std"), "length")


_KINDS = ["click", "error", "purchase", "signup", "view"]
_EPOCH = SIG + ", e AS (SELECT record_id, t // 10 AS epoch, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS cls FROM sig)"


def _epochs(spark, sf, mode):
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    rows = sig(spark, sf).withColumn("label", (F.array_position(kinds, F.col("event_type")) - 1).cast("int"))
    return C.segment_labels(rows, list(range(5)), 10, mode)


@query(
    "WITH " + _EPOCH + """, n AS (SELECT record_id, epoch, cls, count(*) AS n FROM e GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY record_id, epoch ORDER BY n DESC, cls) AS rn FROM n)
SELECT record_id, epoch, CAST(cls AS INTEGER) AS label FROM r WHERE rn = 1"""
)
def epoch_majority(spark, sf):
    """Majority class per ten steps."""
    return _epochs(spark, sf, "majority")


@query(
    "WITH " + _EPOCH + """ SELECT record_id, epoch, CAST(c.cls AS INTEGER) AS cls, round(count(*) FILTER (e.cls = c.cls) / count(*), 6) AS fraction,
  CAST(count(*) FILTER (e.cls = c.cls) > 0 AS DOUBLE) AS present FROM e, (SELECT unnest([0, 1, 2, 3, 4]) AS cls) c GROUP BY 1, 2, 3"""
)
def epoch_fraction(spark, sf):
    """Class fractions and presence per ten steps."""
    fraction = _epochs(spark, sf, "fraction").select("record_id", "epoch", F.posexplode("label").alias("cls", "fraction"))
    present = _epochs(spark, sf, "presence").select("record_id", "epoch", F.posexplode("label").alias("cls", "present"))
    return fraction.withColumn("fraction", r6("fraction")).join(present, ["record_id", "epoch", "cls"])


_STRIDED = SIG + ", " + _CHUNKS.format(step=5, size=10, least=10) + (
    ", placed AS (SELECT c.record_id, g.t AS pos, g.value * (1 + c.chunk / 100.0) AS value FROM chunks c"
    " JOIN sig g ON g.record_id = c.record_id AND g.t >= c.start_idx AND g.t < c.end_idx)"
)


def _strided(spark, sf):
    """Chunks with one value list each, scaled by the chunk number."""
    chunks = C.chunk_index(sig_lengths(spark, sf), chunk_length=10, stride=5, min_chunk_length=10).select("record_id", "chunk", "start_idx", "end_idx")
    rows = C.take_samples(sig(spark, sf), chunks, block=64)
    cells = F.array_sort(F.collect_list(F.struct("rel", (F.col("value") * (1 + F.col("chunk") / 100.0)).alias("v"))))
    return rows.groupBy("record_id", "chunk").agg(F.transform(cells, lambda x: x["v"]).alias("values"))


@query("WITH " + _STRIDED + " SELECT record_id, pos, round(avg(value), 6) + 0.0 AS value FROM placed GROUP BY 1, 2")
def stitch_overlap(spark, sf):
    """Overlapping chunk predictions averaged per position."""
    return A.stitch_overlap(_strided(spark, sf), REC, 5).select("record_id", "pos", r6("value").alias("value"))


@query(
    "WITH " + _STRIDED + """, a AS (SELECT record_id, pos, avg(value) AS value FROM placed GROUP BY 1, 2)
SELECT record_id, pos, round(value, 6) + 0.0 AS value, count(*) OVER (PARTITION BY record_id) AS length FROM a"""
)
def feature_export(spark, sf):
    """M3: averaged features with the record's feature length."""
    return export_features(_strided(spark, sf), REC, 5).select("record_id", "pos", r6("value").alias("value"), "length")


@query(
    "WITH " + SIG + ", " + _CHUNKS.format(step=5, size=10, least=10)
    + """ SELECT c.record_id, c.chunk * 10 + g.t - c.start_idx AS pos, round(g.value * (1 + c.chunk / 100.0), 6) + 0.0 AS value,
  count(*) OVER (PARTITION BY c.record_id) AS length FROM chunks c JOIN sig g ON g.record_id = c.record_id AND g.t >= c.start_idx AND g.t < c.end_idx"""
)
def feature_concat(spark, sf):
    """M3: chunk features laid end to end."""
    return export_features(_strided(spark, sf), REC).select("record_id", "pos", r6("value").alias("value"), "length")


_WEIGHTS = _CHUNKS.format(step=20, size=20, least=4) + ", k AS (SELECT *, record_id % 3 AS cls, end_idx - start_idx AS len FROM chunks)"


@query(
    "WITH " + _WEIGHTS + """, w AS (SELECT record_id, chunk, len / (sum(len) OVER (PARTITION BY cls)) * CASE cls WHEN 0 THEN 1.0 WHEN 1 THEN 2.5 ELSE 0.5 END AS w FROM k)
SELECT record_id, chunk, round(w / min(w) OVER (), 6) + 0.0 AS weight FROM w"""
)
def sampling_weights(spark, sf):
    """Class weight times the share of the class duration."""
    chunks = C.chunk_index(sig_lengths(spark, sf), chunk_length=20, min_chunk_length=4).withColumn("cls", F.col("record_id") % 3)
    out = R.sampling_weights(chunks, "cls", {0: 1.0, 1: 2.5, 2: 0.5}, total_by="cls")
    return out.select("record_id", "chunk", r6("weight").alias("weight"))


@query("WITH " + _WEIGHTS + " SELECT cls, CAST(sum(len) AS BIGINT) AS duration FROM k GROUP BY 1")
def class_duration(spark, sf):
    """Total chunk length per class."""
    chunks = C.chunk_index(sig_lengths(spark, sf), chunk_length=20, min_chunk_length=4).withColumn("cls", F.col("record_id") % 3)
    return A.duration_by(chunks, ["cls"])


@query(
    "WITH " + SIG + ", " + _CHUNKS.format(step=13, size=13, least=8)
    + """, a AS (SELECT record_id, t, max(event_type) AS mark FROM (SELECT record_id, t // 2 AS t, event_type FROM sig) GROUP BY 1, 2),
s AS (SELECT record_id, start_idx + (end_idx - start_idx - 8) // 2 AS b FROM chunks),
k AS (SELECT record_id, b, CAST(round_even(b * 0.5, 0) AS BIGINT) AS lo FROM s)
SELECT k.record_id, k.b AS crop_start, a.t, a.mark FROM k JOIN a ON a.record_id = k.record_id AND a.t >= k.lo AND a.t < k.lo + 4"""
)
def annotation_align(spark, sf):
    """Labels at half rate matched to crops."""
    notes = sig(spark, sf).withColumn("t", F.floor(F.col("t") / 2)).groupBy("record_id", "t").agg(F.max("event_type").alias("mark"))
    chunks = C.chunk_index(sig_lengths(spark, sf), chunk_length=13, min_chunk_length=8).drop("data_length")
    crops = C.center_crop(chunks, 8)
    lo, hi = C.annotation_span(0.5, 8)
    spans = crops.select("record_id", F.col("start_idx").alias("crop_start"), lo.alias("start_idx"), hi.alias("end_idx"))
    return C.take_samples(notes, spans, block=64).select("record_id", "crop_start", "t", "mark")


@query(
    "WITH " + _CHUNKS.format(step=16, size=16, least=9)
    + " SELECT record_id, CAST(count(*) * 2 AS BIGINT) AS crops, true AS inside, true AS repeatable FROM chunks GROUP BY 1"
)
def random_crop_contract(spark, sf):
    """T5: every crop lies inside its chunk and is drawn again alike."""
    chunks = C.chunk_index(sig_lengths(spark, sf), chunk_length=16, min_chunk_length=9).drop("data_length")
    bounds = chunks.select("record_id", "chunk", F.col("start_idx").alias("lo"), F.col("end_idx").alias("hi"))
    crops = C.random_crop(chunks, 9, ["record_id"], 42, items=2)
    again = C.random_crop(chunks.repartition(3), 9, ["record_id"], 42, items=2)
    again = again.select("record_id", "chunk", "item", F.col("start_idx").alias("again"))
    joined = crops.join(bounds, ["record_id", "chunk"]).join(again, ["record_id", "chunk", "item"])
    inside = (F.col("start_idx") >= F.col("lo")) & (F.col("end_idx") <= F.col("hi")) & (F.col("end_idx") - F.col("start_idx") == 9)
    return joined.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("crops"), F.bool_and(inside).alias("inside"), F.bool_and(F.col("start_idx") == F.col("again")).alias("repeatable")
    )


@query(
    "WITH RECURSIVE " + SIG + """, k AS (SELECT tan(pi() * 10 / 50) AS k),
c AS (SELECT k * k / (1 + sqrt(2) * k + k * k) AS b0, 2 * (k * k - 1) / (1 + sqrt(2) * k + k * k) AS a1, (1 - sqrt(2) * k + k * k) / (1 + sqrt(2) * k + k * k) AS a2 FROM k),
f AS (SELECT record_id, t, c.b0 * value AS y, CAST(0 AS DOUBLE) AS y1, value AS x, CAST(0 AS DOUBLE) AS x1 FROM sig, c WHERE t = 0
  UNION ALL SELECT s.record_id, s.t, c.b0 * (s.value + 2 * f.x + f.x1) - c.a1 * f.y - c.a2 * f.y1, f.y, s.value, f.x
  FROM f JOIN sig s ON s.record_id = f.record_id AND s.t = f.t + 1, c)
SELECT record_id, t, round(y, 6) + 0.0 AS value FROM f"""
)
def lowpass_causal(spark, sf):
    """Causal low-pass of second order, block by block."""
    out = G.butter_filter(sig(spark, sf), 50.0, high=10.0, order=2, zero_phase=False, by=REC, block=32)
    return out.select("record_id", "t", r6("value").alias("value"))


@query("SELECT count(*) AS n, true AS repeatable, true AS centred FROM events")
def noise_contract(spark, sf):
    """Noise has zero mean and the drawn spread, and is drawn again alike."""
    rows = sig(spark, sf)
    noisy = rows.withColumn("a", G.gaussian_noise("value", 0.1, 7, ["record_id", "t"]) - F.col("value"))
    again = rows.repartition(5).select("record_id", "t", (G.gaussian_noise("value", 0.1, 7, ["record_id", "t"]) - F.col("value")).alias("b"))
    both = noisy.join(again, ["record_id", "t"])
    near = (F.abs(F.avg("a")) < 0.02) & (F.abs(F.stddev_pop("a") - 0.1) < 0.02)
    return both.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("a") == F.col("b")).alias("repeatable"), near.alias("centred"))


@query()
def bandpass(spark, sf):
    """Zero-phase band-pass, block by block."""
    out = G.butter_filter(sig(spark, sf), 50.0, low=2.0, high=12.0, order=3, by=REC, block=256)
    return out.select("record_id", "t", r6("value").alias("value"))


_SPECTRUM = """, n AS (SELECT record_id, max(t) AS last FROM sig GROUP BY 1),
padded AS (SELECT record_id, t + 16 AS p, value FROM sig
  UNION ALL SELECT record_id, 16 - t, value FROM sig WHERE t BETWEEN 1 AND 16
  UNION ALL SELECT s.record_id, 2 * n.last + 16 - s.t, s.value FROM sig s JOIN n USING (record_id) WHERE s.t < n.last AND s.t >= n.last - 16),
spread AS (SELECT record_id, p // 16 - h AS frame, p - (p // 16 - h) * 16 AS i, value FROM padded, (SELECT unnest([0, 1]) AS h)),
framed AS (SELECT s.record_id, s.frame, s.i, s.value - avg(s.value) OVER (PARTITION BY s.record_id, s.frame) AS x FROM spread s JOIN n USING (record_id)
  WHERE s.frame >= 0 AND s.frame * 16 + 32 <= n.last + 33),
bins AS (SELECT unnest(range(0, 17)) AS bin),
sums AS (SELECT record_id, frame, bin, sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 32)) * cos(2 * pi() * i * bin / 32)) AS re,
  sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 32)) * sin(2 * pi() * i * bin / 32)) AS im FROM framed, bins GROUP BY 1, 2, 3)
SELECT record_id, frame, CAST(bin AS INTEGER) AS bin,
  round(20 * log10((re * re + im * im) * CASE WHEN bin BETWEEN 1 AND 15 THEN 2 ELSE 1 END / (50.0 * 12.0) + 2.220446049250313e-16), 4) + 0.0 AS power FROM sums"""


@query("WITH " + SIG + _SPECTRUM)
def spectrogram(spark, sf):
    """Short-time spectrum of every record."""
    out = G.spectrogram(sig(spark, sf), 50.0, size=32, overlap=16, by=REC, frames_per_block=4)
    return out.select("record_id", "frame", F.posexplode("power").alias("bin", "power")).withColumn("power", r6("power", 4))


def _unit_sql(seed):
    return f"({hash_sql(seed, 'record_id', 't')} % 4503599627370496) / 4503599627370496.0::DOUBLE"


@query(
    "WITH " + SIG + f""" SELECT record_id, t, value,
  round(value + 0.1::DOUBLE * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_unit_sql(7)})) * cos(2 * pi() * {_unit_sql(8)}), 6) + 0.0 AS noisy FROM sig"""
)
def noise(spark, sf):
    """Seeded Gaussian noise."""
    out = sig(spark, sf).withColumn("noisy", G.gaussian_noise("value", 0.1, 7, ["record_id", "t"]))
    return out.select("record_id", "t", "value", r6("noisy").alias("noisy"))
