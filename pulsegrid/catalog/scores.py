"""Queries on metrics, bootstrap intervals and model-facing jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.base import KNOWN, LENGTHS, PRED, SIG, hash_sql, pred, query, r6, sig_lengths, table
from pulsegrid.operators import aggregates as A
from pulsegrid.operators import bootstrap as B
from pulsegrid.operators import metrics as M
from pulsegrid.operators import scoring as S
from pulsegrid.session import scratch_path
from pulsegrid.sources import sinks

_AUC = (
    ", pairs AS (SELECT a.label, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS value"
    " FROM known a JOIN known b ON a.label = b.label AND a.target = 1 AND b.target = 0 GROUP BY a.label)"
)


@query("WITH " + KNOWN + _AUC + " SELECT label, round(value, 6) + 0.0 AS auroc FROM pairs")
def auroc(spark, sf):
    """Area under the ROC per class."""
    return M.auroc(pred(spark, sf)).select("label", r6("value").alias("auroc"))


@query(
    "WITH " + KNOWN + _AUC + """ SELECT round((SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)
  FROM known a, known b WHERE a.target = 1 AND b.target = 0), 6) + 0.0 AS micro, round((SELECT (sum(value) + 0.5) / 3 FROM pairs), 6) + 0.0 AS macro"""
)
def auroc_micro_macro(spark, sf):
    """Pooled area, and the mean with an undefined class as one half."""
    rows = pred(spark, sf)
    empty = rows.where("label = 'toxic'").withColumns({"label": F.lit("none"), "target": F.when(F.col("target").isNotNull(), 0)})
    per_label = M.auroc(rows.unionByName(empty))
    micro = M.auroc(rows, [])
    return micro.select(r6("value").alias("micro"), r6(M.macro(per_label).scalar()).alias("macro"))


_CURVE = (
    ", s AS (SELECT label, score, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM known GROUP BY 1, 2),"
    " cum AS (SELECT label, score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY label) AS pp, sum(n) OVER (PARTITION BY label) AS nn"
    " FROM s WINDOW w AS (PARTITION BY label ORDER BY score DESC))"
)


@query("WITH " + KNOWN + _CURVE + " SELECT label, round(sum(p * tp / (tp + fp)) / max(pp), 6) + 0.0 AS ap FROM cum GROUP BY label")
def avg_precision(spark, sf):
    """Uninterpolated average precision per class."""
    return M.average_precision(pred(spark, sf)).select("label", r6("value").alias("ap"))


@query(
    "WITH " + KNOWN + """, s AS (SELECT score, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM known GROUP BY 1),
cum AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM s WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(p * tp / (tp + fp)) / sum(p), 6) + 0.0 AS micro FROM cum"""
)
def avg_precision_micro(spark, sf):
    """Average precision over all pooled cells."""
    return M.average_precision(pred(spark, sf), []).select(r6("value").alias("micro"))


@query(
    "WITH " + KNOWN + _CURVE
    + """ SELECT label, round(score, 6) AS threshold, round(fp / nn, 6) + 0.0 AS fpr, round(tp / pp, 6) + 0.0 AS tpr, round(tp / (tp + fp), 6) + 0.0 AS precision FROM cum"""
)
def roc_points(spark, sf):
    """E5: curve points per threshold."""
    out = M.curve_points(pred(spark, sf))
    return out.select("label", *[r6(c).alias(c) for c in ("threshold", "fpr", "tpr", "precision")])


@query(
    "WITH " + KNOWN + _CURVE + """,
pts AS (SELECT label, fp / nn AS x, tp / pp AS y FROM cum UNION ALL SELECT DISTINCT label, 0.0, 0.0 FROM cum),
u AS (SELECT label, x, min(y) AS lo, max(y) AS hi FROM pts GROUP BY 1, 2),
grid AS (SELECT g.x, l.label FROM (SELECT DISTINCT x FROM u) g, (SELECT DISTINCT label FROM u) l),
near AS (SELECT g.x, g.label, max_by(u.x, u.x) FILTER (u.x <= g.x) AS x0, max_by(u.hi, u.x) FILTER (u.x <= g.x) AS y0,
  min_by(u.x, u.x) FILTER (u.x > g.x) AS x1, min_by(u.lo, u.x) FILTER (u.x > g.x) AS y1 FROM grid g JOIN u USING (label) GROUP BY 1, 2)
SELECT round(x, 6) + 0.0 AS fpr, round(avg(CASE WHEN x = x0 OR x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END), 6) + 0.0 AS tpr FROM near GROUP BY near.x"""
)
def macro_roc(spark, sf):
    """Mean ROC curve over classes at all false-positive rates."""
    return M.macro_roc(pred(spark, sf)).select(r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


def _prices(spark, sf):
    rows = table(spark, sf, "lineitem")
    target = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 1000)
    return rows.select("l_orderkey", F.col("l_returnflag").alias("label"), target.alias("target"), (F.col("l_quantity") * 1.5).alias("score"))


_PRICES = "price AS (SELECT l_returnflag AS label, CASE WHEN l_linenumber <> 3 THEN l_extendedprice / 1000 END AS y, l_quantity * 1.5 AS z FROM lineitem)"
_R2 = "round(avg(abs(y - z)), 6) + 0.0 AS mae, round(1 - sum((y - z) * (y - z)) / (count(y) * var_pop(y)), 6) + 0.0 AS r2"


@query(
    "WITH " + _PRICES + f" SELECT label, {_R2} FROM (SELECT label, y, CASE WHEN y IS NOT NULL THEN z END AS z FROM price) GROUP BY label "
    f"UNION ALL SELECT 'pooled', {_R2} FROM (SELECT y, CASE WHEN y IS NOT NULL THEN z END AS z FROM price)"
)
def mae_r2(spark, sf):
    """Absolute error and R2 per target and pooled."""
    rows = _prices(spark, sf)
    per_label = M.regression_errors(rows)
    pooled = M.regression_errors(rows, []).withColumn("label", F.lit("pooled"))
    return per_label.unionByName(pooled).select("label", r6("mae").alias("mae"), r6("r2").alias("r2"))


@query(
    "WITH " + _PRICES + """, p AS (SELECT label, avg(abs(y - z)) AS mae, 1 - count(y) / count(*) AS nulls FROM price GROUP BY 1)
SELECT label, round(mae, 6) AS mae, round(nulls, 6) AS null_fraction, round(avg(mae) OVER (), 6) AS mae_mean, round(sum(mae) OVER (), 6) AS mae_sum FROM p"""
)
def mae_sum_nullfrac(spark, sf):
    """Errors with null shares, mean and sum; the first quantile is scored."""
    rows = _prices(spark, sf).withColumn("score", F.array("score", F.col("score") - 1, F.col("score") + 1))
    per_label, overall = M.mae_summary(rows)
    both = overall.select(F.struct(r6("mae_mean").alias("a"), r6("mae_sum").alias("b")).alias("s")).scalar()
    return per_label.select(
        "label", r6("mae").alias("mae"), r6("null_fraction").alias("null_fraction"),
        both["a"].alias("mae_mean"), both["b"].alias("mae_sum"),
    )


def _status(spark, sf):
    """Three class scores per order, with the status as truth."""
    names = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    cells = F.posexplode(names).alias("label", "name")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", cells)
    return rows.select(
        F.col("o_orderkey").alias("sample_id"), "label",
        (F.col("name") == F.col("o_orderstatus")).cast("int").alias("target"),
        (((F.col("o_orderkey") * 31 + F.col("label") * 17) % 101) / 101.0).alias("score"),
    )


_CLASSES = (
    "s AS (SELECT o_orderkey, list_position(['F', 'O', 'P'], o_orderstatus) - 1 AS t, (o_orderkey * 31) % 101 AS a,"
    " (o_orderkey * 31 + 17) % 101 AS b, (o_orderkey * 31 + 34) % 101 AS c FROM orders),"
    " classes AS (SELECT o_orderkey, t, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS p FROM s)"
)


@query(
    "WITH " + _CLASSES + """, k AS (SELECT unnest([0, 1, 2]) AS label),
c AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t = label AND p <> label) AS fn, count(*) FILTER (t <> label AND p = label) AS fp FROM classes, k GROUP BY 1)
SELECT CAST(label AS INTEGER) AS label, round(5 * tp / (5 * tp + 4 * fn + fp), 6) + 0.0 AS f2, round(avg(5 * tp / (5 * tp + 4 * fn + fp)) OVER (), 6) + 0.0 AS macro FROM c"""
)
def fbeta(spark, sf):
    """F2 per class with the macro mean."""
    scores = M.fbeta(M.argmax_classes(_status(spark, sf)), 2.0)
    mean = M.macro(scores).scalar()
    return scores.select("label", r6("value").alias("f2"), r6(mean).alias("macro"))


@query("WITH " + _CLASSES + " SELECT round(avg(CAST(t = p AS DOUBLE)), 6) AS accuracy FROM classes")
def accuracy(spark, sf):
    """Share of matching classes."""
    return M.accuracy(M.argmax_classes(_status(spark, sf))).select(r6("value").alias("accuracy"))


_THRESH = """, c AS (SELECT label, {t} AS threshold, count(*) FILTER (target = 1 AND score > {t}) AS tp, count(*) FILTER (target = 1 AND score <= {t}) AS fn,
  count(*) FILTER (target = 0 AND score > {t}) AS fp, count(*) FILTER (target = 0 AND score <= {t}) AS tn FROM {src} GROUP BY label{extra})
SELECT label, round(threshold, 6) AS threshold, round(tp / (tp + fn), 6) + 0.0 AS sensitivity, round(tn / (tn + fp), 6) + 0.0 AS specificity,
  round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) + 0.0 AS mcc,
  round(tp / (tp + fn) + tn / (tn + fp) - 1, 6) + 0.0 AS youden FROM c"""


@query("WITH " + KNOWN + _THRESH.format(t="CASE label WHEN 'quality' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END", src="known", extra=""))
def sens_spec_mcc(spark, sf):
    """Threshold metrics at given thresholds."""
    out = M.threshold_metrics(pred(spark, sf), {"quality": 0.4, "toxic": 0.6})
    return out.select("label", *[r6(c).alias(c) for c in ("threshold", "sensitivity", "specificity", "mcc", "youden")])


@query(
    "WITH " + KNOWN + ", c AS (SELECT label, avg(CAST(score > 0.5 AS DOUBLE)) FILTER (target = 1) AS sens, avg(CAST(score <= 0.5 AS DOUBLE)) FILTER (target = 0) AS spec FROM known GROUP BY label)"
    " SELECT label, round(sens + spec - 1, 6) + 0.0 AS youden, round(avg(sens + spec - 1) OVER (), 6) + 0.0 AS macro FROM c"
)
def youden_macro(spark, sf):
    """Youden index per label and its mean over labels."""
    out = M.METRICS["youden"].fn(pred(spark, sf))
    return out.select("label", r6("value").alias("youden"), r6(M.macro(out, undefined=None).scalar()).alias("macro"))


@query()
def youden_intervals(spark, sf):
    """Seeded interval of the Youden index at one half."""
    bounds, _ = B.empirical_interval(pred(spark, sf), M.METRICS["youden"].fn, replicates=200, seed=5)
    return bounds.select("label", *[r6(c).alias(c) for c in ("value", "low", "high")], "nulls")


@query(
    "WITH " + KNOWN + _CURVE + """, e AS (SELECT label, fp / nn AS fpr, tp / pp AS tpr, tp / (tp + fp) AS precision FROM cum
  UNION ALL SELECT DISTINCT label, 0.0, 0.0, 1.0 FROM cum)
SELECT label, round(fpr, 6) + 0.0 AS fpr, round(tpr, 6) + 0.0 AS tpr, round(precision, 6) + 0.0 AS precision FROM e"""
)
def curve_ends(spark, sf):
    """E5: curve points with the ends where nothing is found."""
    out = M.curve_points(pred(spark, sf), ends=True)
    return out.select("label", *[r6(c).alias(c) for c in ("fpr", "tpr", "precision")])


_SENS = (
    ", g AS (SELECT DISTINCT label, score AS t FROM known), m AS (SELECT g.label, g.t, count(*) FILTER (k.target = 1 AND k.score > g.t) / count(*) FILTER (k.target = 1) AS sens,"
    " count(*) FILTER (k.target = 0 AND k.score <= g.t) / count(*) FILTER (k.target = 0) AS spec FROM g JOIN known k USING (label) GROUP BY 1, 2)"
)


@query(
    "WITH " + KNOWN + _SENS + """ SELECT label, round(coalesce(max(t) FILTER (sens > 0.9), -1), 6) AS sens_above, round(coalesce(min(t) FILTER (spec > 0.8), -1), 6) AS spec_above,
  round(coalesce(min(t) FILTER (sens < 0.5), -1), 6) AS sens_below, round(coalesce(max(t) FILTER (spec < 0.3), -1), 6) AS spec_below,
  round(coalesce(max(t) FILTER (sens > 1.5), -1), 6) + 0.0 AS never FROM m GROUP BY label"""
)
def threshold_search(spark, sf):
    """Thresholds meeting a goal from the right side; -1 when none does."""
    rows = pred(spark, sf)
    goals = {
        "sens_above": (0.9, "sensitivity", True), "spec_above": (0.8, "specificity", True),
        "sens_below": (0.5, "sensitivity", False), "spec_below": (0.3, "specificity", False), "never": (1.5, "sensitivity", True),
    }
    out = M.threshold_searches(rows, goals)
    return out.select("label", *[r6(name).alias(name) for name in goals])


@query(
    "WITH " + KNOWN + _SENS + ", best AS (SELECT label, max(t) FILTER (sens > 0.8) AS best FROM m GROUP BY label), joined AS (SELECT k.*, b.best FROM known k JOIN best b USING (label))"
    + _THRESH.format(t="best", src="joined", extra=", best")
)
def threshold_apply(spark, sf):
    """Metrics at searched thresholds."""
    rows = pred(spark, sf)
    out = M.threshold_metrics(rows, M.threshold_search(rows, 0.8))
    return out.select("label", *[r6(c).alias(c) for c in ("threshold", "sensitivity", "specificity", "mcc", "youden")])


_GRID = [i / 20 for i in range(21)]
_SAMPLE = KNOWN + (
    ", g AS (SELECT unnest(range(0, 21)) / 20.0::DOUBLE AS threshold), s AS (SELECT sample_id, threshold, count(*) FILTER (target = 1 AND score >= threshold) AS tp,"
    " count(*) FILTER (target = 0 AND score >= threshold) AS fp, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM known, g GROUP BY 1, 2),"
    " a AS (SELECT threshold, avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END) AS precision, avg(CASE WHEN p > 0 THEN tp / p END) AS recall,"
    " avg(CASE WHEN n > 0 THEN fp / n END) AS fpr, avg(CAST(tp + fp > 0 AS DOUBLE)) AS coverage FROM s GROUP BY 1)"
)


@query(
    "WITH " + _SAMPLE + """ SELECT threshold, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(fpr, 6) + 0.0 AS fpr,
  round(coverage, 6) + 0.0 AS coverage, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END, 6) + 0.0 AS f FROM a"""
)
def sample_centric(spark, sf):
    """Per-sample ratios averaged at each threshold."""
    out = M.sample_centric(pred(spark, sf), _GRID)
    return out.select("threshold", *[r6(c).alias(c) for c in ("precision", "recall", "fpr", "coverage", "f")])


@query(
    "WITH " + _SAMPLE + """, f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f,
  lead(recall) OVER w AS r2, lead(fpr) OVER w AS x2, lead(threshold) OVER w AS t2 FROM a WINDOW w AS (ORDER BY threshold)),
b AS (SELECT * FROM f WHERE f IS NOT NULL ORDER BY f DESC, threshold LIMIT 1)
SELECT round(b.f, 6) AS fmax, round(b.precision, 6) AS precision_at_fmax, round(b.recall, 6) AS recall_at_fmax, round(b.threshold, 6) AS threshold_at_fmax, round(b.coverage, 6) AS coverage_at_fmax,
  (SELECT round(sum((fpr - x2) * (recall + r2) / 2), 6) + 0.0 FROM f) AS sample_auc,
  (SELECT round(sum((recall - r2) * CASE WHEN t2 IS NULL THEN 1.0 ELSE precision END), 6) + 0.0 FROM f) AS sample_apr FROM b"""
)
def sample_centric_fmax(spark, sf):
    """Best F with its row and the two sample areas."""
    out = M.fmax(M.sample_centric(pred(spark, sf), _GRID))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "WITH " + KNOWN + _AUC + ", " + _PRICES
    + " SELECT round(1 - (SELECT avg(value) FROM pairs) + (SELECT avg(abs(y - z)) FROM price), 6) AS composite"
)
def composite(spark, sf):
    """Inverted macro area plus pooled absolute error."""
    value = M.composite(M.auroc(pred(spark, sf)), M.mae(_prices(spark, sf), []))
    return value.select(r6("value").alias("composite"))


_BCE = "((1 - target) * x + (1 + ({w} - 1) * target) * (greatest(-x, 0) + ln(1 + exp(-abs(x)))))"


@query(
    "WITH " + KNOWN + ", l AS (SELECT label, target, score * 4 - 2 AS x FROM known), p AS (SELECT *, "
    + _BCE.format(w="2.0") + " AS b, 1 / (1 + exp(-x)) AS p FROM l) SELECT label, round(avg(b), 6) AS bce, "
    "round(avg(pow(1 - (p * target + (1 - p) * (1 - target)), 2) * b), 6) AS focal_bce, round(avg((x - target) * (x - target)), 6) AS mse FROM p GROUP BY label"
)
def logloss_family(spark, sf):
    """Weighted and focal cross entropy and squared error per label."""
    rows = pred(spark, sf).withColumn("logit", F.col("score") * 4 - 2)
    out = M.masked_losses(rows, pos_weight=2.0)
    return out.select("label", *[r6(c).alias(c) for c in ("bce", "focal_bce", "mse")])


@query(
    "WITH " + _CLASSES + """, x AS (SELECT t, a / 25.0 AS a, b / 25.0 AS b, c / 25.0 AS c FROM s),
l AS (SELECT CASE t WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 0.5 END AS w, ln(exp(a) + exp(b) + exp(c)) - CASE t WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS ce FROM x)
SELECT round(sum(w * ce) / sum(w), 6) AS ce, round(avg(pow(1 - exp(-ce), 2) * w * ce), 6) AS focal_ce FROM l"""
)
def class_losses(spark, sf):
    """Class-weighted and focal multi-class cross entropy."""
    scores = F.array(*[((F.col("o_orderkey") * 31 + 17 * i) % 101) / 25.0 for i in range(3)])
    names = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    rows = table(spark, sf, "orders").select(scores.alias("scores"), (F.array_position(names, F.col("o_orderstatus")) - 1).alias("target"))
    out = M.class_losses(rows, 2.0, [1.0, 2.0, 0.5])
    return out.select(r6("ce").alias("ce"), r6("focal_ce").alias("focal_ce"))


@query(
    "WITH " + _PRICES + """, e AS (SELECT label, y - z AS a, y - (z - 5) AS b, y - (z + 5) AS c FROM price)
SELECT label, round(avg(greatest(-0.5 * a, 0.5 * a) + greatest(-0.975 * b, 0.025 * b) + greatest(-0.025 * c, 0.975 * c)), 6) AS pinball FROM e GROUP BY label"""
)
def pinball_loss(spark, sf):
    """Summed quantile loss of three predicted quantiles."""
    rows = _prices(spark, sf)
    scores = F.array("score", F.col("score") - 5, F.col("score") + 5)
    loss = F.when(F.col("target").isNotNull(), M.pinball(scores, F.col("target"), [0.5, 0.025, 0.975]))
    return rows.groupBy("label").agg(r6(F.avg(loss)).alias("pinball"))


@query(
    "WITH " + KNOWN + _AUC + """ SELECT 'val_auroc_' || label || '_agg_test0' AS metric, round(value, 6) + 0.0 AS value FROM pairs
UNION ALL SELECT 'val_auroc_' || label || '_agg_test0_nans', 0.0 FROM pairs"""
)
def metric_report(spark, sf):
    """Names and values of a report."""
    values = M.auroc(pred(spark, sf)).withColumn("nulls", F.lit(0))
    out = M.metric_report(values, "auroc", "test", aggregation="mean", prefix="val")
    return out.withColumn("value", r6("value"))


@query(
    "WITH p AS (SELECT l_suppkey AS epoch, avg(l_discount) AS v FROM lineitem GROUP BY 1)"
    " SELECT max_by(epoch, v) AS best_max, round(max(v), 6) AS value_max, min_by(epoch, v) AS best_min, round(min(v), 6) AS value_min FROM p"
)
def best_run(spark, sf):
    """Best run by a monitored value, direction from its name."""
    base = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("epoch")).agg(F.avg("l_discount").alias("value"))
    log = base.withColumn("metric", F.explode(F.array(F.lit("macro_auc_agg_val0"), F.lit("mae_agg_val0"))))
    top, low = M.best_run(log, "macro_auc_agg_val0"), M.best_run(log, "mae_agg_val0")
    pair = top.select(F.struct("epoch", "value").alias("s")).scalar()
    return low.select(
        pair["epoch"].alias("best_max"), r6(pair["value"]).alias("value_max"),
        F.col("epoch").alias("best_min"), r6("value").alias("value_min"),
    )


@query(
    """SELECT user_id AS record_id, event_type AS label, round(avg(value), 6) + 0.0 AS score, max(value) AS top, CAST(user_id % 2 AS DOUBLE) AS target FROM events GROUP BY 1, 2"""
)
def agg_predictions(spark, sf):
    """Mean and maximum per record, targets must agree."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("record_id"), F.col("event_type").alias("label"), F.col("value").alias("score"), (F.col("user_id") % 2).alias("target")
    )
    mean = A.aggregate_predictions(rows)
    top = A.aggregate_predictions(rows, how="max", target=None).withColumnRenamed("score", "top")
    return mean.withColumn("score", r6("score")).join(top, ["record_id", "label"])


def _sliced_auroc(rows, by, weight=None):
    return M.auroc(rows, by, weight, slice_by=B.score_slice(descending=True))


@query()
def bootstrap_auroc(spark, sf):
    """Seeded interval of the area per class."""
    bounds, _ = B.empirical_interval(pred(spark, sf), B.AUROC, replicates=1000, seed=42)
    return bounds.select("label", *[r6(c).alias(c) for c in ("value", "low", "high")], "nulls")


@query("WITH " + KNOWN + _AUC + " SELECT label, round(value, 6) + 0.0 AS value, true AS inside, CAST(0 AS BIGINT) AS nulls FROM pairs")
def bootstrap_contract(spark, sf):
    """The point value lies inside its interval."""
    bounds, _ = B.empirical_interval(pred(spark, sf), B.AUROC, replicates=1000, seed=42)
    return bounds.select("label", r6("value").alias("value"), F.col("value").between(F.col("low"), F.col("high")).alias("inside"), "nulls")


@query("SELECT CAST(r AS INTEGER) AS replicate, (SELECT count(*) FROM documents) AS drawn, true AS known FROM (SELECT unnest(range(0, 1000)) AS r)")
def draw_contract(spark, sf):
    """O3: every replicate draws as many rows as there are samples."""
    samples = pred(spark, sf).select("sample_id").distinct()
    known = samples.withColumn("known", F.lit(True))
    return B.sample_weights(samples, 1000, 42).join(known, "sample_id", "left").groupBy("replicate").agg(
        F.sum("weight").cast("long").alias("drawn"), F.bool_and(F.col("known").isNotNull()).alias("known")
    )


@query(
    "WITH " + KNOWN + _AUC + " SELECT label, round(2 * value - 1, 6) + 0.0 AS value, true AS inside FROM pairs"
)
def paired_contract(spark, sf):
    """The difference of a score and its reverse is twice the area less one."""
    rows = pred(spark, sf)
    bounds, _ = B.empirical_interval(rows, B.AUROC, replicates=1000, seed=42, other=rows.withColumn("score", 1.0 - F.col("score")))
    return bounds.select("label", r6("value").alias("value"), F.col("value").between(F.col("low"), F.col("high")).alias("inside"))


@query()
def bootstrap_paired(spark, sf):
    """Interval of the difference of two scores on the same draws."""
    rows = pred(spark, sf)
    other = rows.withColumn("score", 1.0 - F.col("score"))
    bounds, _ = B.empirical_interval(rows, B.AUROC, replicates=1000, seed=42, other=other)
    return bounds.select("label", *[r6(c).alias(c) for c in ("value", "low", "high")], "nulls")


@query()
def bootstrap_mae(spark, sf):
    """Seeded interval of the pooled absolute error."""
    rows = pred(spark, sf)
    bounds, _ = B.empirical_interval(rows, B.MAE, by=(), replicates=1000, seed=1)
    return bounds.select(*[r6(c).alias(c) for c in ("value", "low", "high")], "nulls")


@query()
def bootstrap_poisson(spark, sf):
    """Approximate replicates from independent weights, as mean and spread."""
    rows = pred(spark, sf)
    weights = B.poisson_weights(rows.select("sample_id").distinct(), "sample_id", 1000, 42)
    repeated = _sliced_auroc(rows.join(weights, "sample_id"), ["replicate", "label"], "weight")
    return repeated.groupBy("label").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("spread"))


@query(
    "WITH " + PRED + " SELECT CAST(e AS INTEGER) AS epoch, label AS metric, label || '_auc_noagg_test0' AS logged_metric, CAST(1000 AS BIGINT) AS n"
    " FROM (SELECT DISTINCT label FROM pred), (SELECT unnest([1, 2]) AS e)"
)
def replicate_sink(spark, sf):
    """Replicate values appended to a log twice and counted."""
    path = scratch_path(spark, "replicates")
    _, repeated = B.empirical_interval(pred(spark, sf), B.AUROC, replicates=1000, seed=3)
    sinks.append_replicates(sinks.replicate_rows(repeated, 1, "test", "noagg", 0), path)
    saved = spark.read.parquet(path)
    sinks.append_replicates(saved.withColumn("epoch", F.lit(2)), path)
    return spark.read.parquet(path).groupBy("epoch", "metric", "logged_metric").agg(F.count(F.lit(1)).alias("n"))


_TERMS = ", ".join(
    f"round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * cos(i * {k}))), 4) + 0.0 AS s{k - 1}" for k in (1, 2, 3)
)


@query(f"SELECT vec_id, label, {_TERMS} FROM embeddings")
def embed_score(spark, sf):
    """M1: linear scores over Arrow batches."""
    rows = table(spark, sf, "embeddings")
    out = S.score_batches(rows, S.linear_scorer(64, 3), ["vec_id", "label"])
    return out.select("vec_id", "label", *[r6(F.col("scores")[i], 4).alias(f"s{i}") for i in range(3)])


def _probed(spark, sf):
    rows = table(spark, sf, "embeddings")
    targets = [f"class_{i}" for i in range(10)]
    rows = rows.withColumns({t: (F.col("label") == i).cast("int") for i, t in enumerate(targets)})
    return S.linear_probe(rows, "embedding", targets, F.col("vec_id") % 5 != 0, "vec_id", penalty=0.01)


@query()
def linear_probe(spark, sf):
    """One probe per class, scored on held-out rows by area."""
    return M.auroc(_probed(spark, sf)).select("label", r6("value", 4).alias("auroc"))


@query(
    "SELECT 'class_' || c AS label, count(*) AS held, CAST(count(*) FILTER (label = c) AS BIGINT) AS positives, true AS bounded"
    " FROM embeddings, (SELECT unnest(range(0, 10)) AS c) WHERE vec_id % 5 = 0 GROUP BY c"
)
def probe_contract(spark, sf):
    """M2: every class scores every held-out row with a probability."""
    return _probed(spark, sf).groupBy("label").agg(
        F.count(F.lit(1)).alias("held"), F.sum("target").cast("long").alias("positives"), F.bool_and(F.col("score").between(0, 1)).alias("bounded")
    )


@query("SELECT 'class_' || c AS label, true AS settled FROM (SELECT unnest(range(0, 10)) AS c)")
def probe_solution_contract(spark, sf):
    """M2: the gradient of every class's loss, summed over all training rows here, is near zero."""
    vectors = table(spark, sf, "embeddings").where("vec_id % 5 <> 0")
    targets = [f"class_{c}" for c in range(10)]
    rows = vectors.withColumns({t: (F.col("label") == c).cast("int") for c, t in enumerate(targets)})
    probe = S.fit_probe(rows, "embedding", targets, penalty=0.01)
    long = rows.select("embedding", F.explode(F.array(*[F.struct(F.lit(t).alias("label"), F.col(t).alias("y")) for t in targets])).alias("t"))
    weights = spark.createDataFrame([(t, [float(x) for x in w]) for t, w in zip(probe.labels, probe.weights)], "label string, w array<double>")
    joined = long.select("embedding", "t.label", "t.y").join(F.broadcast(weights), "label")
    inner = F.slice("w", 1, F.size("embedding"))
    off = 1 / (1 + F.exp(-(S.dot(inner, F.col("embedding")) + F.element_at("w", -1)))) - F.col("y")
    cells = joined.select("label", "w", off.alias("off"), F.posexplode("embedding").alias("i", "x"))
    slopes = cells.groupBy("label", "i").agg(F.abs(F.avg(F.col("off") * F.col("x")) + 0.01 * F.first(F.get("w", F.col("i")))).alias("slope"), F.abs(F.avg("off")).alias("bias"))
    return slopes.groupBy("label").agg((F.max(F.greatest("slope", "bias")) < 1e-5).alias("settled"))


def _retrieved(spark, sf):
    from pulsegrid.scale import position

    vectors = table(spark, sf, "embeddings").withColumnRenamed("label", "record_id")
    steps = position(vectors.select("record_id", "vec_id"), ["record_id"], ["vec_id"], "step")
    steps = steps.join(vectors.select("vec_id", "embedding"), "vec_id")
    steps = steps.select("record_id", "step", F.col("embedding").alias("predicted"), F.col("embedding").alias("encoded"))
    return S.retrieval_scores(steps, 1, 16, 42, temperature=0.5, cosine=True)


@query(
    f"""WITH v AS (SELECT label AS record_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS step,
  row_number() OVER (ORDER BY label, vec_id) - 1 AS idx, count(*) OVER () AS total, count(*) OVER (PARTITION BY label) AS n,
  list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings),
d AS (SELECT v.*, {hash_sql(42, "record_id", "step", "k")} % (total - 1) AS at FROM v, (SELECT unnest(range(0, 16)) AS k) WHERE step + 1 < n),
s AS (SELECT d.record_id, d.step, list_sum(list_transform(list_zip(d.u, f.u), lambda z: z[1] * z[2])) / 0.5 AS hit,
  list_sum(list_transform(list_zip(d.u, g.u), lambda z: z[1] * z[2])) / 0.5 AS score
  FROM d JOIN v AS f ON f.idx = d.idx + 1 JOIN v AS g ON g.idx = CASE WHEN d.at >= d.idx + 1 THEN d.at + 1 ELSE d.at END),
a AS (SELECT record_id, step, ln(1 + sum(exp(score - hit))) AS loss, CAST(any_value(hit) >= max(score) AS DOUBLE) AS hit FROM s GROUP BY 1, 2)
SELECT record_id, round(avg(loss), 4) + 0.0 AS loss, round(avg(hit), 6) + 0.0 AS hit_rate FROM a GROUP BY 1"""
)
def contrastive_hit_rate(spark, sf):
    """M4: loss and hit rate of finding the next vector of the same class."""
    out = _retrieved(spark, sf)
    return out.groupBy("record_id").agg(r6(F.avg("loss"), 4).alias("loss"), r6(F.avg("hit")).alias("hit_rate"))


@query("SELECT label AS record_id, count(*) - 1 AS anchors, true AS sane FROM embeddings GROUP BY label HAVING count(*) > 1")
def retrieval_contract(spark, sf):
    """M4: one positive loss per anchor; a hit or a miss each."""
    sane = (F.col("loss") > 0) & F.col("hit").isin(0, 1)
    return _retrieved(spark, sf).groupBy("record_id").agg(F.count(F.lit(1)).alias("anchors"), F.bool_and(sane).alias("sane"))


@query(
    "WITH " + SIG + ", " + LENGTHS + """,
c AS (SELECT record_id, data_length, unnest(range(0, data_length, 8)) AS start_idx FROM lengths),
w AS (SELECT c.record_id, c.start_idx, sum(coalesce(g.value, 0) * cos(g.t - c.start_idx + 1)) AS score
  FROM c JOIN sig g ON g.record_id = c.record_id AND g.t >= c.start_idx AND g.t < c.start_idx + 8 WHERE c.start_idx + 8 <= c.data_length GROUP BY 1, 2),
p AS (SELECT 'noagg' AS aggregation, score, record_id % 2 AS target FROM w UNION ALL SELECT 'agg', avg(score), record_id % 2 FROM w GROUP BY record_id)
SELECT 'odd' AS label, a.aggregation, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) + 0.0 AS value
FROM p a JOIN p b ON a.aggregation = b.aggregation AND a.target = 1 AND b.target = 0 GROUP BY a.aggregation"""
)
def chunk_scores_by_record(spark, sf):
    """Chunks scored, joined per record and evaluated."""
    from pulsegrid.catalog.base import sig
    from pulsegrid.operators import chunks as C

    chunks = C.chunk_index(sig_lengths(spark, sf), chunk_length=8, min_chunk_length=8).select("record_id", "chunk", "start_idx", "end_idx")
    rows = C.take_samples(sig(spark, sf), chunks, block=64)
    cells = F.array_sort(F.collect_list(F.struct("rel", "value")))
    batches = rows.groupBy("record_id", "chunk").agg(F.transform(cells, lambda x: x["value"]).alias("values"))
    scored = S.score_batches(batches, S.linear_scorer(8, 1), ["record_id", "chunk"], "values")
    long = scored.select(
        "record_id", F.lit("odd").alias("label"), (F.col("record_id") % 2).alias("target"), F.col("scores")[0].alias("score")
    )
    merged = A.aggregate_predictions(long)
    plain = M.auroc(long).withColumn("aggregation", F.lit("noagg"))
    return plain.unionByName(M.auroc(merged).withColumn("aggregation", F.lit("agg"))).withColumn("value", r6("value"))
