"""Scores over long predictions ``(sample_id, label, target, score)``.

A null target is masked. Every metric takes grouping columns, so the same
plan serves one label, all labels or labels per bootstrap replicate, and most
take a weight column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.clean import clean_label
from pulsegrid.functions.labels import sigmoid
from pulsegrid.scale import running_sum

LABEL = ("label",)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def score_counts(pred: DataFrame, by: Sequence[str] = LABEL, weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score: the input of all curves.

    Masked targets and missing scores meet in one row of null score and no
    weight, so a label with masked targets only keeps its (undefined) metric.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    target = F.col("target").cast("double")
    known = _known("target") & F.col("score").isNotNull()
    return (
        pred.groupBy(*by, F.when(known, F.col("score").cast("double")).alias("score"))
        .agg(F.sum(F.when(known, w * target).otherwise(0.0)).alias("pos"), F.sum(F.when(known, w * (1.0 - target)).otherwise(0.0)).alias("neg"))
    )


def class_areas(
    pred: DataFrame, by: Sequence[str] = LABEL, weight: str | None = None, slice_by: Column | None = None
) -> DataFrame:
    """``auroc`` and ``aupr`` per group in one pass over the scores.

    Scores are walked downwards. Each negative counts the positives above it
    and half of those beside it; each positive adds the precision at its
    score. Equal scores are merged. An area without both outcomes (or without
    positives) is null. ``slice_by`` must not decrease while the score falls.
    """
    counts = score_counts(pred, by, weight)
    ranked = running_sum(
        counts, by, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, inclusive=True, slice_by=slice_by
    )
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    gain = F.sum(F.col("pos") * _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    return ranked.groupBy(*by).agg(
        _ratio(wins, F.sum("pos") * F.sum("neg")).alias("auroc"), _ratio(gain, F.sum("pos")).alias("aupr")
    )


def auroc(
    pred: DataFrame, by: Sequence[str] = LABEL, weight: str | None = None, slice_by: Column | None = None
) -> DataFrame:
    """Area under the ROC; ``by`` without the label is the pooled area."""
    return class_areas(pred, by, weight, slice_by).select(*by, F.col("auroc").alias("value"))


def average_precision(
    pred: DataFrame, by: Sequence[str] = LABEL, weight: str | None = None, slice_by: Column | None = None
) -> DataFrame:
    """Uninterpolated average precision."""
    return class_areas(pred, by, weight, slice_by).select(*by, F.col("aupr").alias("value"))


def macro(per_label: DataFrame, by: Sequence[str] = (), undefined: float | None = 0.5) -> DataFrame:
    """Mean over labels; an undefined label counts as ``undefined``."""
    value = F.col("value") if undefined is None else F.coalesce(F.col("value"), F.lit(undefined))
    return per_label.groupBy(*by).agg(F.avg(value).alias("value"))


def curve_points(pred: DataFrame, by: Sequence[str] = LABEL, ends: bool = False) -> DataFrame:
    """E5: ROC and precision-recall points, one per threshold ``score >= t``.

    With ``ends`` both curves begin where nothing is found: rates of zero at
    an infinite threshold, with precision one.
    """
    counts = score_counts(pred, by)
    points = running_sum(
        counts, by, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, inclusive=True, totals=True
    ).withColumnsRenamed({"tp_total": "p", "fp_total": "n"})
    points = points.where(F.col("score").isNotNull())
    if ends:
        begin = points.groupBy(*by).agg(F.max("p").alias("p"), F.max("n").alias("n"))
        infinite = F.lit(float("inf"))
        begin = begin.select(*by, infinite.alias("score"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("fp"), "p", "n")
        points = points.select(*by, "score", "tp", "fp", "p", "n").union(begin)
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return points.select(
        *by,
        F.col("score").alias("threshold"),
        _ratio(F.col("fp"), F.col("n")).alias("fpr"),
        _ratio(F.col("tp"), F.col("p")).alias("tpr"),
        (F.when(F.col("score") == float("inf"), 1.0).otherwise(precision) if ends else precision).alias("precision"),
        _ratio(F.col("tp"), F.col("p")).alias("recall"),
    )


def macro_roc(pred: DataFrame) -> DataFrame:
    """Mean of the labels' ROC curves at every false-positive rate of any label.

    The mean curve is piecewise linear. Each score group adds either a jump or
    a slope over an interval, so running sums of jumps and slope changes give
    the curve without evaluating every label at every rate.
    """
    by = ["label"]
    counts = score_counts(pred, by)
    steps = running_sum(counts, by, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, totals=True)
    steps = steps.withColumnsRenamed({"tp_total": "p", "fp_total": "n"}).where("p > 0 and n > 0 and score is not null")
    x0 = F.col("fp") / F.col("n")
    x1 = (F.col("fp") + F.col("neg")) / F.col("n")
    rise = F.col("pos") / F.col("p")
    slope = rise / (F.col("neg") / F.col("n"))

    def event(x: Column, jump: Column, bend: Column) -> Column:
        return F.struct(x.alias("x"), jump.alias("jump"), bend.alias("bend"))

    zero = F.lit(0.0)
    events = F.when(F.col("neg") == 0, F.array(event(x0, rise, zero))).otherwise(
        F.array(event(x0, zero, slope), event(x1, zero, -slope))
    )
    merged = (
        steps.select(F.explode(events).alias("e"))
        .groupBy(F.col("e.x").alias("fpr"))
        .agg(
            F.sum("e.jump").alias("jump"),
            F.sum("e.bend").alias("bend"),
            F.sum(F.col("e.bend") * F.col("e.x")).alias("lean"),
        )
    )
    summed = running_sum(
        merged, [], ["fpr"],
        {"jumps": F.col("jump"), "bends": F.col("bend"), "leans": F.col("lean")},
        inclusive=True,
    )
    # Every curve starts with one step at rate zero.
    labels = steps.where("tp = 0 and fp = 0").agg(F.count(F.lit(1))).scalar()
    height = F.col("jumps") + F.col("fpr") * F.col("bends") - F.col("leans")
    return summed.select("fpr", (height / labels).alias("tpr"))


def regression_errors(pred: DataFrame, by: Sequence[str] = LABEL, weight: str | None = None) -> DataFrame:
    """Mean absolute error and R2; masked targets skipped, empty gives null.

    A constant target has R2 one when met exactly, else zero.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    y, z = F.col("target").cast("double"), F.col("score").cast("double")
    ok = _known("target")
    rows = pred.withColumns(
        {"_w": F.when(ok, w).otherwise(0.0), "_y": F.when(ok, y).otherwise(0.0), "_e": F.when(ok, y - z).otherwise(0.0)}
    )
    center = rows.groupBy(*by).agg(_ratio(F.sum(F.col("_w") * F.col("_y")), F.sum("_w")).alias("_c"))
    rows = rows.join(center, list(by)) if by else rows.withColumn("_c", center.scalar())
    off = F.coalesce(F.col("_y") - F.col("_c"), F.lit(0.0))
    sums = rows.groupBy(*by).agg(
        F.sum("_w").alias("n"),
        F.sum(F.col("_w") * F.abs("_e")).alias("abs"),
        F.sum(F.col("_w") * F.col("_e") * F.col("_e")).alias("sse"),
        F.sum(F.col("_w") * off * off).alias("sst"),
    )
    r2 = F.when(F.col("sst") > 0, 1.0 - F.col("sse") / F.col("sst")).otherwise(
        F.when(F.col("sse") == 0, 1.0).otherwise(0.0)
    )
    return sums.select(
        *by, _ratio(F.col("abs"), F.col("n")).alias("mae"), F.when(F.col("n") >= 2, r2).alias("r2")
    )


def mae(pred: DataFrame, by: Sequence[str] = LABEL, weight: str | None = None) -> DataFrame:
    """E7 as a single-value metric for the bootstrap."""
    return regression_errors(pred, by, weight).select(*by, F.col("mae").alias("value"))


def mae_summary(pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Error and null share per label, and the mean and sum over labels.

    An array score holds quantiles; its first entry is scored.
    """
    if pred.schema["score"].dataType.typeName() == "array":
        pred = pred.withColumn("score", F.get("score", F.lit(0)))
    ok = _known("target")
    gap = F.abs(F.col("target").cast("double") - F.col("score").cast("double"))
    per_label = pred.groupBy("label").agg(
        F.avg(F.when(ok, gap)).alias("mae"),
        (1.0 - F.count_if(ok) / F.count(F.lit(1))).alias("null_fraction"),
    )
    overall = per_label.agg(F.avg("mae").alias("mae_mean"), F.sum("mae").alias("mae_sum"))
    return per_label, overall


def argmax_classes(pred: DataFrame, sample: str = "sample_id", index: str = "label") -> DataFrame:
    """True and predicted class per sample; a tie goes to the first class."""

    def top(c: str) -> Column:
        return F.max(F.struct(F.col(c).cast("double").alias("v"), (-F.col(index)).alias("i")))["i"]

    return pred.groupBy(sample).agg((-top("target")).alias("true_class"), (-top("score")).alias("pred_class"))


def fbeta(classes: DataFrame, beta: float = 1.0, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """F-beta per class that occurs as truth or prediction, per group of ``by``."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    hit = F.col("true_class") == F.col("pred_class")
    none = F.lit(0.0)
    roles = F.array(
        F.struct(F.col("true_class").alias("label"), F.when(hit, w).otherwise(none).alias("tp"), F.when(hit, none).otherwise(w).alias("fn"), none.alias("fp")),
        F.struct(F.col("pred_class").alias("label"), none.alias("tp"), none.alias("fn"), F.when(hit, none).otherwise(w).alias("fp")),
    )
    sums = classes.select(*by, F.explode(roles).alias("r")).groupBy(*by, "r.label").agg(
        F.sum("r.tp").alias("tp"), F.sum("r.fn").alias("fn"), F.sum("r.fp").alias("fp")
    )
    b2 = beta * beta
    top = (1 + b2) * F.col("tp")
    bottom = top + b2 * F.col("fn") + F.col("fp")
    return sums.select(*by, "label", F.coalesce(_ratio(top, bottom), F.lit(0.0)).alias("value"))


def accuracy(classes: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Share of samples whose classes agree."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    known = F.col("true_class").isNotNull() & F.col("pred_class").isNotNull()
    hit = F.sum(F.when(known & (F.col("true_class") == F.col("pred_class")), w).otherwise(0.0))
    return classes.groupBy(*by).agg(_ratio(hit, F.sum(F.when(known, w).otherwise(0.0))).alias("value"))


def threshold_metrics(
    pred: DataFrame, threshold: float | Mapping[str, float] | DataFrame, by: Sequence[str] = LABEL, weight: str | None = None
) -> DataFrame:
    """Sensitivity, specificity, MCC and Youden for ``score > threshold``.

    The threshold is one number, a number per label, or a frame with the
    columns ``by`` and ``threshold`` (the result of ``threshold_search``).
    Ratios without a denominator are zero.
    """
    if isinstance(threshold, DataFrame):
        rows = pred.join(threshold.select(*by, "threshold"), list(by))
    elif isinstance(threshold, Mapping):
        pairs = [F.lit(x) for k, v in threshold.items() for x in (k, float(v))]
        rows = pred.withColumn("threshold", F.create_map(*pairs)[F.col("label")])
    else:
        rows = pred.withColumn("threshold", F.lit(float(threshold)))
    rows = rows.where(_known("target"))
    yes, above = F.col("target") == 1, F.col("score") > F.col("threshold")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")

    def total(which: Column) -> Column:
        return F.sum(F.when(which, w).otherwise(0.0))

    sums = rows.groupBy(*by, "threshold").agg(
        total(yes & above).alias("tp"), total(yes & ~above).alias("fn"), total(~yes & above).alias("fp"), total(~yes & ~above).alias("tn")
    )
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    zero = F.lit(0.0)
    sens = F.coalesce(_ratio(tp, tp + fn), zero)
    spec = F.coalesce(_ratio(tn, tn + fp), zero)
    spread = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.coalesce(_ratio(tp * tn - fp * fn, spread), zero)
    return sums.select(
        *by, "threshold", sens.alias("sensitivity"), spec.alias("specificity"), mcc.alias("mcc"),
        (sens + spec - 1).alias("youden"),
    )


def at_threshold(metric: str, threshold: float | Mapping[str, float] = 0.5) -> Callable[..., DataFrame]:
    """E11 as a single-value metric for reports and the bootstrap."""

    def value(pred: DataFrame, by: Sequence[str] = LABEL, weight: str | None = None) -> DataFrame:
        return threshold_metrics(pred, threshold, by, weight).select(*by, F.col(metric).alias("value"))

    return value


def threshold_searches(
    pred: DataFrame, goals: Mapping[str, tuple[float, str, bool]], by: Sequence[str] = LABEL
) -> DataFrame:
    """A column per goal (value, metric, greater than) with its threshold, all from one walk over the scores.

    The threshold is the first distinct score, from the side where the metric
    fails last, at which ``score > t`` meets the goal; -1 when none does.
    """
    counts = score_counts(pred, by)
    rows = running_sum(
        counts, by, ["score"], {"pos_le": F.col("pos"), "neg_le": F.col("neg")}, inclusive=True, totals=True
    ).withColumnsRenamed({"pos_le_total": "p", "neg_le_total": "n"})
    kinds = {
        "sensitivity": _ratio(F.col("p") - F.col("pos_le"), F.col("p")),
        "specificity": _ratio(F.col("neg_le"), F.col("n")),
    }
    for _, metric, _ in goals.values():
        if metric not in kinds:
            raise ValueError(f"unknown metric {metric!r}")
    rows = rows.withColumns({f"_{k}": F.coalesce(v, F.lit(0.0)) for k, v in kinds.items()})
    aggs, chosen = [], []
    for k in kinds:
        aggs += [F.min_by(f"_{k}", "score").alias(f"_low_{k}"), F.max_by(f"_{k}", "score").alias(f"_high_{k}")]
    for i, (name, (goal, metric, greater)) in enumerate(goals.items()):
        met = F.col(f"_{metric}") > goal if greater else F.col(f"_{metric}") < goal
        aggs += [F.min(F.when(met, F.col("score"))).alias(f"_least_{i}"), F.max(F.when(met, F.col("score"))).alias(f"_most_{i}")]
        falling = F.col(f"_low_{metric}") > F.col(f"_high_{metric}")
        found = F.when(falling if greater else ~falling, F.col(f"_most_{i}")).otherwise(F.col(f"_least_{i}"))
        chosen.append(F.coalesce(found, F.lit(-1.0)).alias(name))
    return rows.groupBy(*by).agg(*aggs).select(*by, *chosen)


def threshold_search(
    pred: DataFrame, goal: float, metric: str = "sensitivity", greater_than: bool = True, by: Sequence[str] = LABEL
) -> DataFrame:
    """One goal, as the column ``threshold``."""
    return threshold_searches(pred, {"threshold": (goal, metric, greater_than)}, by)


def sample_centric(pred: DataFrame, thresholds: Sequence[float], sample: str = "sample_id") -> DataFrame:
    """Per-sample precision, recall, false-positive rate and coverage.

    Ratios are taken inside each sample for ``score >= t`` and averaged;
    a sample without predictions has no precision, one without positives no
    recall, one without negatives no false-positive rate.
    """
    cells = (
        pred.where(_known("target"))
        .groupBy(sample)
        .agg(F.collect_list(F.struct((F.col("target") == 1).alias("yes"), F.col("score").cast("double").alias("s"))).alias("cells"))
    )
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    rows = cells.withColumn("threshold", grid)

    def count(test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter("cells", test))

    above = lambda c: c["s"] >= F.col("threshold")
    rows = rows.withColumns(
        {
            "tp": count(lambda c: c["yes"] & above(c)),
            "fp": count(lambda c: ~c["yes"] & above(c)),
            "p": count(lambda c: c["yes"]),
            "n": count(lambda c: ~c["yes"]),
        }
    )
    marked = F.col("tp") + F.col("fp")
    out = rows.groupBy("threshold").agg(
        F.avg(_ratio(F.col("tp"), marked)).alias("precision"),
        F.avg(_ratio(F.col("tp"), F.col("p"))).alias("recall"),
        F.avg(_ratio(F.col("fp"), F.col("n"))).alias("fpr"),
        F.avg((marked > 0).cast("double")).alias("coverage"),
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f", _ratio(2 * p * r, p + r))


def fmax(points: DataFrame) -> DataFrame:
    """Best F over thresholds (first on ties) with its row, zeros if undefined.

    Also the trapezoid area of recall over false-positive rate and the
    uninterpolated precision area. ``points`` has one row per threshold, so a
    single ordered window over it stays small.
    """
    rank = F.struct(F.col("f"), -F.col("threshold"))
    best = lambda c: F.coalesce(F.max_by(c, F.when(F.col("f").isNotNull(), rank)), F.lit(0.0))
    w = Window.partitionBy(F.lit(0)).orderBy("threshold")
    last = F.lead("threshold").over(w).isNull()
    walk = points.withColumns(
        {
            "_precision": F.when(last, 1.0).otherwise(F.col("precision")),
            "_dr": F.col("recall") - F.lead("recall").over(w),
            "_mid": (F.col("recall") + F.lead("recall").over(w)) / 2,
            "_dx": F.col("fpr") - F.lead("fpr").over(w),
        }
    )
    return walk.agg(
        best("f").alias("fmax"),
        best("precision").alias("precision_at_fmax"),
        best("recall").alias("recall_at_fmax"),
        best("threshold").alias("threshold_at_fmax"),
        best("coverage").alias("coverage_at_fmax"),
        F.sum(F.col("_dx") * F.col("_mid")).alias("sample_auc"),
        F.sum(F.col("_dr") * F.col("_precision")).alias("sample_apr"),
    )


def composite(per_label_auroc: DataFrame, pooled_mae: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(1 - macro AUROC) + pooled mean absolute error."""
    area = macro(per_label_auroc, by)
    if by:
        joined = area.join(pooled_mae.select(*by, F.col("value").alias("_mae")), list(by))
        return joined.select(*by, (1.0 - F.col("value") + F.col("_mae")).alias("value"))
    return area.select((1.0 - F.col("value") + pooled_mae.select("value").scalar()).alias("value"))


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce(logit: Column, target: Column, pos_weight: Column | float = 1.0, gamma: float | None = None) -> Column:
    """Binary cross entropy of a logit, optionally focal; null target is null."""
    y = target.cast("double")
    pw = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    loss = (1.0 - y) * logit + (1.0 + (pw - 1.0) * y) * _softplus(-logit)
    if gamma is None:
        return loss
    p = sigmoid(logit)
    p_true = p * y + (1.0 - p) * (1.0 - y)
    return F.pow(1.0 - p_true, F.lit(float(gamma))) * loss


def cross_entropy(scores: Column, target: Column) -> Column:
    """Negative log-softmax of the target class of a score array."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.log(total) + top - F.get(scores, target.cast("int"))


def pinball(scores: Column, target: Column, quantiles: Sequence[float]) -> Column:
    """Summed quantile loss of a score array, one entry per quantile."""
    out = F.lit(0.0)
    for i, q in enumerate(quantiles):
        error = target - F.get(scores, F.lit(i))
        out = out + F.greatest((q - 1) * error, q * error)
    return out


def masked_losses(pred: DataFrame, by: Sequence[str] = LABEL, pos_weight: float = 1.0, gamma: float = 2.0) -> DataFrame:
    """Mean BCE, focal BCE and squared error per label; masked rows skipped.

    The summed form over labels is a plain sum of these means.
    """
    x, y = F.col("logit"), F.col("target").cast("double")
    ok = _known("target")
    return pred.groupBy(*by).agg(
        F.avg(F.when(ok, bce(x, y, pos_weight))).alias("bce"),
        F.avg(F.when(ok, bce(x, y, pos_weight, gamma))).alias("focal_bce"),
        F.avg(F.when(ok, (x - y) * (x - y))).alias("mse"),
    )


def class_losses(samples: DataFrame, gamma: float = 2.0, weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted cross entropy and focal cross entropy of (scores, target).

    Plain cross entropy divides by the summed class weights, the focal form by
    the number of rows.
    """
    w = F.lit(1.0)
    if weights is not None:
        w = F.get(F.array(*[F.lit(float(v)) for v in weights]), F.col("target").cast("int"))
    ce = cross_entropy(F.col("scores"), F.col("target"))
    focal = F.pow(1.0 - F.exp(-ce), F.lit(float(gamma))) * ce * w
    return samples.agg((F.sum(w * ce) / F.sum(w)).alias("ce"), F.avg(focal).alias("focal_ce"))


@dataclass(frozen=True)
class Metric:
    """A named score: ``fn(pred, by, weight) -> by + value``, with its direction."""

    name: str
    fn: Callable[..., DataFrame]
    mode: str = "max"
    summary: str = "macro"


METRICS = {
    "auroc": Metric("auroc", auroc),
    "aupr": Metric("aupr", average_precision),
    "mae": Metric("mae", mae, "min", "sum"),
    **{name: Metric(name, at_threshold(name)) for name in ("sensitivity", "specificity", "mcc", "youden")},
}

# --- fixed values -----------------------------------------------------------
MINIMISED_PREFIXES = ("composite_score", "mae", "loss")
REPORT_BRACKETS = "_"
# -----------------------------------------------------------------------------


def metric_report(
    values: DataFrame, name: str, split: str, loader: int = 0, aggregation: str = "", prefix: str = ""
) -> DataFrame:
    """Long (metric, value) with names ``prefix_name_label_agg<loader>_suffix``.

    ``values`` has a ``label`` and any of value, low, high, nulls. Mean
    aggregation is tagged ``_agg``, others ``_agg<how>``.
    """
    tag = "" if aggregation == "" else "_agg" if aggregation == "mean" else f"_agg{aggregation}"
    suffixes = {"value": "", "low": "_low", "high": "_high", "nulls": "_nans"}
    present = [c for c in suffixes if c in values.columns]
    cells = F.explode(
        F.array(*[F.struct(F.lit(suffixes[c]).alias("suffix"), F.col(c).cast("double").alias("v")) for c in present])
    )
    head = F.lit((prefix + "_" if prefix else "") + name + "_")
    key = F.concat(head, clean_label(F.col("label")), F.lit(f"{tag}_{split}{loader}"), F.col("cell.suffix"))
    return values.select("label", *present, cells.alias("cell")).select(key.alias("metric"), F.col("cell.v").alias("value"))


def best_run(log: DataFrame, monitor: str, mode: str = "auto", run: str = "epoch") -> DataFrame:
    """The run with the best monitored value; errors and losses are minimised."""
    if mode == "auto":
        mode = "min" if monitor.startswith(MINIMISED_PREFIXES) else "max"
    rows = log.where((F.col("metric") == monitor) & F.col("value").isNotNull())
    sign = F.col("value") if mode == "min" else -F.col("value")
    pick = F.struct(sign, F.col(run))
    return rows.agg(F.min_by(run, pick).alias(run), F.min_by("value", pick).alias("value"))
