"""Invariants of seeded operators: splits, samples, bootstrap, probes."""

import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pulsegrid.operators import bootstrap as B
from pulsegrid.operators import metrics as M
from pulsegrid.operators import reshape as R
from pulsegrid.operators import scoring as S
from pulsegrid.operators import splits as K

LAB = "/root/testdata/sf0.01"


def lab(spark):
    from pulsegrid.catalog.base import lab as view

    return view(spark, LAB)


def shares(rows, fold):
    long = rows.select(fold, F.explode("labels").alias("label")).groupBy("label", fold).count().toPandas()
    totals = long.groupby("label")["count"].sum()
    return long, totals


@pytest.mark.parametrize("ratios", [[0.2] * 5, [0.8, 0.1, 0.1]])
@pytest.mark.parametrize("buckets", [1, 3])
def test_K1_K3_shares(spark, ratios, buckets):
    rows = K.stratified_folds(lab(spark), "p_partkey", "labels", ratios, 7, buckets=buckets).cache()
    assert rows.count() == 2000 and rows.where("strat_fold < 0").count() == 0
    long, totals = shares(rows, "strat_fold")
    near(long, totals, ratios)


def near(long, totals, ratios):
    """Within five points, or within one row."""
    for label, total in totals.items():
        for i, ratio in enumerate(ratios):
            got = long[(long.label == label) & (long.strat_fold == i)]["count"].sum()
            assert abs(got - ratio * total) <= max(0.05 * total, 1.0), (label, i, got, total)


@pytest.mark.parametrize("ratios", [[0.25] * 4, [0.5, 0.3, 0.2]])
def test_K2_three_patients_of_a_sixth_each(spark, ratios):
    patient = F.when(F.col("id") < 3000, F.floor(F.col("id") / 1000)).otherwise(F.col("id"))
    label = F.concat(F.lit("l"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("string"))
    rare = F.when(F.col("id") % 1500 == 1400, F.array(F.lit("rare"))).otherwise(F.array().cast("array<string>"))
    rows = spark.range(6000).select("id", patient.alias("patient"), F.concat(F.array(F.lit("all"), label), rare).alias("labels"))
    out = K.stratified_folds(rows, "id", "labels", ratios, 7, group="patient").cache()
    assert out.count() == 6000 and out.groupBy("patient").agg(F.count_distinct("strat_fold").alias("n")).where("n > 1").count() == 0
    near(*shares(out, "strat_fold"), ratios)


def test_K1_null_group_and_no_labels(spark):
    rows = spark.createDataFrame([(None, ["a"]), (1, ["a", "b"]), (2, []), (3, None)], "p int, labels array<string>")
    out = {r["p"]: r["strat_fold"] for r in K.stratified_folds(rows, "p", "labels", [0.5, 0.5], 1).collect()}
    assert {out[None], out[1]} == {0, 1} and out[2] == out[3] == -1


def test_water_fill_restores_the_ratios():
    ratios = np.array([0.5, 0.3, 0.2])
    need = np.array([10.0, 10.0, 10.0])
    part = K.water_fill(need, ratios, 20.0) * 20
    assert np.allclose((need - part)[1:] / ratios[1:], (need - part)[1] / 0.3) or (part >= 0).all()
    assert np.isclose(part.sum(), 20.0)
    assert np.allclose(K.water_fill(np.array([-5.0, 3.0, 2.0]), ratios, 5.0), [0, 0.6, 0.4])
    assert np.allclose(K.water_fill(need, ratios, 0.0), ratios)
    assert K.water_fill(np.array([4.0, 4.0]), np.array([1.0, 0.0]), 3.0).tolist() == [1.0, 0.0]


def test_heavy_groups_are_settled_by_moves_and_swaps():
    rng = np.random.default_rng(0)
    rows = [(g, f"l{x}", int(rng.integers(1, 4))) for g in range(60) for x in rng.choice(8, 3, replace=False)]
    totals = {}
    for _, label, n in rows:
        totals[label] = totals.get(label, 0) + n
    ratios = np.array([0.6, 0.2, 0.2])
    need = {label: ratios * n for label, n in totals.items()}
    placed = K.place_heavy(rows, totals, need, 3)
    assert len(placed) == 60 and max(np.abs(v).max() / totals[k] for k, v in need.items()) < 0.05


def test_K1_is_deterministic_and_marks_unlabelled(spark):
    rows = lab(spark).withColumn("labels", F.when(F.col("p_partkey") % 50 == 0, F.array().cast("array<string>")).otherwise(F.col("labels")))
    a = K.stratified_folds(rows, "p_partkey", "labels", [0.5, 0.5], 3)
    b = K.stratified_folds(rows.repartition(5), "p_partkey", "labels", [0.5, 0.5], 3)
    c = K.stratified_folds(rows, "p_partkey", "labels", [0.5, 0.5], 4)
    pick = lambda df: {r["p_partkey"]: r["strat_fold"] for r in df.collect()}
    assert pick(a) == pick(b) and pick(a) != pick(c)
    assert {k for k, v in pick(a).items() if v == -1} == {k for k in range(0, 2000, 50)}


def test_K1_ratios_checked(spark):
    with pytest.raises(ValueError):
        K.stratified_folds(lab(spark), "p_partkey", "labels", [0.5, 0.4], 1)


def test_K2_groups_stay_together(spark):
    rows = lab(spark).withColumn("patient", F.floor(F.col("p_partkey") / 5))
    out = K.stratified_folds(rows, "p_partkey", "labels", [0.25] * 4, 7, group="patient")
    assert out.groupBy("patient").agg(F.count_distinct("strat_fold").alias("n")).where("n > 1").count() == 0
    assert out.count() == 2000


def test_K2_one_heavy_group(spark):
    rows = lab(spark).withColumn("patient", F.when(F.col("p_partkey") < 700, -1).otherwise(F.col("p_partkey")))
    out = K.stratified_folds(rows, "p_partkey", "labels", [0.5, 0.5], 7, group="patient")
    assert out.count() == 2000 and K.split_leaks(out, "patient", "strat_fold").count() == 0


def test_K5_share_and_untouched_test(spark):
    frame = entry.queries()["label_efficiency"](spark, LAB).cache()
    assert frame.where("split = 'test'").count() == 66 * 3
    for split, patients in (("train", 534), ("val", 67)):
        part = frame.where(F.col("split") == split)
        assert part.count() == part.select("patient").distinct().count()
        assert abs(part.count() / patients - 0.25) < 0.08


def test_K6_near_equal(spark):
    rows = spark.range(103).withColumnRenamed("id", "p")
    sizes = [r["count"] for r in K.patient_kfold(rows, "p", 5, 1).groupBy("strat_fold").count().collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]


def test_K9_repeats_and_fill(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 90, F.floor(F.col("id") / 3)).otherwise(F.col("id") + 1000).alias("p"))
    out = K.holdout_repeats(rows, "id", "p", 0.2, 1)
    assert out.where("orig_fold = 1").count() == 200 and out.where("id < 90 and orig_fold = 0").count() == 0


def test_O2_exact(spark):
    rows = spark.range(500)
    a = [r["id"] for r in R.sample_exact(rows, 77, "id", 5).collect()]
    assert len(a) == len(set(a)) == 77
    assert sorted(a) == sorted(r["id"] for r in R.sample_exact(rows.repartition(7), 77, "id", 5).collect())
    assert R.sample_exact(rows, 900, "id", 5).count() == 500


def test_O3_draws(spark):
    out = B.draws(spark, 50, 8, 1)
    assert [r["s"] for r in out.groupBy("replicate").agg(F.sum("weight").alias("s")).collect()] == [50.0] * 8
    assert out.agg(F.min("idx"), F.max("idx")).first()[0] >= 0


def preds(spark, n=300):
    rows = []
    for i in range(n):
        u = ((i * 7919) % 1009) / 1009
        rows += [(i, "a", int((i * 31) % 100 < 40 + 40 * u), u), (i, "b", None if i % 3 else i % 2, 1 - u)]
    return spark.createDataFrame(rows, "sample_id int, label string, target int, score double")


def metric(rows, by, weight=None):
    return M.auroc(rows, by, weight, slice_by=B.score_slice(descending=True))


def test_E15_interval(spark):
    frame = preds(spark)
    got = {r["label"]: r for r in B.empirical_interval(frame, metric, replicates=60, seed=2)[0].collect()}
    point = {r["label"]: r["value"] for r in M.auroc(frame).collect()}
    for label in "ab":
        assert got[label]["value"] == pytest.approx(point[label])
        assert got[label]["low"] < point[label] < got[label]["high"] and got[label]["nulls"] == 0
    width = lambda label: got[label]["high"] - got[label]["low"]
    assert width("b") > width("a")  # fewer known targets, wider interval


def test_E15_weights_equal_materialised_draws(spark):
    frame = preds(spark, 60)
    _, values = B.empirical_interval(frame, metric, replicates=3, seed=9)
    got = {(r["replicate"], r["label"]): r["value"] for r in values.collect()}
    chosen = B.draws(spark, 60, 3, 9).collect()
    data = {(r["sample_id"], r["label"]): (r["target"], r["score"]) for r in frame.collect()}
    for (rep, label), value in got.items():
        cells = [(w, *data[(i, label)]) for r, i, w in chosen if r == rep and data[(i, label)][0] is not None]
        wins = total = 0.0
        for w, t, s in cells:
            for w2, t2, s2 in cells:
                if t == 1 and t2 == 0:
                    total += w * w2
                    wins += w * w2 * (1.0 if s > s2 else 0.5 if s == s2 else 0.0)
        assert value == pytest.approx(wins / total)


@pytest.mark.parametrize("slices", [1, 7])
def test_E15_areas_equal_brute_force_on_the_same_draws(spark, slices, monkeypatch):
    """Ties, masked targets, pooled rows and stretches that cut groups, both areas, every replicate."""
    monkeypatch.setattr(B, "STEP", 16)
    frame = preds(spark, 90).withColumn("score", F.round("score", 1)).unionByName(
        spark.createDataFrame([(7, "c", None, 0.5), (8, "d", 1, 0.5)], "sample_id int, label string, target int, score double")
    )
    spark.conf.set("spark.sql.shuffle.partitions", str(slices))
    got = {(r["replicate"], r["label"]): (r["auroc"], r["aupr"]) for r in B.replicate_areas(frame, ["label"], 12, 9, precision=True).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    weights = {(r["replicate"], r["sample_id"]): r["weight"] for r in B.sample_weights(frame, 12, 9).collect()}
    rows = frame.collect()
    assert set(got) == {(i, x) for i in range(12) for x in "abcd"}
    for (rep, label), (area, precision) in got.items():
        cells = [(weights.get((rep, r["sample_id"]), 0.0), r["target"], r["score"]) for r in rows if r["label"] == label and r["target"] is not None]
        pos, neg = (sum(w for w, t, _ in cells if t == k) for k in (1, 0))
        wins = sum(w * v * (1.0 if s > z else 0.5 if s == z else 0.0) for w, t, s in cells if t == 1 for v, u, z in cells if u == 0)
        assert area == (pytest.approx(wins / (pos * neg)) if pos * neg else None)
        gain = 0.0
        for w, t, s in cells:
            if t == 1 and w:
                tp, all_ = (sum(v for v, u, z in cells if z >= s and (u == 1 or every)) for every in (False, True))
                gain += w * tp / all_
        assert precision == (pytest.approx(gain / pos) if pos else None)


def test_E15_means_equal_brute_force_on_the_same_draws(spark):
    frame = preds(spark, 50)
    got = {r["replicate"]: r["value"] for r in B.replicate_means(frame, F.abs(F.col("score") - F.col("target")), [], 6, 2).collect()}
    weights = {(r["replicate"], r["sample_id"]): r["weight"] for r in B.sample_weights(frame, 6, 2).collect()}
    cells = [(r["sample_id"], abs(r["score"] - r["target"])) for r in frame.collect() if r["target"] is not None]
    for rep, value in got.items():
        total = sum(weights.get((rep, i), 0.0) for i, _ in cells)
        assert value == pytest.approx(sum(weights.get((rep, i), 0.0) * x for i, x in cells) / total)


def test_O3_totals_are_exact_and_even_in_lanes_of_many_chunks():
    sizes = [0, 5, 3000, 1, 0, 700]
    split = B.Splitter(sizes, 200, 5)
    parts = {lane: np.concatenate([split.weights(lane, c) for c in range(-(-n // B.CHUNK))]) for lane, n in enumerate(sizes) if n}
    whole = np.concatenate(list(parts.values())).astype(int)
    assert whole.shape == (sum(sizes), 200) and (whole.sum(axis=0) == sum(sizes)).all()
    assert abs(whole.var() - 1.0) < 0.02 and abs((whole == 0).mean() - np.exp(-1)) < 0.005
    per_lane = parts[2].astype(int).sum(axis=0)
    assert abs(per_lane.mean() - 3000) < 15 and 15 < per_lane.std() < 40
    again = B.Splitter(sizes, 200, 5)  # another task, another order
    assert (again.weights(2, 1) == parts[2][B.CHUNK : 2 * B.CHUNK]).all() and (again.weights(1, 0) == parts[1]).all()


def test_O3_draws_do_not_depend_on_partitions_or_id_type(spark):
    ids = spark.range(300)
    a = {(r[0], r[1]): r[2] for r in B.sample_weights(ids.repartition(7), 5, 3, "id").collect()}
    b = {(r[0], r[1]): r[2] for r in B.sample_weights(ids.select(F.col("id").cast("int")), 5, 3, "id").collect()}
    c = {(r[0], r[1]): r[2] for r in B.sample_weights(ids, 5, 4, "id").collect()}
    assert a == b != c


def test_E15_vector_metrics_equal_the_general_way(spark):
    frame = preds(spark, 120)
    for fast, slow in ((B.AUROC, M.auroc), (B.AVERAGE_PRECISION, M.average_precision), (B.MAE, M.mae)):
        one, two = (B.empirical_interval(frame, m, replicates=8, seed=6) for m in (fast, slow))
        for x, y in zip(*(f[0].orderBy("label").collect() for f in (one, two))):
            assert tuple(x)[0] == tuple(y)[0] and tuple(x)[1:] == pytest.approx(tuple(y)[1:])


def test_E16_vector_difference_shares_its_draws(spark):
    frame = preds(spark, 80)
    same = B.empirical_interval(frame, B.AUROC, replicates=5, seed=1, other=frame.where("sample_id >= 0"))[0].collect()
    assert all(r["value"] == r["low"] == r["high"] == 0.0 for r in same)
    turned = frame.withColumn("score", 1.0 - F.col("score"))
    _, one = B.empirical_interval(frame, B.AUROC, replicates=5, seed=1)
    _, two = B.empirical_interval(frame, B.AUROC, replicates=5, seed=1, other=turned)
    one = {(r["replicate"], r["label"]): r["value"] for r in one.collect()}
    for r in two.collect():
        assert r["value"] == pytest.approx(2 * one[r["replicate"], r["label"]] - 1)


def test_E15_seed_and_zero(spark):
    frame = preds(spark, 50)
    with pytest.raises(ValueError):
        B.empirical_interval(frame, metric, replicates=5)
    zero = B.empirical_interval(frame, metric, replicates=0, seed=1)[0].collect()
    assert all(r["low"] == r["high"] == 0.0 for r in zero)


def test_E16_difference_with_itself_is_zero(spark):
    frame = preds(spark, 80)
    got = B.empirical_interval(frame, metric, replicates=4, seed=1, other=frame)[0].collect()
    assert all(r["value"] == r["low"] == r["high"] == 0.0 for r in got)


def test_T5_crops_inside(spark):
    rows = entry.queries()["random_crop"](spark, SMALL)
    assert rows.where("end_idx - start_idx <> 9 or start_idx < chunk * 16 or end_idx > chunk * 16 + 16").count() == 0


def test_M2_finds_a_separable_class(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=4) + (3 if i % 2 else 0)], i % 2, None if i % 7 else i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int, z int")
    out = S.linear_probe(df, "v", ["y", "z"], F.col("id") % 3 != 0, "id", iterations=20)
    areas = {r["label"]: r["value"] for r in M.auroc(out).collect()}
    assert areas["y"] > 0.95 and areas["z"] > 0.9
    assert out.where("id % 3 <> 0").count() == 0


def test_M2_all_targets_settle_in_shared_passes(spark):
    """The gradient of every target's own loss, masked rows left out, is near zero at its weights."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) * [1, 2, 5, 0.1, 1, 1] + 1
    y = (rng.random((400, 5)) < 1 / (1 + np.exp(-x[:, :5]))).astype(float)
    y[:, 3] = rng.random(400) < 0.02  # a rare class
    y[::3, 1] = np.nan
    y[:, 4] = 1.0  # one class only
    rows = [(i, [float(v) for v in x[i]], *(None if np.isnan(v) else int(v) for v in y[i])) for i in range(400)]
    names = [f"t.{i}" for i in range(5)]
    df = spark.createDataFrame(rows, "id int, v array<double>, " + ", ".join(f"`{n}` int" for n in names)).repartition(5)
    probe = S.fit_probe(df, "v", names, penalty=0.02)
    assert probe.labels == tuple(names[:4]) and probe.passes < 80 and probe.slope.max() <= 1e-6
    ones = np.hstack([x, np.ones((400, 1))])
    for k, w in enumerate(probe.weights):
        seen = ~np.isnan(y[:, k])
        p = 1 / (1 + np.exp(-ones[seen] @ w))
        slope = (p - y[seen, k]) @ ones[seen] / seen.sum() + 0.02 * np.append(w[:-1], 0)
        assert np.abs(slope).max() < 1e-5
    out = S.linear_probe(df, "v", names, F.col("id") % 4 != 0, "id", penalty=0.02)
    held = out.where("label = 't.1'")
    assert held.count() == 100 and held.where("target is null").count() == len([i for i in range(0, 400, 4) if i % 3 == 0])
    with pytest.raises(ValueError):
        S.fit_probe(df, "v", ["t.4"])


def test_M2_separable_targets_end(spark):
    df = spark.createDataFrame([(i, [float(i)], int(i > 5)) for i in range(12)], "id int, v array<double>, y int")
    probe = S.fit_probe(df, "v", ["y"], iterations=40)
    assert probe.passes <= 40 and np.isfinite(probe.weights).all()


@pytest.mark.parametrize("same,interval", [(False, 0), (True, 0), (False, 2)])
def test_M4_perfect_prediction(spark, same, interval):
    rows = []
    for rec in range(3):
        for step in range(6):
            angle = 2 * math.pi * (rec * 6 + step) / 18
            ahead = 2 * math.pi * (rec * 6 + step + 1) / 18
            rows.append((rec, step, [math.cos(ahead), math.sin(ahead)], [math.cos(angle), math.sin(angle)]))
    df = spark.createDataFrame(rows, "record_id int, step int, predicted array<double>, encoded array<double>")
    out = S.retrieval_scores(df, 1, 5, 3, temperature=0.1, same_record=same, interval=interval).collect()
    assert len(out) == 15 and all(r["hit"] == 1 for r in out)
    assert all(0 < r["loss"] < math.log(6) for r in out)


def test_M1_nulls_become_zero(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, [2.0, 3.0])], "id int, v array<double>")
    out = S.score_batches(df, lambda x: x.sum(axis=1, keepdims=True) / (x[:, 1:] > 0), ["id"], "v").orderBy("id").collect()
    assert out[0]["scores"][0] > 1e300 and out[1]["scores"] == [5.0]
