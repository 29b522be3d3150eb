"""Cases that once gave wrong rows: short tails, masks, holes, null keys, odd literals."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pulsegrid.functions import labels as L
from pulsegrid.operators import bootstrap, chunks, metrics, reshape, scoring, signal
from pulsegrid.scale import carry, position
from pulsegrid.sources import tables


def test_features_of_a_short_last_chunk(spark):
    rows = [("r", 0, [1.0, 2.0, 3.0]), ("r", 1, [4.0, 5.0, 6.0]), ("r", 2, [7.0]), (None, 0, [9.0])]
    frame = spark.createDataFrame(rows, "record_id string, chunk int, values array<double>")
    got = {(r.record_id, r.pos): (r.value, r.length) for r in scoring.export_features(frame.where("record_id is not null"), ["record_id"]).collect()}
    assert got == {("r", i): (float(i + 1), 7) for i in range(7)}


def test_null_keys_are_a_group(spark):
    frame = spark.createDataFrame([("a", 1, 5.0), (None, 1, 7.0), (None, 2, None)], "k string, t int, v double")
    assert sorted((str(r.k), r.pos) for r in position(frame, ["k"], ["t"]).collect()) == [("None", 0), ("None", 1), ("a", 0)]
    filled = carry(frame, ["k"], F.floor(F.col("t") / 2), ["t"], last={"x": F.col("v")})
    assert sorted((str(r.k), r.x) for r in filled.collect()) == [("None", 7.0), ("None", 7.0), ("a", 5.0)]
    sig = spark.createDataFrame([(None, "c", 0, 1.0), (None, "c", 1, 3.0)], "record_id string, channel string, t int, value double")
    assert sorted(round(r.value, 6) for r in signal.normalise_record(sig).collect()) == [-1.0, 1.0]


def masked(spark):
    rows = [(1, "a", 0.0, 0.1), (2, "a", 1.0, 0.9), (1, "b", None, 0.3), (2, "b", None, 0.4), (3, "a", 1.0, None)]
    return spark.createDataFrame(rows, "sample_id int, label string, target double, score double")


def test_masked_labels_stay_undefined(spark):
    per = metrics.auroc(masked(spark))
    assert {r.label: r.value for r in per.collect()} == {"a": 1.0, "b": None}
    assert metrics.macro(per).first().value == 0.75
    found = {r.label: r.threshold for r in metrics.threshold_search(masked(spark), 0.5).collect()}
    assert found["b"] == -1.0
    assert all(r.threshold is not None for r in metrics.curve_points(masked(spark)).collect())


def test_replicates_without_targets_are_counted(spark):
    rows = [(i, "a", float(i % 2), i / 40) for i in range(20)] + [(99, "rare", 1.0, 0.5), (98, "rare", 0.0, 0.2)]
    pred = spark.createDataFrame(rows, "sample_id int, label string, target double, score double")
    bounds, repeated = bootstrap.empirical_interval(pred, metrics.auroc, replicates=30, seed=5)
    found = {r.label: r.nulls for r in bounds.collect()}
    valid = {r.label: r.n for r in repeated.where("value is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert found == {label: 30 - valid[label] for label in found} and found["rare"] > 0


def test_poisson_steps_reach_one():
    steps = bootstrap.poisson_steps()
    assert len(steps) > 12 and steps == sorted(steps) and 1 - steps[-1] < 1e-12
    assert math.isclose(steps[0], math.exp(-1))


def test_resampling_near_a_null_sample(spark):
    frame = spark.createDataFrame([("r", "c", t, v) for t, v in enumerate([10.0, None, 30.0])], "record_id string, channel string, t int, value double")
    got = {r.t: r.value for r in signal.resample_linear(frame, 1, 2).collect()}
    assert got == {0: 10.0, 1: None, 2: None, 3: None, 4: 30.0, 5: 30.0}


def test_blocks_refuse_holes(spark):
    rows = [("r", "c", t, float(t)) for t in range(40) if t != 17]
    frame = spark.createDataFrame(rows, "record_id string, channel string, t int, value double")
    with pytest.raises(PySparkException, match="missing or repeated"):
        signal.context_blocks(frame, 16, 4, 4).collect()


def test_filter_refuses_records_shorter_than_the_padding(spark):
    frame = spark.createDataFrame([("r", "c", t, float(t)) for t in range(6)], "record_id string, channel string, t int, value double")
    with pytest.raises(PySparkException, match="padding"):
        signal.butter_filter(frame, 100.0, low=1.0, high=20.0).collect()


def test_quoted_words_keep_their_text(spark):
    frame = spark.createDataFrame([("['None of these', None, 'nan', nan]", "{'None of': 1.0, 'b': None}")], "a string, b string")
    row = frame.select(L.literal_list("a").alias("a"), L.literal_map("b").alias("b")).first()
    assert row.a == ["None of these", None, "nan", None] and row.b == {"None of": 1.0, "b": None}


def test_remapped_ids_follow_an_order_column(spark):
    one = spark.createDataFrame([("x", 9), ("y", 1), ("x", 8)], "k string, at int")
    got = {r.k: r.record_id for r in reshape.remap_union([one], "k", "at").collect()}
    assert got == {"y": 0, "x": 1}


def test_short_last_epoch(spark):
    frame = spark.createDataFrame([("r", t, 1 if t >= 4 else 0) for t in range(5)], "record_id string, t int, label int")
    got = {r.epoch: r.label for r in chunks.segment_labels(frame, [0, 1], 4, mode="fraction").collect()}
    assert got == {0: [1.0, 0.0], 1: [0.0, 1.0]}


def test_one_id_column_per_table(spark):
    frame = spark.createDataFrame([("p/10.npy", "a.x"), (None, "b.x")], "ecg_id string, filename string")
    ids = frame.select(tables.record_id(dict(frame.dtypes), tables.usable_id(frame)).alias("i"))
    assert [r.i for r in ids.collect()] == ["a", "b"]
