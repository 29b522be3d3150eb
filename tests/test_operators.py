"""Hand-computed micro fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import clean
from pulsegrid.functions import labels as L
from pulsegrid.operators import aggregates as A
from pulsegrid.operators import chunks as C
from pulsegrid.operators import codes as K
from pulsegrid.operators import joins as J
from pulsegrid.operators import metrics as M
from pulsegrid.operators import reshape as R
from pulsegrid.operators import signal as G
from pulsegrid.operators.nearest import DAY, HOUR, nearest_long
from pulsegrid.scale import carry, exact_quantiles, position, running_sum
from pulsegrid.sources import packing


def one(df):
    return df.collect()[0]


def col(df, name="value"):
    return [r[name] for r in df.collect()]


PRED = [(0, "a", 0, 0.1), (1, "a", 0, 0.4), (2, "a", 1, 0.35), (3, "a", 1, 0.8), (4, "a", None, 0.9)]


def preds(spark, rows=PRED):
    return spark.createDataFrame(rows, "sample_id int, label string, target int, score double")


def test_E1_auroc(spark):
    assert one(M.auroc(preds(spark)))["value"] == pytest.approx(0.75)


def test_E1_ties_and_undefined(spark):
    rows = [(0, "t", 0, 0.5), (1, "t", 1, 0.5), (0, "u", 0, 0.5), (1, "u", 0, 0.2)]
    got = {r["label"]: r["value"] for r in M.auroc(preds(spark, rows)).collect()}
    assert got == {"t": 0.5, "u": None}


def test_E1_weights_equal_repeats(spark):
    weighted = preds(spark).withColumn("w", F.when(F.col("sample_id") == 1, 3.0).otherwise(1.0))
    repeated = preds(spark, PRED + [PRED[1], PRED[1]])
    assert one(M.auroc(weighted, weight="w"))["value"] == pytest.approx(one(M.auroc(repeated))["value"])


def test_E3_macro(spark):
    values = spark.createDataFrame([("a", 0.75), ("b", None)], "label string, value double")
    assert one(M.macro(values))["value"] == pytest.approx(0.625)


def test_E4_average_precision(spark):
    assert one(M.average_precision(preds(spark)))["value"] == pytest.approx(0.833333, abs=1e-6)


def test_E6_macro_roc_is_the_mean_curve(spark):
    rows = [(i, "a", t, s) for i, (t, s) in enumerate([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)])]
    rows += [(i, "b", t, s) for i, (t, s) in enumerate([(0, 0.9), (1, 0.5), (0, 0.5), (1, 0.1)])]
    got = {round(r["fpr"], 4): r["tpr"] for r in M.macro_roc(preds(spark, rows)).collect()}
    # a: (0, .5) (.5, .5 -> 1) (1, 1); b: (0, 0) (.5, 0) (1, .5 -> 1)
    assert got == {0.0: pytest.approx(0.25), 0.5: pytest.approx(0.5), 1.0: pytest.approx(1.0)}


def test_E7_masked_and_empty(spark):
    rows = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", None, 9.0), ("b", None, 1.0)], "label string, target double, score double"
    )
    got = {r["label"]: (r["mae"], r["r2"]) for r in M.regression_errors(rows).collect()}
    assert got == {"a": (0.5, pytest.approx(0.5)), "b": (None, None)}


def test_E12_threshold(spark):
    assert one(M.threshold_search(preds(spark), 0.9))["threshold"] == pytest.approx(0.1)
    assert one(M.threshold_search(preds(spark), 1.0))["threshold"] == -1.0
    assert one(M.threshold_search(preds(spark), 0.5, "specificity"))["threshold"] == pytest.approx(0.4)


def test_E14_composite(spark):
    errors = spark.createDataFrame([(0.5,)], "value double")
    assert one(M.composite(M.auroc(preds(spark)), errors))["value"] == pytest.approx(0.75)


def test_T1_chunks(spark):
    rec = spark.createDataFrame([(1, 25)], "record_id int, data_length int")
    spans = lambda **k: [(r["start_idx"], r["end_idx"]) for r in C.chunk_index(rec, **k).orderBy("start_idx").collect()]
    assert spans(chunk_length=10, min_chunk_length=10) == [(0, 10), (10, 20)]
    assert [s for s, _ in spans(chunk_length=10, stride=5, min_chunk_length=10)] == [0, 5, 10, 15]
    assert spans(chunk_length=10, min_chunk_length=5) == [(0, 10), (10, 20), (20, 25)]
    assert spans() == [(0, 25)]


def test_T1_many_chunks_in_pieces(spark):
    rec = spark.createDataFrame([(1, 30000)], "record_id int, data_length int")
    out = C.chunk_index(rec, chunk_length=1)
    assert out.count() == 30000 and out.agg(F.sum("end_idx")).first()[0] == sum(range(1, 30001))


def test_T6_fixed_crop_must_fit(spark):
    rec = spark.createDataFrame([(1, 8)], "record_id int, data_length int")
    with pytest.raises(Exception, match="past its chunk"):
        C.fixed_crop(C.chunk_index(rec, chunk_length=8), 0, 8).collect()


def test_F5_F6_codes(spark):
    df = spark.createDataFrame([(["I4819X"],), (["S72X"],), (["I1"],)], "c array<string>")
    got = df.select(L.code_prefixes(L.truncate_codes(F.col("c"), 5)).alias("v")).collect()
    assert [r["v"] for r in got] == [["I48", "I481", "I4819"], ["S72"], []]


def test_F2_missing_and_repeated_keys(spark):
    df = spark.createDataFrame([(["Age: 63", "Sex: M", "Age: n/a", "free text"],)], "c array<string>")
    got = one(df.select(L.comment_age(F.col("c")).alias("a"), L.comment_sex(F.col("c")).alias("s"), L.comment_value(F.col("c"), "Dx").alias("d")))
    assert (got["a"], got["s"], got["d"]) == (None, "male", None)


def test_F3_trim_before_blacklist(spark):
    df = spark.createDataFrame([([" no", "Angina ", "unknown"],)], "c array<string>")
    assert one(df.select(L.drop_blacklisted(F.col("c")).alias("v")))["v"] == ["Angina"]


def test_F4_never_evaluates(spark):
    df = spark.createDataFrame([("['a', \"b's\", None]", "__import__('os')")], "x string, y string")
    got = one(df.select(L.literal_list("x").alias("x"), L.literal_list("y").alias("y")))
    assert got["x"] == ["a", "b's", None] and got["y"] is None


SIG = "record_id int, t int, value double"


@pytest.mark.parametrize("clip,expected", [(0.0, [None, 1, 2, 3, 3]), (2.0, [None, 1, 2, 2, 2])])
@pytest.mark.parametrize("block", [2, 100])
def test_W5_gap_fill(spark, clip, expected, block):
    rows = [(1, t, v) for t, v in enumerate([None, 1.0, None, 3.0, None])]
    out = R.gap_fill(spark.createDataFrame(rows, SIG), ["record_id"], clip=clip, block=block)
    assert col(out.orderBy("t")) == expected


def ts(text):
    return dt.datetime.fromisoformat(text)


def near(spark, points, tolerance, **kwargs):
    anchors = spark.createDataFrame([(1, ts("2020-03-01 10:00:00"))], "subject_id int, anchor_time timestamp_ntz")
    rows = spark.createDataFrame([(1, ts(t), "m", v) for t, v in points], "subject_id int, time timestamp_ntz, name string, value double")
    return [(r["time_diff"], r["value"]) for r in nearest_long(anchors, rows, ["m", "n"], tolerance, **kwargs).collect()]


def test_J6_hours(spark):
    points = [("2020-03-01 09:30:00", 1.0), ("2020-03-01 10:20:00", 2.0), ("2020-03-01 11:30:00", 9.0)]
    assert near(spark, points, HOUR) == [(20 * 60 * 10**6, 2.0)]


def test_J6_tie_takes_earlier_then_smaller(spark):
    points = [("2020-03-01 10:30:00", 1.0), ("2020-03-01 09:30:00", 8.0), ("2020-03-01 09:30:00", 7.0)]
    assert near(spark, points, HOUR)[0][1] == 7.0


def test_J6_whole_days(spark):
    assert near(spark, [("2020-03-31 09:00:00", 5.0)], 30 * DAY, whole_days=True) == [(29, 5.0)]
    late = [("2020-01-30 11:00:00", 5.0), ("2020-01-30 10:00:00", 6.0)]  # 30d23h kept, 31d dropped
    assert near(spark, late, 30 * DAY, whole_days=True) == [(30, 5.0)]
    # Both within the same whole day: the earliest row wins although it is farther.
    same = [("2020-03-01 09:00:00", 1.0), ("2020-02-29 11:00:00", 2.0), ("2020-03-01 10:30:00", 3.0)]
    assert near(spark, same, 30 * DAY, whole_days=True) == [(0, 2.0)]


def test_A4_tie(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", "z")], "g string, i string")
    assert sorted((r["g"], r["i"]) for r in A.dominant(df, ["g"], "i").collect()) == [("g", "a"), ("h", "z")]


def test_A5_trim(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 6)] + [("g", None)], "g string, v double")
    assert sorted(col(A.trim_quantiles(df, ["g"], "v"), "v")) == [2, 3, 4]


def test_A8_pooled(spark):
    df = spark.createDataFrame([("c", 0.0, 1.0, 2), ("c", 3.0, 1.0, 2)], "channel string, mean double, std double, length int")
    got = one(A.dataset_stats_pooled(df))
    assert got["mean"] == pytest.approx(1.5) and got["std"] ** 2 == pytest.approx(3.25)


def test_A8_keeps_small_spread_on_large_offset(spark):
    df = spark.createDataFrame([("c", 1e9, 0.5, 10), ("c", 1e9 + 1, 0.5, 10)], "channel string, mean double, std double, length int")
    assert one(A.dataset_stats_pooled(df))["std"] ** 2 == pytest.approx(0.5)


def test_A11_disagreeing_targets(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 0.5), (1, "a", None, 0.7)], "record_id int, label string, target double, score double")
    with pytest.raises(Exception, match="targets of one record differ"):
        A.aggregate_predictions(df).collect()


def test_A12_stitch(spark):
    df = spark.createDataFrame([(1, 0, [1.0] * 4), (1, 1, [3.0] * 4)], "record_id int, chunk int, values array<double>")
    assert col(A.stitch_overlap(df, ["record_id"], 2).orderBy("pos")) == [1, 1, 2, 2, 3, 3]


def test_A1_counts_occurrences(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a"])], "id int, l array<string>")
    assert [(r["label"], r["count"]) for r in K.vocabulary(df, "l", 3).collect()] == [("a", 3)]
    assert one(K.label_counts(df, "l", per_record=True).where("label = 'a'"))["count"] == 2
    mapped = K.map_labels(df, ["id"], "l", K.vocabulary(df, "l", 3)).orderBy("id").collect()
    assert [r["l_filtered_numeric"] for r in mapped] == [[0, 0], [0]]


def test_A15_validity(spark):
    rows = [(18, [1.0, None, 5.0]), (18, [1.0, 0.0, 6.0]), (18, [0.0, 0.0, 7.0]), (18, [0.0, 1.0, None])]
    df = spark.createDataFrame(rows, "fold int, v array<double>")
    assert [r["place"] for r in A.class_validity(df, "fold", "v").orderBy("place").collect()] == [1, 2]
    assert A.class_validity(df, "fold", "v", regression=True).count() == 0


def test_W6_weights(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 0, 30), ("b", 0, 20)], "c string, start_idx int, end_idx int")
    out = R.sampling_weights(df, "c", total_by="c").orderBy("end_idx").collect()
    assert [(r["end_idx"], round(r["weight"], 9)) for r in out] == [(10, 1.0), (20, 4.0), (30, 3.0)]


def test_T18_segments(spark):
    df = spark.createDataFrame([(1, t, c) for t, c in enumerate([0, 0, 1, 1, 1, 0])], "record_id int, t int, label int")
    assert col(C.segment_labels(df, [0, 1], 3).orderBy("epoch"), "label") == [0, 1]
    assert one(C.segment_labels(df, [0, 1], 0, "fraction"))["label"] == [0.5, 0.5]


def test_P14_folds(spark):
    df = spark.range(10).withColumnRenamed("id", "fold")
    pick = lambda *w: sorted(col(clean.select_folds(df, "fold", list(w)), "fold"))
    assert pick("x-1", "x-2") == list(range(8))
    assert pick("0", "-1") == [0, 9] and pick("all") == list(range(10))
    with pytest.raises(ValueError):
        pick("1", "x2")


def test_P6_binary(spark):
    df = spark.createDataFrame([(" Yes ",), ("NEG",)], "x string")
    assert col(df.select(clean.parse_binary("x").alias("value"))) == [1, 0]
    with pytest.raises(Exception, match="not a binary value"):
        spark.createDataFrame([("maybe",)], "x string").select(clean.parse_binary("x")).collect()


def test_P8_short_years(spark):
    df = spark.createDataFrame([("29-Sep-90",), ("01-Jan-05",), ("n/a",)], "x string")
    assert col(df.select(clean.parse_date("x", clean.DATE_SHORT_MONTH).alias("value"))) == [dt.date(1990, 9, 29), dt.date(2005, 1, 1), None]


def test_R6_out_of_range(spark):
    df = spark.createDataFrame([([0, 3],)], "i array<int>")
    with pytest.raises(Exception, match="outside"):
        df.select(L.multi_hot(F.col("i"), 3)).collect()


def test_T8_lengths(spark):
    rows = spark.createDataFrame([(1, "i", t, float(t)) for t in range(10)], "record_id int, channel string, t int, value double")
    assert col(G.resample_linear(rows, 500, 250).orderBy("t")) == [0, 2, 4, 6, 8]
    assert G.resample_linear(rows, 500, 240).count() == 4


def test_T9_leads(spark):
    rows = spark.createDataFrame([(1, "II", 0, 5.0), (1, "aVR", 0, 7.0)], "record_id int, channel string, t int, value double")
    assert col(G.lead_fill(rows, ["i", "ii", "iii", "avr"]).orderBy("channel")) == [0.0, 5.0, 0.0, 7.0]


def test_T10_trim(spark):
    rows = spark.createDataFrame([(1, t, v) for t, v in enumerate([0.0, 0.0, 3.0, 4.0, 0.0, 0.0])], SIG)
    assert [(r["t"], r["value"]) for r in G.zero_trim(rows).orderBy("t").collect()] == [(0, 3.0), (1, 4.0)]


def test_J7_rules(spark):
    rec = spark.createDataFrame([("r1", 100)], "NAME string, data_length int")
    spans = spark.createDataFrame(
        [("r1", "1", "2.5", "test"), ("r1", "x", "3", "test"), ("r1", "4", "4", "test"), ("r1", "0", "1", "val"), ("q", "0", "1", "test")],
        "Record_Name string, start_sec string, end_sec string, split string",
    )
    out = J.attach_intervals(rec, spans, 10, split="test")
    assert [(r["start_idx"], r["end_idx"]) for r in out.collect()] == [(10, 25)]
    with pytest.raises(ValueError, match="no record"):
        J.attach_intervals(rec, spans.where("false"), 10, check_empty=True)


def test_J8_first_and_last(spark):
    names = spark.createDataFrame([("1", 0, "x"), ("1", 1, "y"), ("2", 2, "z")], "code string, row int, name string")
    rows = spark.createDataFrame([(1, ["2", "9", "1"]), (2, ["9"])], "id int, codes array<string>")
    for how, expected in (("first", ["z", "x"]), ("last", ["z", "y"])):
        table = J.first_definition(names, "code", "row", ["name"], how)
        out = J.translate_codes(rows, ["id"], "codes", table, "code", ["name"]).orderBy("id").collect()
        assert [r["codes_name"] for r in out] == [expected, []]


@pytest.mark.parametrize("cap", [0, 1, 7, 25, 1000])
def test_S8_files_close_after_the_cap(spark, cap):
    lengths = [(i * 7919) % 13 + (i % 3) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(lengths)), "id int, n int")
    got = [(r["file_idx"], r["start"]) for r in packing.pack_manifest(df, ["id"], "n", cap).orderBy("id").collect()]
    expected, file_idx, at = [], 0, 0
    for n in lengths:
        if cap > 0 and at > cap:
            file_idx, at = file_idx + 1, 0
        expected.append((file_idx, at))
        at += n
    assert got == expected


def test_S9_shapes_must_match(spark):
    one_ = spark.createDataFrame([(0, 5, 0, 0)], "data long, length long, file_idx long, start long")
    with pytest.raises(ValueError):
        packing.append_manifest(one_, one_, shape_first=[12], shape_second=[8])
    out = packing.append_manifest(one_, one_).orderBy("data").collect()
    assert [(r["data"], r["start"]) for r in out] == [(0, 0), (1, 5)]


def test_scale_helpers_against_brute_force(spark):
    rows = [(i % 3, (i * 37) % 11, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, v int, id int")
    got = {r["id"]: r["pos"] for r in position(df, ["g"], ["v", "id"]).collect()}
    for g in range(3):
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in ordered] == list(range(len(ordered)))
    sliced = running_sum(df, ["g"], ["id"], {"s": F.col("v")}, inclusive=True, slice_by=F.floor(F.col("id") / 16), totals=True)
    for r in sliced.collect():
        assert r["s"] == sum(x[1] for x in rows if x[0] == r["g"] and x[2] <= r["id"])
        assert r["s_total"] == sum(x[1] for x in rows if x[0] == r["g"])
    holes = df.withColumn("x", F.when(F.col("v") == 5, F.col("id")))
    for backward in (False, True):
        out = carry(holes, ["g"], F.floor(F.col("id") / 10), ["id"], **{"following" if backward else "last": {"y": F.col("x")}})
        for r in out.collect():
            known = [x[2] for x in rows if x[0] == r["g"] and x[1] == 5 and (x[2] >= r["id"] if backward else x[2] <= r["id"])]
            assert r["y"] == ((min if backward else max)(known) if known else None)


def test_exact_quantiles(spark):
    import numpy as np

    values = [float((i * 31) % 17) for i in range(97)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    got = one(exact_quantiles(df, [], "v", {"a": 0.01, "b": 0.5, "c": 0.99}))
    assert [got[k] for k in "abc"] == pytest.approx(np.percentile(values, [1, 50, 99]).tolist())
