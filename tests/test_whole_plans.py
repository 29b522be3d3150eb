"""Whole plans on small fixtures with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.codes import CohortSpec, cohort_labels
from pulsegrid.plans import clinical, curation, evaluate, probe_export
from pulsegrid.session import scratch_path
from pulsegrid.sources import packing, sinks
from pulsegrid.sources import tables as S


def at(hour, minute=0, day=1):
    return dt.datetime(2020, 3, day, hour, minute)


def cohort_rows(spark):
    rows = [
        # study, fold, visit, in ed, any, ed codes, all codes
        (1, 0, 0, True, True, ["I4819X"], ["I4819X", "E119"]),
        (2, 0, 1, True, True, ["I4819X"], ["I4819X"]),  # later recording of the stay
        (3, 1, 0, False, True, ["I10"], ["I10"]),  # not in the training cohort
        (4, 2, 0, True, True, [], ["I10"]),  # no training code
        (5, 18, 1, False, True, [], ["I481", "I10"]),
        (6, 19, 0, False, True, [], []),  # no test code
        (7, 19, 0, False, False, [], ["I48"]),
        (8, 19, 0, False, True, [], ["I48"]),
    ]
    schema = (
        "study_id int, fold int, ecg_no_within_stay int, ecg_taken_in_ed boolean, ecg_taken_in_ed_or_hosp boolean, "
        "ed_diag_ed array<string>, all_diag_all array<string>"
    )
    return spark.createDataFrame(rows, schema)


def test_F8_cohort(spark):
    out, vocab = cohort_labels(cohort_rows(spark), CohortSpec.parse("x_edfirst_edI_all_all_2_4A"))
    assert [(r["label"], r["count"], r["idx"]) for r in vocab.orderBy("idx").collect()] == [("I48", 2, 0), ("I481", 2, 1)]
    got = {r["study_id"]: sorted(r["label"]) for r in out.collect()}
    assert got == {1: ["I48", "I481"], 5: ["I48", "I481"], 8: ["I48"]}


def test_F8_without_ancestors_keeps_known_prefixes(spark):
    _, vocab = cohort_labels(cohort_rows(spark), CohortSpec.parse("x_ed_ed_all_all_1_5"))
    # The cut codes are I4819 and I10; only prefixes among them survive.
    assert sorted(r["label"] for r in vocab.collect()) == ["I10", "I4819"]


def test_F8_config_errors():
    with pytest.raises(ValueError):
        CohortSpec.parse("x_icu_ed_all_all_1")
    spec = CohortSpec.parse("x_hospfirst_hospaf_ed_ed_7")
    assert (spec.train_flag, spec.train_first, spec.category, spec.digits) == ("ecg_taken_in_hosp", True, "af", None)


def test_bedside_units_and_names(spark):
    items = spark.createDataFrame(
        [(1, "Daily Weight"), (2, "Temperature Celsius"), (3, "Albumin"), (4, "Safety Measures"), (5, "Heart Rate"), (6, "PAR-Oxygen saturation")],
        "itemid int, label string",
    )
    events = [(1, i, at(9), v, u) for i, v, u in [(1, 100.0, "kg"), (2, 37.0, "C"), (3, 4.0, None), (4, 1.0, "x"), (5, 80.0, "bpm"), (6, 97.0, "%")]]
    events.append((2, 1, at(9), 50.0, "kg"))  # unknown subject
    frame = spark.createDataFrame(events, "subject_id int, itemid int, storetime timestamp_ntz, valuenum double, valueuom string")
    out = clinical.bedside_rows(items, frame, spark.createDataFrame([(1,)], "subject_id int"), min_count=1)
    got = {r["name"]: round(r["value"], 4) for r in out.collect()}
    assert got == {"Weight (lbs)": 220.462, "temperature": 98.6, "heartrate": 80.0}


def test_lab_rows_keep_one_item_and_unit(spark):
    items = spark.createDataFrame([(50862, "Albumin"), (53085, "Albumin"), (7, "Other")], "itemid int, label string")
    rows = [(1, 50862, at(9), float(v), "g/dL") for v in range(1, 6)]
    rows += [(1, 50862, at(9), 3.0, "mg"), (1, 53085, at(9), 3.0, "g/dL"), (1, 7, at(9), 1.0, "g"), (9, 50862, at(9), 3.0, "g/dL")]
    frame = spark.createDataFrame(rows, "subject_id int, itemid int, storetime timestamp_ntz, valuenum double, valueuom string")
    out = clinical.lab_rows(items, frame, spark.createDataFrame([(1,)], "subject_id int"))
    assert sorted(r["value"] for r in out.collect()) == [2.0, 3.0, 4.0]


def test_attach_nearest(spark):
    records = spark.createDataFrame([(1, at(10)), (2, at(10))], "subject_id int, ecg_time timestamp_ntz")
    schema = "subject_id int, time timestamp_ntz, name string, value double"
    body = spark.createDataFrame([(1, at(0, day=20), "Weight (Lbs)", 150.0)], schema)
    vitals = spark.createDataFrame([(1, at(9, 30), "sbp", 120.0), (1, at(12), "dbp", 70.0)], schema)
    labs = spark.createDataFrame([(2, at(10, 59), "PT", 11.0)], schema)
    got = {r["subject_id"]: r for r in clinical.attach_nearest(records, body, vitals, labs).collect()}
    assert (got[1]["Weight (Lbs)"], got[1]["sbp"], got[1]["dbp"], got[1]["PT"]) == (150.0, 120.0, None, None)
    assert (got[2]["Weight (Lbs)"], got[2]["PT"]) == (None, 11.0)


def test_evaluate_has_replicate_bounds(spark):
    rows = [(i, i // 2, "a", (i // 2) % 2, float((i * 7) % 11) - 5) for i in range(60)]
    rows += [(i, i // 2, "n", i // 2, float(i // 2) + 1) for i in range(60)]
    frame = spark.createDataFrame(
        [(s, r, l, float(t), z) for s, r, l, t, z in rows], "sample_id int, record_id int, label string, target double, score double"
    )
    out = {(r["aggregation"], r["metric"], r["label"]): r for r in evaluate.evaluate(frame, ["n"], replicates=5, seed=1).collect()}
    plain = {(r["aggregation"], r["metric"], r["label"]): r["value"] for r in evaluate.evaluate(frame, ["n"]).collect()}
    assert set(out) == set(plain) and len(plain) == 2 * (3 + 3 + 2 + 1)
    for key, value in plain.items():
        assert out[key]["value"] == pytest.approx(value)
        assert out[key]["low"] <= out[key]["high"]
    one = ("agg", "composite_score", "all")
    assert plain[one] == pytest.approx(1 - plain[("agg", "auroc", "macro")] + 1.0)


def test_probe_rules(spark):
    frame = spark.createDataFrame([(1, 0, 6000, [1]), (2, 9, 100, [0]), (3, 9, 6000, [])], "ecg_id int, strat_fold int, data_length int, label_filtered_numeric array<int>")
    out = probe_export.build_pairs(frame, probe_export.DATASETS["georgia"], ["a", "b"]).orderBy("record_id").collect()
    assert [(r["record_id"], r["split"], r["label"], r["a"], r["b"]) for r in out] == [("1", "train", "b", 0, 1), ("3", "test", "", 0, 0)]
    with pytest.raises(ValueError, match="strat_fold"):
        probe_export.build_pairs(frame.drop("strat_fold"), probe_export.DATASETS["code15_diag"], ["a"])


def test_comment_lines_status(spark):
    def lines(event, treated):
        return [
            "Reason for admission: Myocardial infarction", "Additional diagnoses: no", "ECG date: 01/10/1990",
            f"Infarction date (acute): {event}", f"Catheterization date: {treated}",
        ]

    rows = [(0, lines("29-Sep-90", "30-Sep-90")), (1, lines("29-Sep-90", "n/a")), (2, lines("01-Jan-80", "-"))]
    out = curation.from_comment_lines(spark.createDataFrame(rows, "id int, comments array<string>")).orderBy("id").collect()
    assert [r["labels"] for r in out] == [
        ["Myocardial infarction acute catheterized"], ["Myocardial infarction acute"], ["Myocardial infarction old"],
    ]


def test_write_and_read_packed(spark):
    manifest = packing.pack_manifest(spark.createDataFrame([(0, 3), (1, 3), (2, 2)], "record_id int, n int"), ["record_id"], "n", 4)
    sig = spark.createDataFrame([(r, t, float(10 * r + t)) for r, n in ((0, 3), (1, 3), (2, 2)) for t in range(n)], "record_id int, t int, value double")
    path = scratch_path(spark, "packed")
    packing.write_packed(sig, manifest, path)
    back = spark.read.parquet(path).orderBy("file_idx", "at").collect()
    assert [(r["file_idx"], r["at"], r["value"]) for r in back] == [
        (0, 0, 0.0), (0, 1, 1.0), (0, 2, 2.0), (0, 3, 10.0), (0, 4, 11.0), (0, 5, 12.0), (1, 0, 20.0), (1, 1, 21.0),
    ]


def test_S11_fallback(spark):
    root = scratch_path(spark, "set")
    sinks.save_dataset(spark.range(3), root)
    rows, vocab, stats = sinks.load_dataset(spark, root)
    assert rows.count() == 3 and vocab is None and stats is None
    with pytest.raises(FileNotFoundError):
        sinks.load_dataset(spark, root + "-none")


def test_S16_failures_can_stop_the_job(spark):
    rows = spark.createDataFrame([(1, None), (2, "corrupt")], "id int, error string")
    good, failed = S.split_failures(rows, ["id"])
    assert [r["id"] for r in good.collect()] == [1] and failed.count() == 1
    with pytest.raises(Exception, match="corrupt"):
        S.split_failures(rows, ["id"], skip_errors=False)[0].collect()


def test_S4_rules(spark):
    frame = spark.createDataFrame([(i, "yes") for i in range(50)], "NAME int, Label string")
    out = S.load_splits({"val": frame, "odd": frame}, ["NAME", "Label"], limit=10)
    assert {(r["split"], r["strat_fold"], r["count"]) for r in out.groupBy("split", "strat_fold").count().collect()} == {("val", 8, 10), ("odd", 0, 10)}
    with pytest.raises(ValueError, match="Label"):
        S.load_splits({"val": frame.drop("Label")}, ["NAME", "Label"])
    names = spark.createDataFrame([("a/my_valid.csv",), ("x_val.csv",), ("TRAIN.csv",), ("a/odd.csv",)], "n string")
    assert [r[0] for r in names.select(S.infer_split(F.col("n"))).collect()] == ["valid", "val", "train", "odd"]


def test_skewed_subject_matches_small_join(spark):
    """A third of all rows on one subject: same rows as a plain pair join."""
    from pulsegrid.operators.nearest import HOUR, nearest_long

    base = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("subject_id"),
        (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 7919) % 20000)).alias("time"),
        F.when(F.col("id") % 5 == 0, "anchor").otherwise("m").alias("name"), (F.col("id") % 97).cast("double").alias("value"),
    )
    anchors = base.where("name = 'anchor'").select("subject_id", F.col("time").alias("anchor_time")).distinct()
    got = {(r["subject_id"], r["anchor_time"]): r["value"] for r in nearest_long(anchors, base, ["m"], HOUR).collect()}
    rows = base.where("name = 'm'").collect()
    by = {}
    for r in rows:
        by.setdefault(r["subject_id"], []).append((r["time"], r["value"]))
    expected = {}
    for a in anchors.collect():
        near = [(abs(t - a["anchor_time"]), t, v) for t, v in by.get(a["subject_id"], []) if abs(t - a["anchor_time"]) <= dt.timedelta(hours=1)]
        if near:
            expected[(a["subject_id"], a["anchor_time"])] = min(near)[2]
    assert got == expected and len(got) > 100
