"""Plan shape: no window over one undivided group, no cross join, pushed filters."""

import re

import pytest
from conftest import SMALL

import __spark_entry__ as entry

QUERIES = entry.queries()
# Windows over a fixed number of rows: one per listed threshold.
FIXED_SIZE = {"sample_centric_fmax"}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        "nearest_measure_wide", "quantile_trim_simultaneous", "chunk_index", "gap_fill_linear", "resample_linear",
        "auroc", "macro_roc", "pack_bins", "sampling_weights", "vocab_map", "stratified_folds", "interval_attach",
        "group_labels", "anti_dup", "union_remap", "frequent_label_semi", "first_in_stay", "sample_normalise",
    ],
)
def test_no_cross_join(spark, name):
    text = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_windows_are_partitioned(spark):
    for name in ("nearest_measure_wide", "auroc", "gap_fill_linear", "pack_bins", "vocab_filter"):
        text = plan_of(QUERIES[name](spark, SMALL))
        for window in re.findall(r"Window \[.*", text):
            assert not re.search(r"\], \[\], \[", window), (name, window)


def test_scan_reads_needed_columns(spark):
    text = plan_of(QUERIES["prevalence"](spark, SMALL))
    assert "n_chars" in text and "text:string" not in text


def test_nearest_filters_reach_the_scan(spark):
    text = plan_of(QUERIES["nearest_measure_wide"](spark, SMALL))
    assert "PushedFilters: [" in text and "event_type" in text.split("PushedFilters", 1)[1]


def test_no_collects_in_operators():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "pulsegrid" / "operators"
    for path in root.glob("*.py"):
        text = path.read_text()
        assert ".collect()" not in text and ".toPandas()" not in text, path.name
        assert "crossJoin" not in text and "localCheckpoint" not in text, path.name
