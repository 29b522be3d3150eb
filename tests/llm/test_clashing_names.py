"""Stages and joins on tables whose columns bear the names used inside, or names with dots."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import jaccard, lines, mixing, toxicity, urls

NAMES = ["_rid", "_row", "_places", "_toxic", "_gone", "_url", "_day", "_lists", "a.b", "in0", "in1", "rid", "unit", "key", "_text", "_key", "_size", "lists"]


def table(spark, texts):
    cells = ", ".join(f"`{n}` string" for n in NAMES)
    rows = [[f"{n} {i}" for n in NAMES] for i in range(len(texts))]
    return spark.createDataFrame(
        [(i, t, "s1" if i % 2 else None, *r) for i, (t, r) in enumerate(zip(texts, rows))], f"doc_id long, text string, source string, {cells}"
    ).repartition(3)


def texts():
    rng = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    body = " ".join(rng.choice(words) for _ in range(80))
    return [body, body + "\nown end", None, "", body, "one line\nanother line", "one line"] + [" ".join(rng.choice(words) for _ in range(30)) for _ in range(5)]


def others(frame):
    """The extra cells of every document; they must pass through unchanged."""
    return {r["doc_id"]: tuple(r[n] for n in NAMES) for r in frame.collect()}


@pytest.mark.parametrize("stage", ["lines", "jaccard", "mixing", "toxicity"])
def test_stages_keep_all_columns(spark, stage):
    docs = table(spark, texts())
    marks = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    run = {
        "lines": lambda d: lines.dedupe_lines(d),
        "jaccard": lambda d: jaccard.drop_near_copies(d),
        "mixing": lambda d: mixing.mixed_documents(d),
        "toxicity": lambda d: toxicity.drop_toxic(d, toxicity.fit_toxicity(d, marks)),
    }[stage]
    out = run(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    want, got = others(docs), others(out)
    assert got and all(want[i] == cells for i, cells in got.items())
    plain = run(docs.select("doc_id", "text", "source"))
    assert sorted(map(tuple, out.select("doc_id", "text").collect()), key=str) == sorted(map(tuple, plain.select("doc_id", "text").collect()), key=str)
    assert run(docs.limit(0)).count() == 0


def test_counted_lines_take_the_place_of_a_column(spark):
    docs = table(spark, texts())
    out = lines.dedupe_lines(docs, count="_places")
    assert out.columns == [c for c in docs.columns if c != "_places"] + ["_places"]
    assert out.agg(F.sum("_places")).first()[0] > 0


def test_captures_keep_all_columns(spark):
    docs = table(spark, ["http://a.example.org/x/y", "http://b.example.org/", None, "no host"]).withColumn("fetch_day", F.lit(5))
    entries = spark.createDataFrame([("spam", "host", "a.example.org", "add", 1)], "list string, scope string, entry string, action string, day int")
    out = urls.judge(docs, entries, url="text")
    assert out.columns == [c for c in docs.columns if c != "lists"] + ["blocked", "lists"]
    got = {r["doc_id"]: (r["blocked"], r["lists"], r["_url"], r["a.b"]) for r in out.collect()}
    assert got == {i: (i == 0, "spam" if i == 0 else "", f"_url {i}", f"a.b {i}") for i in range(4)}
