"""Queries that run whole plans over stand-ins built from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.base import CODES, codes, query, r6, table, text_list
from pulsegrid.functions import clean
from pulsegrid.plans import clinical, curation, evaluate, probe_export


def _clinical_sources(spark, sf):
    """Purchases are recordings; the other events are measurements of all kinds."""
    ev = table(spark, sf, "events")
    day, uid, eid = F.col("ts"), F.col("user_id"), F.col("event_id")
    number = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    code = F.concat(F.lit("I"), F.lpad((number % 20).cast("string"), 2, "0"), (eid % 3).cast("string"), F.lit("X"))
    shots = ev.where("event_type = 'purchase'")
    records = shots.select(
        eid.alias("study_id"), eid.alias("data"), uid.alias("subject_id"), day.alias("ecg_time"),
        F.when(uid % 2 == 0, "F").when(uid % 5 != 0, "M").alias("gender"), (uid % 90).cast("double").alias("age"),
        (uid % 20).alias("fold"), (uid % 20).alias("strat_fold"), (eid % 2).alias("ecg_no_within_stay"),
        (eid % 3 != 0).alias("ecg_taken_in_ed"), F.lit(True).alias("ecg_taken_in_ed_or_hosp"),
        F.array(code, F.lit("R07")).alias("all_diag_all"),
    )
    deterioration = shots.where(eid % 4 != 0).select(
        eid.alias("general_data"), uid.alias("general_subject_id"), (uid % 20).alias("general_strat_fold"),
        F.when(eid % 5 == 0, -999.0).otherwise((number > 50).cast("double")).alias("deterioration_icu"),
        (number > 70).cast("double").alias("deterioration_mortality"),
    )
    marks = shots.select(
        eid.alias("data"), (F.col("value") * 20).alias("rr_interval"), number.cast("double").alias("p_onset"),
        (number + 40.0).alias("p_end"), (number + 60.0).alias("qrs_onset"), (number + 150.0).alias("qrs_end"),
        (number + 400.0).alias("t_end"), (number * 5.0 - 200).alias("p_axis"), (number * 3.0).alias("qrs_axis"),
        (number * 4.0).alias("t_axis"),
    )
    name = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int"))
    body = ev.where("event_type = 'click'").select(
        "user_id", F.to_date("ts").alias("chartdate"), F.lit(0).alias("seq_num"), name(clinical.BODY_NAMES).alias("result_name"),
        F.when(number % 9 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("result_value"),
    ).withColumnRenamed("user_id", "subject_id")
    vitals = ev.where("event_type = 'view'").select(
        uid.alias("subject_id"), uid.alias("stay_id"), day.alias("charttime"),
        *[F.when((number + i) % 4 != 0, F.col("value") + i).alias(n) for i, n in enumerate(clinical.VITAL_NAMES)],
    )
    items = table(spark, sf, "part").where(F.col("p_partkey") < 18).select(
        (50000 + F.col("p_partkey")).cast("int").alias("itemid"),
        F.element_at(F.array(*[F.lit(n) for n in clinical.LAB_NAMES]), (F.col("p_partkey") + 1).cast("int")).alias("label"),
    )
    lab_events = ev.where("event_type = 'error'").select(
        eid.alias("labevent_id"), uid.alias("subject_id"), (50000 + number % 18).cast("int").alias("itemid"),
        day.alias("storetime"), F.col("value").alias("valuenum"), F.when(eid % 6 != 0, "mg").otherwise("g").alias("valueuom"),
    )
    bedside_items = table(spark, sf, "part").where(F.col("p_partkey") < 17).select(
        (60000 + F.col("p_partkey")).cast("int").alias("itemid"),
        F.element_at(F.array(*[F.lit(n) for n in clinical.BEDSIDE_NAMES]), (F.col("p_partkey") + 1).cast("int")).alias("label"),
    )
    bedside_events = ev.where("event_type = 'signup'").select(
        uid.alias("subject_id"), (60000 + number % 17).cast("int").alias("itemid"), day.alias("storetime"),
        F.col("value").alias("valuenum"), F.when(eid % 8 != 0, "u").alias("valueuom"),
    )
    return clinical.Sources(records, deterioration, marks, body, vitals, items, lab_events, bedside_items, bedside_events)


LAB_ITEMS = [50000 + i for i in range(18)]


@query()
def clinical_targets(spark, sf):
    """The clinical target table."""
    src = _clinical_sources(spark, sf)
    rows, _ = clinical.clinical_targets(src, "x_all_all_all_all_20_4A", min_count=20, lab_items=LAB_ITEMS)
    show = F.transform("label_all", lambda x: F.round(x, 4) + F.lit(0.0))
    return rows.select("study_id", "strat_fold", F.size("label_all").alias("width"), F.array_join(show.cast("array<string>"), ",", "").alias("label_all"))


@query()
def clinical_weak_targets(spark, sf):
    """Label positions with too few values in the held-out folds."""
    src = _clinical_sources(spark, sf)
    rows, names = clinical.clinical_targets(src, "x_all_all_all_all_20_4A", min_count=20, lab_items=LAB_ITEMS)
    return clinical.weak_targets(rows, names)


_EVAL = """WITH base AS (SELECT event_id, user_id, event_type AS label, event_type = 'view' AS num,
  CASE WHEN event_type = 'view' THEN user_id / 10.0::DOUBLE ELSE CAST(user_id % 2 AS DOUBLE) END AS y,
  CASE WHEN event_type = 'view' THEN value ELSE 1 / (1 + exp(-value / 50)) END AS z FROM events),
lines AS (SELECT 'noagg' AS agg, label, num, y, z FROM base UNION ALL SELECT 'agg', label, num, max(y), avg(z) FROM base GROUP BY user_id, label, num),
c AS (SELECT * FROM lines WHERE NOT num),
g AS (SELECT agg, label, z, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM c GROUP BY 1, 2, 3),
m AS (SELECT agg, z, sum(p) AS p, sum(n) AS n FROM g GROUP BY 1, 2),
u AS (SELECT agg, label, z, p, n FROM g UNION ALL SELECT agg, 'micro', z, p, n FROM m),
r AS (SELECT agg, label, z, p, n, sum(n) OVER up AS below, sum(p) OVER down AS tp, sum(n) OVER down AS fp FROM u
  WINDOW up AS (PARTITION BY agg, label ORDER BY z), down AS (PARTITION BY agg, label ORDER BY z DESC)),
s AS (SELECT agg, label, sum(p * (below - n / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS auroc, sum(p * tp / (tp + fp)) / sum(p) AS aupr FROM r GROUP BY 1, 2),
e AS (SELECT agg, label, avg(abs(y - z)) AS mae FROM lines WHERE num GROUP BY 1, 2),
a AS (SELECT agg, 'auroc' AS metric, label, auroc AS value FROM s UNION ALL SELECT agg, 'aupr', label, aupr FROM s
  UNION ALL SELECT agg, 'auroc', 'macro', avg(auroc) FROM s WHERE label <> 'micro' GROUP BY 1
  UNION ALL SELECT agg, 'aupr', 'macro', avg(aupr) FROM s WHERE label <> 'micro' GROUP BY 1
  UNION ALL SELECT agg, 'mae', label, mae FROM e UNION ALL SELECT agg, 'mae', 'micro', mae FROM e)
SELECT agg AS aggregation, metric, label, round(value, 6) + 0.0 AS value FROM a UNION ALL
SELECT x.agg, 'composite_score', 'all', round(1 - x.value + y.value, 6) FROM a x JOIN a y ON x.agg = y.agg AND x.metric = 'auroc' AND x.label = 'macro' AND y.metric = 'mae' AND y.label = 'micro'"""


def _evaluated(spark, sf, **settings):
    number = F.col("event_type") == "view"
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("sample_id"), F.col("user_id").alias("record_id"), F.col("event_type").alias("label"),
        F.when(number, F.col("user_id") / 10.0).otherwise((F.col("user_id") % 2).cast("double")).alias("target"),
        F.when(number, F.col("value")).otherwise(F.col("value") / 50).alias("score"),
    )
    return evaluate.evaluate(rows, numeric=["view"], **settings)


@query(_EVAL)
def evaluation_report(spark, sf):
    """All metrics per sample and per record."""
    return _evaluated(spark, sf).select("aggregation", "metric", "label", r6("value").alias("value"))


@query()
def evaluation_intervals(spark, sf):
    """The report with a thousand replicates and bounds for every value."""
    out = _evaluated(spark, sf, replicates=1000, seed=11)
    return out.select("aggregation", "metric", "label", *[r6(c).alias(c) for c in ("value", "low", "high")], "nulls")


@query("SELECT *, true AS inside, CAST(0 AS BIGINT) AS nulls FROM (" + _EVAL + ")")
def evaluation_intervals_contract(spark, sf):
    """The report's values, each inside its interval, and no undefined replicate."""
    return evaluation_intervals(spark, sf).select(
        "aggregation", "metric", "label", "value", F.col("value").between(F.col("low"), F.col("high")).alias("inside"), "nulls"
    )


@query(
    "WITH " + CODES + """ SELECT 'part_' || CAST(p_partkey AS VARCHAR) AS record_id,
  CASE WHEN p_partkey % 10 = 9 THEN 'test' WHEN p_partkey % 10 = 8 THEN 'val' ELSE 'train' END AS split,
  CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 3 THEN 'c;a' ELSE substr('abc', p_size % 4, 1) END AS label,
  CAST(p_size % 4 IN (1, 3) AS INTEGER) AS a, CAST(p_size % 4 = 2 AS INTEGER) AS b, CAST(p_size % 4 = 3 AS INTEGER) AS c
FROM codes WHERE p_size * 200 >= 5000"""
)
def probe_tables(spark, sf):
    """Probe rows under a dataset's rules."""
    size = F.col("p_size") % 4
    ids = F.when(size == 0, F.array().cast("array<int>")).when(size == 3, F.array(F.lit(2), F.lit(0))).otherwise(F.array((size - 1).cast("int")))
    rows = table(spark, sf, "part").select(
        F.concat(F.lit("out/part_"), F.col("p_partkey").cast("string"), F.lit(".npy")).alias("data"),
        (F.col("p_partkey") % 10).alias("strat_fold"), (F.col("p_size") * 200).alias("data_length"), ids.alias("label_filtered_numeric"),
    )
    return probe_export.build_pairs(rows, probe_export.DATASETS["georgia"], ["a", "b", "c"])


@query(
    """WITH d AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS file_source, 'S000' || CAST(o_custkey % 4 AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS partition, o_orderstatus FROM orders),
i AS (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ';' ORDER BY l_linenumber) AS codes FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1)
SELECT d.file_source, d.partition, coalesce(i.codes, '') AS codes, CASE WHEN o_orderstatus = 'P' THEN 'Unavailable' ELSE o_orderstatus END AS race
FROM d LEFT JOIN i ON i.l_orderkey = d.o_orderkey WHERE d.o_orderkey % 11 <> 5"""
)
def curate_partitioned(spark, sf):
    """Demographics with statement codes, duplicates removed."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    key = F.col("o_orderkey").cast("string")
    path = F.concat(F.lit("root/S000"), (F.col("o_custkey") % 4).cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"), F.lit("/"), key, F.lit(".hea"))
    demographics = orders.select(
        path.alias("FileName"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("PatientRace"), F.lit(None).cast("string").alias("SexDSC")
    )
    grouped = lines.groupBy(F.col("l_orderkey").cast("string").alias("file_source")).agg(
        F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ", ").alias("diagnostic_codes")
    )
    listed = orders.where("o_orderkey % 11 = 5").select(F.concat(F.lit("a/b/"), key).alias("file_name"))
    out = curation.from_partitioned(demographics, grouped, listed)
    return out.select("file_source", "partition", F.array_join("diagnostic_codes", ";").alias("codes"), F.col("PatientRace").alias("race"))


@query(
    """WITH x AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_custkey % 6 AS INTEGER)) AS days, o_custkey % 9 AS treated, o_orderstatus FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Myocardial infarction' || CASE WHEN NOT days BETWEEN 0 AND 3 THEN ' old' WHEN treated <= days THEN ' acute catheterized' ELSE ' acute' END
  ELSE 'Hyperlipoproteinemia' END || ';Valvular disease' AS labels FROM x"""
)
def curate_comments(spark, sf):
    """Diagnoses and infarction status from comment lines."""
    shift = (F.col("o_custkey") % 6).cast("int")
    seen = F.col("o_orderdate").cast("date")
    event = F.date_sub(seen, shift)
    treated = F.date_sub(seen, (F.col("o_custkey") % 9).cast("int"))
    main = F.when(F.col("o_orderstatus") == "F", "Myocardial infarction").otherwise("Hyperlipidemia")
    lines = F.array(
        F.concat(F.lit("Reason for admission: "), main),
        F.lit("Additional diagnoses: Valvular disease, unknown"),
        F.concat(F.lit("ECG date: "), F.date_format(seen, "dd/MM/yyyy")),
        F.concat(F.lit("Infarction date (acute): "), F.date_format(event, "dd-MMM-yy")),
        F.concat(F.lit("Catheterization date: "), F.date_format(treated, "dd-MMM-yy")),
    )
    rows = table(spark, sf, "orders").select("o_orderkey", lines.alias("comments"))
    return curation.from_comment_lines(rows).select("o_orderkey", F.array_join("labels", ";").alias("labels"))


@query(
    """SELECT p_partkey, 'C' || CAST(p_size AS VARCHAR) || ';N' || CAST(p_size % 5 AS VARCHAR) AS label_all,
  CASE WHEN p_size % 2 = 0 THEN 'C' || CAST(p_size AS VARCHAR) ELSE '' END AS label_diag, 'N' || CAST(p_size % 5 AS VARCHAR) AS label_rhythm,
  CASE WHEN p_size % 2 = 0 THEN 'K' || CAST(p_size % 3 AS VARCHAR) ELSE '' END AS superclass FROM part"""
)
def curate_statements(spark, sf):
    """Statement dictionaries to label lists by kind."""
    part = table(spark, sf, "part")
    size = F.col("p_size")
    text = F.concat(F.lit("{'C"), size.cast("string"), F.lit("': 100.0, 'N"), (size % 5).cast("string"), F.lit("': nan}"))
    c_rows = part.select(
        F.concat(F.lit("C"), size.cast("string")).alias("code"), (size % 2 == 0).cast("int").alias("diagnostic"), F.lit(0).alias("form"),
        F.lit(0).alias("rhythm"), F.concat(F.lit("K"), (size % 3).cast("string")).alias("diagnostic_class"), F.lit(None).cast("string").alias("diagnostic_subclass"),
    ).distinct()
    n_rows = part.select(
        F.concat(F.lit("N"), (size % 5).cast("string")).alias("code"), F.lit(0).alias("diagnostic"), F.lit(0).alias("form"), F.lit(1).alias("rhythm"),
        F.lit(None).cast("string").alias("diagnostic_class"), F.lit(None).cast("string").alias("diagnostic_subclass"),
    ).distinct()
    out = curation.from_statement_maps(part.select("p_partkey", text.alias("scp_codes")), c_rows.unionByName(n_rows), "p_partkey")
    return out.select("p_partkey", *[F.array_join(a, ";").alias(b) for a, b in (("label_all", "label_all"), ("label_diag", "label_diag"), ("label_rhythm", "label_rhythm"), ("label_diag_superclass", "superclass"))])


@query(
    """SELECT p_partkey, CAST(p_size * 100 AS INTEGER) AS age, CAST(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS INTEGER) AS gender,
  CASE WHEN p_size % 10 < 6 THEN 'type' || CAST(p_size % 10 + 10 AS VARCHAR) ELSE '' END AS types, 'desc' || CAST(p_size % 4 AS VARCHAR) AS names FROM part"""
)
def curate_pediatric(spark, sf):
    """Ages in days, sex codes and names of three code lists."""
    part = table(spark, sf, "part")
    size = F.col("p_size")
    sex = F.element_at(F.array(F.lit("'Male'"), F.lit("female"), F.lit("x")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = part.select(
        "p_partkey", F.concat((size * 100).cast("string"), F.lit("d")).alias("age"), sex.alias("gender"),
        F.concat(F.lit(" A"), (size % 4).cast("string"), F.lit(" ;'")).alias("aha_code"), F.lit("Null").alias("chn_code"),
        F.concat(F.lit("I"), (size % 10).cast("string"), F.lit(";Z")).alias("icd-10 code"),
    )
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("row"))
    diseases = nation.where("row < 16").select(
        "row", F.concat(F.lit("type"), "row").alias("disease type"), F.lit("c").alias("disease category"),
        F.concat(F.lit("I"), (F.col("row") % 10).cast("string"), F.lit("; ")).alias("icd-10 code"),
    ).where("row >= 10 or row < 6")
    statements = nation.where("row < 4").select("row", F.concat(F.lit("desc"), "row").alias("description"), F.concat(F.lit("A"), "row").alias("aha"), F.lit("N/A").alias("chn"))
    out = curation.from_pediatric(rows, diseases, statements, "p_partkey")
    return out.select("p_partkey", "age", "gender", F.array_join("icd10_disease_type", ";").alias("types"), F.array_join("aha_description", ";").alias("names"))


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'F' END AS condition, 'L' || substr(o_orderpriority, 1, 1) AS rhythm,
  CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'F;' END || 'L' || substr(o_orderpriority, 1, 1) AS joined FROM orders"""
)
def curate_rhythm(spark, sf):
    """condition and rhythm words of a recording."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("FileName"), F.when(F.col("o_custkey") % 3 == 0, "NONE").otherwise("NONE F").alias("Beat"),
        F.concat(F.lit("L"), F.substring("o_orderpriority", 1, 1)).alias("Rhythm"), F.lit("MALE").alias("Gender"), F.lit(1).alias("PatientAge"),
    )
    out = curation.from_rhythm_table(rows)
    return out.select(F.col("id").alias("o_orderkey"), *[F.array_join(a, ";").alias(b) for a, b in (("label_condition", "condition"), ("label_rhythm", "rhythm"), ("label_all", "joined"))])


@query(
    """SELECT d.doc_id, l.doc_id IS NULL AS missing_label, CASE WHEN l.quality = 1 AND l.toxic = 1 THEN '0,5' WHEN l.quality = 1 THEN '0' WHEN l.toxic = 1 THEN '5' ELSE '' END AS label,
  CASE WHEN l.quality = 1 THEN 'male' ELSE 'female' END AS sex FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def curate_exam_flags(spark, sf):
    """Exam flags to label indices; unmatched records are unlabelled."""
    zero = [F.when(F.col("quality").isNotNull(), 0).alias(c) for c in ("RBBB", "LBBB", "SB", "AF")]
    exams = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("1dAVb"), *zero, F.col("toxic").alias("ST"), (F.col("quality") == 1).alias("is_male"))
    out = curation.from_exam_flags(table(spark, sf, "documents").select("doc_id"), exams, "doc_id")
    return out.select("doc_id", "missing_label", text_list("label").alias("label"), "sex")


@query(
    """SELECT event_id, CASE WHEN user_id % 20 = 3 THEN 'N3' ELSE 'N' || CAST(user_id % 20 AS VARCHAR) END || ';ARH' AS labels, CAST(user_id % 80 AS INTEGER) AS age FROM events"""
)
def curate_headers(spark, sf):
    """Header comments with a code dictionary and its fixed entry."""
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("row"), F.concat(F.lit("N"), (F.col("n_nationkey") % 20).cast("string")).alias("name"),
        F.when(F.col("n_nationkey") == 24, "106068003").otherwise((F.col("n_nationkey") % 20 + 100).cast("string")).alias("code"),
    )
    lines = F.array(
        F.concat(F.lit("Dx: 0"), (F.col("user_id") % 20 + 100).cast("string"), F.lit(",106068003,7")),
        F.concat(F.lit("Age: "), (F.col("user_id") % 80).cast("string")),
    )
    rows = table(spark, sf, "events").select("event_id", lines.alias("comments"))
    out = curation.from_header_comments(rows, curation.code_names(nation), "event_id")
    return out.select("event_id", F.array_join("labels", ";").alias("labels"), "age")


@query(
    "WITH " + CODES + """, long AS (SELECT p_partkey, unnest(list_transform(codes, lambda c: substr(c, 1, 2))) AS label FROM codes),
n AS (SELECT label, count(*) AS count FROM long GROUP BY 1)
SELECT 'kinds' AS label_set, label, count, row_number() OVER (ORDER BY label) - 1 AS idx FROM n UNION ALL
SELECT 'kinds_filtered', label, count, row_number() OVER (ORDER BY label) - 1 FROM n WHERE count >= 80"""
)
def dataset_vocabulary(spark, sf):
    """A1: vocabularies of a dataset build, plain and filtered."""
    rows = codes(spark, sf).select("p_partkey", "p_size", F.transform("codes", lambda c: F.substring(c, 1, 2)).alias("kinds"))
    _, vocab = curation.build_dataset(rows, "p_partkey", ["kinds"], 80, 5, 42)
    return vocab.select("label_set", "label", "count", "idx")


@query()
def dataset_build(spark, sf):
    """A1, K1-K4: filtered labels and patient-aware folds of a dataset build."""
    rows = codes(spark, sf).select("p_partkey", "p_size", F.floor(F.col("p_partkey") / 4).alias("patient"), F.transform("codes", lambda c: F.substring(c, 1, 2)).alias("kinds"))
    sex = F.when(F.col("patient") % 2 == 0, "male").otherwise("female")
    out, _ = curation.build_dataset(rows, "p_partkey", ["kinds"], 80, 5, 42, patient="patient", sex=sex, age=clean.age_twenty_name("p_size"))
    return out.select("p_partkey", "patient", text_list("kinds_filtered").alias("kinds"), "strat_fold")


@query(
    "WITH " + CODES + """ SELECT CAST(p_partkey AS VARCHAR) AS record_id, CASE p_partkey % 10 WHEN 9 THEN 'test' WHEN 8 THEN 'val' ELSE 'train' END AS split,
  CASE WHEN p_size % 2 = 1 AND p_size % 3 = 1 THEN 'x;y' WHEN p_size % 2 = 1 THEN 'x' WHEN p_size % 3 = 1 THEN 'y' ELSE '' END AS label,
  CAST(p_size % 2 AS INTEGER) AS x, CASE WHEN p_size % 3 < 2 THEN CAST(p_size % 3 AS INTEGER) END AS y, CAST(p_size AS DOUBLE) AS age, CASE WHEN p_partkey % 5 <> 0 THEN p_size / 2.0::DOUBLE END AS bmi FROM codes"""
)
def target_export(spark, sf):
    """Joint label array to a class table and a numeric table."""
    values = F.array(
        (F.col("p_size") % 2).cast("double"), F.when(F.col("p_size") % 3 < 2, (F.col("p_size") % 3).cast("double")),
        F.col("p_size").cast("double"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") / 2.0),
    )
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 10).alias("strat_fold"), values.alias("label_all"))
    classes, numbers = probe_export.target_tables(rows, ["x", "y", "age", "bmi"], F.col("p_partkey").cast("string"), 2)
    return classes.join(numbers, ["record_id", "split"])
