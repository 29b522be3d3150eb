"""Queries on label lists, vocabularies, codes and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.base import CODES, LAB, LAB_LONG, PRED, codes, hash_sql, lab, pred, query, r6, table, text_list
from pulsegrid.functions import clean, labels as L
from pulsegrid.operators import aggregates as A
from pulsegrid.operators import codes as C
from pulsegrid.operators import reshape as R
from pulsegrid.operators import splits as K
from pulsegrid.operators.signal import static_vector

_VOCAB = LAB_LONG + (
    ", counts AS (SELECT label, count(*) AS count FROM lab_long GROUP BY label HAVING count(*) >= {n}),"
    " vocab AS (SELECT label, count, row_number() OVER (ORDER BY {order}) - 1 AS idx FROM counts)"
)


@query("WITH " + _VOCAB.format(n=240, order="label") + " SELECT label, count, idx FROM vocab")
def vocab_filter(spark, sf):
    """A1: frequent labels in alphabetical order."""
    return C.vocabulary(lab(spark, sf), "labels", 240)


@query("WITH " + _VOCAB.format(n=0, order="count DESC, label") + " SELECT label, count, idx FROM vocab")
def vocab_by_count(spark, sf):
    """A2: all labels by falling count."""
    return C.vocabulary(lab(spark, sf), "labels", by_count=True)


@query(
    "WITH " + LAB + " SELECT label, count(*) AS count FROM (SELECT DISTINCT p_brand, unnest(labels) AS label FROM lab) GROUP BY label"
)
def label_counts_per_group(spark, sf):
    """A1 counted once per record, a record being all parts of a brand."""
    merged = lab(spark, sf).select("p_brand", F.explode("labels").alias("l")).groupBy("p_brand").agg(F.collect_set("l").alias("labels"))
    return C.label_counts(merged, "labels", per_record=True)


@query(
    "WITH " + _VOCAB.format(n=240, order="label")
    + """ SELECT l.p_partkey, coalesce(string_agg(v.label, ',' ORDER BY l.place), '') AS kept,
  coalesce(string_agg(CAST(v.idx AS VARCHAR), ',' ORDER BY l.place), '') AS ids
FROM lab_long l LEFT JOIN vocab v USING (label) GROUP BY l.p_partkey"""
)
def vocab_map(spark, sf):
    """A1: label lists filtered to the vocabulary and turned into indices."""
    rows = lab(spark, sf)
    out = C.map_labels(rows, ["p_partkey"], "labels", C.vocabulary(rows, "labels", 240))
    return out.select("p_partkey", text_list("labels_filtered").alias("kept"), text_list("labels_filtered_numeric").alias("ids"))


# --- fixed values: the words of part names in the test tables ---------------
WORDS = [
    "anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large",
    "new", "old", "plate", "red", "ring", "rod", "small", "widget",
]
# -----------------------------------------------------------------------------
_INDEX = "list_position([" + ", ".join(f"'{w}'" for w in WORDS) + "], {w}) - 1"


def _word_indices():
    table_ = F.array(*[F.lit(w) for w in WORDS])
    return F.transform("labels", lambda w: (F.array_position(table_, w) - 1).cast("int"))


@query(
    "WITH " + LAB + " SELECT CAST(p_partkey AS VARCHAR) AS record_id, CASE WHEN p_partkey % 10 = 9 THEN 'test' WHEN p_partkey % 10 = 8 THEN 'val' ELSE 'train' END AS split, "
    "array_to_string(labels, ';') AS label, "
    + ", ".join(f"CAST(list_contains(labels, '{w}') AS INTEGER) AS \"{w}\"" for w in WORDS)
    + " FROM lab"
)
def multihot_pairs(spark, sf):
    """Probe table with one 0/1 column per class."""
    fold = F.col("p_partkey") % 10
    split = F.when(fold == 9, "test").when(fold == 8, "val").otherwise("train")
    return R.probe_pairs(lab(spark, sf), F.col("p_partkey").cast("string"), split, _word_indices(), WORDS)


@query(
    "WITH " + LAB + " SELECT p_partkey, array_to_string(labels, ';') AS names, array_to_string(list_sort(list_distinct(labels)), ';') AS in_order, "
    + "array_to_string(list_transform(labels, lambda w: " + _INDEX.format(w="w") + "), ',') AS ids FROM lab"
)
def multihot_decode(spark, sf):
    """Indices to 0/1 and back to names, in list and in class order."""
    ids = _word_indices()
    return lab(spark, sf).select(
        "p_partkey",
        L.index_names(ids, WORDS).alias("names"),
        L.hot_names(L.multi_hot(ids, len(WORDS)), WORDS).alias("in_order"),
        text_list(ids).alias("ids"),
    )


@query(
    "WITH " + LAB + """, m AS (SELECT p_partkey, list_filter(list_transform(labels, lambda w: CASE w WHEN 'red' THEN 0 WHEN 'gear' THEN 1 WHEN 'blue' THEN 2 END), lambda x: x IS NOT NULL) AS ids FROM lab)
SELECT p_partkey, array_to_string(ids, ',') AS ids FROM m WHERE len(ids) > 0"""
)
def label_subset_reindex(spark, sf):
    """Keep chosen classes, re-index them and drop rows left empty."""
    kept = {WORDS.index(w): i for i, w in enumerate(("red", "gear", "blue"))}
    out = lab(spark, sf).select("p_partkey", L.reindex(_word_indices(), kept).alias("ids"))
    return out.where(F.size("ids") > 0).select("p_partkey", text_list("ids").alias("ids"))


_TRUNC = "list_distinct(list_transform(codes, lambda c: regexp_replace(substr(trim(c), 1, 5), 'X+$', '')))"


@query(
    "WITH " + CODES + f" SELECT p_partkey, array_to_string(list_sort({_TRUNC}), ',') AS codes, "
    f"array_to_string(list_sort(list_filter({_TRUNC}, lambda c: substr(c, 1, 1) IN ('S', 'E'))), ',') AS picked FROM codes"
)
def code_truncate(spark, sf):
    """cut, strip the placeholder, choose by first letter."""
    cut = L.truncate_codes(F.col("codes"), 5)
    return codes(spark, sf).select(
        "p_partkey", text_list(F.array_sort(cut)).alias("codes"),
        text_list(F.array_sort(L.pick_categories(cut, "SE"))).alias("picked"),
    )


_PREFIX = "list_distinct(flatten(list_transform(list_filter(codes, lambda c: length(c) >= 3), lambda c: list_transform(range(3, length(c) + 1), lambda n: substr(c, 1, n)))))"


@query("WITH " + CODES + f" SELECT p_partkey, array_to_string(list_sort({_PREFIX}), ',') AS codes FROM codes")
def code_ancestors(spark, sf):
    """every prefix of three or more characters."""
    return codes(spark, sf).select("p_partkey", text_list(F.array_sort(L.code_prefixes(F.col("codes")))).alias("codes"))


@query(
    "WITH " + CODES + f""", p AS (SELECT p_partkey, unnest({_PREFIX}) AS label FROM codes),
known AS (SELECT DISTINCT unnest(list_transform(codes, lambda c: substr(c, 1, 4))) AS label FROM codes),
j AS (SELECT p.p_partkey, p.label FROM p SEMI JOIN known USING (label))
SELECT c.p_partkey, coalesce(string_agg(j.label, ',' ORDER BY j.label), '') AS codes FROM codes c LEFT JOIN j USING (p_partkey) GROUP BY c.p_partkey"""
)
def code_known_ancestors(spark, sf):
    """only prefixes that occur in a known code list."""
    rows = codes(spark, sf)
    known = rows.select(F.explode(F.transform("codes", lambda c: F.substring(c, 1, 4))).alias("label"))
    return C.known_prefixes(rows, ["p_partkey"], "codes", known).select("p_partkey", text_list("codes").alias("codes"))


_COHORT = "WITH " + CODES + """,
base AS (SELECT p_partkey, p_partkey % 20 AS fold, p_partkey % 3 AS visit, p_size % 2 = 0 AS in_ed, p_size % 5 <> 0 AS in_any,
  CASE WHEN p_size % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE codes END AS ed, codes AS al FROM codes),
cut AS (SELECT *, list_distinct(list_transform(ed, lambda c: regexp_replace(substr(trim(c), 1, 4), 'X+$', ''))) AS e4,
  list_distinct(list_transform(al, lambda c: regexp_replace(substr(trim(c), 1, 4), 'X+$', ''))) AS a4 FROM base),
tr AS (SELECT p_partkey, list_distinct(flatten(list_transform(list_filter(e4, lambda c: length(c) >= 3 AND substr(c,1,1) IN ('S','E')), lambda c: list_transform(range(3, length(c) + 1), lambda n: substr(c, 1, n))))) AS labels FROM cut),
te AS (SELECT p_partkey, list_distinct(flatten(list_transform(list_filter(a4, lambda c: length(c) >= 3), lambda c: list_transform(range(3, length(c) + 1), lambda n: substr(c, 1, n))))) AS labels FROM cut),
counts AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM tr) GROUP BY label HAVING count(*) >= 15),
vocab AS (SELECT label, n, row_number() OVER (ORDER BY n DESC, label) - 1 AS idx FROM counts)
"""


@query(
    _COHORT
    + """, picked AS (SELECT b.p_partkey, CASE WHEN b.fold >= 18 THEN te.labels ELSE tr.labels END AS labels
  FROM base b JOIN tr USING (p_partkey) JOIN te USING (p_partkey)
  WHERE CASE WHEN b.fold >= 18 THEN b.in_any AND len(b.al) > 0 ELSE b.in_ed AND len(b.ed) > 0 AND b.visit = 0 END),
long AS (SELECT p_partkey, unnest(labels) AS label FROM picked),
j AS (SELECT p_partkey, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS ids FROM long JOIN vocab USING (label) GROUP BY 1)
SELECT p.p_partkey AS study_id, coalesce(j.ids, '') AS ids FROM picked p LEFT JOIN j USING (p_partkey)"""
)
def cohort_label_job(spark, sf):
    """F8: rows and labels of a cohort by its configuration text."""
    part = codes(spark, sf)
    empty = F.array().cast("array<string>")
    rows = part.select(
        F.col("p_partkey").alias("study_id"),
        (F.col("p_partkey") % 20).alias("fold"),
        (F.col("p_partkey") % 3).alias("ecg_no_within_stay"),
        (F.col("p_size") % 2 == 0).alias("ecg_taken_in_ed"),
        (F.col("p_size") % 5 != 0).alias("ecg_taken_in_ed_or_hosp"),
        F.when(F.col("p_size") % 7 == 0, empty).otherwise(F.col("codes")).alias("ed_diag_ed"),
        F.col("codes").alias("all_diag_all"),
    )
    out, _ = C.cohort_labels(rows, C.CohortSpec.parse("x_edfirst_edSE_all_all_15_4A"))
    return out.select("study_id", text_list(F.array_sort("label_idx")).alias("ids"))


@query(
    """SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS INTEGER) AS age,
  CASE WHEN user_id % 3 = 0 THEN 'male' WHEN user_id % 3 = 1 THEN 'female' ELSE 'unknown' END AS sex,
  event_type || ';' || CAST(user_id AS VARCHAR) AS dx FROM events"""
)
def kv_parse(spark, sf):
    """values of key: value comment lines."""
    number = F.regexp_replace("props", "[^0-9]", "")
    word = F.element_at(F.array(F.lit("M"), F.lit("f x"), F.lit("Unknown")), (F.col("user_id") % 3 + 1).cast("int"))
    lines = F.array(
        F.regexp_replace("props", '[{}"]', ""),
        F.concat(F.lit("Age: "), number),
        F.concat(F.lit("Sex: "), word),
        F.concat(F.lit("Dx: "), "event_type", F.lit(","), F.col("user_id").cast("string")),
    )
    rows = table(spark, sf, "events").select("event_id", lines.alias("lines"))
    ls = F.col("lines")
    return rows.select(
        "event_id", L.comment_value(ls, "k").alias("k"), L.comment_age(ls).alias("age"), L.comment_sex(ls).alias("sex"),
        F.array_join(L.code_list(L.comment_value(ls, "Dx"), ","), ";").alias("dx"),
    )


@query("SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS INTEGER) AS flag FROM orders")
def binary_parse(spark, sf):
    """yes/no words to 1/0."""
    word = F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "NEG").otherwise("false")
    return table(spark, sf, "orders").select("o_orderkey", clean.parse_binary(word).alias("flag"))


@query(
    """SELECT o_orderkey, array_to_string(list_filter([o_orderstatus, CAST(o_custkey % 9 AS VARCHAR)], lambda x: x <> '0'), ',') AS codes,
  o_orderstatus AS primary_code FROM orders"""
)
def code_list_parse(spark, sf):
    """delimited code lists, and the leading code of each entry."""
    text = F.concat(F.lit(" '"), "o_orderstatus", F.lit("+mod';; "), (F.col("o_custkey") % 9).cast("string"), F.lit(" ;"))
    parsed = L.leading_code(L.code_list(text, ";", drop=["0"]))
    return table(spark, sf, "orders").select(
        "o_orderkey", text_list(parsed).alias("codes"), F.element_at(parsed, 1).alias("primary_code")
    )


@query(
    """WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_size * 2.0 END AS age FROM part)
SELECT p_partkey,
  CAST(CASE WHEN age IS NULL THEN -1 WHEN age < 30 THEN 0 WHEN age < 40 THEN 1 WHEN age < 50 THEN 2 WHEN age < 60 THEN 3 WHEN age < 70 THEN 4 WHEN age < 80 THEN 5 ELSE 6 END AS INTEGER) AS decade,
  CAST(CASE WHEN age < 20 THEN 0 WHEN age < 40 THEN 1 WHEN age < 60 THEN 2 WHEN age < 80 THEN 3 ELSE 4 END AS INTEGER) AS twenty,
  CASE WHEN age - 10 IS NULL OR age - 10 < 0 THEN 'age_unknown' WHEN age - 10 < 18 THEN 'age_18' WHEN age - 10 < 30 THEN 'age_30' WHEN age - 10 < 40 THEN 'age_40' WHEN age - 10 < 50 THEN 'age_50'
    WHEN age - 10 < 60 THEN 'age_60' WHEN age - 10 < 70 THEN 'age_70' WHEN age - 10 < 80 THEN 'age_80' WHEN age - 10 < 90 THEN 'age_90' ELSE 'age_100' END AS adult,
  CAST(CASE WHEN age * 100 < 365 THEN 0 WHEN age * 100 < 1825 THEN 1 WHEN age * 100 < 4380 THEN 2 WHEN age * 100 < 6570 THEN 3 ELSE 4 END AS INTEGER) AS child,
  CASE WHEN age < 20 THEN '<20' WHEN age < 40 THEN '20-40' WHEN age < 60 THEN '40-60' WHEN age < 80 THEN '60-80' WHEN age >= 80 THEN '>=80' END AS name
FROM a"""
)
def age_bucket(spark, sf):
    """P10: five age schemes."""
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") * 2.0).alias("age"))
    return rows.select(
        "p_partkey",
        clean.age_decade("age").alias("decade"),
        clean.age_twenty("age").alias("twenty"),
        clean.age_adult(F.col("age") - 10).alias("adult"),
        clean.age_child_days(F.col("age") * 100).alias("child"),
        clean.age_twenty_name("age").alias("name"),
    )


@query(
    "WITH " + LAB + """ SELECT p_partkey, array_to_string(list_filter(labels, lambda x: x NOT IN ('red', 'gear')), ',') AS cleaned,
  array_to_string(list_concat(labels, [p_type]), ',') AS joined, list_contains(labels, 'blue') AS is_blue FROM lab"""
)
def array_clean(spark, sf):
    """blacklist, concatenation and membership."""
    padded = F.transform("labels", lambda x: F.concat(F.lit(" "), x, F.lit(" ")))
    return lab(spark, sf).select(
        "p_partkey",
        text_list(L.drop_blacklisted(padded, ["red", "gear"])).alias("cleaned"),
        text_list(F.concat("labels", F.array("p_type"))).alias("joined"),
        F.array_contains("labels", "blue").alias("is_blue"),
    )


@query(
    "WITH " + LAB + """ SELECT p_partkey, array_to_string(list_sort(list_intersect(labels, ['red', 'bolt', 'hot'])), ',') AS both_sides,
  array_to_string(list_sort(list_filter(labels, lambda x: x NOT IN ('red', 'bolt', 'hot'))), ',') AS rest FROM lab"""
)
def set_ops(spark, sf):
    """Intersection and difference of label sets."""
    other = F.array(F.lit("red"), F.lit("bolt"), F.lit("hot"))
    return lab(spark, sf).select(
        "p_partkey",
        text_list(F.array_sort(F.array_intersect("labels", other))).alias("both_sides"),
        text_list(F.array_sort(F.array_except("labels", other))).alias("rest"),
    )


@query(
    "WITH " + LAB_LONG + """, s AS (SELECT p_brand, count(*) AS samples FROM lab GROUP BY 1)
SELECT l.p_brand, l.label, count(*) AS n, max(s.samples) AS samples FROM lab_long l JOIN s USING (p_brand) GROUP BY 1, 2"""
)
def group_labels(spark, sf):
    """A3: label occurrences and rows per group."""
    counts, sizes = A.group_label_counts(lab(spark, sf), "p_brand", "labels")
    return counts.join(sizes, "p_brand")


@query(
    """SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS labels FROM events GROUP BY user_id"""
)
def record_labels(spark, sf):
    """Distinct labels of a record."""
    return A.distinct_labels(table(spark, sf, "events"), ["user_id"], "event_type").select("user_id", text_list("labels").alias("labels"))


_FLAGS = """WITH f AS (SELECT user_id, max(CAST(event_type = 'click' AND value > 200 AS INTEGER)) AS a, max(CAST(event_type = 'view' AND value > 200 AS INTEGER)) AS b,
  max(CAST(event_type = 'error' AND value > 200 AS INTEGER)) AS c, max(CASE WHEN event_type = 'signup' AND value > 150 THEN value END) AS d,
  max(value) AS e FROM events GROUP BY user_id)"""


def _flags(spark, sf):
    ev = table(spark, sf, "events")
    hit = lambda n: F.max(((F.col("event_type") == n) & (F.col("value") > 200)).cast("int"))
    high = F.when((F.col("event_type") == "signup") & (F.col("value") > 150), F.col("value"))
    return ev.groupBy("user_id").agg(
        hit("click").alias("a"), hit("view").alias("b"), hit("error").alias("c"),
        F.max(high).alias("d"), F.max("value").alias("e"),
    )


@query(
    _FLAGS + """ SELECT user_id, array_to_string(list_filter([CASE WHEN a = 1 THEN 0 END, CASE WHEN b = 1 THEN 1 END, CASE WHEN c = 1 THEN 2 END], lambda x: x IS NOT NULL), ',') AS ids,
  concat_ws(',', a::DOUBLE::VARCHAR, b::DOUBLE::VARCHAR, c::DOUBLE::VARCHAR, CASE WHEN user_id % 4 = 0 THEN 'null' ELSE coalesce(d::VARCHAR, 'null') END,
  CASE WHEN user_id % 4 = 0 THEN 'null' ELSE coalesce(e::VARCHAR, 'null') END) AS block FROM f"""
)
def label_blocks(spark, sf):
    """Flags to indices, missing blocks to nulls, blocks joined."""
    flags = F.array(*[F.col(c).cast("double") for c in "abc"])
    numbers = F.when(F.col("user_id") % 4 != 0, F.array("d", "e"))
    block = L.concat_blocks([(flags, 3), (numbers, 2)])
    return _flags(spark, sf).select(
        "user_id", text_list(L.flags_to_indices(["a", "b", "c"])).alias("ids"),
        F.array_join(block.cast("array<string>"), ",", "null").alias("block"),
    )


@query(
    _FLAGS + """ SELECT user_id, CAST(a AS VARCHAR) || ',' || CAST(b AS VARCHAR) || ',' || CAST(c AS VARCHAR) AS classes, coalesce(CAST(d AS VARCHAR), '') AS d, coalesce(CAST(e AS VARCHAR), '') AS e FROM f"""
)
def target_split(spark, sf):
    """Class targets as integers, numeric targets with empty text for null."""
    values = F.array(*[F.col(c).cast("double") for c in "abcde"])
    classes, numbers = L.split_targets(values, 2)
    blank = lambda i: F.coalesce(F.get(numbers, F.lit(i)).cast("string"), F.lit(""))
    return _flags(spark, sf).select(
        "user_id", F.array_join(F.transform(classes, lambda x: x.cast("int").cast("string")), ",").alias("classes"),
        blank(0).alias("d"), blank(1).alias("e"),
    )


@query(
    """WITH d AS (SELECT c_custkey % 100 AS fold, CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 7 = 0 THEN NULL ELSE 0 END AS a,
  CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE 0 END AS b FROM customer),
s AS (SELECT fold, 0 AS place, count(*) FILTER (a = 1) AS p, count(*) FILTER (a = 0) AS n FROM d GROUP BY 1 UNION ALL
  SELECT fold, 1, count(*) FILTER (b = 1), count(*) FILTER (b = 0) FROM d GROUP BY 1)
SELECT fold, CAST(place AS INTEGER) AS place FROM s WHERE p < 2 OR n < 2"""
)
def class_validity(spark, sf):
    """Label positions with too few positives or negatives in a fold."""
    k = F.col("c_custkey")
    a = F.when(k % 3 == 0, 1).when(k % 7 == 0, None).otherwise(0)
    b = F.when(k % 50 == 0, 1).otherwise(0)
    rows = table(spark, sf, "customer").select((k % 100).alias("fold"), F.array(a, b).alias("v"))
    return A.class_validity(rows, "fold", "v")


@query(
    "WITH " + PRED + " SELECT label, CAST(coalesce(sum(target), 0) AS DOUBLE) AS positives, count(target) AS valid, round(avg(target), 6) + 0.0 AS prevalence FROM pred GROUP BY label"
)
def prevalence(spark, sf):
    """A10: positives, valid targets and ratio per class."""
    return A.prevalence(pred(spark, sf)).select("label", "positives", "valid", r6("prevalence").alias("prevalence"))


@query(
    "WITH " + PRED + """ SELECT sample_id, label, round(1 / (1 + exp(-(score * 8 - 4))), 6) + 0.0 AS p FROM pred"""
)
def score_link(spark, sf):
    """logistic link of raw scores."""
    return pred(spark, sf).select("sample_id", "label", r6(L.sigmoid(F.col("score") * 8 - 4)).alias("p"))


@query(
    """WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id, i - 1 AS place, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) + 0.0 AS p FROM s"""
)
def softmax_link(spark, sf):
    """softmax over a score array."""
    scores = F.transform("embedding", lambda x: x.cast("double"))
    out = table(spark, sf, "embeddings").select("vec_id", F.posexplode(L.softmax(scores)).alias("place", "p"))
    return out.select("vec_id", F.col("place").cast("long").alias("place"), r6("p").alias("p"))


@query(
    """SELECT event_id, CAST(ceil(value * 2.5) AS BIGINT) AS up, CAST(round_even(value * 2.5, 0) AS BIGINT) AS even, CAST(trunc(value * 2.5) AS BIGINT) AS cut FROM events"""
)
def seconds_to_samples(spark, sf):
    """seconds to samples in three rounding modes."""
    s = clean.samples_from_seconds
    return table(spark, sf, "events").select(
        "event_id", s("value", 2.5).alias("up"), s("value", 2.5, "round").alias("even"), s("value", 2.5, "int").alias("cut")
    )


@query(
    """SELECT vec_id, len(embedding) + 2 AS width, round(label + vec_id + list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) + 0.0 AS total FROM embeddings"""
)
def static_vectors(spark, sf):
    """Scalar and array columns as one vector."""
    rows = table(spark, sf, "embeddings")
    vector = static_vector(rows, ["label", "embedding", "vec_id"])
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", vector.alias("v")).select("vec_id", F.size("v").cast("long").alias("width"), r6(total, 5).alias("total"))


@query(
    "WITH " + LAB + """ SELECT p_partkey, array_to_string(list_concat(labels, ['sex_' || CASE WHEN p_partkey % 2 = 0 THEN 'male' ELSE 'female' END,
  'race_' || coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_type END, 'Unavailable'), CASE WHEN p_size < 18 THEN 'age_18' WHEN p_size < 30 THEN 'age_30' WHEN p_size < 40 THEN 'age_40' WHEN p_size < 50 THEN 'age_50' ELSE 'age_60' END]), ',') AS strata FROM lab"""
)
def strata_labels(spark, sf):
    """K4: labels extended by sex, race and age strings."""
    sex = F.when(F.col("p_partkey") % 2 == 0, "male").otherwise("female")
    race = F.when(F.col("p_partkey") % 5 != 0, F.col("p_type"))
    return lab(spark, sf).select(
        "p_partkey", text_list(K.strata_labels(F.col("labels"), sex, clean.age_adult("p_size"), race)).alias("strata")
    )


_FIVE, _EIGHT = [0.2] * 5, [0.8, 0.1, 0.1]


@query()
def stratified_folds(spark, sf):
    """K1: label-stratified folds without groups."""
    return K.stratified_folds(lab(spark, sf), "p_partkey", "labels", _FIVE, 7).select("p_partkey", "strat_fold")


@query()
def group_stratified_folds(spark, sf):
    """K2: whole brands and sizes stay together."""
    rows = lab(spark, sf).withColumn("patient", F.concat_ws("-", "p_brand", "p_size"))
    return K.stratified_folds(rows, "p_partkey", "labels", _EIGHT, 7, group="patient").select("p_partkey", "patient", "strat_fold")


@query()
def batched_folds(spark, sf):
    """K3: folds solved in four hash batches."""
    return K.stratified_folds(lab(spark, sf), "p_partkey", "labels", _FIVE, 7, buckets=4).select("p_partkey", "strat_fold")


def _patients(spark, sf):
    return lab(spark, sf).select(
        "p_partkey", F.floor(F.col("p_partkey") / 3).alias("patient"), "labels",
        F.when(F.col("p_partkey") % 2 == 0, "male").otherwise("female").alias("sex"),
        (F.col("p_size") * 2).alias("age"),
        F.when(F.floor(F.col("p_partkey") / 3) % 10 == 9, "test").when(F.floor(F.col("p_partkey") / 3) % 10 == 8, "val").otherwise("train").alias("split"),
    )


@query()
def label_efficiency(spark, sf):
    """One record per patient, a quarter of training and validation."""
    return K.label_efficiency(_patients(spark, sf), 0.25, "p_partkey", "patient", "labels", "sex", "age", 42).select("p_partkey", "patient", "split")


@query(
    f"""SELECT p_partkey // 3 AS patient, p_partkey FROM part
QUALIFY row_number() OVER (PARTITION BY p_partkey // 3 ORDER BY {hash_sql(42, "p_partkey")}, p_partkey) = 1"""
)
def first_per_patient(spark, sf):
    """One record per patient in a seeded order."""
    return R.first_per_patient(_patients(spark, sf), "patient", "p_partkey", 42).select("patient", "p_partkey")


@query(
    f"""WITH c AS (SELECT DISTINCT o_custkey FROM orders),
r AS (SELECT o_custkey, row_number() OVER (ORDER BY {hash_sql(42, "o_custkey")}, o_custkey) - 1 AS r, count(*) OVER () AS n FROM c)
SELECT o_orderkey, o_custkey, CAST(r * 5 // n AS INTEGER) AS strat_fold FROM orders JOIN r USING (o_custkey)"""
)
def patient_kfold(spark, sf):
    """K6: five near-equal random groups of customers."""
    return K.patient_kfold(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5, 42)


@query(
    f"""WITH p AS (SELECT o_orderkey, CASE WHEN o_custkey % 8 = 0 THEN o_custkey ELSE -o_orderkey END AS patient FROM orders),
m AS (SELECT *, count(*) OVER (PARTITION BY patient) > 1 AS multi FROM p),
f AS (SELECT greatest(CAST(floor(count(*) * 0.2::DOUBLE) AS BIGINT) - count(*) FILTER (multi), 0) AS fill FROM m),
x AS (SELECT *, row_number() OVER (PARTITION BY multi ORDER BY {hash_sql(73, "o_orderkey")}, o_orderkey) AS r FROM m)
SELECT o_orderkey, patient, CAST(multi OR r <= fill AS INTEGER) AS orig_fold FROM x, f"""
)
def holdout_repeats(spark, sf):
    """K9: repeated customers to test, filled to a share of all orders."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 8 == 0, F.col("o_custkey")).otherwise(-F.col("o_orderkey")).alias("patient"))
    return K.holdout_repeats(rows, "o_orderkey", "patient", 0.2, 73)


@query(
    """SELECT patient, count(DISTINCT split) AS splits FROM (SELECT p_brand AS patient, p_partkey % 3 AS split FROM part) GROUP BY patient HAVING count(DISTINCT split) > 1"""
)
def split_leaks(spark, sf):
    """K8: patients found in more than one split."""
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("patient"), (F.col("p_partkey") % 3).alias("split"))
    return K.split_leaks(rows, "patient", "split")


def _shares(rows, fold, ratios):
    """Rows per label and whether each fold holds its part within five points, or within one row."""
    long = rows.select(fold, F.explode("labels").alias("label"))
    counts = long.groupBy("label").pivot(fold, list(range(len(ratios)))).count().fillna(0)
    total = sum((F.col(str(i)) for i in range(len(ratios))), F.lit(0))
    close = F.lit(True)
    for i, ratio in enumerate(ratios):
        close = close & (F.abs(F.col(str(i)) - total * ratio) <= F.greatest(total * 0.05, F.lit(1.0)))
    return counts.select("label", total.cast("long").alias("total"), close.alias("balanced"))


@query("WITH " + LAB_LONG + " SELECT label, count(*) AS total, true AS balanced FROM lab_long GROUP BY 1")
def stratified_contract(spark, sf):
    """K1: every label is spread evenly and no row is lost."""
    return _shares(K.stratified_folds(lab(spark, sf), "p_partkey", "labels", _FIVE, 7), "strat_fold", _FIVE)


@query("WITH " + LAB_LONG + " SELECT label, count(*) AS total, true AS balanced FROM lab_long GROUP BY 1")
def batched_contract(spark, sf):
    """K3: batches that carry their totals keep the shares."""
    return _shares(lab(spark, sf).join(batched_folds(spark, sf), "p_partkey"), "strat_fold", _FIVE)


@query("WITH " + LAB_LONG + " SELECT label, count(*) AS total, true AS balanced FROM lab_long GROUP BY 1")
def group_shares_contract(spark, sf):
    """K2: the labels of patients of unequal weight are spread evenly too."""
    rows = group_stratified_folds(spark, sf).select("p_partkey", "strat_fold")
    return _shares(lab(spark, sf).join(rows, "p_partkey"), "strat_fold", _EIGHT)


@query("WITH " + LAB_LONG + " SELECT label, count(*) AS total, true AS balanced FROM lab_long GROUP BY 1")
def heavy_groups_contract(spark, sf):
    """K2: three patients with a twentieth of all rows each, among patients of one row."""
    heavy = F.col("p_partkey") % 20 < 3
    rows = lab(spark, sf).withColumn("patient", F.when(heavy, F.col("p_partkey") % 20).otherwise(F.col("p_partkey") + 1000))
    return _shares(K.stratified_folds(rows, "p_partkey", "labels", _FIVE, 7, group="patient"), "strat_fold", _FIVE)


@query("SELECT count(DISTINCT p_brand || '-' || p_size) AS patients, count(*) AS rows, CAST(0 AS BIGINT) AS leaks, CAST(0 AS BIGINT) AS unassigned FROM part")
def group_contract(spark, sf):
    """K2: every patient lies in one fold and every row has one."""
    rows = group_stratified_folds(spark, sf)
    per = rows.groupBy("patient").agg(F.count_distinct("strat_fold").alias("folds"), F.count(F.lit(1)).alias("n"), F.min("strat_fold").alias("low"))
    return per.agg(
        F.count(F.lit(1)).alias("patients"), F.sum("n").alias("rows"),
        F.count_if(F.col("folds") > 1).alias("leaks"), F.count_if(F.col("low") < 0).alias("unassigned"),
    )


@query(
    """WITH p AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), r AS (SELECT unnest(range(0, n)) AS k, n FROM p)
SELECT CAST(k * 5 // n AS INTEGER) AS strat_fold, count(*) AS patients FROM r GROUP BY 1"""
)
def kfold_contract(spark, sf):
    """K6: fold sizes in patients."""
    return patient_kfold(spark, sf).groupBy("strat_fold").agg(F.count_distinct("o_custkey").alias("patients"))


@query(
    """WITH p AS (SELECT o_orderkey, CASE WHEN o_custkey % 8 = 0 THEN o_custkey ELSE -o_orderkey END AS patient FROM orders),
m AS (SELECT *, count(*) OVER (PARTITION BY patient) > 1 AS multi FROM p)
SELECT CAST(count(*) FILTER (multi) AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS repeated_outside,
  CAST(greatest(floor(count(*) * 0.2), count(*) FILTER (multi)) AS BIGINT) AS held FROM m"""
)
def holdout_contract(spark, sf):
    """K9: all repeated patients are held out and the share is met exactly."""
    from pulsegrid.operators.reshape import duplicate_flag

    rows = duplicate_flag(holdout_repeats(spark, sf), ["patient"], "multi")
    return rows.agg(
        F.count_if("multi").alias("repeated"),
        F.count_if(F.col("multi") & (F.col("orig_fold") == 0)).alias("repeated_outside"),
        F.count_if(F.col("orig_fold") == 1).alias("held"),
    )


@query(
    """WITH p AS (SELECT p_partkey // 3 AS patient, CASE WHEN p_partkey // 3 % 10 = 9 THEN 'test' WHEN p_partkey // 3 % 10 = 8 THEN 'val' ELSE 'train' END AS split FROM part)
SELECT split, CASE WHEN split = 'test' THEN count(*) END AS kept_whole, true AS one_per_patient, true AS near_share FROM p GROUP BY split"""
)
def label_efficiency_contract(spark, sf):
    """K5: test untouched; other splits hold a quarter of the patients within five points, one record each."""
    sizes = _patients(spark, sf).groupBy("split").agg(F.count_distinct("patient").alias("all"))
    got = label_efficiency(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient").alias("p"))
    test = F.col("split") == "test"
    return got.join(sizes, "split").select(
        "split", F.when(test, F.col("n")).alias("kept_whole"),
        (test | (F.col("n") == F.col("p"))).alias("one_per_patient"),
        (test | (F.abs(F.col("p") - F.col("all") * 0.25) <= F.greatest(F.col("all") * 0.05, F.lit(1.0)))).alias("near_share"),
    )


@query("SELECT count(DISTINCT p_partkey // 3) AS patients, true AS known FROM part")
def first_record_contract(spark, sf):
    """One existing record for every patient."""
    picked = first_per_patient(spark, sf)
    known = F.col("patient") == F.floor(F.col("p_partkey") / 3)
    return picked.agg(F.count_distinct("patient").alias("patients"), (F.bool_and(known) & (F.count(F.lit(1)) == F.count_distinct("patient"))).alias("known"))
