"""Queries on scans, joins, cleaning, reshaping and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.catalog.base import hash_sql, meas, pred, query, r6, table, text_list
from pulsegrid.functions import clean, labels as L
from pulsegrid.operators import aggregates as A
from pulsegrid.operators import joins as J
from pulsegrid.operators import reshape as R
from pulsegrid.operators.nearest import DAY, HOUR, nearest_long, nearest_wide, pivot_names
from pulsegrid.operators.splits import fixed_split, fold_split, provided_split_fold
from pulsegrid.scale import position
from pulsegrid.session import scratch_path
from pulsegrid.sources import packing, sinks, tables as S

NAMES = ["click", "view", "signup", "error"]
_NEAR = """
WITH j AS (
  SELECT a.event_id AS aid, b.event_type AS name, b.value, b.ts, {diff} AS diff
  FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type <> 'purchase'
  AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= {limit}),
k AS (SELECT *, row_number() OVER (PARTITION BY aid, name ORDER BY diff, ts, value) AS rn FROM j)
"""
_WIDE = ", ".join(f"max(CASE WHEN k.name = '{n}' THEN k.value END) AS \"{n}\"" for n in NAMES)


@query(
    _NEAR.format(diff="abs(epoch_us(b.ts) - epoch_us(a.ts))", limit=24 * HOUR)
    + f"""SELECT e.user_id AS subject_id, epoch_us(e.ts) AS anchor_us, {_WIDE}
FROM events e LEFT JOIN k ON k.aid = e.event_id AND k.rn = 1
WHERE e.event_type = 'purchase' GROUP BY e.event_id, e.user_id, e.ts"""
)
def nearest_measure_wide(spark, sf):
    """Closest other measure within a day of each purchase."""
    rows = meas(spark, sf)
    base = rows.where("name = 'purchase'").select("subject_id", F.col("time").alias("anchor_time"))
    long = nearest_long(base, rows, NAMES, 24 * HOUR)
    wide = pivot_names(long, ["subject_id", "anchor_time"], NAMES)
    out = nearest_wide(base, [wide], ["subject_id", "anchor_time"])
    return out.select("subject_id", clean.to_micros("anchor_time").alias("anchor_us"), *NAMES)


@query(
    _NEAR.format(diff=f"abs(epoch_us(b.ts) - epoch_us(a.ts)) // {DAY}", limit=4 * DAY - 1)
    + """SELECT e.user_id AS subject_id, epoch_us(e.ts) AS anchor_us, k.name, k.diff AS days, k.value
FROM k JOIN events e ON k.aid = e.event_id WHERE k.rn = 1"""
)
def nearest_measure_days(spark, sf):
    """J6 with differences floored to whole days."""
    rows = meas(spark, sf)
    base = rows.where("name = 'purchase'").select("subject_id", F.col("time").alias("anchor_time"))
    long = nearest_long(base, rows, NAMES, 3 * DAY, whole_days=True)
    return long.select(
        "subject_id", clean.to_micros("anchor_time").alias("anchor_us"), "name", F.col("time_diff").alias("days"), "value"
    )


@query(
    """WITH m AS (SELECT *, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS quantity,
  CASE WHEN l_discount BETWEEN 0.02 AND 0.08 THEN l_discount END AS discount,
  CASE WHEN l_tax <> 0.0 THEN l_tax END AS tax,
  CASE WHEN l_extendedprice / 10 BETWEEN 0 AND 5000 THEN l_extendedprice / 10 END AS t_end,
  l_suppkey * 10.0 AS rr FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, quantity, discount, tax,
  round(l_extendedprice * (1 - discount), 4) + 0.0 AS net,
  l_quantity - l_linenumber AS pr, CAST(l_linenumber AS DOUBLE) AS qrs, round(t_end - l_quantity, 6) + 0.0 AS qt,
  CASE WHEN rr BETWEEN 0 AND 5000 AND rr <> 0 THEN round((t_end - l_quantity) / sqrt(rr / 1000), 6) + 0.0 END AS qtc
FROM m"""
)
def range_clean_derive(spark, sf):
    """Ranges and sentinels to null, then derived intervals."""
    rows = table(spark, sf, "lineitem").withColumns(
        {
            "quantity": clean.range_to_null("l_quantity", 5, 45),
            "discount": clean.range_to_null("l_discount", 0.02, 0.08),
            "tax": clean.number_or_null("l_tax", 0.0),
            "p_onset": F.col("l_linenumber").cast("double"),
            "qrs_onset": F.col("l_quantity"),
            "qrs_end": F.col("l_quantity") + F.col("l_linenumber"),
            "t_end": F.col("l_extendedprice") / 10,
            "rr_interval": F.col("l_suppkey") * 10.0,
        }
    )
    rows = clean.clean_waveform_marks(rows).withColumns(clean.derived_intervals())
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "quantity", "discount", "tax",
        r6(F.col("l_extendedprice") * (1 - F.col("discount")), 4).alias("net"),
        F.col("PR").alias("pr"), F.col("QRS").alias("qrs"), r6("QT").alias("qt"), r6("QTc").alias("qtc"),
    )


@query(
    """WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey,
  CASE l_returnflag WHEN 'A' THEN 'weight' WHEN 'N' THEN 'temperature' ELSE l_returnflag END AS label,
  CASE l_returnflag WHEN 'A' THEN l_quantity * 2.20462 WHEN 'N' THEN l_quantity * 1.8 + 32 ELSE l_quantity END AS value,
  CASE WHEN l_returnflag = 'A' THEN 'lbs' WHEN l_returnflag = 'N' THEN 'F' WHEN l_linestatus = 'F' THEN 'raw' END AS unit
  FROM lineitem WHERE l_linenumber < 7)
SELECT l_orderkey, l_linenumber, l_partkey, label, round(value, 6) + 0.0 AS value, unit FROM u
WHERE NOT (label = 'R' AND unit IS NULL)"""
)
def unit_harmonise(spark, sf):
    """Convert, relabel, drop listed labels and unit-less rows."""
    rules = (
        clean.UnitRule("A", "weight", "lbs", clean.KG_TO_LBS),
        clean.UnitRule("N", "temperature", "F", 9 / 5, 32.0),
    )
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_linenumber") == 7, "extra").otherwise(F.col("l_returnflag")).alias("label"),
        F.col("l_quantity").alias("value"),
        F.when(F.col("l_linestatus") == "F", "raw").alias("unit"),
    )
    out = clean.harmonise_units(rows, rules, drop=["extra"], unit_required=["R"])
    return out.withColumn("value", r6("value"))


@query(
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1)
SELECT e.event_id, e.event_type AS name, e.value FROM events e JOIN q USING (event_type) WHERE e.value BETWEEN q.lo AND q.hi"""
)
def quantile_trim_simultaneous(spark, sf):
    """A5: both quantiles taken before trimming."""
    return A.trim_quantiles(meas(spark, sf), ["name"], "value").select("event_id", "name", "value")


@query(
    """WITH h AS (SELECT event_type, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1),
kept AS (SELECT e.* FROM events e JOIN h USING (event_type) WHERE e.value <= h.hi),
l AS (SELECT event_type, quantile_cont(value, 0.01) AS lo FROM kept GROUP BY 1)
SELECT k.event_id, k.event_type AS name, k.value FROM kept k JOIN l USING (event_type) WHERE k.value >= l.lo"""
)
def quantile_trim_sequential(spark, sf):
    """A5: the low quantile is taken after the top is cut."""
    return A.trim_quantiles(meas(spark, sf), ["name"], "value", sequential=True).select("event_id", "name", "value")


@query(
    """WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2),
d AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rn FROM c)
SELECT p.p_partkey, p.p_brand, p.p_type FROM part p JOIN d ON p.p_brand = d.p_brand AND p.p_type = d.p_type WHERE d.rn = 1"""
)
def dominant_pair(spark, sf):
    """Keep the parts of each brand's most frequent type."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return J.keep_known(part, A.dominant(part, ["p_brand"], "p_type"), ["p_brand", "p_type"])


@query(
    """WITH n AS (SELECT l.*, p.p_name AS label FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  WHERE p.p_name <> 'red widget' AND l.l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)),
f AS (SELECT label FROM n GROUP BY label HAVING count(*) >= 700)
SELECT l_orderkey, l_linenumber, l_partkey, label, l_quantity FROM n WHERE label IN (SELECT label FROM f)"""
)
def frequent_label_semi(spark, sf):
    """Rows of known subjects whose label is frequent."""
    events = table(spark, sf, "lineitem").withColumnsRenamed({"l_partkey": "itemid", "l_suppkey": "subject_id"})
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"))
    subjects = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("subject_id"))
    rows = S.frequent_rows(events, items, subjects, 700, drop=("red widget",))
    return rows.select("l_orderkey", "l_linenumber", F.col("itemid").alias("l_partkey"), "label", "l_quantity")


@query(
    """WITH d AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity FROM lineitem l
ANTI JOIN d ON l.l_orderkey = d.l_orderkey AND l.l_linenumber = d.l_linenumber"""
)
def anti_dup(spark, sf):
    """Remove every row of a repeated key."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    key = ["l_orderkey", "l_linenumber"]
    listed = R.duplicate_flag(rows, key).where("is_duplicate").select(*key).distinct()
    return J.drop_known(rows, listed, key)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS is_duplicate FROM lineitem"""
)
def duplicate_flags(spark, sf):
    """Mark every row of a repeated key."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return R.duplicate_flag(rows, ["l_orderkey", "l_linenumber"])


MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, l_partkey, '{m}' AS name, {m} AS value FROM lineitem" for m in MEASURES
    )
)
def melt_long(spark, sf):
    """Three measures to long rows."""
    return R.melt(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"], MEASURES)


@query(
    "SELECT user_id AS subject_id, "
    + ", ".join(f"round(avg(CASE WHEN event_type = '{n}' THEN value END), 6) + 0.0 AS \"{n}\"" for n in NAMES)
    + " FROM events WHERE event_type <> 'purchase' GROUP BY user_id"
)
def pivot_mean(spark, sf):
    """R2: one column per measure, mean over duplicates."""
    wide = pivot_names(meas(spark, sf), ["subject_id"], NAMES)
    return wide.select("subject_id", *[r6(n).alias(n) for n in NAMES])


@query(
    """WITH t AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2
  FROM customer WHERE c_custkey % 10 < 8)
SELECT c_custkey, round((c_acctbal - t.m) / t.s, 6) + 0.0 AS c_acctbal, round((c_nationkey - t.m2) / t.s2, 6) + 0.0 AS c_nationkey
FROM customer, t"""
)
def train_scaler(spark, sf):
    """Standardise by training folds only."""
    from pulsegrid.operators.signal import fit_apply_scaler

    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    cols = ["c_acctbal", "c_nationkey"]
    scaled = fit_apply_scaler(rows, cols, F.col("c_custkey") % 10 < 8)
    return scaled.select("c_custkey", *[r6(c).alias(c) for c in cols])


@query(
    """WITH s AS (SELECT s_suppkey, [CAST(s_nationkey AS VARCHAR), CAST((s_nationkey + 7) % 30 AS VARCHAR)] AS codes FROM supplier),
e AS (SELECT s_suppkey, unnest(codes) AS code, unnest([0, 1]) AS place FROM s),
n AS (SELECT CAST(n_nationkey % 20 AS VARCHAR) AS code, min_by(n_name, n_nationkey) AS n_name,
  min_by(r_name, n_nationkey) AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
x AS (SELECT s_suppkey, string_agg(n_name, ',' ORDER BY place) AS names, string_agg(r_name, ',' ORDER BY place) AS regions
  FROM e JOIN n USING (code) GROUP BY s_suppkey)
SELECT s.s_suppkey, coalesce(names, '') AS names, coalesce(regions, '') AS regions FROM s LEFT JOIN x USING (s_suppkey)"""
)
def dict_explode_join(spark, sf):
    """Code lists to names by a dictionary whose first entry wins."""
    code = F.col("s_nationkey").cast("string")
    lists = table(spark, sf, "supplier").select(
        "s_suppkey", F.array(code, ((F.col("s_nationkey") + 7) % 30).cast("string")).alias("codes")
    )
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nation.withColumn("code", (F.col("n_nationkey") % 20).cast("string"))
    known = J.first_definition(nation, "code", "n_nationkey", ["n_name", "r_name"])
    out = J.translate_codes(lists, ["s_suppkey"], "codes", known, "code", ["n_name", "r_name"])
    return out.select("s_suppkey", text_list("codes_n_name").alias("names"), text_list("codes_r_name").alias("regions"))


@query(
    """WITH n AS (SELECT CAST(n_nationkey % 20 AS VARCHAR) AS code, max_by(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1)
SELECT code, n_name FROM n"""
)
def dict_last_wins(spark, sf):
    """The last definition of a repeated code wins."""
    nation = table(spark, sf, "nation").withColumn("code", (F.col("n_nationkey") % 20).cast("string"))
    return J.first_definition(nation, "code", "n_nationkey", ["n_name"], on_duplicate="last")


@query(
    """SELECT o_orderkey, CASE WHEN k = 9 THEN 'test' WHEN k = 8 THEN 'val' ELSE 'train' END AS split
FROM (SELECT o_orderkey, o_custkey % 10 AS k FROM orders)"""
)
def fold_to_split(spark, sf):
    """K7: the last two folds are validation and test."""
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("fold"))
    return fold_split(rows, "fold").drop("fold")


@query("SELECT o_orderkey, o_custkey % 10 AS fold FROM orders WHERE o_custkey % 10 NOT IN (9, 8, 0)")
def fold_expr(spark, sf):
    """Folds excluded from the end and by number."""
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("fold"))
    return clean.select_folds(rows, "fold", ["x-1", "x-2", "x0"])


@query("SELECT o_orderkey, o_custkey % 10 AS fold FROM orders WHERE o_custkey % 10 IN (0, 9)")
def fold_expr_keep(spark, sf):
    """Folds kept by number and from the end."""
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 10).alias("fold"))
    return clean.select_folds(rows, "fold", ["0", "-1"])


@query(
    """SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN o_custkey % 8 WHEN o_orderpriority = '5-LOW' THEN -1
  WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN 8 WHEN o_orderstatus = 'O' THEN 9 ELSE -2 END AS INTEGER) AS strat_fold FROM orders"""
)
def provided_split_folds(spark, sf):
    """K8: named splits to folds in order of precedence."""
    status = F.col("o_orderstatus")
    split = F.when(status == "F", "train").when(status == "P", "no_split").when(F.col("o_custkey") % 2 == 0, "val").otherwise("test")
    labels = F.when(F.col("o_orderpriority") == "5-LOW", F.array().cast("array<string>")).otherwise(F.array("o_orderpriority"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", split.alias("split"), labels.alias("labels"))
    return provided_split_fold(rows, "split", "labels", F.col("o_custkey") % 8).select("o_orderkey", "strat_fold")


_PACK = """
WITH RECURSIVE d AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS s FROM documents),
f(b) AS (SELECT CAST(0 AS HUGEINT) UNION ALL SELECT (SELECT min(s) FROM d WHERE d.s > f.b + 200000) FROM f
  WHERE EXISTS (SELECT 1 FROM d WHERE d.s > f.b + 200000))
"""


@query(
    _PACK
    + """SELECT doc_id, n_chars, CAST(count(f.b) - 1 AS BIGINT) AS file_idx, CAST(d.s - max(f.b) AS BIGINT) AS start
FROM d JOIN f ON f.b <= d.s GROUP BY doc_id, n_chars, d.s"""
)
def pack_manifest(spark, sf):
    """Files close once they exceed the cap; starts count inside a file."""
    rows = table(spark, sf, "documents").select("doc_id", "n_chars")
    return packing.pack_manifest(rows, ["doc_id"], "n_chars", 200_000)


@query(
    """WITH d AS (SELECT doc_id, n_chars, CAST(sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS BIGINT) AS s FROM documents),
b AS (SELECT *, s // 200000 AS file_idx FROM d)
SELECT doc_id, n_chars, file_idx, s - min(s) OVER (PARTITION BY file_idx) AS start FROM b"""
)
def pack_bins(spark, sf):
    """Files by running length over the cap."""
    rows = table(spark, sf, "documents").select("doc_id", "n_chars")
    return packing.pack_bins(rows, ["doc_id"], "n_chars", 200_000)


@query(
    """WITH a AS (SELECT doc_id // 2 AS data, n_chars AS length, 0 AS file_idx, CAST(sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS BIGINT) AS start
  FROM documents WHERE doc_id % 2 = 0),
b AS (SELECT doc_id // 2 AS data, n_chars AS length, CAST(sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS BIGINT) AS start
  FROM documents WHERE doc_id % 2 = 1)
SELECT data, length, CAST(0 AS BIGINT) AS file_idx, start FROM a UNION ALL
SELECT b.data - (SELECT min(data) FROM b) + (SELECT max(data) + 1 FROM a), b.length, 0, b.start + (SELECT max(start + length) FROM a) FROM b"""
)
def append_manifest(spark, sf):
    """Append one manifest to another with shifted starts and ids."""
    docs = table(spark, sf, "documents")

    def side(rest):
        rows = docs.where(F.col("doc_id") % 2 == rest).select(
            F.floor(F.col("doc_id") / 2).alias("data"), F.col("n_chars").alias("length")
        )
        return packing.pack_manifest(rows, ["data"], "length", 0)

    return packing.append_manifest(side(0), side(1))


@query(
    """WITH a AS (SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS record_id FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 + (SELECT count(*) FROM a) AS record_id FROM orders WHERE o_orderstatus = 'O'),
c AS (SELECT o_orderkey, o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 + (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS record_id FROM orders WHERE o_orderstatus = 'P')
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"""
)
def union_remap(spark, sf):
    """Stack two datasets with dense, shifted record ids."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    parts = [orders.where(F.col("o_orderstatus") == s).drop("o_orderstatus") for s in ("F", "O", "P")]
    return R.remap_union(parts, "o_custkey").select("o_orderkey", "o_custkey", "record_id")


@query(
    """SELECT o_orderkey AS k, o_totalprice AS price, CAST(NULL AS VARCHAR) AS name FROM orders
UNION ALL SELECT c_custkey, c_acctbal, c_name FROM customer"""
)
def union_align(spark, sf):
    """Stack tables by column name, absent columns null."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    customers = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("price"), F.col("c_custkey").alias("k"))
    return R.align_union(orders, customers)


@query(
    """SELECT n.n_nationkey, n.n_name, r.r_name, coalesce(s.member, 0) AS is_member, o.subset FROM nation n
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT n_nationkey, 1 AS member FROM nation WHERE n_nationkey % 3 = 0) s ON n.n_nationkey = s.n_nationkey
LEFT JOIN (SELECT n_nationkey, CAST(n_nationkey % 5 AS INTEGER) AS subset FROM nation WHERE n_nationkey < 20) o ON n.n_nationkey = o.n_nationkey"""
)
def split_file_join(spark, sf):
    """Tables and split files written as text, read back and joined."""
    root = scratch_path(spark, "split-files")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    nation.write.option("compression", "gzip").csv(f"{root}/nation", header=True, sep="|")
    region.write.csv(f"{root}/region", header=True)
    nation.where("n_nationkey % 3 = 0").select("n_nationkey").write.csv(f"{root}/members")
    nation.where("n_nationkey < 20").select("n_nationkey", F.col("n_nationkey") % 5).write.csv(f"{root}/subsets")
    back = S.read_csv(spark, f"{root}/nation", "n_nationkey int, n_name string, n_regionkey int", sep="|")
    other = S.read_csv(spark, f"{root}/region", "r_regionkey int, r_name string")
    joined = J.left_with_lists(back, other.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"])
    flagged = J.attach_split(joined, S.read_members(spark, f"{root}/members", 1, "int"), "n_nationkey", "is_member")
    out = J.attach_split(flagged, S.read_members(spark, f"{root}/subsets", 2, "int"), "n_nationkey", "subset")
    return out.select("n_nationkey", "n_name", "r_name", "is_member", "subset")


@query(
    """SELECT o_orderkey, o_custkey, o_totalprice, split,
  CAST(CASE split WHEN 'valid' THEN 8 WHEN 'test' THEN 9 ELSE 0 END AS INTEGER) AS strat_fold
FROM (SELECT *, CASE o_custkey % 4 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' WHEN 2 THEN 'extra' ELSE 'train' END AS split FROM orders)"""
)
def csv_roundtrip(spark, sf):
    """One text file set per split, written and read back."""
    root = scratch_path(spark, "csv")
    names = ["valid", "test", "extra", "train"]
    split = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_custkey") % 4 + 1).cast("int"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", split.alias("split"))
    sinks.write_by_split(rows, root, splits=names)
    schema = "o_orderkey long, o_custkey long, o_totalprice double"
    frames = {n: S.read_csv(spark, f"{root}/split={n}", schema) for n in names}
    return S.load_splits(frames, ["o_orderkey", "o_custkey"], key="o_orderkey")


@query(
    """SELECT o_orderkey, CAST(CASE WHEN o_custkey % 10 < 7 THEN 0 ELSE 1 END AS INTEGER) AS subset FROM orders"""
)
def fixed_split_reuse(spark, sf):
    """A split saved once is loaded the second time."""
    path = scratch_path(spark, "fixed-split")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    make = lambda df: df.withColumn("subset", F.when(F.col("o_custkey") % 10 < 7, 0).otherwise(1))
    fixed_split(rows, path, "o_orderkey", make)
    again = fixed_split(rows, path, "o_orderkey", lambda df: df.withColumn("subset", F.lit(-1)))
    return again.select("o_orderkey", "subset")


@query(
    r"""SELECT p.page_id, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)\.[^.]*$', '\1') AS stem,
  regexp_replace(regexp_replace(substr(url, 8), '^/+', ''), '/+', '__', 'g') AS flat,
  CASE WHEN length(CAST((page_id * 37 // 1000) * 1000 AS VARCHAR)) < 5
    THEN lpad(CAST((page_id * 37 // 1000) * 1000 AS VARCHAR), 5, '0') ELSE CAST((page_id * 37 // 1000) * 1000 AS VARCHAR) END AS folder,
  array_to_string(list_slice(string_split(url, '/'), 2, 3), '-') AS part
FROM pages p"""
)
def path_ids(spark, sf):
    """Stems, flat names, padded folders and partition names from paths."""
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        S.path_stem(url).alias("stem"),
        S.flat_name(url.substr(F.lit(8), F.length(url))).alias("flat"),
        S.folder_bucket(F.concat((F.col("page_id") * 37).cast("string"), F.lit("_hr"))).alias("folder"),
        S.partition_name(url).alias("part"),
    )


@query(
    """WITH b AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey) - 1 AS meta_idx
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')),
m AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS meta_idx FROM customer)
SELECT b.meta_idx, b.o_orderkey, m.c_custkey, m.c_name FROM b JOIN m USING (meta_idx)"""
)
def block_align(spark, sf):
    """Block rows matched to metadata by position, surplus dropped."""
    blocks = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("split"))
    meta = table(spark, sf, "customer").select("c_custkey", "c_name")
    out = S.align_blocks(blocks, meta, ["1-URGENT", "2-HIGH", "5-LOW"], ["o_orderkey"], ["c_custkey"])
    return out.select("meta_idx", "o_orderkey", "c_custkey", "c_name")


@query(
    """SELECT n_nationkey, 'fs=' || CAST(n_nationkey * 10 AS VARCHAR) || ',name=' || n_name || ',version=1'
  || ',annotation_fs=' || CAST(n_regionkey AS VARCHAR) AS merged,
  'name=' || n_name || ',version=1,meta.fs=250,meta.version=2' AS upgraded FROM nation"""
)
def manifest_merge(spark, sf):
    """Annotation keys prefixed without their version; old rate replaced."""
    nation = table(spark, sf, "nation")
    meta = F.create_map(
        F.lit("fs"), (F.col("n_nationkey") * 10).cast("string"), F.lit("name"), F.col("n_name"), F.lit("version"), F.lit("1")
    )
    notes = F.create_map(F.lit("version"), F.lit("9"), F.lit("fs"), F.col("n_regionkey").cast("string"))
    show = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return nation.select(
        "n_nationkey",
        show(packing.merged_meta(meta, notes)).alias("merged"),
        show(packing.upgraded_meta(meta, {"fs": "250", "version": "2"})).alias("upgraded"),
    )


@query(
    """SELECT doc_id, n_chars, 'good' AS status FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 5 <> 0
UNION ALL SELECT doc_id, n_chars, 'failed: code ' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 7 = 3 AND doc_id % 5 <> 0
UNION ALL SELECT doc_id, n_chars, 'done' FROM documents WHERE doc_id % 5 = 0"""
)
def failure_split(spark, sf):
    """Skip finished outputs, put failures aside, keep the rest."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    done = docs.where("doc_id % 5 = 0").select("doc_id")
    todo = S.pending(docs, done, ["doc_id"])
    worked = todo.withColumn(
        "error", F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("code "), F.col("doc_id").cast("string")))
    )
    good, failed = S.split_failures(worked, ["doc_id"])
    finished = S.mark_done(docs, done, ["doc_id"]).where("done = 1").drop("done")
    return R.align_union(
        good.withColumn("status", F.lit("good")),
        failed.select("doc_id", "n_chars", F.concat(F.lit("failed: "), "error").alias("status")),
        finished.withColumn("status", F.lit("done")),
    )


@query(
    "SELECT 'patient=' || CAST(k AS VARCHAR) AS folder, k AS folder_id, CAST(0 AS INTEGER) AS corrupt, CAST(1 AS BIGINT) AS files"
    " FROM (SELECT DISTINCT o_custkey % 97 AS k FROM orders) UNION ALL SELECT 'patient1013', CAST(1013 AS BIGINT), CAST(1 AS INTEGER), CAST(1 AS BIGINT)"
)
def file_audit(spark, sf):
    """Catalogue and check every written file: a folder per group of customers, and one of another format."""
    root = scratch_path(spark, "audit")
    orders = table(spark, sf, "orders").withColumn("patient", F.col("o_custkey") % 97)
    orders.repartition("patient").write.partitionBy("patient").parquet(f"{root}/records")
    table(spark, sf, "nation").coalesce(1).write.csv(f"{root}/patient1013")

    def check(content: bytes) -> None:
        if content[:4] != b"PAR1" or content[-4:] != b"PAR1":
            raise ValueError("not a complete file")

    listed = S.record_catalogue(spark, root, "")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    _, bad = S.audit_files(files, check)
    return J.flag_lookup(listed, bad.select("path"), ["path"], "corrupt").groupBy("folder", "folder_id", "corrupt").agg(
        F.count(F.lit(1)).alias("files")
    )


@query(
    "SELECT CAST(v + 1 AS INTEGER) AS epoch, (SELECT count(*) * 2 FROM documents) AS n, CAST(v AS VARCHAR) AS version, kind"
    " FROM (SELECT unnest([0, 1]) AS v), (SELECT unnest(['noagg', 'agg']) AS kind)"
)
def versioned_export(spark, sf):
    """Two exports get versions 0 and 1, both kinds of tables each."""
    root = scratch_path(spark, "export")
    plain = pred(spark, sf)
    agg = A.aggregate_predictions(plain, ["sample_id", "label"])
    paths = [sinks.export_predictions(plain, agg, root, "task", epoch) for epoch in (1, 2)]
    parts = []
    for path in paths:
        for kind in ("noagg", "agg"):
            rows = spark.read.parquet(f"{path}/{kind}/*").groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))
            parts.append(rows.withColumns({"version": F.lit(path.rsplit("_", 1)[-1]), "kind": F.lit(kind)}))
    return R.align_union(*parts)


@query(
    """SELECT p_partkey, p_brand, CAST(idx AS INTEGER) AS idx, r.mean FROM (SELECT p_partkey, p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS idx FROM part)
JOIN (SELECT p_brand, round(avg(p_retailprice), 6) + 0.0 AS mean FROM part GROUP BY p_brand) r USING (p_brand)"""
)
def dataset_roundtrip(spark, sf):
    """Records, vocabulary and statistics saved and loaded again."""
    from pulsegrid.operators.codes import vocabulary

    root = scratch_path(spark, "dataset")
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    vocab = vocabulary(part.withColumn("l", F.array("p_brand")), "l")
    stats = part.groupBy("p_brand").agg(r6(F.avg("p_retailprice")).alias("mean"))
    sinks.save_dataset(part, root, vocab, stats)
    rows, names, saved = sinks.load_dataset(spark, root)
    out = rows.join(names.withColumnRenamed("label", "p_brand"), "p_brand").join(saved, "p_brand")
    return out.select("p_partkey", "p_brand", F.col("idx").cast("int").alias("idx"), "mean")


@query(
    """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'HOME' WHEN 'HOUSEHOLD' THEN 'HOME' ELSE c_mktsegment END AS segment,
  CASE WHEN c_nationkey % 4 = 0 THEN 'male' WHEN c_nationkey % 4 = 1 THEN 'female' WHEN c_nationkey % 4 = 2 THEN 'male' ELSE 'unknown' END AS sex,
  CASE WHEN c_nationkey % 4 IN (0, 2) THEN 0 WHEN c_nationkey % 4 = 1 THEN 1 ELSE -1 END AS sex_code,
  'Seg_' || c_mktsegment || '_x' AS plain, 'Seg__' || c_mktsegment || '__x' AS marked FROM customer"""
)
def rename_chain(spark, sf):
    """Chained renames, sex words and label names."""
    raw = F.element_at(F.array(*[F.lit(w) for w in (" M", "'Female'", "male", "?")]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    name = F.concat(F.lit("Seg ("), F.col("c_mktsegment"), F.lit(")|x"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        clean.rename_chain("c_mktsegment", {"BUILDING": "HOUSEHOLD"}, {"HOUSEHOLD": "HOME"}).alias("segment"),
        clean.sex_name(raw).alias("sex"),
        clean.sex_code(raw).alias("sex_code"),
        clean.clean_label(name).alias("plain"),
        clean.clean_label(name, "_").alias("marked"),
    )


@query(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
  CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 3 = 0 THEN NULL ELSE round(value * 10, 4) + 0.0 END AS measured FROM events"""
)
def coerce_numeric(spark, sf):
    """Text to number, null where it is not one."""
    raw = F.regexp_replace("props", '[^0-9]', "")
    text = F.when(raw.cast("int") % 3 == 0, F.concat(F.col("value").cast("string"), F.lit(" mg"))).otherwise((F.col("value") * 10).cast("string"))
    return table(spark, sf, "events").select("event_id", clean.to_number(raw).alias("k"), r6(clean.to_number(text), 4).alias("measured"))


@query(
    """SELECT o_orderkey, o_orderpriority || ',it''s' AS words, CAST(o_custkey % 7 AS DOUBLE) AS weight,
  CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey % 3 AS DOUBLE) END AS other FROM orders"""
)
def literal_lists(spark, sf):
    """list and dictionary literals parsed as data."""
    words = F.concat(F.lit("['"), F.col("o_orderpriority"), F.lit("', \"it's\"]"))
    other = F.when(F.col("o_custkey") % 2 == 0, (F.col("o_custkey") % 3).cast("string")).otherwise("nan")
    pairs = F.concat(F.lit("{'NORM': "), (F.col("o_custkey") % 7).cast("string"), F.lit(", 'SR': "), other, F.lit("}"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        text_list(L.literal_list(words)).alias("words"),
        L.literal_map(pairs)["NORM"].alias("weight"),
        L.literal_map(pairs)["SR"].alias("other"),
    )


@query(
    """WITH o AS (SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS d, min(CAST(l.l_shipdate AS DATE)) AS s, max(CAST(l.l_shipdate AS DATE)) AS e
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2),
x AS (SELECT o_orderkey, date_diff('day', d, s) AS days, date_diff('day', d, e) AS treated FROM o)
SELECT o_orderkey, CAST(days AS INTEGER) AS days, coalesce(days BETWEEN 0 AND 3, false) AS acute,
  coalesce(days >= 0 AND treated <= days, false) AS catheterised,
  CASE WHEN o_orderkey % 2 = 0 THEN '' WHEN NOT coalesce(days BETWEEN 0 AND 3, false) THEN ' old'
    WHEN coalesce(days >= 0 AND treated <= days, false) THEN ' acute catheterized' ELSE ' acute' END AS status FROM x"""
)
def date_status(spark, sf):
    """Text dates in two formats, day differences and event status."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    ship = lines.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("s"), F.max("l_shipdate").alias("e"))
    rows = orders.join(ship, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey",
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"),
        F.coalesce(F.date_format("s", "dd-MMM-yy"), F.lit("n/a")).alias("s"),
        F.coalesce(F.date_format("e", "dd-MMM-yy"), F.lit(" - ")).alias("e"),
    )
    day = clean.parse_date("d", clean.DATE_FULL_YEAR)
    days = F.datediff(clean.parse_date("s", clean.DATE_SHORT_MONTH), day)
    treated = F.datediff(clean.parse_date("e", clean.DATE_SHORT_MONTH), day)
    acute, cath = clean.acute_event(days), clean.treated_after_event(days, treated)
    return rows.select(
        "o_orderkey", days.alias("days"), acute.alias("acute"), cath.alias("catheterised"),
        clean.event_status(F.col("o_orderkey") % 2 != 0, acute, cath).alias("status"),
    )


@query(
    """SELECT d.doc_id, CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS is_labelled, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def lookup_flag(spark, sf):
    """Presence flag and mapped value."""
    docs = table(spark, sf, "documents").select("doc_id")
    return J.flag_lookup(docs, table(spark, sf, "labels"), ["doc_id"], "is_labelled", "quality")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (
  ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) - 1 AS place FROM lineitem"""
)
def sorted_top(spark, sf):
    """O1: a whole multi-key sort; the place of every row is part of the result."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"]
    return position(R.ordered(rows, order), [], order, "place")


@query(
    """SELECT o_custkey, min(o_orderkey) AS o_orderkey, min_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey"""
)
def dedupe(spark, sf):
    """The first order of each customer."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.first_by(rows, ["o_custkey"], [F.col("o_orderkey").alias("k")])


@query(
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1"""
)
def first_in_stay(spark, sf):
    """The first event of each user."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return R.first_in_stay(rows, "user_id", ["ts", "event_id"]).drop("ts")


@query(
    """WITH seen AS (SELECT user_id, row_number() OVER (ORDER BY min(event_id), user_id) - 1 AS rk, count(*) OVER () AS n FROM events GROUP BY user_id),
a AS (SELECT e.event_id, e.user_id FROM events e JOIN seen s USING (user_id) WHERE e.event_type <> 'error' AND s.rk >= floor(0.2 * s.n) AND s.rk < floor(0.5 * s.n)),
b AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS rk, count(*) OVER () AS n FROM events WHERE event_type = 'error')
SELECT event_id, user_id FROM a UNION ALL SELECT event_id, user_id FROM b WHERE rk >= floor(0.2 * n) AND rk < floor(0.5 * n)"""
)
def fraction_slice(spark, sf):
    """A contiguous range of patients, unlabelled rows sliced alike."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return R.fraction_slice(rows, "user_id", "event_id", 0.2, 0.5, F.col("event_type") != "error").select("event_id", "user_id")


@query(
    """SELECT doc_id, n_chars, lang FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 10 >= 2 AND n_chars >= 500"""
)
def cohort_filter(spark, sf):
    """Membership, fold and length predicates."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    folded = docs.withColumn("fold", F.col("doc_id") % 10 - 2)
    keep = clean.in_cohort("lang", ["en", "fr"], "fold", "n_chars", 500)
    return folded.where(keep).drop("fold")


@query(
    """SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS "F", CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS "O",
  CAST(count(*) FILTER (o_orderstatus = 'X') AS BIGINT) AS "X" FROM orders GROUP BY 1"""
)
def crosstab(spark, sf):
    """Zero-filled cross table."""
    rows = table(spark, sf, "orders")
    return A.crosstab(rows, "o_orderpriority", "o_orderstatus", ["F", "O", "X"])


@query(
    """SELECT k.fold, count(o.o_orderkey) AS n FROM (SELECT unnest([0,1,2,3,4,5,6,7,8,9,10,11])::BIGINT AS fold) k
LEFT JOIN orders o ON o.o_custkey % 10 = k.fold GROUP BY 1"""
)
def fold_counts(spark, sf):
    """Rows per expected fold, zero where absent."""
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("fold"))
    return A.value_counts(rows, "fold", list(range(12)))


@query("SELECT count(DISTINCT o_custkey) AS o_custkey, count(DISTINCT o_orderkey) AS o_orderkey FROM orders")
def distinct_counts(spark, sf):
    """Distinct patients and records."""
    return A.distinct_count(table(spark, sf, "orders"), ["o_custkey", "o_orderkey"])


@query(
    """WITH m AS (SELECT 'c_acctbal' AS feature, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS value FROM customer
  UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer)
SELECT feature, min(value) AS min, max(value) AS max, CAST(count(*) - count(value) AS BIGINT) AS nulls,
  round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(quantile_cont(value, 0.25), 6) + 0.0 AS q25, round(quantile_cont(value, 0.75), 6) + 0.0 AS q75
FROM m GROUP BY feature"""
)
def feature_summary(spark, sf):
    """Median, quartiles, range and null count."""
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.col("c_nationkey").cast("double").alias("c_nationkey"),
    )
    long = R.melt(rows, ["c_custkey"], ["c_acctbal", "c_nationkey"], "feature", "value")
    out = A.feature_summary(long)
    return out.select("feature", "min", "max", "nulls", *[r6(c).alias(c) for c in ("median", "q25", "q75")])


@query("SELECT CAST(500 AS BIGINT) AS n, CAST(500 AS BIGINT) AS orders, true AS known")
def sample_contract(spark, sf):
    """O2: the sample is exact, without repeats, and made of known orders."""
    orders = table(spark, sf, "orders")
    picked = J.flag_lookup(hash_sample(spark, sf), orders, ["o_orderkey", "o_custkey"], "known")
    return picked.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("orders"), F.bool_and(F.col("known") == 1).alias("known")
    )


@query(f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {hash_sql(73, 'o_orderkey')}, o_orderkey LIMIT 500")
def hash_sample(spark, sf):
    """O2: exactly 500 orders without replacement."""
    return R.sample_exact(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 500, "o_orderkey", 73)
