"""Label curation per source layout, and the shared dataset build.

Each function turns one kind of metadata table into records with label lists;
``build_dataset`` then filters rare labels, indexes vocabularies and adds
patient-aware stratified folds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import clean
from pulsegrid.functions import labels as L
from pulsegrid.operators.codes import map_labels, vocabulary
from pulsegrid.operators.joins import drop_known, first_definition, left_with_lists, translate_codes
from pulsegrid.operators.splits import strata_labels, stratified_folds
from pulsegrid.sources.tables import partition_name, path_stem

# --- fixed values -----------------------------------------------------------
DIAGNOSIS_RENAMES = {
    "Arterial Hypertension": "Arterial hypertension",
    "Hyperlipoproteinemia Type IIa": "Hyperlipoproteinemia",
    "Hyperlipoproteinemia Type IV": "Hyperlipoproteinemia",
    "Hyperlipoproteinemia Type IIb": "Hyperlipoproteinemia",
    "Hyperlipemia": "Hyperlipoproteinemia",
    "Hyperlipoproteinemia Typ IIa": "Hyperlipoproteinemia",
    "Postop. Thyriodectomy": "Postop. Thyroidectomy",
    "Coronary artery disease (PTCA+Stent)": "Coronary artery disease",
    "Hyperlipoproteinemia Type IV b": "Hyperlipoproteinemia",
    "peripheral atherosclerosis": "Peripheral atherosclerosis",
    "Recurrent sustained ventricular tachycardia": "Ventricular tachycardia",
    "Ventricular tachycardias": "Ventricular tachycardia",
    "Recurrent ventricular tachycardias": "Ventricular tachycardia",
    "Recurrent ventricular tachycardia": "Ventricular tachycardia",
    "Hyperlipidemia": "Hyperlipoproteinemia",
    "Mitral regurgitation (grade 2)": "Mitral regurgitation",
    "Hypertrophic obstructive cardiomyopathy (intraventricular gradient 100-160mmHg)": "Hypertrophic obstructive cardiomyopathy",
    "Hypertrophic obstructive cardiomyopathy (intraventricular gradient 70-90mmHg)": "Hypertrophic obstructive cardiomyopathy",
}
INFARCTION = "Myocardial infarction"
FORCED_CODE, FORCED_NAME = "106068003", "ARH"
EXAM_FLAGS = ("1dAVb", "RBBB", "LBBB", "SB", "AF", "ST")
EXAM_LABELS = ("1AVB", "RBBB", "LBBB", "SBRAD", "AFIB", "STACH")
# -----------------------------------------------------------------------------


def from_comment_lines(df: DataFrame, lines: str = "comments") -> DataFrame:
    """Diagnoses and infarction status from ``key: value`` comments."""
    ls = F.col(lines)
    value = lambda key: L.comment_value(ls, key)
    seen = clean.parse_date(value("ECG date"), clean.DATE_FULL_YEAR)
    event = clean.parse_date(value("Infarction date (acute)"), clean.DATE_SHORT_MONTH)
    treated = clean.parse_date(value("Catheterization date"), clean.DATE_SHORT_MONTH)
    out = df.withColumns(
        {
            "days_since_infarction": F.datediff(seen, event),
            "days_since_catheterization": F.datediff(seen, treated),
            "labels": L.drop_blacklisted(
                F.concat(F.array(value("Reason for admission")), F.split(value("Additional diagnoses"), ","))
            ),
        }
    )
    since, after = F.col("days_since_infarction"), F.col("days_since_catheterization")
    out = out.withColumn("labels", F.transform("labels", lambda x: clean.rename_chain(x, DIAGNOSIS_RENAMES)))
    status = clean.event_status(
        F.array_contains("labels", INFARCTION), clean.acute_event(since), clean.treated_after_event(since, after)
    )
    return out.withColumn("status", status).withColumn(
        "labels",
        F.transform("labels", lambda x: F.when(x == INFARCTION, F.concat(x, F.col("status"))).otherwise(x)),
    )


def code_names(mapping: DataFrame, code: str = "code", name: str = "name", order: str = "row") -> DataFrame:
    """Code dictionary: the first name of a code wins, one code is set by rule."""
    table = first_definition(mapping, code, order, [name])
    return table.withColumn(name, F.when(F.col(code) == FORCED_CODE, FORCED_NAME).otherwise(F.col(name)))


def from_header_comments(df: DataFrame, mapping: DataFrame, key: str, lines: str = "comments") -> DataFrame:
    """Labels, age and sex from header comments with a code dictionary."""
    ls = F.col(lines)
    parsed = df.withColumns(
        {
            "codes": F.transform(L.code_list(L.comment_value(ls, "Dx"), ","), lambda x: x.try_cast("long").cast("string")),
            "age": L.comment_age(ls),
            "sex": F.coalesce(L.comment_sex(ls), F.lit("nan")),
        }
    )
    out = translate_codes(parsed, [key], "codes", mapping, "code", ["name"])
    return out.withColumnRenamed("codes_name", "labels").drop("codes")


def from_rhythm_table(df: DataFrame) -> DataFrame:
    """Condition and rhythm words, joined; the empty token is dropped per word."""
    condition = L.code_list("Beat", " ", drop=[L.EMPTY_TOKEN])
    rhythm = L.code_list("Rhythm", " ")
    return df.select(
        F.col("FileName").alias("id"),
        condition.alias("label_condition"),
        rhythm.alias("label_rhythm"),
        F.concat(condition, rhythm).alias("label_all"),
        F.lower("Gender").alias("sex"),
        F.col("PatientAge").alias("age"),
    )


def from_code_table(df: DataFrame, codes: str = "aha_code") -> DataFrame:
    """Codes with modifiers, and without them."""
    full = L.code_list(codes, ";")
    return df.withColumns({"label_primary_w_mod": full, "label_primary": L.leading_code(full)})


def from_exam_flags(df: DataFrame, exams: DataFrame, key: str, flags: Sequence[str] = EXAM_FLAGS, marker: str = "ST") -> DataFrame:
    """Flag columns to label indices; a missing marker flag means unlabelled."""
    joined = df.join(exams, key, "left")
    return joined.withColumns(
        {
            "missing_label": F.col(marker).isNull(),
            "label": L.flags_to_indices(list(flags)),
            "sex": F.when(F.col("is_male"), "male").otherwise("female"),
        }
    )


def from_statement_maps(df: DataFrame, statements: DataFrame, key: str, codes: str = "scp_codes") -> DataFrame:
    """All, diagnostic, form and rhythm codes plus class and subclass names."""
    listed = df.withColumn("label_all", F.map_keys(L.literal_map(codes)))
    kinds = ("diagnostic", "form", "rhythm")
    marked = [F.when(F.col(k) > 0, F.col("code")).alias(k) for k in kinds]
    named = [F.when(F.col("diagnostic") > 0, F.col(c)).alias(c) for c in ("diagnostic_class", "diagnostic_subclass")]
    table = statements.select("code", *marked, *named)
    out = translate_codes(listed, [key], "label_all", table, "code", [*kinds, "diagnostic_class", "diagnostic_subclass"])
    return out.withColumnsRenamed(
        {
            "label_all_diagnostic": "label_diag",
            "label_all_form": "label_form",
            "label_all_rhythm": "label_rhythm",
            "label_all_diagnostic_class": "label_diag_superclass",
            "label_all_diagnostic_subclass": "label_diag_subclass",
        }
    )


def from_pediatric(df: DataFrame, diseases: DataFrame, statements: DataFrame, key: str) -> DataFrame:
    """Age in days, sex code and three code lists with their names.

    Dictionaries keep the last definition of a code.
    """
    cleaned = df.withColumns(
        {
            "age": F.regexp_replace("age", "d", "").cast("int"),
            "gender": clean.sex_code("gender", male=1, female=0),
            **{c: L.code_list(clean.text_or_null(f"`{c}`"), ";") for c in ("aha_code", "chn_code", "icd-10 code")},
        }
    )
    disease_code = F.explode(L.code_list("`icd-10 code`", ";"))
    by_disease = diseases.select("row", "`disease type`", "`disease category`", disease_code.alias("code"))
    by_disease = first_definition(
        by_disease.withColumnsRenamed({"disease type": "type", "disease category": "category"}),
        "code", "row", ["type", "category"], on_duplicate="last",
    )
    out = cleaned.withColumnRenamed("icd-10 code", "icd10")
    out = translate_codes(out, [key], "icd10", by_disease, "code", ["type", "category"])
    for name in ("aha", "chn"):
        code = clean.text_or_null(name, ("N/A", "nan"))
        table = statements.select("row", code.alias("code"), F.trim("description").alias("description"))
        table = first_definition(table, "code", "row", ["description"], on_duplicate="last")
        out = translate_codes(out, [key], f"{name}_code", table, "code", ["description"])
        out = out.withColumnRenamed(f"{name}_code_description", f"{name}_description")
    return out.withColumnsRenamed({"icd10_type": "icd10_disease_type", "icd10_category": "icd10_disease_category"})


def from_flag_columns(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """0/1 columns to a list of label indices."""
    return df.withColumn("label", L.flags_to_indices(list(flags)))


def from_partitioned(demographics: DataFrame, interpretations: DataFrame, duplicates: DataFrame, partition: str | None = None) -> DataFrame:
    """Demographics with statement codes; listed duplicates removed.

    With ``partition`` only that folder pair is read on.
    """
    source = path_stem(F.col("FileName"))
    rows = demographics.withColumns({"partition": partition_name(F.col("FileName")), "file_source": source})
    if partition is not None:
        rows = rows.where(F.col("partition") == partition)
    codes = interpretations.select("file_source", L.code_list("diagnostic_codes", ",").alias("diagnostic_codes"))
    joined = left_with_lists(rows, codes, ["file_source"], ["diagnostic_codes"])
    listed = duplicates.select(F.regexp_extract("file_name", "([^/]*)$", 1).alias("file_source")).distinct()
    return drop_known(joined, listed, ["file_source"]).withColumns(
        {
            "PatientRace": F.coalesce("PatientRace", F.lit("Unavailable")),
            "SexDSC": F.coalesce("SexDSC", F.lit("Unknown")),
        }
    )


def from_binary_splits(df: DataFrame, name: str = "NAME", label: str = "Label") -> DataFrame:
    """Yes/no label per record name."""
    return df.select(F.col(name).alias("record_name"), clean.parse_binary(label).alias("label"), "split", "strat_fold")


def build_dataset(
    df: DataFrame, key: str, label_columns: Sequence[str], min_count: int, folds: int, seed: int,
    strata: str | None = None, patient: str | None = None, sex: Column | None = None, age: Column | None = None,
    race: Column | None = None, buckets: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Filtered and indexed labels, ``strat_fold``, and vocab(label_set, label, idx, count)."""
    out, vocab = df, None
    for column in label_columns:
        for suffix, least in (("", 0), ("_filtered", min_count)):
            names = vocabulary(df, column, least)
            part = names.withColumn("label_set", F.lit(column + suffix))
            vocab = part if vocab is None else vocab.unionByName(part)
            if suffix:
                out = map_labels(out, [key], column, names)
    strata = strata or label_columns[0]
    marks = F.col(strata) if sex is None else strata_labels(F.col(strata), sex, age, race)
    out = stratified_folds(
        out.withColumn("_strata", marks.cast("array<string>")), key, "_strata", [1.0 / folds] * folds, seed,
        group=patient, buckets=buckets,
    ).drop("_strata")
    return out, vocab
