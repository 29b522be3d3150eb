"""Clinical target table: measurements nearest to each recording plus labels.

One plan from raw tables to one row per recording: harmonise units, trim,
match the nearest body measure, vital sign and lab value, scale by training
folds and append the class labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import clean
from pulsegrid.functions.labels import concat_blocks, multi_hot
from pulsegrid.operators.aggregates import class_validity, dominant, trim_quantiles
from pulsegrid.operators.codes import CohortSpec, cohort_labels
from pulsegrid.operators.joins import flag_lookup, keep_known
from pulsegrid.operators.nearest import DAY, HOUR, nearest_long, nearest_wide, pivot_names
from pulsegrid.operators.reshape import align_union, melt
from pulsegrid.operators.signal import fit_apply_scaler
from pulsegrid.session import cut
from pulsegrid.sources.tables import frequent_rows

# --- fixed values -----------------------------------------------------------
COHORT = "mimic_ed_all_edfirst_all_2000_5A"
BODY_NAMES = ("Height (Inches)", "Weight (Lbs)", "BMI (kg/m2)")
VITAL_NAMES = ("temperature", "heartrate", "resprate", "o2sat", "sbp", "dbp")
VITAL_OUTPUT = ("dbp", "heartrate", "o2sat", "resprate", "sbp", "temperature")
LAB_NAMES = (
    "PT", "Albumin", "Anion Gap", "Bicarbonate", "Bilirubin, Total", "Calcium, Total", "Creatinine",
    "Ferritin", "Urea Nitrogen", "Hematocrit", "Hemoglobin", "Lymphocytes", "MCHC", "RDW",
    "Red Blood Cells", "RDW-SD", "Creatine Kinase (CK)", "NTproBNP",
)
MARK_NAMES = ("RR", "QRS", "QT", "QTc", "P_wave_axis", "QRS_axis", "T_wave_axis")
LAB_ITEMS = (
    50963, 51006, 52647, 50811, 51222, 51640, 50912, 52546, 50924, 51221, 51480, 51638, 51639,
    52028, 50862, 53085, 52172, 50868, 52500, 51277, 50882, 50885, 53089, 51237, 51675, 51279,
    51274, 52921, 50910, 51249, 50893, 51244,
)
BEDSIDE_BODY = ("Weight (lbs)", "Height (Inches)")
BEDSIDE_VITALS = ("temperature", "heartrate", "resprate", "o2sat")
BEDSIDE_LABS = ("Creatinine (serum)", "Hemoglobin", "Hematocrit (serum)", "Total Bilirubin", "Albumin")
BEDSIDE_NAMES = (
    "Height (cm)", "Height", "Daily Weight", "Admission Weight (lbs.)", "Admission Weight (Kg)",
    "Temperature Celsius", "Temperature Fahrenheit", "Heart Rate", "Respiratory Rate",
    "PAR-Oxygen saturation", "O2 saturation pulseoxymetry", "Albumin", "Anion Gap", "Total Bilirubin",
    "Creatinine (serum)", "Hematocrit (serum)", "Hemoglobin",
)
BEDSIDE_RENAMES = {
    "Height": "Height (Inches)",
    "Temperature Fahrenheit": "temperature",
    "Heart Rate": "heartrate",
    "Respiratory Rate": "resprate",
    "O2 saturation pulseoxymetry": "o2sat",
}
BODY_RENAMES = {"Weight (lbs)": "Weight (Lbs)"}
LAB_RENAMES = (
    {"Creatinine (serum)": "Creatinine", "Hematocrit (serum)": "Hematocrit", "Total Bilirubin": "Bilirubin"},
    {"Bilirubin": "Bilirubin, Total"},
)
BODY_DAYS = 30
CLOSE_HOURS = 1
TRAIN_FOLDS, VALIDATION_FOLD, TEST_FOLD = 18, 18, 19
# -----------------------------------------------------------------------------

TARGET_NAMES = ("age", *BODY_NAMES, *MARK_NAMES, *LAB_NAMES, *VITAL_OUTPUT)
KEYS = ["subject_id", "ecg_time"]


def lab_rows(items: DataFrame, events: DataFrame, subjects: DataFrame, item_ids: Sequence[int] = LAB_ITEMS) -> DataFrame:
    """Lab values of one item and one unit per label, outliers trimmed."""
    wanted = items.where(F.col("itemid").isin(*item_ids)).select("itemid", "label")
    rows = events.where(F.col("valuenum").isNotNull()).join(wanted, "itemid")
    rows = keep_known(rows, dominant(rows, ["label"], "itemid"), ["label", "itemid"])
    rows = trim_quantiles(rows, ["label"], "valuenum")
    rows = keep_known(rows, dominant(rows, ["itemid"], "valueuom"), ["itemid", "valueuom"])
    rows = keep_known(rows, subjects, ["subject_id"])
    return rows.select("subject_id", F.col("storetime").alias("time"), F.col("label").alias("name"), F.col("valuenum").alias("value"))


def bedside_rows(items: DataFrame, events: DataFrame, subjects: DataFrame, min_count: int = 1000) -> DataFrame:
    """Bedside values in common units under common names."""
    rows = frequent_rows(events, items, subjects, min_count).where(F.col("label").isin(*BEDSIDE_NAMES))
    rows = clean.harmonise_units(rows, value="valuenum", unit="valueuom")
    name = clean.rename_chain("label", BEDSIDE_RENAMES)
    return rows.select("subject_id", F.col("storetime").alias("time"), name.alias("name"), F.col("valuenum").alias("value"))


def body_measures(body: DataFrame, bedside: DataFrame) -> DataFrame:
    """Height, weight and body mass index; trimmed from the top, then the bottom."""
    known = body.where(F.col("result_name").isin(*BODY_NAMES) & F.col("result_value").isNotNull()).select(
        "subject_id", F.col("chartdate").cast("timestamp_ntz").alias("time"), F.col("result_name").alias("name"),
        clean.to_number("result_value").alias("value"),
    )
    rows = align_union(known, bedside.where(F.col("name").isin(*BEDSIDE_BODY)))
    rows = rows.withColumn("name", clean.rename_chain("name", BODY_RENAMES))
    return trim_quantiles(rows, ["name"], "value", sequential=True)


def vital_signs(vitals: DataFrame, bedside: DataFrame) -> DataFrame:
    """Vital signs in long form, both quantiles cut at once."""
    long = melt(vitals.withColumnRenamed("charttime", "time"), ["subject_id", "time"], VITAL_NAMES)
    rows = align_union(long, bedside.where(F.col("name").isin(*BEDSIDE_VITALS))).where("value is not null")
    return trim_quantiles(rows, ["name"], "value")


def lab_values(labs: DataFrame, bedside: DataFrame) -> DataFrame:
    """Lab values with bedside additions under one name."""
    rows = align_union(labs, bedside.where(F.col("name").isin(*BEDSIDE_LABS))).where("value is not null")
    return trim_quantiles(rows.withColumn("name", clean.rename_chain("name", *LAB_RENAMES)), ["name"], "value")


def waveform_features(marks: DataFrame, key: str = "data") -> DataFrame:
    """Cleaned intervals and axes per recording."""
    rows = clean.clean_waveform_marks(marks).withColumns(clean.derived_intervals())
    renamed = {"rr_interval": "RR", "p_axis": "P_wave_axis", "qrs_axis": "QRS_axis", "t_axis": "T_wave_axis"}
    return rows.withColumnsRenamed(renamed).select(key, *MARK_NAMES)


def attach_nearest(records: DataFrame, body: DataFrame, vitals: DataFrame, labs: DataFrame) -> DataFrame:
    """One column per measure: body within 30 whole days, others within an hour."""
    plan = (
        (body, BODY_NAMES, BODY_DAYS * DAY, True),
        (vitals, VITAL_OUTPUT, CLOSE_HOURS * HOUR, False),
        (labs, LAB_NAMES, CLOSE_HOURS * HOUR, False),
    )
    wide = []
    for rows, names, tolerance, whole in plan:
        long = nearest_long(records, rows, names, tolerance, anchor_time="ecg_time", whole_days=whole)
        wide.append(pivot_names(long, KEYS, names))
    return nearest_wide(records, wide, KEYS)


@dataclass(frozen=True)
class Sources:
    """Raw tables of the clinical plan, with the columns of their readers."""

    records: DataFrame
    deterioration: DataFrame
    marks: DataFrame
    body: DataFrame
    vitals: DataFrame
    lab_items: DataFrame
    lab_events: DataFrame
    bedside_items: DataFrame
    bedside_events: DataFrame


def clinical_targets(
    src: Sources, cohort: str = COHORT, min_count: int = 1000, lab_items: Sequence[int] = LAB_ITEMS
) -> tuple[DataFrame, list[str]]:
    """Rows of the cohort with ``label_all`` and the label names in array order.

    The array holds diagnosis classes, deterioration flags, sex and the scaled
    numeric targets; missing entries are null.
    """
    records = src.records
    subjects = records.select("subject_id").distinct()
    chosen, vocab = cohort_labels(records, CohortSpec.parse(cohort))
    # The vocabulary holds frequent codes only: its names form the array layout.
    codes = [r["label"] for r in vocab.orderBy("idx").collect()]
    flags = [c for c in src.deterioration.columns if "deterioration" in c]
    cells = F.array(*[clean.number_or_null(c) for c in flags])
    flagged = src.deterioration.select(F.col("general_data").alias("data"), cells.alias("label_deterioration"))

    # Three tables draw on the filtered bedside rows: filter the big scan once.
    bedside = cut(bedside_rows(src.bedside_items, src.bedside_events, subjects, min_count))
    base = records.join(chosen.select("study_id", F.col("label_idx").alias("_codes")), "study_id")
    base = flag_lookup(base, flagged, ["data"], "is_deterioration", "label_deterioration")
    base = base.join(waveform_features(src.marks), "data", "left")
    wide = attach_nearest(
        base,
        body_measures(src.body, bedside),
        vital_signs(src.vitals, bedside),
        lab_values(lab_rows(src.lab_items, src.lab_events, subjects, lab_items), bedside),
    )
    # The joined table feeds both the fit and the scaling: freeze it once.
    wide = cut(wide)
    scaled = fit_apply_scaler(wide, TARGET_NAMES, F.col("strat_fold").between(0, TRAIN_FOLDS - 1))
    scaled = scaled.where((F.col("strat_fold") >= 0) & (F.col("strat_fold") <= TEST_FOLD))

    sex = F.when(F.col("gender") == "F", 0.0).when(F.col("gender") == "M", 1.0)
    hot = multi_hot(F.col("_codes"), len(codes)).cast("array<double>") if codes else F.array().cast("array<double>")
    blocks = [
        (hot, len(codes)),
        (F.col("label_deterioration"), len(flags)),
        (F.array(sex), 1),
        (F.array(*[F.col(f"`{c}`").cast("double") for c in TARGET_NAMES]), len(TARGET_NAMES)),
    ]
    out = scaled.withColumn("label_all", concat_blocks(blocks)).drop("_codes")
    return out, [*codes, *flags, "sex", *TARGET_NAMES]


def weak_targets(rows: DataFrame, names: Sequence[str], fold: str = "strat_fold") -> DataFrame:
    """Array positions with too few values in the validation or test fold."""
    held = rows.where(F.col(fold).isin(VALIDATION_FOLD, TEST_FOLD))
    numeric = len(TARGET_NAMES)
    split = len(names) - numeric
    classes = class_validity(held.withColumn("v", F.slice("label_all", 1, split)), fold, "v")
    numbers = class_validity(held.withColumn("v", F.slice("label_all", split + 1, numeric)), fold, "v", regression=True)
    return classes.unionByName(numbers.withColumn("place", F.col("place") + split))
