"""Column-level cleaning rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
MISSING_NUMBER = -999.0
MISSING_TEXT = ("n/a", "-", "Null", "nan")
TRUE_TEXT = ("true", "1", "yes", "y", "positive", "pos")
FALSE_TEXT = ("false", "0", "no", "n", "negative", "neg")
KG_TO_LBS = 2.20462
CM_TO_INCH = 0.393701
AXIS_RANGE = (-360.0, 360.0)
INTERVAL_RANGE = (0.0, 5000.0)
AXIS_COLUMNS = ("p_axis", "qrs_axis", "t_axis")
INTERVAL_COLUMNS = ("rr_interval", "p_onset", "p_end", "qrs_onset", "qrs_end", "t_end")
AGE_DECADES = (30, 40, 50, 60, 70, 80)
AGE_TWENTIES = (20, 40, 60, 80)
AGE_ADULT = (18, 30, 40, 50, 60, 70, 80, 90)
AGE_CHILD_DAYS = (365, 365 * 5, 365 * 12, 365 * 18)
AGE_ADULT_NAMES = (
    "age_18", "age_30", "age_40", "age_50", "age_60", "age_70", "age_80", "age_90", "age_100",
)
AGE_TWENTY_NAMES = ("<20", "20-40", "40-60", "60-80", ">=80")
# -----------------------------------------------------------------------------


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def range_to_null(c: str | Column, low: float, high: float) -> Column:
    """Values outside ``[low, high]`` become null."""
    c = _col(c)
    return F.when(c.between(low, high), c)


def number_or_null(c: str | Column, missing: float = MISSING_NUMBER) -> Column:
    """Sentinel numbers and NaN become null."""
    c = _col(c).cast("double")
    return F.when((c != missing) & ~F.isnan(c), c)


def text_or_null(c: str | Column, missing: Sequence[str] = MISSING_TEXT) -> Column:
    """Sentinel words become null; other text is trimmed."""
    c = F.trim(_col(c))
    return F.when(~c.isin(*missing), c)


def clean_waveform_marks(df: DataFrame) -> DataFrame:
    """P1 over the machine measurement columns that are present."""
    rules = {c: AXIS_RANGE for c in AXIS_COLUMNS} | {c: INTERVAL_RANGE for c in INTERVAL_COLUMNS}
    return df.withColumns({c: range_to_null(c, *r) for c, r in rules.items() if c in df.columns})


def derived_intervals() -> dict[str, Column]:
    """PR, QRS, QT and rate-corrected QT from waveform marks."""
    qt = F.col("t_end") - F.col("qrs_onset")
    rr = F.col("rr_interval")
    return {
        "PR": F.col("qrs_onset") - F.col("p_onset"),
        "QRS": F.col("qrs_end") - F.col("qrs_onset"),
        "QT": qt,
        "QTc": F.when(rr != 0, qt / F.sqrt(rr / 1000)),
    }


@dataclass(frozen=True)
class UnitRule:
    """Value -> value * factor + offset, with a new label and unit."""

    label: str
    new_label: str
    new_unit: str
    factor: float = 1.0
    offset: float = 0.0


# --- fixed values -----------------------------------------------------------
BODY_UNIT_RULES = (
    UnitRule("Admission Weight (Kg)", "Weight (lbs)", "lbs", KG_TO_LBS),
    UnitRule("Height (cm)", "Height (Inches)", "Inch", CM_TO_INCH),
    UnitRule("Daily Weight", "Weight (lbs)", "lbs", KG_TO_LBS),
    UnitRule("Temperature Celsius", "temperature", "°F", 9 / 5, 32.0),
)
DROPPED_BEDSIDE = ("PAR-Oxygen saturation", "Admission Weight (lbs.)")
UNIT_REQUIRED = (
    "Albumin", "Total Bilirubin", "Hematocrit (serum)", "Creatinine (serum)", "Weight (lbs)",
)
# -----------------------------------------------------------------------------


def harmonise_units(
    df: DataFrame,
    rules: Sequence[UnitRule] = BODY_UNIT_RULES,
    drop: Sequence[str] = DROPPED_BEDSIDE,
    unit_required: Sequence[str] = UNIT_REQUIRED,
    label: str = "label",
    value: str = "value",
    unit: str = "unit",
) -> DataFrame:
    """Convert, relabel, then drop unwanted labels and unit-less rows."""
    new_value, new_label, new_unit = F.col(value), F.col(label), F.col(unit)
    for rule in rules:
        hit = F.col(label) == rule.label
        new_value = F.when(hit, F.col(value) * rule.factor + rule.offset).otherwise(new_value)
        new_label = F.when(hit, F.lit(rule.new_label)).otherwise(new_label)
        new_unit = F.when(hit, F.lit(rule.new_unit)).otherwise(new_unit)
    out = df.withColumns({value: new_value, label: new_label, unit: new_unit})
    unwanted = F.col(label).isin(*drop) if drop else F.lit(False)
    unitless = (F.col(label).isin(*unit_required) & F.col(unit).isNull()) if unit_required else F.lit(False)
    return out.where(~(unwanted | unitless))


def rename_chain(c: str | Column, *steps: Mapping[str, str]) -> Column:
    """P5: apply whole-value renames one map after the other."""
    out = _col(c)
    for step in steps:
        if step:
            pairs = [F.lit(x) for kv in step.items() for x in kv]
            out = F.coalesce(F.create_map(*pairs)[out], out)
    return out


def parse_binary(c: str | Column) -> Column:
    """yes/no words to 1/0; anything else fails the job."""
    word = F.lower(F.trim(_col(c).cast("string")))
    bad = F.raise_error(F.concat(F.lit("not a binary value: "), F.coalesce(word, F.lit("null"))))
    return F.when(word.isin(*TRUE_TEXT), 1).when(word.isin(*FALSE_TEXT), 0).otherwise(bad.cast("int"))


def to_number(c: str | Column) -> Column:
    """Numeric parse, null when the text is not a number."""
    parsed = _col(c).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def parse_date(c: str | Column, fmt: str) -> Column:
    """Date by format; a two-digit year above 68 is in the 1900s."""
    parsed = F.to_date(F.try_to_timestamp(text_or_null(c), F.lit(fmt)))
    if "yy" in fmt and "yyyy" not in fmt:
        return F.when(F.year(parsed) > 2068, F.add_months(parsed, -1200)).otherwise(parsed)
    return parsed


# --- fixed values -----------------------------------------------------------
DATE_FULL_YEAR = "dd/MM/yyyy"
DATE_SHORT_MONTH = "dd-MMM-yy"
# -----------------------------------------------------------------------------


def acute_event(days_since_event: Column) -> Column:
    """Within three days after the event; unknown is false."""
    return F.coalesce(days_since_event.between(0, 3), F.lit(False))


def treated_after_event(days_since_event: Column, days_since_treatment: Column) -> Column:
    """Event in the past and treatment no earlier than the event."""
    return F.coalesce((days_since_event >= 0) & (days_since_treatment <= days_since_event), F.lit(False))


def event_status(present: Column, acute: Column, treated: Column) -> Column:
    """Text suffix for the event label."""
    return (
        F.when(~present, "")
        .when(~acute, " old")
        .when(treated, " acute catheterized")
        .otherwise(" acute")
    )


def bucket(
    c: str | Column, bounds: Sequence[float], names: Sequence, unknown, negative_unknown: bool = False
) -> Column:
    """P10: first bucket whose upper bound exceeds the value."""
    c = _col(c).cast("double")
    missing = c.isNull() | F.isnan(c)
    if negative_unknown:
        missing = missing | (c < 0)
    out = F.when(missing, F.lit(unknown))
    for bound, name in zip(bounds, names):
        out = out.when(c < bound, F.lit(name))
    return out.otherwise(F.lit(names[len(bounds)]))


def age_decade(c: str | Column) -> Column:
    """0..6 by decade from 30, -1 for unknown."""
    return bucket(c, AGE_DECADES, range(7), -1)


def age_twenty(c: str | Column, base: int = 0) -> Column:
    """Five codes by steps of twenty years; unknown falls in the last."""
    return bucket(c, AGE_TWENTIES, range(base, base + 5), base + 4)


def age_adult(c: str | Column) -> Column:
    """Named adult buckets; unknown or negative is its own name."""
    return bucket(c, AGE_ADULT, AGE_ADULT_NAMES, "age_unknown", negative_unknown=True)


def age_child_days(c: str | Column, base: int = 0) -> Column:
    """P10d: age in days, cut at 1, 5, 12 and 18 years."""
    return bucket(c, AGE_CHILD_DAYS, range(base, base + 5), base + 4)


def age_twenty_name(c: str | Column) -> Column:
    """P10e: text names by steps of twenty years."""
    return bucket(c, AGE_TWENTIES, AGE_TWENTY_NAMES, None)


def sex_name(c: str | Column, unknown: str = "unknown") -> Column:
    """m/f/male/female in any case, quotes removed; other text is unknown."""
    word = F.lower(F.trim(F.regexp_replace(_col(c).cast("string"), "'", "")))
    return (
        F.when(word.isin("m", "male"), "male")
        .when(word.isin("f", "female"), "female")
        .otherwise(F.lit(unknown))
    )


def sex_code(c: str | Column, male: int = 0, female: int = 1, unknown: int = -1) -> Column:
    """Numeric code of a normalised name."""
    name = sex_name(c)
    return F.when(name == "male", male).when(name == "female", female).otherwise(unknown)


def in_cohort(
    split: str | None = None,
    splits: Sequence[str] = (),
    fold: str | None = None,
    length: str | None = None,
    min_length: int = 0,
) -> Column:
    """Split membership, non-negative fold and minimum length."""
    keep = F.lit(True)
    if split is not None:
        keep = keep & F.col(split).isin(*splits)
    if fold is not None:
        keep = keep & (F.col(fold) >= 0)
    if length is not None:
        keep = keep & (F.col(length) >= min_length)
    return keep


def select_folds(df: DataFrame, fold: str, wanted: Sequence[str]) -> DataFrame:
    """Fold ids ``k``, ``-k`` from the end, ``xk`` excluded, or ``all``.

    Fold ``0`` means fold 0; including and excluding cannot be mixed.
    """
    if list(wanted) == ["all"]:
        return df
    out = [int(w[1:]) for w in wanted if w.startswith("x")]
    keep = [int(w) for w in wanted if not w.startswith("x")]
    if out and keep:
        raise ValueError("fold ids are either all kept or all excluded")
    top = df.agg(F.max(fold)).scalar()

    def hit(ids):
        cond = F.lit(False)
        for k in ids:
            cond = cond | (F.col(fold) == (F.lit(k) if k >= 0 else top + 1 + k))
        return cond

    return df.where(~hit(out) if out else hit(keep))


def clean_label(c: str | Column, brackets_to: str = "") -> Column:
    """Blanks and bars become ``_``; brackets are removed or replaced."""
    c = F.regexp_replace(_col(c), "[ |]", "_")
    return F.regexp_replace(c, "[()]", brackets_to)


def to_micros(c: str | Column) -> Column:
    """exact microseconds of a date or (zone-less) timestamp."""
    return F.unix_micros(_col(c).cast("timestamp"))


def samples_from_seconds(seconds: str | Column, rate: float, mode: str = "ceil") -> Column:
    """sample count by ``ceil``, half-even ``round`` or truncating ``int``."""
    x = _col(seconds).cast("double") * F.lit(float(rate))
    if mode == "ceil":
        return F.ceil(x).cast("long")
    if mode == "round":
        return F.bround(x).cast("long")
    if mode == "int":
        return x.cast("long")
    raise ValueError(f"unknown mode {mode!r}")
