"""Array, map and text functions for label lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
DIAGNOSIS_BLACKLIST = ("no", "n/a", "unknown", "M. Bechterew", "M. Basedow")
EMPTY_TOKEN = "NONE"
# -----------------------------------------------------------------------------


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_list(c: str | Column, sep: str, drop: Sequence[str] = ()) -> Column:
    """delimited text to trimmed, unquoted, non-empty tokens (null -> [])."""
    parts = F.split(_col(c), "\\Q" + sep + "\\E")
    parts = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, "['\"]", "")))
    parts = F.filter(parts, lambda x: (x != "") & ~x.isin(*drop) if drop else x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def leading_code(codes: Column, sep: str = "+") -> Column:
    """first part of every code that carries modifiers."""
    return F.transform(codes, lambda x: F.trim(F.substring_index(x, sep, 1)))


def comment_value(lines: Column, key: str) -> Column:
    """text after ``key:`` in the last line with that key."""
    hits = F.filter(lines, lambda x: F.trim(F.substring_index(x, ":", 1)) == key)
    last = F.try_element_at(hits, F.lit(-1))
    return F.trim(F.get(F.split(last, ":"), F.lit(1)))


def comment_age(lines: Column) -> Column:
    """integer age or null."""
    return comment_value(lines, "Age").try_cast("int")


def comment_sex(lines: Column) -> Column:
    """first word of the sex line, spelled out."""
    word = F.lower(F.substring_index(comment_value(lines, "Sex"), " ", 1))
    return F.when(word == "m", "male").when(word == "f", "female").otherwise(word)


def drop_blacklisted(labels: Column, blacklist: Sequence[str] = DIAGNOSIS_BLACKLIST) -> Column:
    """trim names and remove the listed ones."""
    return F.filter(F.transform(labels, lambda x: F.trim(x)), lambda x: ~x.isin(*blacklist))


def _nulls(text: Column) -> Column:
    """None and nan as null where they stand for a whole element, not inside a quoted word."""
    return F.regexp_replace(text, r"(?<=[\[,:{(])(\s*)(?:None|nan)(?=\s*[\],})])", "$1null")


def literal_list(c: str | Column, element: str = "string") -> Column:
    """a quoted list literal parsed as data, never evaluated."""
    return F.from_json(_nulls(_col(c)), f"array<{element}>")


def literal_map(c: str | Column, value: str = "double") -> Column:
    """a quoted dictionary literal parsed as data."""
    return F.from_json(_nulls(_col(c)), f"map<string,{value}>")


def truncate_codes(codes: Column, digits: int | None) -> Column:
    """trim, cut to ``digits``, strip trailing placeholder X, de-duplicate."""
    if digits is not None:
        codes = F.transform(codes, lambda x: F.substring(F.trim(x), 1, digits))
    return F.array_distinct(F.transform(codes, lambda x: F.regexp_replace(x, "X+$", "")))


def code_prefixes(codes: Column) -> Column:
    """every prefix of three or more characters; shorter codes vanish."""
    long_enough = F.filter(codes, lambda c: F.length(c) >= 3)
    nested = F.transform(
        long_enough,
        lambda c: F.transform(F.sequence(F.lit(3), F.length(c)), lambda n: c.substr(F.lit(1), n)),
    )
    return F.array_distinct(F.flatten(nested))


def pick_categories(codes: Column, category: str) -> Column:
    """``af`` keeps I48 codes, capitals keep codes by first letter."""
    if category == "":
        return codes
    if category == "af":
        return F.filter(codes, lambda c: c.startswith("I48"))
    letters = F.array(*[F.lit(x) for x in category])
    return F.filter(codes, lambda c: F.array_contains(letters, F.substring(c, 1, 1)))


def sigmoid(score: str | Column) -> Column:
    """logistic link."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(score)))


def softmax(scores: Column) -> Column:
    """softmax over a score array, shifted by its maximum."""
    exps = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda x: x / total)


def flags_to_indices(flags: Sequence[str | Column]) -> Column:
    """Positions of the flag columns equal to one."""
    cells = [F.when(_col(f).cast("double") == 1.0, F.lit(i)) for i, f in enumerate(flags)]
    return F.filter(F.array(*cells), lambda x: x.isNotNull())


def nulls_of_width(values: Column, width: int) -> Column:
    """A missing array becomes ``width`` nulls."""
    return F.coalesce(values, F.array_repeat(F.lit(None).cast("double"), width))


def concat_blocks(blocks: Sequence[tuple[Column, int]]) -> Column:
    """Join label blocks of known widths into one array."""
    return F.concat(*[nulls_of_width(values, width) for values, width in blocks])


def multi_hot(indices: Column, width: int) -> Column:
    """Index list to a 0/1 array; an index out of range fails the job."""
    bad = F.exists(indices, lambda i: (i < 0) | (i >= width))
    hot = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.array_contains(indices, i).cast("int"),
    )
    problem = F.raise_error(F.concat(F.lit(f"label index outside [0, {width}): "), indices.cast("string")))
    return F.when(bad, problem.cast("array<int>")).otherwise(hot)


def index_names(indices: Column, names: Sequence[str], sep: str = ";") -> Column:
    """Index list to joined names, in list order."""
    lookup = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(indices, lambda i: F.get(lookup, i.cast("int"))), sep)


def hot_names(hot: Column, names: Sequence[str], sep: str = ";") -> Column:
    """0/1 array to joined names."""
    lookup = F.array(*[F.lit(n) for n in names])
    picked = F.filter(
        F.transform(hot, lambda x, i: F.when(x == 1, F.get(lookup, i))), lambda x: x.isNotNull()
    )
    return F.array_join(picked, sep)


def reindex(indices: Column, kept: Mapping[int, int]) -> Column:
    """Keep chosen classes and give them their new index."""
    table = F.create_map(*[F.lit(x) for kv in kept.items() for x in kv])
    mapped = F.transform(indices, lambda i: table[i.cast("int")])
    return F.filter(mapped, lambda x: x.isNotNull())


def split_targets(values: Column, regression: int) -> tuple[Column, Column]:
    """Class targets and the last ``regression`` numeric targets."""
    n = F.size(values)
    return F.slice(values, F.lit(1), n - regression), F.slice(values, n - regression + 1, F.lit(regression))
