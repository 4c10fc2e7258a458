"""Rule grammar: free-text criteria to typed bounds, as column expressions.

Two dialects exist. ``lenient`` looks for substrings and numbers anywhere, ``strict`` looks for
anchored patterns in a fixed order. Both keep their documented quirks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from entitle.functions.strings import strip
from entitle.schema import OPEN_INCOME_CAP, OPEN_MAX_AGE

# Patterns, thresholds and word lists of the two dialects.
AGE_RANGE = r"(\d+)-(\d+)"
AGE_FROM = r"(\d+)\+"
AGE_BELOW = r"<\s*(\d+)"
AGE_EXACT = r"^(\d+)$"
INCOME_BPL = r"(?i)bpl|below\s+poverty\s+line"
INCOME_APL = r"(?i)apl|above\s+poverty\s+line"
INCOME_LAKH = r"(?i)<\s*(\d+(?:\.\d+)?)\s*lakh"
INCOME_AMOUNT = r"<\s*₹?\s*(\d+(?:,\d+)*(?:\.\d+)?)"
ANY_NUMBER = r"(\d+)"
ANY_DECIMAL = r"(\d+\.?\d*)"
LAKH = 100000
CRORE = 10000000
STRICT_BPL_CAP = 150000.0
LENIENT_BPL_CAP = 200000
OPEN_BOUND_WORDS = ["all", "any", "no limit"]
OPEN_CATEGORY_WORDS = ["all", "any", "general"]
OPEN_OCCUPATION_WORDS = ["all", "any", "no restriction"]
OCCUPATION_SYNONYMS = {
    "student": ["student", "pupil", "learner"],
    "farmer": ["farmer", "agriculturist", "cultivator"],
    "unemployed": ["unemployed", "jobless", "seeking employment"],
    "self-employed": ["self-employed", "entrepreneur", "business owner"],
    "employed": ["employed", "working", "job holder"],
}


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _lenient_text(text: Column) -> Column:
    """Missing and empty criteria count as the open word."""
    return F.when(F.length(text) > 0, F.lower(text)).otherwise(F.lit("all"))


def age_bounds_strict(text: Column) -> Column:
    """Struct (min_age, max_age); null means no bound. ``< n`` excludes n itself."""
    t = strip(text)
    low, high = _int(F.regexp_extract(t, AGE_RANGE, 1)), _int(F.regexp_extract(t, AGE_RANGE, 2))
    start = _int(F.regexp_extract(t, AGE_FROM, 1))
    below = _int(F.regexp_extract(t, AGE_BELOW, 1)) - 1
    exact = _int(F.regexp_extract(t, AGE_EXACT, 1))
    none = F.lit(None).cast("int")

    def bounds(a: Column, b: Column) -> Column:
        return F.struct(a.alias("min_age"), b.alias("max_age"))

    return (
        F.when(F.lower(t).isin(OPEN_BOUND_WORDS), bounds(none, none))
        .when(t.rlike(AGE_RANGE), bounds(low, high))
        .when(t.rlike(AGE_FROM), bounds(start, none))
        .when(t.rlike(AGE_BELOW), bounds(none, below))
        .when(t.rlike(AGE_EXACT), bounds(exact, exact))
        .otherwise(bounds(none, none))
    )


def income_cap_strict(text: Column) -> Column:
    """Upper income bound in rupees, null when open."""
    t = strip(text)
    amount = F.regexp_replace(F.regexp_extract(t, INCOME_AMOUNT, 1), ",", "")
    return (
        F.when(F.lower(t).isin(OPEN_BOUND_WORDS), F.lit(None).cast("double"))
        .when(t.rlike(INCOME_BPL), F.lit(STRICT_BPL_CAP))
        .when(t.rlike(INCOME_APL), F.lit(None).cast("double"))
        .when(t.rlike(INCOME_LAKH), F.regexp_extract(t, INCOME_LAKH, 1).try_cast("double") * LAKH)
        .when(t.rlike(INCOME_AMOUNT), amount.try_cast("double"))
    )


def category_text(text: Column) -> Column:
    return F.lower(strip(text))


def category_tokens(text: Column) -> Column:
    """Listed categories; a slash separates like a comma."""
    parts = F.split(F.replace(category_text(text), F.lit("/"), F.lit(",")), ",")
    return F.transform(parts, strip)


def category_keys_strict(text: Column) -> Column:
    """Every category value that passes the criterion by equality (open criteria excluded)."""
    t = category_text(text)
    return F.array_distinct(F.concat(
        category_tokens(text),
        F.when(t.contains("sc/st"), F.array(F.lit("sc"), F.lit("st"))).otherwise(F.array().cast("array<string>")),
        F.when(t.contains("minority"), F.array(F.lit("minority"))).otherwise(F.array().cast("array<string>")),
    ))


def occupation_keys_strict(text: Column) -> Column:
    """Every occupation value that passes by equality or synonym (open criteria excluded).

    A synonym counts only when one of the two sides is the group's own name.
    """
    t = F.lower(strip(text))
    empty = F.array().cast("array<string>")
    arrays = [F.array(t)]
    for key, words in OCCUPATION_SYNONYMS.items():
        arrays.append(F.when(t == key, F.array(*map(F.lit, words))).otherwise(empty))
        arrays.append(F.when(t.isin(words), F.array(F.lit(key))).otherwise(empty))
    return F.array_distinct(F.concat(*arrays))


def age_bounds_lenient(text: Column) -> Column:
    t = _lenient_text(text)
    numbers = F.regexp_extract_all(t, F.lit(ANY_NUMBER), F.lit(1))
    first, second = _int(F.get(numbers, F.lit(0))), _int(F.get(numbers, F.lit(1)))
    zero, top = F.lit(0), F.lit(OPEN_MAX_AGE)

    def bounds(a: Column, b: Column) -> Column:
        return F.struct(a.alias("min_age"), b.alias("max_age"))

    return (
        F.when((t == "all") | (F.size(numbers) == 0), bounds(zero, top))
        .when(t.contains("+"), bounds(first, top))
        .when(F.size(numbers) >= 2, bounds(first, second))
        .otherwise(bounds(first, first))
    )


def income_cap_lenient(text: Column) -> Column:
    t = _lenient_text(text)
    value = F.regexp_extract(t, ANY_DECIMAL, 1).try_cast("double")
    factor = F.when(t.contains("lakh"), LAKH).when(t.contains("crore"), CRORE).otherwise(1)
    return (
        F.when(t == "all", F.lit(OPEN_INCOME_CAP).cast("bigint"))
        .when(t.contains("bpl") | t.contains("low income"), F.lit(LENIENT_BPL_CAP).cast("bigint"))
        .otherwise(F.coalesce((value * factor).cast("bigint"), F.lit(OPEN_INCOME_CAP).cast("bigint")))
    )


def is_open_lenient(text: Column) -> Column:
    return _lenient_text(text) == "all"
