"""compile_rules: catalogue in, one typed rule row per programme out, parsed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitle.functions import rules as R
from entitle.functions.strings import strip
from entitle.operators.joins import spread

KEEP = ["id", "pos", "name", "state"]


def compile_rules(catalogue: DataFrame, dialect: str = "strict") -> DataFrame:
    """Typed rules from ``catalogue(id, pos, name, state, eligibility struct | map)``, parsed by all cores."""
    catalogue = with_criteria(spread(catalogue, "id"))
    if dialect == "strict":
        return _strict(catalogue)
    if dialect == "lenient":
        return _lenient(catalogue)
    raise ValueError(f"unknown dialect {dialect!r}")


def with_criteria(catalogue: DataFrame) -> DataFrame:
    """Eligibility as four columns c_age … c_occupation; absent criteria are open."""
    source = catalogue.schema["eligibility"].dataType.typeName()
    eligibility = F.col("eligibility")
    for name in ("age", "income", "category", "occupation"):
        value = F.element_at(eligibility, name) if source == "map" else eligibility[name]
        catalogue = catalogue.withColumn(f"c_{name}", F.coalesce(value, F.lit("All")))
    return catalogue


def _strict(c: DataFrame) -> DataFrame:
    category, occupation = R.category_text(F.col("c_category")), F.lower(strip(F.col("c_occupation")))
    return (
        c.withColumn("age_bounds", R.age_bounds_strict(F.col("c_age")))
        .select(
            *KEEP,
            F.col("age_bounds.min_age").alias("min_age"),
            F.col("age_bounds.max_age").alias("max_age"),
            R.income_cap_strict(F.col("c_income")).alias("max_income"),
            category.alias("category_text"),
            category.isin(R.OPEN_CATEGORY_WORDS).alias("category_open"),
            R.category_tokens(F.col("c_category")).alias("category_tokens"),
            R.category_keys_strict(F.col("c_category")).alias("category_keys"),
            occupation.alias("occupation_text"),
            occupation.isin(R.OPEN_OCCUPATION_WORDS).alias("occupation_open"),
            R.occupation_keys_strict(F.col("c_occupation")).alias("occupation_keys"),
        )
    )


def _lenient(c: DataFrame) -> DataFrame:
    return (
        c.withColumn("age_bounds", R.age_bounds_lenient(F.col("c_age")))
        .select(
            *KEEP,
            F.col("age_bounds.min_age").alias("min_age"),
            F.col("age_bounds.max_age").alias("max_age"),
            R.is_open_lenient(F.col("c_age")).alias("age_open"),
            F.col("c_age").alias("age_text"),
            R.income_cap_lenient(F.col("c_income")).alias("max_income"),
            R.is_open_lenient(F.col("c_income")).alias("income_open"),
            F.col("c_income").alias("income_text"),
            F.lower("c_category").alias("category_text"),
            (F.lower("c_category") == "all").alias("category_open"),
            F.lower("c_category").contains("all").alias("category_has_all"),
            F.lower("c_occupation").alias("occupation_text"),
            (F.lower("c_occupation") == "all").alias("occupation_open"),
            F.col("c_occupation").alias("occupation_label"),
        )
    )
