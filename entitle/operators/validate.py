"""Validation: every check yields an error struct, rows split into valid and rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitle import schema as D
from entitle.functions.strings import strip

NO_ERRORS = "array<struct<field:string,message:string,invalid_value:string,expected_type:string>>"


def _error(bad: Column, field: str, message: str, value: Column, expected: str) -> Column:
    """Error struct when ``bad`` holds; an unknown outcome (null input) counts as bad."""
    return F.when(F.coalesce(bad, F.lit(True)), F.struct(
        F.lit(field).alias("field"), F.lit(message).alias("message"),
        value.cast("string").alias("invalid_value"), F.lit(expected).alias("expected_type")))


def _with_errors(df: DataFrame, checks: list[Column]) -> DataFrame:
    errors = F.array_compact(F.array(*checks)).cast(NO_ERRORS)
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def _blank(text: Column) -> Column:
    return strip(text) == ""


def validate_profiles(profiles: DataFrame, categories: list[str] | None = None,
                      states: list[str] | None = None) -> DataFrame:
    """Profile checks; occupation trimmed and lower-cased, missing state set to the default."""
    state = F.coalesce(F.col("state"), F.lit(D.DEFAULT_STATE))
    age, income, occupation = F.col("age"), F.col("income"), F.col("occupation")
    checked = _with_errors(profiles.withColumn("state", state), [
        _error(~age.between(0, 120), "age", "must be between 0 and 120", age, "integer"),
        _error(~(income >= 0), "income", "must not be negative", income, "number"),
        _error(~F.col("category").isin(categories or D.SOCIAL_CATEGORIES), "category",
               "not a known social category", F.col("category"), "enum"),
        _error((F.length(occupation) > 100) | _blank(occupation), "occupation",
               "must have 1 to 100 characters and not be blank", occupation, "string"),
        _error(~F.col("state").isin(states or D.STATES), "state", "not a known state", F.col("state"), "enum"),
    ])
    return checked.withColumn("occupation", F.lower(strip(occupation)))


def validate_criteria(rules: DataFrame) -> DataFrame:
    """The four criteria texts must not be blank; they come back trimmed."""
    checked = _with_errors(rules, [
        _error(_blank(F.col("eligibility")[name]), f"eligibility.{name}", "must not be blank",
               F.col("eligibility")[name], "string") for name in D.CRITERIA])
    trimmed = F.struct(*[strip(F.col("eligibility")[name]).alias(name) for name in D.CRITERIA])
    return checked.withColumn("eligibility", trimmed)


def clean_documents(documents: Column) -> Column:
    """Trimmed, blanks and repeats dropped, order kept."""
    return F.array_distinct(F.filter(F.transform(documents, strip), lambda d: d != ""))


def validate_catalogue(catalogue: DataFrame, states: list[str] | None = None,
                       categories: list[str] | None = None, dim: int = D.EMBEDDING_DIM) -> DataFrame:
    """Catalogue row checks; the document list comes back cleaned."""
    cleaned = clean_documents(F.col("documents"))
    size = F.size("embedding")
    checks = [
        _error(F.length("id") < 1, "id", "must not be empty", F.col("id"), "string"),
        _error(~F.length("name").between(1, 200), "name", "must have 1 to 200 characters", F.col("name"), "string"),
        _error(F.length("description") < 1, "description", "must not be empty", F.col("description"), "string"),
        *[_error(_blank(F.col("eligibility")[name]), f"eligibility.{name}", "must not be blank",
                 F.col("eligibility")[name], "string") for name in D.CRITERIA],
        _error(F.size(cleaned) < 1, "documents", "needs at least one document",
               F.array_join("documents", ","), "list"),
        _error(~F.col("state").isin(states or D.STATES), "state", "not a known state", F.col("state"), "enum"),
        _error(~F.col("category").isin(categories or D.SCHEME_CATEGORIES), "category",
               "not a known programme category", F.col("category"), "enum"),
        _error(F.col("keywords").isNull(), "keywords", "is required", F.col("keywords"), "string"),
        _error(F.col("embedding").isNotNull() & ((size != dim) | F.exists("embedding", lambda x: x.isNull())),
               "embedding", f"must have {dim} numbers", size, "vector"),
    ]
    return _with_errors(catalogue, checks).withColumn("documents", cleaned)


def validate_searches(requests: DataFrame) -> DataFrame:
    """Search requests: query 1..500 characters, top_k 1..20 (default 5), language in the enum."""
    requests = (requests.withColumn("top_k", F.coalesce("top_k", F.lit(5)))
                .withColumn("language", F.coalesce("language", F.lit("english"))))
    query = F.col("query")
    return _with_errors(requests, [
        _error((F.length(query) > 500) | _blank(query), "query",
               "must have 1 to 500 characters and not be blank", F.length(query), "string"),
        _error(~F.col("top_k").between(1, 20), "top_k", "must be between 1 and 20", F.col("top_k"), "integer"),
        _error(~F.col("language").isin(D.LANGUAGES), "language", "not a supported language",
               F.col("language"), "enum"),
    ]).withColumn("query", strip(query))


def validate_format_requests(requests: DataFrame) -> DataFrame:
    """Format requests need at least one item and a supported language."""
    requests = requests.withColumn("language", F.coalesce("language", F.lit("english")))
    return _with_errors(requests, [
        _error(F.size("items") < 1, "items", "needs at least one item", F.size("items"), "list"),
        _error(~F.col("language").isin(D.LANGUAGES), "language", "not a supported language",
               F.col("language"), "enum"),
    ])


def validate_browse_requests(requests: DataFrame, categories: list[str] | None = None,
                             states: list[str] | None = None) -> DataFrame:
    """Browse requests: limit 1..50 (default 10), offset >= 0 (default 0), optional enum filters."""
    requests = (requests.withColumn("limit", F.coalesce("limit", F.lit(10)))
                .withColumn("offset", F.coalesce("offset", F.lit(0))))
    category, state = F.col("category"), F.col("state")
    return _with_errors(requests, [
        _error(~F.col("limit").between(1, 50), "limit", "must be between 1 and 50", F.col("limit"), "integer"),
        _error(~(F.col("offset") >= 0), "offset", "must not be negative", F.col("offset"), "integer"),
        _error(category.isNotNull() & ~category.isin(categories or D.SCHEME_CATEGORIES), "category",
               "not a known programme category", category, "enum"),
        _error(state.isNotNull() & ~state.isin(states or D.STATES), "state", "not a known state", state, "enum"),
    ])


def missing_keys(profile_map: Column, required: list[str] | None = None) -> Column:
    """Required keys a profile map lacks, in the required order."""
    return F.array_except(F.array(*map(F.lit, required or D.PROFILE_KEYS)), F.map_keys(profile_map))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the check columns, rejected rows with their errors)."""
    return (checked.where("valid").drop("errors", "valid"), checked.where(~F.col("valid")).drop("valid"))


def violations(checked: DataFrame, *ids: str) -> DataFrame:
    """One row per violation."""
    return checked.select(*ids, F.explode("errors").alias("e")).select(*ids, "e.*")


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows lacking each required field, one row per field, from one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("total"),
                    *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr("total", f"stack({len(columns)}, {pairs}) AS (field, missing)").select(
        "field", "missing", "total", (F.col("missing") == 0).alias("compliant"))


def count_matches(items: str, stated: str) -> Column:
    """Does the stated count equal the list length?"""
    return F.size(items) == F.col(stated)
