"""Declared schemas, enumerations and default constants."""

from __future__ import annotations

from pyspark.sql import types as T

# Domains and defaults that results depend on.
SOCIAL_CATEGORIES = ["General", "OBC", "SC", "ST", "Minority"]
STATES = [
    "Karnataka", "Central", "Andhra Pradesh", "Tamil Nadu", "Telangana", "Kerala",
    "Maharashtra", "Gujarat", "Rajasthan", "Uttar Pradesh", "West Bengal", "Bihar",
    "Odisha", "Madhya Pradesh", "Punjab", "Haryana", "Jharkhand", "Chhattisgarh",
    "Assam", "Himachal Pradesh", "Uttarakhand", "Goa", "Manipur", "Meghalaya",
    "Tripura", "Nagaland", "Mizoram", "Arunachal Pradesh", "Sikkim",
]
SCHEME_CATEGORIES = [
    "education", "health", "agriculture", "housing", "employment", "social_welfare",
    "women_empowerment", "skill_development", "financial_inclusion", "rural_development",
]
LANGUAGES = ["english", "hindi"]
DEFAULT_STATE = "Karnataka"
CRITERIA = ["age", "income", "category", "occupation"]
PROFILE_KEYS = ["age", "income", "category", "occupation", "state"]
EMBEDDING_DIM = 384
ELIGIBLE_SCORE = 75.0
RECOMMEND_SCORE = 25.0
OPEN_INCOME_CAP = 999999999
OPEN_MAX_AGE = 150

CRITERIA_TYPE = T.StructType([T.StructField(c, T.StringType()) for c in CRITERIA])

CATALOGUE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("eligibility", CRITERIA_TYPE),
    T.StructField("documents", T.ArrayType(T.StringType())),
    T.StructField("state", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("keywords", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

PROFILE = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("income", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("occupation", T.StringType()),
    T.StructField("state", T.StringType()),
])

ERROR_TYPE = T.StructType([
    T.StructField("field", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("invalid_value", T.StringType()),
    T.StructField("expected_type", T.StringType()),
])
