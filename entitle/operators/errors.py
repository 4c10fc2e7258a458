"""Error classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Error code -> HTTP status, severity -> log level.
STATUS_BY_CODE = {
    400: ["INVALID_INPUT", "MISSING_REQUIRED_FIELD", "INVALID_FIELD_VALUE", "INVALID_AGE_RANGE",
          "INVALID_INCOME_VALUE", "INVALID_CATEGORY", "INVALID_STATE", "INVALID_QUERY_LENGTH",
          "INVALID_PAGINATION"],
    401: ["UNAUTHORIZED", "INVALID_API_KEY"],
    403: ["FORBIDDEN"],
    404: ["SCHEME_NOT_FOUND", "USER_PROFILE_NOT_FOUND", "ENDPOINT_NOT_FOUND"],
    408: ["REQUEST_TIMEOUT", "EXTERNAL_SERVICE_TIMEOUT"],
    429: ["RATE_LIMIT_EXCEEDED", "API_QUOTA_EXCEEDED"],
    500: ["INTERNAL_ERROR", "DATABASE_ERROR", "CONFIGURATION_ERROR", "PROCESSING_ERROR"],
    503: ["EXTERNAL_SERVICE_ERROR", "TRANSLATION_SERVICE_ERROR", "SARVAM_AI_ERROR",
          "EMBEDDING_SERVICE_ERROR"],
}
LEVEL_BY_SEVERITY = {"critical": "CRITICAL", "high": "ERROR", "medium": "WARNING", "low": "INFO"}


def status_table(spark: SparkSession) -> DataFrame:
    rows = [(code, status) for status, codes in STATUS_BY_CODE.items() for code in codes]
    return spark.createDataFrame(rows, "code string, status int")


def classify_errors(errors: DataFrame) -> DataFrame:
    """Adds status (500 when the code is unknown) and log level (ERROR when there is no severity)."""
    lookup = F.broadcast(status_table(errors.sparkSession))  # 27 rows, fixed
    level = F.lit("ERROR")
    for severity, name in LEVEL_BY_SEVERITY.items():
        level = F.when(F.col("severity") == severity, name).otherwise(level)
    return (errors.join(lookup, "code", "left")
            .withColumn("status", F.coalesce("status", F.lit(500)))
            .withColumn("level", level))
