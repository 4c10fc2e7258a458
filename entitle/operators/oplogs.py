"""Operation logs: duration classes, service summaries, structured rows, windowed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitle.functions.privacy import redact_text

# Duration limits in milliseconds and the request limit per window.
SLOW_MS, MODERATE_MS = 1000, 500
REQUEST_LIMIT, REQUEST_WINDOW = 100, "1 minute"


def duration_class(ms: Column) -> Column:
    return F.when(ms > SLOW_MS, "slow").when(ms > MODERATE_MS, "moderate").otherwise("normal")


def duration_classes(log: DataFrame) -> DataFrame:
    return (log.groupBy("operation", duration_class(F.col("duration_ms")).alias("class"))
            .agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg("duration_ms"), 2).alias("avg_ms")))


def service_summary(log: DataFrame, service: str = "operation", percentile: float | None = None) -> DataFrame:
    """Calls, failures and durations per service; a percentile is approximate (mergeable sketch)."""
    extra = [] if percentile is None else [F.percentile_approx("duration_ms", percentile).alias("percentile_ms")]
    return log.groupBy(F.col(service).alias("service")).agg(
        F.count(F.lit(1)).alias("calls"), F.count(F.when(~F.col("success"), 1)).alias("failures"),
        F.round(F.avg("duration_ms"), 2).alias("avg_ms"), F.max("duration_ms").alias("max_ms"), *extra)


def structured_rows(log: DataFrame, keep: list[str], fields: dict[str, Column]) -> DataFrame:
    """Each log row as JSON with its message redacted; absent fields are left out."""
    columns = [(redact_text(value) if name == "message" else value).alias(name) for name, value in fields.items()]
    return log.select(*keep, F.to_json(F.struct(*columns)).alias("json"))


def rate_violations(requests: DataFrame, limit: int = REQUEST_LIMIT, window: str = REQUEST_WINDOW,
                    user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Users with more than ``limit`` requests in a window; batch or stream."""
    counted = requests.groupBy(F.window(ts, window).alias("w"), user).agg(F.count(F.lit(1)).alias("requests"))
    return (counted.where(F.col("requests") > limit)
            .select(user, F.col("w.start").alias("window_start"), "requests"))


def slow_per_window(log: DataFrame, window: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Calls and slow calls per operation and window; batch or stream."""
    return (
        log.groupBy(F.window(ts, window).alias("w"), "operation")
        .agg(F.count(F.lit(1)).alias("calls"), F.count(F.when(F.col("duration_ms") > SLOW_MS, 1)).alias("slow"))
        .select(F.col("w.start").alias("window_start"), "operation", "calls", "slow")
    )
