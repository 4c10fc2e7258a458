"""Structured Streaming forms of the batch jobs. Each takes and returns a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from entitle.functions import scoring as S
from entitle.functions.privacy import redact_text
from entitle.operators import eligibility as E
from entitle.operators.oplogs import rate_violations, slow_per_window
from entitle.operators.suppress import suppressed_stream
from entitle.session import truncate_lineage


def eligibility_batches(profiles: DataFrame, rules: DataFrame,
                        sink: Callable[[DataFrame, int], None], max_results: int = 10) -> DataStreamWriter:
    """Ranked eligible and recommended programmes for each micro-batch of profiles."""

    # the static rules are put together once, not in every batch
    shaped = tuple(truncate_lineage(t) for t in E.rule_shapes(rules, max(max_results, 5, max_results // 2)))

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(E.eligible_and_recommended(batch, rules, max_results, shaped), batch_id)

    return profiles.writeStream.foreachBatch(run)


def requested_assessments(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Stream of requests (profile columns and scheme_id) scored against the static rules (append)."""
    keyed = S.with_user_keys(requests).withColumnRenamed("scheme_id", "r_id")
    return (keyed.join(E.prefixed(rules), "r_id")
            .select("user_id", F.col("r_id").alias("scheme_id"), S.strict_score().alias("match_score"),
                    S.strict_reason().alias("reason"))
            .withColumn("is_eligible", F.col("match_score") >= E.ELIGIBLE_SCORE))


def redacted(logs: DataFrame, text: str = "text") -> DataFrame:
    return logs.withColumn(text, redact_text(F.col(text)))


def rate_limit(requests: DataFrame, limit: int = 100, window: str = "1 minute",
               delay: str = "1 minute") -> DataFrame:
    return rate_violations(requests.withWatermark("ts", delay), limit, window)


def slow_operations(log: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return slow_per_window(log.withWatermark("ts", delay), window)


def suppress_repeats(results: DataFrame, keys: list[str], ttl: str = "1 hour") -> DataFrame:
    """One row per key within the watermark delay, and possibly longer; ``suppress_within`` keeps the time exactly."""
    return results.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def suppress_within(results: DataFrame, keys: list[str], ttl_seconds: float, delay: str = "1 minute") -> DataFrame:
    """One row per key and time to live: a repeat passes again once that has gone by since the last that passed."""
    return suppressed_stream(results, keys, ttl_seconds, delay)
