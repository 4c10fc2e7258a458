"""Repeated requests in a log: how often a key comes again within a time to live.

Time is cut in pieces of one time to live. The request before another lies in the same piece or, if it
is recent enough to matter, in the piece before; so a key of any size is split over its pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def repeats(requests: DataFrame, keys: list[str], ttl_seconds: int) -> DataFrame:
    """``requests`` (keys, ts) with ``repeated``: the key was requested less than ``ttl_seconds`` before."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = requests.withColumn("_t", micros).withColumn("_piece", F.floor(F.col("_t") / (ttl_seconds * 1_000_000)))
    last = timed.groupBy(*keys, "_piece").agg(F.max("_t").alias("_before")).withColumn("_piece", F.col("_piece") + 1)
    inside = F.lag("_t").over(W.partitionBy(*keys, "_piece").orderBy("_t"))
    both = timed.withColumn("_own", inside).join(last, [*keys, "_piece"], "left")
    gap = F.col("_t") - F.coalesce("_own", "_before")
    return both.withColumn("repeated", F.coalesce(gap < ttl_seconds * 1_000_000, F.lit(False))).drop("_t", "_piece", "_own", "_before")


def reuse_by_key(requests: DataFrame, keys: list[str], ttl_seconds: int) -> DataFrame:
    """Requests, repeats and their share for each key."""
    hit = F.col("repeated").cast("int")
    return (repeats(requests.select(*keys, "ts"), keys, ttl_seconds).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("requests"), F.sum(hit).alias("repeats"))
            .withColumn("repeat_share", F.round(F.col("repeats") / F.col("requests"), 4)))


def reuse_summary(by_key: DataFrame) -> DataFrame:
    """One row over all keys."""
    return by_key.agg(
        F.count(F.lit(1)).alias("keys"), F.sum("requests").alias("requests"), F.sum("repeats").alias("repeats"),
        F.round(F.sum("repeats") / F.sum("requests"), 4).alias("repeat_share"))
