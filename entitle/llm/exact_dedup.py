"""Exact dedup with a heavy-hitter split (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.llm.shared import NO_ID, keep, rows_of, table

#: Counters of a Misra-Gries summary: a digest of more than 1 / (COUNTERS + 1) of all rows is always found.
COUNTERS = 512
SPACES = " \t\n\x0b\x0c\r"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Misra-Gries over a partition: counts of a batch are added, then the count of rank COUNTERS + 1 is
    taken off all, which frees counters."""
    held: dict[str, int] = {}
    for batch in batches:
        for pair in pc.value_counts(batch.column(0)):
            digest = pair["values"].as_py()
            held[digest] = held.get(digest, 0) + pair["counts"].as_py()
        held = _trimmed(held)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                     ["text_sha256", "n"])


def _trimmed(held: dict[str, int]) -> dict[str, int]:
    if len(held) > COUNTERS:
        off = sorted(held.values(), reverse=True)[COUNTERS]
        held = {k: n - off for k, n in held.items() if n > off}
    return held


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of several partitions become one, of as many counters."""
    held: dict[str, int] = {}
    for batch in batches:
        for digest, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held[digest] = held.get(digest, 0) + n
        held = _trimmed(held)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                     ["text_sha256", "n"])


def frequent_digests(digests: DataFrame, rows: int) -> list[str]:
    """Candidates for heavy digests, COUNTERS of them at most. Summaries are merged by tasks, 64 to one,
    so that the driver receives 64 summaries at most, whatever the number of partitions."""
    parts = digests.select("text_sha256").mapInArrow(_summaries, "text_sha256 string, n long")
    parts = parts.coalesce(64).mapInArrow(_merged, "text_sha256 string, n long")
    held: dict[str, int] = {}
    for row in parts.collect():
        held[row.text_sha256] = held.get(row.text_sha256, 0) + row.n
    return list(_trimmed(held)) if rows > COUNTERS else []


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_key
    (the 64-bit hash of the original text).

    Texts are equal when identical without the characters ``[\\x20\\x09-\\x0D]``; a null text counts as
    empty, and all empty texts are one group. The row with the most code points in the original text stays, of
    equals the smallest doc_id (null ids last), of rows repeated with the same id any one. An empty table
    gives no rows. Only doc_id and text are read, so other columns may have any name.

    Misra-Gries summaries name the frequent digests. Their winners and sizes are computed exactly, with
    partial aggregation in each task, and broadcast (COUNTERS rows at most): rows of heavy digests meet
    their winner without a shuffle. No other digest has more than 1 / (COUNTERS + 1) of the rows, so the
    rest goes through an ordinary shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keep(docs.select(
        F.col("doc_id"), F.char_length(text).cast("long").alias("size"),
        F.sha2(F.translate(text, SPACES, ""), 256).alias("text_sha256"),
        F.xxhash64(text).alias("text_key"), F.monotonically_increasing_id().alias("row_id")))
    heavy = frequent_digests(rows, rows.count())
    best = F.min(F.struct((-F.col("size")).alias("minus_size"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("best")
    size = F.count(F.lit(1)).alias("group_size")
    if heavy:
        names = docs.sparkSession.createDataFrame([(x,) for x in heavy], "text_sha256 string")
        frequent = F.broadcast(names)
        winners = rows.join(frequent, "text_sha256").groupBy("text_sha256").agg(best, size)
        heavy_rows = rows.join(F.broadcast(winners), "text_sha256")
        rest = rows.join(frequent, "text_sha256", "left_anti")
    else:
        heavy_rows, rest = None, rows
    groups = rest.groupBy("text_sha256").agg(best, size)
    found = rest.join(groups, "text_sha256")
    found = found if heavy_rows is None else found.unionByName(heavy_rows)
    return found.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256", "text_key")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that do not stay; all columns in their order. Same cases as ``exact_groups``."""
    stays = exact_groups(docs).where("kept").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text_key")
    return rows_of(docs, stays, once=True)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("text_key")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size,
  sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256 FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
