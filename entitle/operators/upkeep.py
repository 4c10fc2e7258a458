"""A search index kept up as documents come and go.

An index is a row of steps. A step adds documents, with their (document, term) counts and what they add to the totals of each
term, or removes documents, with what that takes from the totals. Vocabulary and vectors follow from the totals and the
counts of the documents that are left, so they equal those of an index built anew; texts are read once, when they come.
Totals are sums and later steps decide about earlier ones, so steps merge in any grouping of neighbours.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.operators import tfidf
from entitle.operators.joins import BROADCAST_ROWS
from entitle.schema import EMBEDDING_DIM
from entitle.session import truncate_lineage

PARTS = ["counts", "terms", "docs"]
MANIFEST = "step long, folder string, retired boolean"


Keep = Callable[[Column], Column]
Only = Callable[[DataFrame], DataFrame]


class Step(NamedTuple):
    """``counts`` (doc_id, term, tf) of added documents; ``terms`` (term, tf, df), whose sums the step adds to the totals, negative
    where it removes (a stored step has a row per term); ``docs`` (doc_id, added), every document once."""

    counts: DataFrame
    terms: DataFrame
    docs: DataFrame

    def made(self, only: Only, keep: Keep | None) -> DataFrame:
        """The counts of the documents that ``only`` leaves and the terms that ``keep`` is true of."""
        return only(_kept(self.counts, keep))

    def totals(self, keep: Keep) -> DataFrame:
        """``terms`` likewise."""
        return _kept(self.terms, keep)

    def seen(self, only: Only) -> DataFrame:
        """(doc_id, term, tf) whose sums by term are those of the counts."""
        return only(self.counts)

    def occurrences(self) -> DataFrame:
        """(term, tf) whose sums by term are those of ``terms``."""
        return self.terms.select("term", "tf")


class Unstored(Step):
    """A step that knows how its tables come about, so that what is not wanted of them is never made."""

    def by(self, made: Callable, totals: Callable, seen: Callable, occurrences: Callable) -> Unstored:
        self.made, self.totals, self.seen, self.occurrences = made, totals, seen, occurrences
        return self


def _every(df: DataFrame) -> DataFrame:
    return df


def _totals(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select("term", (sign * F.col("tf")).alias("tf"), F.lit(sign).cast("long").alias("df"))


def _signed(seen: DataFrame, sign: int) -> DataFrame:
    return seen.select("term", (sign * F.col("tf")).alias("tf"))


def _summed(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where("tf <> 0 OR df <> 0")


def _kept(rows: DataFrame, keep: Keep | None) -> DataFrame:
    return rows if keep is None else rows.where(keep(F.col("term")))


def _small(ids: DataFrame) -> tuple[DataFrame, int]:
    """``ids``, to be sent to every task when a count finds BROADCAST_ROWS at most, and the count (cut there)."""
    n = ids.limit(BROADCAST_ROWS + 1).count()
    return (F.broadcast(ids) if n <= BROADCAST_ROWS else ids), n


def added(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Step:
    """The step that adds ``docs``, whose ids are new. Its counts are made from the texts where they are used, so that
    a step that is not stored writes nothing."""
    named = docs.withColumnRenamed(id_col, "doc_id")

    def made(only: Only, keep: Keep | None) -> DataFrame:
        return tfidf.term_counts(named, "doc_id", text, keep, only)

    def seen(only: Only) -> DataFrame:
        return tfidf.tokenised(named, "doc_id", text, only).select(
            "doc_id", F.explode(F.concat("tokens", "bigrams")).alias("term"), F.lit(1).cast("long").alias("tf"))

    counts = made(_every, None)
    return Unstored(counts, _totals(counts, 1), docs.select(F.col(id_col).alias("doc_id"), F.lit(True).alias("added"))).by(
        made, lambda keep: _totals(made(_every, keep), 1), seen, lambda: _signed(seen(_every), 1))


def _left(steps: list[Step]) -> list[Only]:
    """For each step what leaves those of its documents that no later step removes."""
    every = reduce(DataFrame.unionByName, [s.docs.withColumn("_step", F.lit(i)) for i, s in enumerate(steps)])
    gone, n = _small(every.where(~F.col("added")).groupBy("doc_id").agg(F.max("_step").alias("_gone")))

    def left(i: int) -> Only:
        return lambda df: df.join(gone.where(F.col("_gone") >= i).select("doc_id"), "doc_id", "left_anti")
    return [left(i) if n else _every for i in range(len(steps))]


def _alive(steps: list[Step]) -> Callable[..., DataFrame]:
    """Gives rows of ``part`` of all steps without documents that a later step removes, those that ``also`` leaves. The steps
    are those of now, whatever becomes of the list."""
    each = list(zip(steps, _left(steps)))

    def alive(part: Callable[[Step, Only], DataFrame], also: Only = _every) -> DataFrame:
        return reduce(DataFrame.unionByName, [part(step, lambda df, left=left: also(left(df))) for step, left in each])
    return alive


def _ids(step: Step, only: Only) -> DataFrame:
    return only(step.docs.where("added").select("doc_id"))


def removed(ids: DataFrame, steps: list[Step]) -> Step:
    """The step that removes the documents ``ids`` (doc_id) from what ``steps`` hold; unknown ids are passed over."""
    alive = _alive(steps)
    known = truncate_lineage(alive(_ids).join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))
    few = _small(known)[0]

    def those(df: DataFrame) -> DataFrame:
        return df.join(few, "doc_id", "left_semi")

    def totals(keep: Keep | None) -> DataFrame:
        return _totals(alive(lambda step, only: step.made(only, keep), those), -1)

    none = alive(lambda step, only: step.made(only, None), those).limit(0)
    return Unstored(none, totals(None), known.withColumn("added", F.lit(False))).by(
        lambda only, keep: none, totals, lambda only: none, lambda: _signed(alive(lambda step, only: step.seen(only), those), -1))


def merged(steps: list[Step]) -> Step:
    """One step in place of ``steps``, which are the first of an index: the documents alive, and the totals."""
    steps, alive = list(steps), _alive(steps)
    union = lambda parts: reduce(DataFrame.unionByName, parts)

    def made(only: Only, keep: Keep | None) -> DataFrame:
        return alive(lambda step, left: step.made(left, keep), only)

    return Unstored(made(_every, None), union([s.terms for s in steps]), alive(_ids).withColumn("added", F.lit(True))).by(
        made, lambda keep: union([s.totals(keep) for s in steps]), lambda only: alive(lambda step, left: step.seen(left), only),
        lambda: union([s.occurrences() for s in steps]))


def index_of(steps: list[Step], dim: int = EMBEDDING_DIM, max_df: float = tfidf.MAX_DF) -> tfidf.Index:
    """Vocabulary and postings (doc_id, term, weight) of the documents alive.

    Of steps that are not stored, terms are counted within the row only where they may be of the vocabulary, and texts of
    documents that are gone are not cut into terms for the postings."""
    whole = merged(steps)
    vocabulary = tfidf.frequent_terms(whole.occurrences(), whole.totals, whole.docs.count(), dim, max_df)
    return tfidf.Index(vocabulary, tfidf.unit_weights(whole.made(_every, tfidf.known_terms(vocabulary)), vocabulary, "doc_id"))


# --- stored steps ---------------------------------------------------------------------------

def _listed(spark: SparkSession, path: str) -> list:
    """Rows of the manifest in order, without retired steps. It has a row per step since the last compaction, and
    those that this retired."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    except Exception as error:  # an index without steps has no manifest
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []
    retired = {r.folder for r in rows if r.retired}
    return sorted((r for r in rows if r.folder not in retired), key=lambda r: r.step)


def read_steps(spark: SparkSession, path: str) -> list[Step]:
    return [Step(*[spark.read.parquet(f"{path}/{r.folder}/{p}") for p in PARTS]) for r in _listed(spark, path)]


def _append(spark: SparkSession, path: str, step: Step, number: int, retired: list = ()) -> None:
    """The step's tables, then its row of the manifest: a step that fails half way is never read."""
    folder = f"steps/{uuid.uuid4().hex}"
    for name, df in zip(PARTS, step._replace(terms=_summed(step.terms))):
        df.write.parquet(f"{path}/{folder}/{name}")
    rows = [(number, folder, False), *((r.step, r.folder, True) for r in retired)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def add_documents(spark: SparkSession, path: str, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> None:
    """Adds ``docs`` to the index at ``path``; documents that it holds under the same ids are replaced. Reads the texts of
    ``docs`` alone, and of the index the ids, and the counts of replaced documents."""
    listed, steps = _listed(spark, path), read_steps(spark, path)
    number = listed[-1].step + 1 if listed else 0
    if steps:
        old = removed(docs.select(F.col(id_col).alias("doc_id")), steps)
        if not old.docs.isEmpty():
            _append(spark, path, old, number)
            number += 1
    _append(spark, path, added(docs, id_col, text), number)


def remove_documents(spark: SparkSession, path: str, ids: DataFrame) -> None:
    listed = _listed(spark, path)
    if listed:
        _append(spark, path, removed(ids, read_steps(spark, path)), listed[-1].step + 1)


def compact(spark: SparkSession, path: str) -> None:
    """One step in place of all; the folders of the old ones may be deleted once nobody reads them."""
    listed = _listed(spark, path)
    if len(listed) > 1:
        _append(spark, path, merged(read_steps(spark, path)), listed[-1].step + 1, listed)
