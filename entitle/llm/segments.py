"""Seeds shared by documents: winnowed anchors, joined by hash and extended by their surroundings.

A document is cut into segments, runs of windows with one anchor (``kernels.winnowed``). Equal windows
have equal anchors at equal places, so they lie in segments of one anchor. Segments of an anchor that
agree in all they cover are one class; its first document answers for all. Only where an anchor has
several classes do their windows have to be compared one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitle.llm.kernels import BASES, BYTE, Rolling, Words, covered, signed, text_slices, winnowed, words
from entitle.llm.shared import keep, split_join

SEGMENT = "id long, text_key long, anchor long, body long, place long"
#: ``place`` holds first and, in so many bits, last - first.
BITS = 12
#: Kinds of a marked segment: all windows found earlier; to be compared; to be compared, of a hot anchor.
EARLIER, EDGE, HOT = 0, 1, 2


def units_of(data: np.ndarray, offsets: np.ndarray, by_word: bool) -> tuple[np.ndarray, np.ndarray, Words | None]:
    """64-bit values of the units (words or bytes), where rows begin in them, the words."""
    if by_word:
        w = words(data, offsets)
        return w.hashes(data), w.first, w
    return BYTE[data], offsets, None


def _cut(by_word: bool, length: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in text_slices(batch.column(2)):
                units, bounds, _w = units_of(data, offsets, by_word)
                s = winnowed(units, bounds, length, seed)
                row, base = pa.array(s.row + i), bounds[s.row]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(row), batch.column(1).take(row), signed(s.anchor), signed(s.body),
                    pa.array((s.first - base) << BITS | (s.last - s.first))],
                    ["id", "text_key", "anchor", "body", "place"])
    return run


def marked(docs: DataFrame, by_word: bool, length: int, seed: int, later: Callable[[Column], Column],
           hot_classes: int) -> DataFrame:
    """One row per document (id, text_key) that shares anchors: ``marks``, its segments with their kind.

    ``later`` says if a segment's row comes after the first of its class (a struct of id, text_key, first).
    Anchors found once are dropped after a count with partial sums; hot anchors are split by the skew join.
    A document's list is as long as the document, never as long as a group.
    """
    if length >= 1 << BITS:
        raise ValueError(f"windows have fewer than {1 << BITS} units")
    segments = docs.select("id", "text_key", "text").mapInArrow(_cut(by_word, length, seed), SEGMENT)
    again = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    shared = keep(split_join(segments, again, ["anchor"], "left_semi"))
    first = F.shiftright("place", BITS)
    shared = shared.select("id", "text_key", "anchor", "body", first.cast("int").alias("first"),
                           (first + F.col("place").bitwiseAND(F.lit((1 << BITS) - 1))).cast("int").alias("last"))
    classes = shared.groupBy("anchor", "body").agg(F.min(F.struct("id", "text_key", "first")).alias("least"))
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    rows = (split_join(split_join(shared, classes, ["anchor", "body"]), several, ["anchor"], "left")
            .withColumn("kind", F.when(later(F.col("least")), EARLIER).when(F.col("classes") > hot_classes, HOT)
                        .when(F.col("classes") > 1, EDGE)).where("kind IS NOT NULL"))
    return rows.groupBy("id", "text_key").agg(
        F.collect_list(F.struct("first", "last", "anchor", "kind")).alias("marks"))


def listed(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, pa.Array]:
    """(row counted from i, values) of the lists in rows i to j."""
    part = column.slice(i, j - i)
    counts = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(j - i), counts), part.flatten()


def field(values: pa.Array, name: str) -> np.ndarray:
    return values.field(name).to_numpy(zero_copy_only=False)


def removed(marks: pa.Array, found: pa.Array, i: int, j: int, bounds: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which units of a slice are covered by a window found earlier: those of marked segments of kind
    EARLIER, and those that begin from ``first`` to ``last`` of an entry of ``found``."""
    row, values = listed(marks, i, j)
    early = field(values, "kind") == EARLIER
    base = bounds[row[early]]
    row_2, more = listed(found, i, j)
    base_2 = bounds[row_2]
    low = np.concatenate([base + field(values, "first")[early], base_2 + field(more, "first")]).astype(np.int64)
    high = np.concatenate([base + field(values, "last")[early], base_2 + field(more, "last")]).astype(np.int64) + length
    return covered(n, low, high)


def windows_of(segments: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the segment, start) of every window of the segments."""
    first, last = field(segments, "first").astype(np.int64), field(segments, "last").astype(np.int64)
    size = last - first + 1
    which = np.repeat(np.arange(len(size)), size)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)


def window_rows(by_word: bool, length: int, kinds: tuple[int, ...]
                ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text_key, anchor, window, start): the windows of marked segments of some kinds, by their hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(2)):
                row, values = listed(batch.column(3), i, j)
                chosen = np.isin(field(values, "kind"), kinds)
                if not chosen.any():
                    continue
                row, values = row[chosen], values.filter(pa.array(chosen))
                units, bounds, _w = units_of(data, offsets, by_word)
                which, start = windows_of(values, row)
                at = bounds[row[which]] + start
                hashes = Rolling(units, BASES[1]).spans(at, at + length)
                of = pa.array(row[which] + i)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(of), batch.column(1).take(of), pa.array(field(values, "anchor")[which]),
                    signed(hashes), pa.array(start.astype(np.int32))], ["id", "text_key", "anchor", "window", "start"])
    return run


WINDOW = "id long, text_key long, anchor long, window long, start int"


def found_earlier(windows: DataFrame, later: Callable[[Column], Column]) -> DataFrame:
    """(id, text_key, first, last) of the windows that come after the first of their kind, one by one."""
    least = (windows.groupBy("anchor", "window")
             .agg(F.min(F.struct("id", "text_key", F.col("start").alias("first"))).alias("least"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").drop("n"))
    return (split_join(windows.withColumnRenamed("start", "first"), least, ["anchor", "window"]).where(later(F.col("least")))
            .select("id", "text_key", "first", F.col("first").alias("last")))
