"""Large JSON documents read in several tasks.

Spark's text source splits a file anywhere when records end with a character, here the closing brace. What a split
starts in (a string or not, how deep) follows from all splits before: a first pass sums each split up under both
assumptions, a fold over these sums (one small row for each split) gives the start of every split, and a second pass
cuts the elements out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLOSING = "}"
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?P<shut>"|\Z)|[{}\[\]]', re.S)
REST = re.compile(r'(?:[^"\\]|\\.)*(?P<shut>"|\Z)', re.S)
DEEPER = {"{": 1, "[": 1, "}": -1, "]": -1}
SUMS = "file string, block long, outside boolean, outside_depth long, inside boolean, inside_depth long"
PIECES = "file string, block long, seq long, starts boolean, ends boolean, key string, text string"
#: A key whose beginning lies in an earlier split, which the key looked for never does.
CUT_KEY = "\0"


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the text up to each closing brace, in the order of each split."""
    return spark.read.option("lineSep", CLOSING).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _tokens(text: str, inside: bool) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether a string goes on after the text) of strings and brackets; ``inside``: it begins in a string."""
    at = 0
    if inside:
        m = REST.match(text)
        at = m.end()
        yield "rest", 0, at, not m.group("shut")
    for m in TOKEN.finditer(text, at):
        kind = text[m.start()]
        yield kind, m.start(), m.end(), kind == '"' and not m.group("shut")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """(file, block and what else comes with the rows; texts) in order; a block may come in several parts."""
    for batch in batches:
        others = [batch.column(k).to_pylist() for k in range(batch.num_columns) if batch.schema.names[k] != "value"]
        values = batch.column(batch.schema.names.index("value")).to_pylist()
        low = 0
        rows = list(zip(*others))
        for high in range(1, len(rows) + 1):
            if high == len(rows) or rows[high] != rows[low]:
                yield rows[low], [v + CLOSING for v in values[low:high]]
                low = high


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: whether it ends in a string and by how much it is deeper, if it begins outside of one, and inside."""
    held: dict[tuple, list[list]] = {}
    for key, texts in _blocks(batches):
        states = held.setdefault(key, [[False, 0], [True, 0]])
        for text in texts:
            for state in states:
                inside, state[0] = state[0], False
                for kind, _, _, open_ in _tokens(text, inside):
                    state[0] = open_
                    state[1] += DEEPER.get(kind, 0)
    rows = [(*key, *one, *two) for key, (one, two) in held.items()]
    names = [c.split()[0] for c in SUMS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    columns = zip(*rows) if rows else [()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


class _Cutter:
    """Cuts the elements of a split out of its texts, which follow one another."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth = inside, depth
        self.cut = inside  # the string that is open began before the split
        self.key: str | None = None
        self.string = ""
        self.held: list[str] | None = [] if depth > 2 else None
        self.starts = False
        self.seq = 0

    def feed(self, text: str) -> Iterator[tuple[int, bool, bool, str | None, str]]:
        begin = 0
        inside, self.inside = self.inside, False
        for kind, start, end, open_ in _tokens(text, inside):
            if kind in ('"', "rest"):
                self.inside = open_
                if self.depth == 1:
                    self.string = (self.string if kind == "rest" else "") + text[start:end]
                    if not open_:
                        self.string, self.cut = (CUT_KEY if self.cut and kind == "rest" else self.string), False
                continue
            if kind in "{[":
                if self.depth == 1:
                    self.key = self._name() + kind
                elif self.depth == 2 and kind == "{":
                    self.held, self.starts, begin = [], True, start
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == 2 and self.held is not None:
                    if kind == "}":
                        yield self._piece(text[begin:end], True)
                    self.held = None
        if self.held is not None:
            self.held.append(text[begin:])

    def _name(self) -> str:
        try:
            return json.loads(self.string)
        except ValueError:
            return CUT_KEY

    def _piece(self, last: str, ends: bool) -> tuple[int, bool, bool, str | None, str]:
        self.seq += 1
        return self.seq, self.starts, ends, self.key, "".join([*self.held, last])

    def rest(self) -> Iterator[tuple[int, bool, bool, str | None, str]]:
        if self.held:
            yield self._piece("", False)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements and parts of elements that a split holds, and a last row with the key it ends in."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
    now, cutter = None, None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def finished() -> list[tuple]:
        rows = [(*now[:2], *p) for p in cutter.rest()]
        return [*rows, (*now[:2], cutter.seq + 1, False, False, cutter.key, None)]

    for key, texts in _blocks(batches):
        rows = []
        if key != now:
            if now is not None:
                rows += finished()
            now, cutter = key, _Cutter(key[2], key[3])
        for text in texts:
            rows += [(*now[:2], *p) for p in cutter.feed(text)]
        if rows:
            yield batch(rows)
    if now is not None:
        yield batch(finished())


def array_elements(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, pos, json): the objects in the array under the top-level ``key`` of each JSON document of ``path``.

    ``pos`` is dense and unique, in order of file and place. A document may be larger than a task's memory, only its
    elements may not. Elements that are no objects are left out. Of blocks of a file (``spark.sql.files.maxPartitionBytes``)
    one small row each is broadcast and folded; compressed files are one block. The text after the end of the
    document is not read. A file without the key, or an empty one, has no rows.
    """
    segments = _segments(spark, path)
    sums = segments.mapInArrow(_sums, SUMS).withColumn("sum", F.struct(*[c.split()[0] for c in SUMS.split(", ")[1:]]))
    begin = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("depth"),
                     F.array().cast("array<struct<block:long,inside:boolean,depth:long>>").alias("starts"))
    fold = F.aggregate("sums", begin, lambda a, s: F.struct(
        F.when(a["inside"], s["inside"]).otherwise(s["outside"]).alias("inside"),
        (a["depth"] + F.when(a["inside"], s["inside_depth"]).otherwise(s["outside_depth"])).alias("depth"),
        F.concat(a["starts"], F.array(F.struct(s["block"].alias("block"), a["inside"].alias("inside"), a["depth"].alias("depth")))).alias("starts")))
    starts = (sums.groupBy("file").agg(F.array_sort(F.collect_list("sum")).alias("sums"))
              .select("file", F.explode(fold["starts"]).alias("s")).select("file", "s.*"))
    placed = segments.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "inside", "depth", "value")
    pieces = placed.mapInArrow(_pieces, PIECES)
    # the key that a block begins in is the last one of the blocks before
    ends = pieces.where("text IS NULL").select("file", "block", F.col("key").alias("last"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    found = (pieces.where("text IS NOT NULL").join(F.broadcast(carried), ["file", "block"])
             .where(F.coalesce("key", "carried") == F.lit(key + "[")).select("file", "block", "seq", "starts", "ends", "text"))
    whole = found.where("starts AND ends").select("file", "block", "seq", F.col("text").alias("json"))
    # elements over several blocks: at most two parts of a block are in no whole element
    number = F.sum(F.col("starts").cast("int")).over(W.partitionBy("file").orderBy("block", "seq"))
    parts = found.where("NOT (starts AND ends)").withColumn("number", number)
    listed = F.array_sort(F.collect_list(F.struct("block", "seq", "text")))
    cut = (parts.groupBy("file", "number").agg(listed.alias("p"), F.bool_or("ends").alias("done")).where("done AND number > 0")
           .select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"), F.array_join("p.text", "").alias("json")))
    every = whole.unionByName(cut)
    sizes = every.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("file", "block", offset.alias("offset"))
    place = F.row_number().over(W.partitionBy("file", "block").orderBy("seq"))
    return (every.withColumn("place", place).join(offsets, ["file", "block"])
            .select("file", (F.col("offset") + F.col("place") - 1).alias("pos"), "json"))
