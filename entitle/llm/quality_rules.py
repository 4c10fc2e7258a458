"""Quality rules with cross-document line frequency (operator 8)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from entitle.llm.kernels import BASES, BYTE, Rolling, SPACE, mix, text_slices, words
from entitle.llm.shared import WORD, doc_id, keep, keyed, packed, split_join, table

#: A line goes if it stands in more documents of its host than both of these allow.
LINE_DOCS, LINE_SHARE = 20, 0.05
#: A document is depleted if fewer than this share of its words is left.
LEFT_SHARE = 0.5
#: Fixed by the query's contract.
MIN_WORDS, REPEAT_PERCENT = 50, 50
FULL = re.compile(WORD)
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
MEASURES = ("id long, text_key long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, lines array<struct<line:long,words:int>>")


def _repeated(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row: words in 3-word windows that are found twice or more in the row."""
    if len(hashes) < 3:
        return np.zeros(rows, np.int64)
    grams = Rolling(hashes, BASES[1]).all_of(3)
    at = np.flatnonzero(row[:-2] == row[2:])
    key = mix(grams[at] + row[at].astype(np.uint64) * np.uint64(BASES[0]))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(hashes), bool)
    for shift in range(3):
        hit[at[twice] + shift] = True
    return np.bincount(row[hit], minlength=rows)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in text_slices(batch.column(3)):
            n, w = j - i, words(data, offsets)
            hashes = w.hashes(data)
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
            chars = np.bincount(w.row, weights=lead[w.end] - lead[w.start], minlength=n).astype(np.int64)
            # a line is known by the sequence of its words, a duplicate by its bytes
            breaks = np.flatnonzero(data == 10)
            starts = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < len(data)], breaks + 1]))
            starts = starts[starts < len(data)]
            row = np.searchsorted(offsets, starts, "right") - 1
            ends = np.minimum(np.append(starts[1:], len(data)), offsets[row + 1])
            ends = np.where((ends > starts) & (data[np.maximum(ends, 1) - 1] == 10) & (ends > starts), ends - 1, ends)
            low, high = np.searchsorted(w.start, starts), np.searchsorted(w.start, ends)
            full = high > low
            starts, ends, row, low, high = starts[full], ends[full], row[full], low[full], high[full]
            exact = mix(Rolling(BYTE[data]).spans(starts, ends) + row.astype(np.uint64) * np.uint64(BASES[1]))
            _, lines = np.unique(exact, return_index=True)
            dup = np.bincount(row, minlength=n) - np.bincount(row[lines], minlength=n)
            normal = Rolling(hashes, BASES[1]).spans(low, high).view(np.int64)
            # equal normalised lines of one document count once, with all their words
            key = mix(normal.view(np.uint64) + row.astype(np.uint64) * np.uint64(BASES[0]))
            _, where, back = np.unique(key, return_index=True, return_inverse=True)
            size = np.bincount(back, weights=high - low, minlength=len(where)).astype(np.int32)
            order = np.argsort(row[where], kind="stable")
            where, size = where[order], size[order]
            bounds = np.concatenate([[0], np.cumsum(np.bincount(row[where], minlength=n))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(
                [pa.array(normal[where]), pa.array(size)], ["line", "words"]))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k).slice(i, n) for k in range(3)), pa.array(np.diff(w.first)), pa.array(chars),
                pa.array(symbols[offsets[1:]] - symbols[offsets[:-1]]), pa.array(dup),
                pa.array(_repeated(hashes, w.row, n)), lists],
                ["id", "text_key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def _host(column: str):
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-")).alias("host")


def _judged(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE,
            left_share: float = LEFT_SHARE) -> DataFrame:
    """The rows of ``quality`` with host and common, the hashes of their common lines or null."""
    rows = keyed(docs, _host(host))
    lines = keep(rows.select("id", "text_key", "host", "text").mapInArrow(_measure, MEASURES)
                 .withColumn("row_id", F.monotonically_increasing_id()))
    texts = lines.groupBy("host", "text_key").agg(F.any_value("lines").alias("lines"))
    hosts = lines.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    each = lines.select("row_id", "host", F.explode("lines").alias("l")).select("row_id", "host", "l.line", "l.words")
    common = (texts.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > line_docs)
              .join(hosts, "host").where(F.col("n") > F.col("host_docs") * line_share).select("host", "line"))
    depleted = (split_join(each, common, ["host", "line"]).groupBy("row_id")
                .agg(F.sum("words").cast("long").alias("n_common_words"), F.collect_list("line").alias("common")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_common_words")
    return (lines.drop("lines").join(depleted, "row_id", "left")
            .withColumns({"n_common_words": F.coalesce("n_common_words", F.lit(0).cast("long")), "base_failed": failed})
            .withColumn("kept", ~F.col("base_failed") & (left >= F.col("n_words") * left_share)))


def quality(docs: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE,
            left_share: float = LEFT_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_common_words, kept, and id and text_key to find its row by.

    Lines are hashed by their sequence of words, so white space does not matter, and counted once per
    distinct text and host: exact copies are one document here, their removal is dedup's work. A line in more than ``line_docs`` documents and more than ``line_share`` of the
    documents of its host is common; its words (``n_common_words``) do not count as left, and ``quality_filter``
    removes it. A document with less than
    ``left_share`` of its words left is depleted and rejected, as one that fails the base rules is.

    A null text has no words and fails; a null host is a host of its own; rows with one id are judged each; a long text is measured in its task. An empty table gives no rows. Other
    columns are not read. Counts are aggregated in the tasks before the shuffle, and the rows to
    be judged are found by the common lines alone, so no group gathers in one task.
    """
    judged = _judged(docs, host, line_docs, line_share, left_share)
    return judged.select(doc_id(), *BASE, "n_common_words", "kept", "id", "text_key")


def _without_lines(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (common, ...) without common; lines whose hashes it has are taken out of their text, and n_chars follows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, common = list(batch.columns[1:]), batch.column(0)
            at = np.flatnonzero(common.is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                where = schema.get_field_index("text")
                texts = columns[where].to_pylist()
                for i, j, data, offsets in text_slices(columns[where].take(pa.array(at))):
                    w = words(data, offsets)
                    rolling = Rolling(w.hashes(data), BASES[1])
                    for k in range(i, j):
                        gone, lines, low = set(common[int(at[k])].as_py()), texts[at[k]].split("\n"), int(w.first[k - i])
                        high = low + np.cumsum([len(FULL.findall(x)) for x in lines])
                        starts = np.concatenate([[low], high[:-1]])
                        full = np.flatnonzero(high > starts)
                        found = rolling.spans(starts[full], high[full]).view(np.int64).tolist()
                        out = {x for x, line in zip(full.tolist(), found) if line in gone}
                        texts[at[k]] = "\n".join(x for n, x in enumerate(lines) if n not in out)
                columns[where] = pa.array(texts, schema.field(where).type)
                size = schema.get_field_index("n_chars")
                if size >= 0 and pa.types.is_integer(schema.field(size).type):
                    sizes = columns[size].to_pylist()
                    for k in at.tolist():
                        sizes[k] = len(texts[k])
                    columns[size] = pa.array(sizes, schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[1:])
    return run


def quality_filter(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """``docs`` without the rejected rows, and without the common lines of those that stay: their ``text`` has its
    other lines as they were, ``n_chars`` (if there is one) counts them. All columns in their order. Same
    cases as ``quality``; rows that share id and text stay if each of them does."""
    noted = _judged(docs, host, **limits).where("NOT kept OR common IS NOT NULL").select("id", "text_key", "host", "kept", "common")
    notes = noted.groupBy("id", "text_key").agg(
        F.min("kept").alias("kept"), F.map_from_entries(F.collect_set(F.struct("host", F.sort_array("common")))).alias("of_host"))
    found = (packed(docs, _host(host)).join(notes, ["id", "text_key"], "left").where("coalesce(kept, true)")
             .select(F.try_element_at("of_host", F.col("host")).alias("common"), "row.*"))
    return found.mapInArrow(_without_lines(to_arrow_schema(docs.schema)), docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("id", "text_key")


OP8_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_zip(w[:-3], w[2:-2], w[3:])) AS g FROM d WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM t),
rep AS (SELECT doc_id, count(DISTINCT i + s) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS s) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT *, regexp_extract_all(line, '{WORD}') AS lws FROM l),
ln AS MATERIALIZED (SELECT *, array_to_string(lws, ' ') AS norm, len(lws) AS k FROM lw WHERE len(lws) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY doc_id),
h AS (SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY host),
com AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS n FROM ln GROUP BY host, norm) JOIN h USING (host)
  WHERE n > {LINE_DOCS} AND n > host_docs * CAST({LINE_SHARE} AS DOUBLE)),
gone AS (SELECT doc_id, CAST(sum(k) AS BIGINT) AS n_common_words FROM ln JOIN com USING (host, norm) GROUP BY doc_id),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  coalesce(n_common_words, 0) AS n_common_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_words - n_common_words >= n_words * CAST({LEFT_SHARE} AS DOUBLE) AS kept FROM j
"""
