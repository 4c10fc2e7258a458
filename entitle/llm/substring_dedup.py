"""Substring dedup by seed and extend over winnowed anchors (operator 1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.llm.kernels import joined_words, text_slices, words
from entitle.llm.segments import EDGE, HOT, WINDOW, found_earlier, marked, removed, window_rows
from entitle.llm.shared import WORD, compact, doc_id, keep, keyed, table

#: Words of a repeat that goes, words of a seed.
LENGTH, SEED_WORDS = 50, 16


def _later(least: Column) -> Column:
    return F.col("id") > least["id"]


def _cut_out(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(2)):
                w = words(data, offsets)
                gone = removed(batch.column(3), batch.column(4), i, j, w.first, length, len(w.start))
                head = gone & np.concatenate([[True], ~gone[:-1] | (w.row[1:] != w.row[:-1])])[:len(gone)]
                tail = gone & np.concatenate([~gone[1:] | (w.row[1:] != w.row[:-1]), [True]])[-len(gone):] if len(gone) else gone
                head, tail = np.flatnonzero(head), np.flatnonzero(tail)
                base = w.first[w.row[head]]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(w.row[head], minlength=j - i))]).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(
                    [pa.array((head - base).astype(np.int32)), pa.array((tail + 1 - base).astype(np.int32))], ["low", "high"]))
                stay = ~gone
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(w.first)),
                    pa.array(np.bincount(w.row[gone], minlength=j - i)), spans,
                    joined_words(data, w.start[stay], w.end[stay], w.row[stay], j - i)],
                    ["id", "text_key", "n_words", "n_removed", "spans", "kept_text"])
    return run


def substring_dedup(docs: DataFrame, length: int = LENGTH, seed_words: int = SEED_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans, kept_text.

    Words are runs of other characters than ``[\\x20\\x09-\\x0D]``. Every word goes that a window of
    ``length`` words covers whose sequence also starts in a document of smaller id; windows are judged
    on the input. ``spans`` has the maximal repeats so removed, as word ranges [low, high), and
    ``kept_text`` the other words, joined by one space.

    Seeds of ``seed_words`` words, winnowed so that every window holds its anchor, are joined by hash.
    A seed's match is extended to both sides by the hashes of what surrounds it, for all documents
    of the seed at once: to all its windows together where the surroundings agree, else window by window. So
    no pair of documents is formed, and hot seeds are summed up in the tasks before they meet.

    A null text has no words; a null doc_id counts as the smallest id; rows of one id never remove each
    other's words, and repeated rows give repeated results. Texts shorter than ``length`` words stay whole. A
    very long text is handled in one task, as a row. An empty table gives no rows; other columns are not read.
    """
    texts = compact(keyed(docs))
    marks = keep(marked(texts, True, length, seed_words, _later, 1 << 30))
    both = texts.join(marks, ["id", "text_key"], "left")
    windows = both.select("id", "text_key", "text", "marks").mapInArrow(window_rows(True, length, (EDGE, HOT)), WINDOW)
    found = found_earlier(windows, _later).groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    return (both.join(found, ["id", "text_key"], "left").select("id", "text_key", "text", "marks", "found")
            .mapInArrow(_cut_out(length), "id long, text_key long, n_words long, n_removed long, "
                        "spans array<struct<low:int,high:int>>, kept_text string")
            .select(doc_id(), "n_words", "n_removed", "spans", "kept_text"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - {LENGTH - 2})) AS i, w FROM d WHERE len(w) >= {LENGTH}),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS k FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM h),
g AS (SELECT DISTINCT doc_id, i + s AS i FROM m, (SELECT unnest(range({LENGTH})) AS s) WHERE least < doc_id),
a AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM a ANTI JOIN g USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
