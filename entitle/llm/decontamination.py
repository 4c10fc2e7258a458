"""Benchmark decontamination by winnowing (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.llm.kernels import Rolling, Words, mix, signed, text_slices, winnowed, words
from entitle.llm.shared import doc_id, keep, keyed, packed, small_batches, split_join, table

#: Words of a window and of the k-grams it is winnowed by.
WINDOW, SEED = 10, 5
#: Bits of the filter per fingerprint of the items, and their bounds: 512 KB to 16 MB.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 22, 1 << 27
#: Bits of one row of Spark's bitmap functions.
BITMAP = 1 << 15
#: What a byte counts as: digits, small letters and bytes beyond ASCII stay, A-Z become small, all else parts words.
PLAIN = np.full(256, 32, np.uint8)
PLAIN[48:58], PLAIN[97:123], PLAIN[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
PLAIN[65:91] = np.arange(97, 123)
#: Starting values of the two halves of a window's hash.
HALVES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

ITEM = "item string, seed long, high long, low long"
SCANNED = "id long, text_key long, n_words long, found array<struct<start:int,size:int,high:bigint,low:bigint>>"


def word_values(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit value of each word, from a cryptographic hash of each distinct one."""
    inside = data != 32
    ends = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(w.start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = column.dictionary_encode()
    distinct = b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in coded.dictionary.to_pylist())
    return np.frombuffer(distinct, np.uint64)[coded.indices.to_numpy(zero_copy_only=False)]


def window_hashes(values: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows of ``size`` words that begin at ``start``, word after word."""
    out = []
    for half in HALVES:
        h = np.full(len(start), half ^ size, np.uint64)
        for k in range(size):
            h = mix(h + np.uint64(half)) ^ values[start + k]
            h = mix(h)
        out.append(h)
    return out[0], out[1]


def _windows(values: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, fingerprint) of all windows of ``window`` words: the least k-gram hash of each, the leftmost of equals."""
    s = winnowed(values, first, window, seed)
    each = s.last - s.first + 1
    start = np.repeat(s.first - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    return np.repeat(s.row, each), start, np.repeat(s.anchor, each)


def _grams(values: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, fingerprint) of all windows of a short item's size, each its own fingerprint."""
    grams = Rolling(values).all_of(size)
    start = np.arange(len(grams))
    row = np.searchsorted(first, start, "right") - 1
    inside = start + size <= first[row + 1]
    return row[inside], start[inside], mix(grams[inside] + np.uint64(size))


def _item_windows(window: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(1)):
                data = PLAIN[data]
                w = words(data, offsets)
                values, sizes = word_values(data, w), np.diff(w.first)
                row, start, print_ = _windows(values, w.first, window, seed)
                found = [(row, start, print_, np.full(len(row), window))]
                for size in np.unique(sizes[(sizes > 0) & (sizes < window)]):
                    row, start, print_ = _grams(values, w.first, size)
                    whole = sizes[row] == size
                    found.append((row[whole], start[whole], print_[whole], np.full(int(whole.sum()), size)))
                for row, start, print_, size in found:
                    if len(row):
                        high, low = window_hashes(values, start, int(size[0]))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(row + i)), signed(print_), signed(high), signed(low), pa.array(size.astype(np.int32))],
                            ["item", "seed", "high", "low", "size"])
    return run


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """Which bits the fingerprints of the items take, as a bitmap of ``bits`` bits; only that reaches the driver."""
    place = F.col("seed").bitwiseAND(F.lit(bits - 1)) + 1  # these functions count from 1
    rows = (seeds.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap")).collect())
    out = np.zeros(bits // 8, np.uint8)
    for row in rows:
        part = np.frombuffer(row.bitmap, np.uint8)
        at = (row.bucket - 1) * BITMAP // 8
        out[at:at + len(part)] |= part
    return out


def _scan(window: int, seed: int, shorts: list[int], bits: int, taken: np.ndarray
          ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document its number of words and the windows around those fingerprints that an item may share."""
    def likely(print_: np.ndarray) -> np.ndarray:
        at = (print_ & np.uint64(bits - 1)).astype(np.int64)
        return np.flatnonzero(taken[at >> 3] >> (at & 7).astype(np.uint8) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(2)):
                data = PLAIN[data]
                w = words(data, offsets)
                values = word_values(data, w)
                parts = []
                for size in [window, *shorts]:
                    row, start, print_ = _windows(values, w.first, window, seed) if size == window else _grams(values, w.first, size)
                    near = likely(print_)
                    high, low = window_hashes(values, start[near], size)
                    parts.append((row[near], start[near], np.full(len(near), size), high, low))
                row, start, size, high, low = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(row, kind="stable")
                row = row[order]
                entries = pa.StructArray.from_arrays(
                    [pa.array((start[order] - w.first[row]).astype(np.int32)), pa.array(size[order].astype(np.int32)),
                     signed(high[order]), signed(low[order])], ["start", "size", "high", "low"])
                bounds = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(w.first)),
                     pa.ListArray.from_arrays(bounds, entries)], ["id", "text_key", "n_words", "found"])
    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (start, size) of each row, in order of start, as the maximal ranges [low, high) they cover."""
    for batch in batches:
        column = batch.column(2)
        each = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        ranges, row = column.flatten(), np.repeat(np.arange(len(each)), each)
        low, size = (ranges.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "size"))
        # rows apart from each other, so that one running maximum serves all
        far = row * (int((low + size).max()) + 2 if len(low) else 1)
        reach = np.maximum.accumulate(low + size + far) if len(low) else low
        head = np.flatnonzero(np.concatenate([[True], (low + far)[1:] > reach[:-1]])[:len(low)])
        tail = np.append(head[1:], len(low))[:len(head)] - 1
        bounds = pa.array(np.searchsorted(row[head], np.arange(len(each) + 1)).astype(np.int32))
        spans = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(
            [pa.array(low[head].astype(np.int32)), pa.array((reach[tail] - far[tail]).astype(np.int32))], ["low", "high"]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans, batch.column(3)], ["id", "text_key", "spans", "groups"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_words, n_hit, spans, items.

    Words are runs of digits, letters a-z (A-Z become small) and characters beyond ASCII. A window is ``window``
    consecutive words of an item; an item of fewer words, but not none, is one window. ``spans`` has the maximal word
    ranges [low, high) that windows of items cover, ``n_hit`` their words, ``items`` the ids of the items with a
    window in the document, as strings, in order.

    Winnowing: the fingerprint of a window is the least hash of its ``seed``-word grams, so two texts that share a
    window share its fingerprint. A bitmap of the items' fingerprints (16 MB at most, sized by their number) passes
    over the documents; a hit is extended over the windows that hold it, and these meet the items' windows
    by a 128-bit hash of their words. Windows with the same items are one class, and so are documents with the
    same classes: lists of items are put together once per class, not once per document.

    A null text has no words and hits nothing. Items without words match nothing; rows with one item_id are one item;
    the windows of a null item_id hit but are not listed. Repeated rows give repeated results. A very long text
    is handled in one task, as a row. Without items nothing is hit; empty tables of documents give no rows.
    Only doc_id, item_id and text are read, so other columns may have any name.
    """
    if not 0 < seed <= window:
        raise ValueError("a seed has at least one word and is no longer than a window")
    texts = small_batches(items).select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    known = keep(texts.mapInArrow(_item_windows(window, seed), f"{ITEM}, size int"))
    shorts = [r.size for r in known.where(F.col("size") < window).select("size").distinct().collect()]  # fewer than window
    bits = LEAST_BITS
    fingerprints = known.select("seed").distinct().count()
    while bits < MOST_BITS and bits < fingerprints * BITS_EACH:
        bits *= 2
    taken = _filter(known, bits)
    scanned = keep(keyed(docs).select("id", "text_key", "text").mapInArrow(_scan(window, seed, sorted(shorts), bits, taken), SCANNED))

    # windows of the same items have one signature
    key = ["high", "low"]
    listed = known.where("item IS NOT NULL").select(*key, "item").distinct()
    signed_ = listed.groupBy(*key).agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.min("item").alias("least"), F.bit_xor(F.xxhash64("item")).alias("mixed"),
        F.sum(F.xxhash64(F.concat(F.lit("#"), "item")).cast("decimal(20,0)")).alias("total")).alias("group"))
    classes = known.select(*key).distinct().join(signed_, key, "left").withColumn("group", F.sha2(F.to_json("group"), 256))
    near = scanned.select("id", "text_key", F.explode("found").alias("f")).select("id", "text_key", "f.*")
    per_doc = split_join(near, classes, key).groupBy("id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "size"))).alias("ranges"),
        F.array_sort(F.collect_set("group")).alias("groups"))
    spans = "id long, text_key long, spans array<struct<low:int,high:int>>, groups array<string>"
    per_doc = keep(per_doc.mapInArrow(_spans, spans).withColumn("class", F.sha2(F.array_join("groups", ","), 256)))

    # the items of a class of documents, by way of the signatures
    wanted = per_doc.select("class", "groups").dropDuplicates(["class"]).select("class", F.explode("groups").alias("group"))
    one = classes.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(*key)).alias("k")).select("group", "k.*")
    members = split_join(listed, one, key).select("group", "item")
    per_class = (split_join(wanted, members, ["group"]).select("class", "item").distinct()
                 .groupBy("class").agg(F.array_sort(F.collect_list("item")).alias("items")))
    result = split_join(per_doc.select("id", "text_key", "spans", "class"), per_class, ["class"], "left").drop("class")
    none = F.array().cast("array<string>")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    out = scanned.select("id", "text_key", "n_words").join(result, ["id", "text_key"], "left")
    return out.select(doc_id(), "text_key", "n_words", F.coalesce(hit, F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("spans", F.array().cast("array<struct<low:int,high:int>>")).alias("spans"),
                      F.coalesce("items", none).alias("items"))


def decontaminated(docs: DataFrame, items: DataFrame, share: float = 0.0, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` of whose words no more than ``share`` lie in windows of items; all columns in their order.
    Same cases as ``contamination``; a document without words stays."""
    bad = (contamination(docs, items, window, seed).where(F.col("n_hit") > share * F.col("n_words"))
           .select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "text_key").distinct())
    return packed(docs).join(bad, ["id", "text_key"], "left_anti").select("row.*")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({SMALL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, n, md5(array_to_string(w[i:i + n - 1], ' ')) AS h
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
p AS (SELECT doc_id, n, i, md5(array_to_string(w[i:i + n - 1], ' ')) AS h
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
f AS (SELECT doc_id, n, i, item_id FROM p JOIN k USING (n, h)),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS o FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, CAST(item_id AS VARCHAR) AS item FROM f WHERE item_id IS NOT NULL GROUP BY ALL),
u AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM t GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN u USING (doc_id)
"""
