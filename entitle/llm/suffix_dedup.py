"""Suffix-array dedup of byte strings, with two-stage suffix sorting (operator 10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.llm.kernels import text_array, text_slices
from entitle.llm.segments import EDGE, HOT, WINDOW, found_earlier, listed, field, marked, removed, window_rows
from entitle.llm.shared import compact, doc_id, keep, keyed, table

#: Bytes of a repeat that goes, bytes of a seed.
LENGTH, SEED_BYTES = 100, 24
#: A seed with more classes of surroundings (3 MB of pieces) is hot; its windows are summed up by hash, not sorted
#: in one task.
HOT_CLASSES = 20_000
#: Pieces of whole seeds are sorted together until they have so many bytes.
SORT_BYTES = 1 << 21
#: Units of 9 bits in a sort key.
UNITS = 7


def _keys(text: np.ndarray) -> np.ndarray:
    """For each place the next UNITS units as one number; the end of the text counts as zeros."""
    padded = np.concatenate([text, np.zeros(UNITS, np.uint16)]).astype(np.int64)
    out = np.zeros(len(text), np.int64)
    for k in range(UNITS):
        out = (out << 9) | padded[k:k + len(text)]
    return out


def _sorted_directly(places: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the suffixes there, compared over ``depth`` units; equals stay in text order."""
    order = places[np.argsort(keys[places], kind="stable")]
    group = np.concatenate([[0], np.cumsum(keys[order][1:] != keys[order][:-1])]) if len(order) else order
    n = len(keys)
    for at in range(UNITS, depth, UNITS):
        size = np.bincount(group) if len(group) else group
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_):
            break
        ahead = order[open_] + at
        key = np.where(ahead < n, keys[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((key, group[open_]))
        order[open_] = order[open_][by]
        split = np.zeros(len(order), bool)
        key = key[by]
        split[open_[1:]] = (group[open_][1:] == group[open_][:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(split)
    return order


def suffix_array(text: np.ndarray, depth: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Order of the suffixes of ``text`` (units 0 to 256, 0 ends a piece), compared over ``depth`` units at least.

    ``ends`` has for each piece the place up to which its suffixes are wanted; of the others only those come along
    that the wanted ones are induced from. By default all suffixes are ordered.

    Two stages. A suffix smaller than its successor is sorted directly. All others are induced: buckets of
    the first unit are scanned upwards; the suffix one place before each one scanned, if it is larger than
    its successor, takes the next place at the front of its bucket.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    follow = np.append(text[1:], np.uint16(0))
    change = text != follow
    change[-1] = True
    runs = np.flatnonzero(change)
    end = runs[np.searchsorted(runs, np.arange(n))]  # last place of the run of equal units
    smaller = text[end] < follow[end]
    smaller |= text == 0
    places = np.flatnonzero(smaller)
    if ends is not None:
        stop = places[np.searchsorted(places, ends)]  # the first such suffix after the wanted ones
        piece = np.cumsum(text == 0) - (text == 0)
        places = places[places <= stop[piece[places]]]
    direct = _sorted_directly(places, _keys(text), depth)
    counts = np.bincount(text[direct], minlength=258)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    fronts: list[list[np.ndarray]] = [[] for _ in range(257)]
    if not smaller[n - 1]:
        fronts[text[n - 1]].append(np.array([n - 1]))  # the last suffix is larger than the empty one
    out = []
    for unit in range(257):
        front = np.concatenate(fronts[unit]) if fronts[unit] else np.zeros(0, np.int64)
        level, parts = front, [front]
        while len(level):  # suffixes of this bucket induced by others of it: runs of one unit
            before = level[level > 0] - 1
            level = before[(text[before] == unit) & ~smaller[before]]
            parts.append(level)
        bucket = np.concatenate([*parts, direct[cuts[unit]:cuts[unit + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > unit) & ~smaller[before]]
        if len(before):
            to = text[before]
            by = np.argsort(to, kind="stable")
            before, to = before[by], to[by]
            heads = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            for a, b in zip(heads, np.append(heads[1:], len(to))):
                fronts[to[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefix_reaches(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each neighbour pair of the suffix array: have they ``length`` units in common?"""
    keys, n = _keys(text), len(text)
    a, b = order[:-1], order[1:]
    alive = np.flatnonzero(np.maximum(a, b) + length <= n)
    if length < UNITS:
        keys, steps = keys >> 9 * (UNITS - length), [0]
    else:
        steps = [*range(0, length - UNITS, UNITS), length - UNITS]
    for at in steps:
        alive = alive[keys[a[alive] + at] == keys[b[alive] + at]]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[alive] = True
    return out


def repeats_in(pieces: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of the windows that have an equal one before them. ``pieces`` are in document order,
    the first ``windows[k]`` places of piece k are its windows."""
    sizes = np.array([len(p) + 1 for p in pieces])
    begin = np.cumsum(sizes) - sizes
    joined = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + 1
    joined[begin + sizes - 1] = 0
    order = suffix_array(joined, length, begin + windows)
    piece = np.searchsorted(begin, order, "right") - 1
    window = order - begin[piece] < windows[piece]
    order, piece = order[window], piece[window]
    group = np.concatenate([[0], np.cumsum(~common_prefix_reaches(joined, order, length))])[:len(order)]
    first = np.full(int(group.max()) + 1 if len(group) else 0, len(joined))
    np.minimum.at(first, group, order)
    again = order > first[group]
    return piece[again], (order - begin[piece])[again]


PIECE = "anchor long, id long, text_key long, first int, last int, piece binary"


def _pieces(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes under each marked segment that has to be compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(2)):
                row, values = listed(batch.column(3), i, j)
                chosen = field(values, "kind") == EDGE
                if not chosen.any():
                    continue
                row, values = row[chosen], values.filter(pa.array(chosen))
                low = offsets[row] + field(values, "first")
                high = offsets[row] + field(values, "last") + length
                of = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([
                    values.field("anchor"), batch.column(0).take(of), batch.column(1).take(of), values.field("first"),
                    values.field("last"), pa.array([data[a:b].tobytes() for a, b in zip(low, high)], pa.binary())],
                    ["anchor", "id", "text_key", "first", "last", "piece"])
    return run


def _sort_pieces(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Suffix arrays over the pieces of whole seeds; rows come sorted by seed and document order."""
    def hits(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([("id", "ascending"), ("text_key", "ascending"), ("first", "ascending")])
        first = rows.column("first").to_numpy().astype(np.int64)
        count = rows.column("last").to_numpy() - first + 1
        piece, start = repeats_in(rows.column("piece").to_pylist(), count, length)
        by = np.lexsort((start, piece))
        piece, start = piece[by], start[by]
        new = np.ones(len(piece), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(piece))[:len(head)] - 1
        of = pa.array(piece[head])
        return pa.RecordBatch.from_arrays([
            rows.column("id").combine_chunks().take(of), rows.column("text_key").combine_chunks().take(of),
            *(pa.array((first[piece[k]] + start[k]).astype(np.int32)) for k in (head, tail))], ["id", "text_key", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= SORT_BYTES:
                whole = pa.Table.from_batches(held)
                anchor = whole.column("anchor").to_numpy()
                # the last seed may go on in the next batch
                cut = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
                if cut:
                    yield hits(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
        if held:
            yield hits(pa.Table.from_batches(held))
    return run


def _later(least: Column) -> Column:
    return F.struct("id", "text_key", "first") > least


def _cut_out(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_slices(batch.column(2)):
                n = j - i
                gone = removed(batch.column(3), batch.column(4), i, j, offsets, length, len(data))
                row = np.repeat(np.arange(n), np.diff(offsets))
                new = gone.copy()
                new[1:] &= ~(gone[:-1] & (row[1:] == row[:-1]))
                lost = np.bincount(row[gone], minlength=n)
                kept = np.concatenate([[0], np.cumsum(np.diff(offsets) - lost)])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(np.diff(offsets)), pa.array(lost),
                    pa.array(np.bincount(row[new], minlength=n)), text_array(data[~gone], kept, pa.BinaryArray)],
                    ["id", "text_key", "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def suffix_dedup(docs: DataFrame, length: int = LENGTH, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    Texts are UTF-8 bytes. Every byte goes that is covered by a string of ``length`` bytes which also starts
    earlier, in a document of smaller id or further ahead in the same one; matches never cross documents
    and are judged on the input. ``n_spans`` counts maximal removed runs.

    Suffixes that share no seed with another place cannot repeat, and places whose whole surroundings repeat
    need no sorting; what is left, the pieces around seeds with several surroundings, is dealt to tasks by
    seed. There a suffix array is built in two stages (``suffix_array``), and adjacent suffixes with ``length``
    bytes in common are the repeats. Seeds with more than HOT_CLASSES surroundings would gather in one
    task; their windows are matched by hash instead, summed up in the tasks first.

    A null text counts as empty; a null doc_id as the smallest id; of two texts with one id the one of smaller
    ``text_key`` is the earlier; repeated rows give repeated results. A very long text is handled in one
    task, as a row. An empty table gives no rows; other columns are not read.
    """
    texts = compact(keyed(docs))
    marks = keep(marked(texts, False, length, seed_bytes, _later, HOT_CLASSES))
    both = texts.join(marks, ["id", "text_key"], "left").select("id", "text_key", "text", "marks")
    sorted_ = (both.mapInArrow(_pieces(length), PIECE).repartition("anchor").sortWithinPartitions("anchor")
               .mapInArrow(_sort_pieces(length), "id long, text_key long, first int, last int"))
    hot = found_earlier(both.mapInArrow(window_rows(False, length, (HOT,)), WINDOW), _later)
    found = sorted_.unionByName(hot).groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    return (both.join(found, ["id", "text_key"], "left").select("id", "text_key", "text", "marks", "found")
            .mapInArrow(_cut_out(length), "id long, text_key long, n_bytes long, n_removed long, n_spans long, kept binary")
            .select(doc_id(), "n_bytes", "n_removed", "n_spans", "kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(0, n - {LENGTH - 1})) AS i, x FROM d WHERE n >= {LENGTH}),
h AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) AS k FROM p),
m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM h),
s AS (SELECT doc_id, i, i > lag(i, 1, -1 - {LENGTH}) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} AS new FROM m WHERE r > 1),
g AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
v AS (SELECT doc_id, run, min(i) AS low, max(i) + {LENGTH} AS high FROM g GROUP BY doc_id, run),
q AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(high - low) AS BIGINT) AS n_removed FROM v GROUP BY doc_id),
c AS (SELECT doc_id, high AS low, lead(low) OVER (PARTITION BY doc_id ORDER BY low) AS high FROM v
  UNION ALL SELECT doc_id, 0, min(low) FROM v GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(x, 2 * low + 1, 2 * (coalesce(high, n) - low)), '' ORDER BY low) AS t
  FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(t, x))) AS kept_sha256 FROM d LEFT JOIN q USING (doc_id) LEFT JOIN k USING (doc_id)
"""
