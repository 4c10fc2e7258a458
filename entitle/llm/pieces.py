"""SentencePiece encoding and decoding by suffix-array matching (operator 4)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitle.llm.kernels import BYTE, Rolling, text_array, text_slices
from entitle.llm.shared import small_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The character that stands for a space in pieces, in UTF-8.
MARK = "▁"
#: Code points of new chunks that are matched at once; slices of text that are encoded at once.
MATCH_UNITS, TEXT_BYTES = 1 << 19, 1 << 21
#: Entries of the direct-mapped cache of piece pairs.
CACHE = 1 << 20


class Model(NamedTuple):
    """Pieces of a BPE model of SentencePiece as arrays; bounded by the vocabulary."""

    codes: np.ndarray  # matched pieces: code points, padded with 0
    sizes: np.ndarray  # their lengths
    ids: np.ndarray  # their ids
    order: np.ndarray  # by id: place in the order of merges, -1 if not merged
    left: np.ndarray  # by id: the parts that are merged last
    right: np.ndarray
    length: np.ndarray  # by id: code points
    pair_keys: np.ndarray  # left * V + right, sorted, of all pairs that make a piece
    pair_order: np.ndarray
    single: dict[int, int]  # code point -> id
    text: list[bytes]  # by id: what it decodes to
    first_byte: int  # id of <0x00>
    mark: int  # id of the mark alone
    runs: dict[str, int]  # pieces of several marks

    @property
    def size(self) -> int:
        return len(self.order)


def merged(symbols: list[str], rank: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Byte-pair merges of a short sequence: best rank first, of equals the leftmost; the last pair merged."""
    last = None
    while len(symbols) > 1:
        found = [(rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in rank]
        if not found:
            break
        _, i = min(found)
        last = (symbols[i], symbols[i + 1])
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols, last


def load(path: str = MODEL) -> Model:
    """Reads a model file on the driver. Only models with byte fallback, an identity normaliser and a
    leading space are meant."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    v = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(v)]
    plain = [i for i in range(v) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    of = {names[i]: i for i in plain}
    rank = {names[i]: -sp.get_score(i) for i in plain if len(names[i]) > 1}
    runs = {x: of[x] for x in rank if not x.strip(MARK)}
    words = {x: r for x, r in rank.items() if x not in runs}
    place = {x: k for k, x in enumerate(sorted(words, key=words.get))}
    order, left, right = np.full(v, -1), np.zeros(v, np.int64), np.zeros(v, np.int64)
    usable, pairs = [], {}
    for x in words:
        out, last = merged(list(x), words)
        if len(out) == 1 and all(c in of for c in last):
            usable.append(x)
            order[of[x]] = place[x]
            left[of[x]], right[of[x]] = of[last[0]], of[last[1]]
        for cut in range(1, len(x)):
            if x[:cut] in of and x[cut:] in of:
                pairs[of[x[:cut]] * v + of[x[cut:]]] = place[x]
    single = {ord(x): i for x, i in of.items() if len(x) == 1}
    matched = [*usable, *map(chr, single)]
    codes = np.zeros((len(matched), max(map(len, matched))), np.int64)
    for k, x in enumerate(matched):
        codes[k, :len(x)] = [ord(c) for c in x]
    keys = np.array(sorted(pairs), np.int64)
    first = next(i for i in range(v) if sp.is_byte(i))
    text = [bytes([i - first]) if sp.is_byte(i) else b"" for i in range(v)]
    for x, i in of.items():
        text[i] = x.replace(MARK, " ").encode()
    return Model(codes, np.array([len(x) for x in matched]), np.array([of[x] for x in matched]), order, left, right,
                 np.array([max(1, len(x)) for x in names]), keys, np.array([pairs[k] for k in keys.tolist()]), single, text,
                 first, of[MARK], runs)


def _suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array over ``depth`` code points, by doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(3, np.int64)])
    key, reach = (padded[:n] << 42) | (padded[1:n + 1] << 21) | padded[2:n + 2], 3
    while True:
        order = np.argsort(key, kind="stable")
        if reach >= depth:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])]) + 1
        after = np.zeros(n, np.int64)
        after[:max(0, n - reach)] = rank[reach:]
        key, reach = rank * (n + 2) + after, reach * 2


def _occurrences(text: np.ndarray, order: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range of the suffix array with suffixes that begin with it, by binary search."""
    width = model.codes.shape[1]
    padded = np.concatenate([text, np.zeros(width, np.int64)])
    inside = np.arange(width)[None, :] < model.sizes[:, None]

    def bound(after_equals: bool) -> np.ndarray:
        low, high = np.zeros(len(model.codes), np.int64), np.full(len(model.codes), len(order))
        while (busy := np.flatnonzero(low < high)).size:
            mid = (low[busy] + high[busy]) // 2
            there = padded[order[mid][:, None] + np.arange(width)]
            other = (there != model.codes[busy]) & inside[busy]
            at = other.argmax(axis=1)
            k = np.arange(len(busy))
            less = np.where(other[k, at], there[k, at] < model.codes[busy, at], after_equals)
            low[busy] = np.where(less, mid + 1, low[busy])
            high[busy] = np.where(less, high[busy], mid)
        return low

    return bound(False), bound(True)


def _compatible(one: np.ndarray, two: np.ndarray, model: Model) -> np.ndarray:
    """Do byte-pair merges of the two pieces' text give these two pieces? Undoes merges from the last to the
    first; wherever a merge across the seam would have come first, they don't."""
    v, n = model.size, len(one)
    out, at = np.ones(n, bool), np.arange(n)
    one, two, limit = one.copy(), two.copy(), np.full(n, 1 << 40)
    while len(at):
        known = (one < v) & (two < v)
        key = one * v + two
        where = np.minimum(np.searchsorted(model.pair_keys, key), len(model.pair_keys) - 1)
        crossing = known & (model.pair_keys[where] == key) & (model.pair_order[where] < limit)
        out[at[crossing]] = False
        a, b = np.full(len(at), -1), np.full(len(at), -1)
        a[one < v], b[two < v] = model.order[one[one < v]], model.order[two[two < v]]
        go = ~crossing & ((a >= 0) | (b >= 0))
        at, one, two, a, b = at[go], one[go], two[go], a[go], b[go]
        from_left = a > b
        limit = np.where(from_left, a, b + 1)
        one = np.where(from_left, model.right[np.minimum(one, v - 1)], one)
        two = np.where(from_left, two, model.left[np.minimum(two, v - 1)])
    return out


class Encoder:
    """Chunks to ids. A chunk is a word with the space before it, a run of other spaces or a line end: no
    piece crosses from one to the next, so a chunk met before in the task is not encoded again."""

    def __init__(self, model: Model):
        self.model = model
        self.keys = np.zeros(0, np.uint64)  # hashes of known chunks, sorted
        self.place = np.zeros(0, np.int64)  # their places in the lists below
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.cache_key, self.cache_value = np.full(CACHE, -1), np.zeros(CACHE, bool)

    def _pairs(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        key = one * (1 << 22) + two
        slot = ((key * 0x9E3779B1) >> 7) & (CACHE - 1)
        missing = self.cache_key[slot] != key
        out = self.cache_value[slot]
        if missing.any():
            new, back = np.unique(key[missing], return_inverse=True)
            value = _compatible(new >> 22, new & ((1 << 22) - 1), self.model)
            out[missing] = value[back]
            slot = ((new * 0x9E3779B1) >> 7) & (CACHE - 1)
            self.cache_key[slot], self.cache_value[slot] = new, value
        return out

    def run(self, marks: int) -> list[int]:
        out, _ = merged([MARK] * marks, {x: -len(x) * 0.0 for x in self.model.runs}) if marks < 64 else (None, None)
        if out is None:  # merges of equal rank go from left to right, so long runs are whole longest pieces and a rest
            longest = max(map(len, self.model.runs))
            out = [MARK * longest] * (marks // longest)
            if marks % longest:
                return [self.model.runs[x] for x in out] + self.run(marks % longest)
        return [self.model.runs.get(x, self.model.mark) for x in out]

    def _match(self, chunks: list[str]) -> list[np.ndarray]:
        model, v = self.model, self.model.size
        sizes = np.array([len(c) for c in chunks])
        text = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        # a NUL inside a chunk is a character without a piece, as the gap between chunks is none
        order = _suffixes(text, model.codes.shape[1])
        low, high = _occurrences(text, order, model)
        hits = high - low
        start = order[np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)]
        piece = np.repeat(model.ids, hits)
        covered = np.zeros(len(text), bool)
        covered[start[model.length[piece] == 1]] = True
        gap = np.zeros(len(text), bool)
        gap[begin + sizes] = True
        lone = np.flatnonzero(~covered & ~gap)  # characters without a piece become bytes
        start = np.concatenate([start, lone])
        piece = np.concatenate([piece, v + text[lone]])
        length = np.concatenate([model.length, [1]])
        size = length[np.minimum(piece, v)]
        chunk = np.searchsorted(begin, start, "right") - 1
        offset = start + size - begin[chunk]
        by = np.argsort(offset, kind="stable")
        start, piece, offset, head = start[by], piece[by], offset[by], begin[chunk[by]]
        cuts = np.searchsorted(offset, np.arange(1, offset[-1] + 2)) if len(offset) else [0]
        last = np.full(len(text) + 1, -1)  # the piece that ends the encoding of what stands before each place
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, p = start[a:b], piece[a:b]
            first = s == head[a:b]
            good = first.copy()
            rest = np.flatnonzero(~first)
            if len(rest):
                before = last[s[rest]]
                reached = before >= 0
                rest, before = rest[reached], before[reached]
                good[rest[self._pairs(before, p[rest])]] = True
            last[s[good] + length[np.minimum(p[good], v)]] = p[good]
        out: list[list[int]] = []
        pieces = last.tolist()
        lengths = model.length.tolist()
        for b, n in zip(begin.tolist(), sizes.tolist()):
            at, ids = b + n, []
            while at > b:
                p = pieces[at]
                if p >= v:
                    ids += [model.first_byte + x for x in reversed(chr(p - v).encode("utf-8", "surrogatepass"))]
                    at -= 1
                else:
                    ids.append(p)
                    at -= lengths[p]
            out.append(ids[::-1])
        return out

    def learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        encoded: list[list[int]] = [[]] * len(chunks)
        held, size = [], 0
        todo = []
        for k, chunk in enumerate(chunks):
            if not chunk.strip(b" "):
                encoded[k] = self.run(len(chunk))
            else:
                todo.append(k)
        for k in todo:
            held.append((k, chunks[k].decode("utf-8", "surrogatepass").replace(" ", MARK)))
            size += len(held[-1][1])
            if size >= MATCH_UNITS or k == todo[-1]:
                for (i, _), ids in zip(held, self._match([c for _, c in held])):
                    encoded[i] = ids
                held, size = [], 0
        counts = np.array([len(x) for x in encoded], np.int64)
        total = len(self.ids)
        self.ids = np.concatenate([self.ids, np.array([i for x in encoded for i in x], np.int32)])
        place = len(self.begin) + np.arange(len(chunks))
        self.begin = np.concatenate([self.begin, total + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        keys, places = np.concatenate([self.keys, hashes]), np.concatenate([self.place, place])
        by = np.argsort(keys, kind="stable")
        self.keys, self.place = keys[by], places[by]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows); every row that is not empty begins with a space."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        space, line = data == 32, data == 10
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], space[:-1]]) & ~edge[:n]
        after_line = np.concatenate([[False], line[:-1]])
        word_next = np.concatenate([~space[1:] & ~line[1:], [False]]) & ~edge[1:]
        begins = edge[:n] | line | after_line | (space & (~before | word_next))
        start = np.flatnonzero(begins)
        end = np.append(start[1:], n)
        hashes = Rolling(BYTE[data]).spans(start, end)
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = where < len(self.keys)
        new[inside] = self.keys[where[inside]] != keys[inside]
        if new.any():
            raw = data.tobytes()
            self.learn(keys[new], [raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
        code = self.place[np.searchsorted(self.keys, keys)][back]
        begin, count = self.begin[code], self.count[code]
        # spaces before a word whose own space is left alone make one run with it
        blank = space[start] & (end - start > 0)
        blank &= space[end - 1]
        alone = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[start[1:]]) if len(start) > 1 else np.zeros(0, np.int64)
        alone = alone[space[start[alone + 1]] & (self.ids[begin[alone + 1]] == self.model.mark)]
        for k in alone.tolist():
            ids = np.array(self.run(int(end[k] - start[k]) + 1), np.int32)
            begin[k], count[k] = len(self.ids), len(ids)
            self.ids = np.concatenate([self.ids, ids])
            begin[k + 1] += 1
            count[k + 1] -= 1
        total = np.cumsum(count)
        ids = self.ids[np.repeat(begin - (total - count), count) + np.arange(total[-1])]
        return ids, np.concatenate([[0], total])[np.searchsorted(start, offsets)]


class Decoder:
    """Ids to the bytes they stand for, the leading space included."""

    def __init__(self, model: Model):
        self.data = np.frombuffer(b"".join(model.text), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in model.text])])

    def rows(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        size = np.diff(self.begin)[ids]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        raw = self.data[np.repeat(self.begin[ids] - (stop - size), size) + np.arange(total)].tobytes()
        cuts = np.concatenate([[0], stop])[bounds].tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _encode(model: Model, columns: int, check: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(model), Decoder(model)
        for batch in batches:
            text = pc.replace_substring(batch.column(0), MARK, " ")
            text = pc.if_else(pc.greater(pc.binary_length(text), 0), pc.binary_join_element_wise(" ", text, ""), "")
            for i, j, data, offsets in text_slices(text, TEXT_BYTES):
                ids, bounds = encoder.encode(data, offsets)
                raw, cuts = ids.tobytes(), (bounds * 4).tolist()
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
                made = [pa.array(np.diff(bounds)), pa.array(sha)]
                if check:
                    whole, edges = data.tobytes(), offsets.tolist()
                    made.append(pa.array([x == whole[a:b] for x, a, b in zip(decoder.rows(ids, bounds), edges, edges[1:])], pa.bool_()))
                else:
                    made.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i) for k in range(1, columns)] + made,
                                                 [*batch.schema.names[1:columns], "n_tokens", "ids_sha256", "round_trip" if check else "ids"])
    return run


def encode(docs: DataFrame, *columns: str, model: Model | None = None, check: bool = False) -> DataFrame:
    """``columns`` of ``docs``, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers) and ids; with
    ``check`` instead of the ids round_trip: they were decoded again and gave the text, its marks as spaces.

    The ids are those of SentencePiece's BPE encoding of the whole text. In each task the new chunks of a
    batch are joined and indexed by a suffix array; binary search finds the range of every piece; the ranges
    are the edges of a lattice, sorted by where they end. Relaxing them in that order keeps, for every place,
    the one piece that can end the encoding of all before it: the one that stands its ground against the piece
    ahead of it (``_compatible``). A BPE model has no piece weights to be added up, so this test takes the
    place of the comparison of sums.

    A null or empty text has no tokens. Characters without a piece become their bytes. Repeated rows are encoded
    each; other columns pass through under the names given. A very long text is encoded in one task. An empty
    table gives no rows.
    """
    model = model or load()
    rows = small_batches(docs).select(F.coalesce("text", F.lit("")).alias("_text"), *columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(_encode(model, len(rows.columns), check),
                           f"{schema}, n_tokens long, ids_sha256 string, {'round_trip boolean' if check else 'ids array<int>'}")


def decode(tokens: DataFrame, *columns: str, model: Model | None = None) -> DataFrame:
    """``columns`` of ``tokens`` and ``decoded``, the text of its ``ids``; null ids give an empty text."""
    model = model or load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                counts = pc.fill_null(pc.list_value_length(part.column(0)), 0).to_numpy(zero_copy_only=False)
                ids = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                text = [x.removeprefix(b" ").decode("utf-8", "replace") for x in decoder.rows(ids, np.concatenate([[0], np.cumsum(counts)]))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(text, pa.string())], [*columns, "decoded"])

    rows = tokens.select("ids", *columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(run, f"{schema}, decoded string")


def encoded_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens and ids of every row: the last stage of the pipeline."""
    return encode(docs, "doc_id", "source").drop("ids_sha256")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", check=True)
