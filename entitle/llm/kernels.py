"""NumPy kernels that run inside tasks: slices of Arrow text, words, rolling hashes, winnowed anchors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice of a batch has about so many bytes, so that its arrays stay in the cache.
SLICE_BYTES = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random 64-bit value for each byte; rolling hashes work on them.
BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


#: Rolling hashes are polynomials modulo this prime, two of them with bases of their own.
PRIME = np.uint64((1 << 31) - 1)
_SHIFT = np.uint64(31)
#: Powers of so many places are kept for later slices; those of longer texts are not.
KEPT_POWERS = 1 << 19


def _fold(x: np.ndarray) -> np.ndarray:
    """``x``, made smaller in its place without a change of the residue modulo PRIME: 2^64 to 3 * 2^32, that to 2^31 + 5."""
    high = x >> _SHIFT
    x &= PRIME
    x += high
    return x


def _powers(factor: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:
        out[done:2 * done] = _fold(_fold(out[:size - done][:done] * np.uint64(pow(factor, done, int(PRIME)))))
        done *= 2
    return out


class Rolling:
    """Hashes of any span of a sequence of 64-bit values, from prefix sums of two polynomials modulo PRIME: one of the
    lower and one of the upper bits of the values. A prime has no sequences that agree under every base, which a power
    of two has."""

    _kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        self._halves = []
        for factor, half in ((base % int(PRIME), values & PRIME), ((base >> 31) % int(PRIME), values >> np.uint64(33))):
            up, down = self._tables(factor, n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_fold(half * up[:n]), out=sums[1:])
            self._halves.append((sums, down))

    @classmethod
    def _tables(cls, factor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        both = cls._kept.get(factor)
        if both is None or len(both[0]) < size:
            places = max(size, KEPT_POWERS)
            both = _powers(factor, places), _powers(pow(factor, -1, int(PRIME)), places)
            if places == KEPT_POWERS:
                cls._kept[factor] = both
        return both

    @staticmethod
    def _joined(differences: list[np.ndarray], down: list[np.ndarray]) -> np.ndarray:
        """Sums times inverse powers, both halves in one value. A sum is less than 2^63, as a text has fewer than 2^31 units."""
        low, high = (_fold(_fold(np.multiply(_fold(x), d, out=x))) for x, d in zip(differences, down))
        for x in (low, high):
            np.subtract(x, PRIME, out=x, where=x >= PRIME)
        high <<= _SHIFT
        high |= low
        return mix(high)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._joined([sums[end] - sums[start] for sums, _ in self._halves], [down[start] for _, down in self._halves])

    def all_of(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length."""
        n = len(self._halves[0][0]) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return self._joined([sums[length:] - sums[:n] for sums, _ in self._halves], [down[:n] for _, down in self._halves])


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); a null counts as empty, a
    text over ``limit`` is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


class Words(NamedTuple):
    """Words of a slice: byte ranges, row of each word, index of each row's first word (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def hashes(self, data: np.ndarray) -> np.ndarray:
        return Rolling(BYTE[data]).spans(self.start, self.end)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of bytes that are not white space, never across rows."""
    n = len(data)
    solid = ~SPACE[data]
    begin, last = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    at = offsets[:-1][offsets[:-1] < n]
    begin[at] = solid[at]
    at = offsets[offsets > 0] - 1
    last[at] = solid[at]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(offsets, start, "right") - 1, np.searchsorted(start, offsets))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


class Segments(NamedTuple):
    """Runs of windows with one winnowed anchor: row, first and last window start, offset of the anchor
    from the first start, hash of the anchor's seed, hash of all the units the windows cover."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    lead: np.ndarray
    anchor: np.ndarray
    body: np.ndarray


def winnowed(units: np.ndarray, bounds: np.ndarray, length: int, seed: int) -> Segments:
    """Winnowing: the anchor of a window of ``length`` units is its seed (``seed`` units) of least hash,
    the leftmost of equals, so equal windows have equal anchors at equal places. Every window is in one
    segment. ``bounds``: where rows begin in ``units``, and the end; windows stay inside a row."""
    n = len(units)
    if n < length:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none.view(np.uint64), none.view(np.uint64))
    rolling = Rolling(units)
    grams = rolling.all_of(seed)
    packed = (grams & HIGH) | np.arange(len(grams), dtype=np.uint64)
    anchors = (sliding_min(packed, length - seed + 1) & LOW).astype(np.int64)
    starts = np.arange(len(anchors))
    rows = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + length <= bounds[rows + 1]
    starts, rows, anchors = starts[inside], rows[inside], anchors[inside]
    if not len(starts):
        return winnowed(units[:0], bounds, length, seed)
    new = np.ones(len(starts), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    first, last, at = starts[head], starts[tail], anchors[head]
    body = mix(rolling.spans(first, last + length) + (at - first).astype(np.uint64) * np.uint64(BASES[1]))
    return Segments(rows[head], first, last, at - first, grams[at], body)


def covered(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of ``n`` units lie in one of the ranges [low, high)."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, low, 1)
    np.add.at(edges, high, -1)
    return np.cumsum(edges[:n]) > 0


def joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """The words of each row with one space between them."""
    last = np.ones(len(start), bool)
    last[:-1] = row[1:] != row[:-1]
    size = end - start + 1 - last
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    out = np.full(total, 32, np.uint8)
    source = np.repeat(start - (stop - size), size) + np.arange(total)
    letter = np.ones(total, bool)
    letter[stop[~last] - 1] = False
    out[letter] = data[source[letter]]
    lengths = np.bincount(row, weights=size, minlength=rows).astype(np.int64)
    return text_array(out, np.concatenate([[0], np.cumsum(lengths)]))


def text_array(data: np.ndarray, offsets: np.ndarray, kind: type = pa.StringArray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary() if kind is pa.BinaryArray else pa.string(), len(offsets) - 1, buffers)
