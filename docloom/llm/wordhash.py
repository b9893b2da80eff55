"""Words of UTF-8 text as numpy arrays: where they are, and 64-bit hashes of them and of runs of them.

A word is a run of bytes other than space and the control characters 9 to 13.  All functions work on the
texts of one Arrow batch at once, so Python runs per batch and not per word.  Hashes are polynomials over
random byte values, taken modulo 2**64 and mixed; prefix sums give any word's hash by one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_RUN = np.uint64(0xD6E8FEB86659FD93)
_RUN_2 = np.uint64(0xA0761D6478BD642F)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random byte values, and the powers of the multiplier and of its inverse for one block."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    powers = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        steps = np.full(BLOCK + 1, base, dtype=np.uint64)
        steps[0] = 1
        powers.append(np.cumprod(steps, dtype=np.uint64))
    return values, powers[0], powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each text begins and ends (null: an empty text)."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[bounds[0]:bounds[-1]], bounds - bounds[0]


class Words:
    """Words of a batch: ``start`` and ``end`` in ``data``, and ``first[i]`` to ``first[i + 1]`` for text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = _WHITE):
        inside = np.zeros(len(data) + 2, dtype=bool)
        np.logical_not(separators[data], out=inside[1:-1])
        begins = inside[1:] & ~inside[:-1]
        cuts = bounds[1:-1]
        begins[cuts] |= inside[cuts + 1]
        ends = inside[:-1] & ~inside[1:]
        ends[cuts] |= inside[cuts]
        self.data = data
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, bounds)
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        values, powers, inverse = _tables()
        out = np.empty(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(out):
            origin = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, origin + BLOCK, side="right")))
            span = self.end[to - 1] - origin
            if span <= BLOCK:
                sums = np.zeros(span + 1, dtype=np.uint64)
                np.cumsum(values[self.data[origin:origin + span]] * powers[:span], out=sums[1:])
                begin, end = self.start[at:to] - origin, self.end[at:to] - origin
                out[at:to] = (sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)
            else:
                out[at] = self._long(int(origin), int(self.end[at]))
            at = to
        return mix(out)

    def _long(self, begin: int, end: int) -> np.uint64:
        """Hash of one word of more than a block, block by block."""
        values, powers, _ = _tables()
        total = 0
        for k, at in enumerate(range(begin, end, BLOCK)):
            part = self.data[at:min(end, at + BLOCK)]
            value = int(np.sum(values[part] * powers[:len(part)], dtype=np.uint64))
            total = (total + value * pow(_MULTIPLIER, k * BLOCK, 1 << 64)) % (1 << 64)
        return np.uint64((total + end - begin) % (1 << 64))

    def runs(self, hashes: np.ndarray, size: int, second: bool = False) -> np.ndarray:
        """Hash of the ``size`` words from each word on; the last places of a text hold no run (see ``whole``)."""
        factor = _RUN_2 if second else _RUN
        base = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) if second else hashes
        total, length = np.zeros(len(base), dtype=np.uint64), 0
        power, span = base, 1  # ``power``: hash of ``span`` words, doubled each turn
        scale = int(factor)
        rest = size
        while rest:
            if rest & 1:
                total = _join(total, power, length, factor)
                length += span
            rest >>= 1
            if rest:
                power = _join(power, power, span, factor)
                span *= 2
        return mix(total + np.uint64((scale * size) % (1 << 64)))

    def whole(self, size: int) -> np.ndarray:
        """Whether the ``size`` words from each word on are of one text."""
        out = np.zeros(len(self.start), dtype=bool)
        if len(out) >= size:
            out[:len(out) - size + 1] = self.text[:len(out) - size + 1] == self.text[size - 1:]
        return out


def _join(left: np.ndarray, right: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """Hash of ``length`` words followed by those that ``right`` covers; places beyond the end keep ``left``."""
    out = left.copy()
    if length < len(out):
        scale = np.uint64(pow(int(factor), length, 1 << 64))
        out[:len(out) - length] += right[length:] * scale
    return out


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows of the given sizes into runs of at most ``most`` in total; a larger row stands alone."""
    at = 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield at, to
        at = to


def word_batches(batches, column: str, most: int = 4 << 20, table: bytes | None = None,
                 separators: np.ndarray = _WHITE) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Arrow batches cut to about ``most`` bytes of text, each with its words; ``table`` maps the bytes first."""
    for batch in batches:
        data, bounds = text_bytes(batch.column(batch.schema.get_field_index(column)))
        for at, to in slices(np.diff(bounds), most):
            part = data[bounds[at]:bounds[to]]
            if table is not None:
                part = np.frombuffer(table, dtype=np.uint8)[part]
            yield batch.slice(at, to - at), Words(part, bounds[at:to + 1] - bounds[at], separators)
