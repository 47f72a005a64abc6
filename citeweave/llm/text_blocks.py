"""Vectorised scanning of Arrow text columns.

Texts are processed as UTF-8 bytes in blocks of about half a megabyte, so memory
does not depend on how many rows an Arrow batch holds.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
U64 = np.uint64

PRIME = (1 << 61) - 1
SEGMENT = 1 << 20

# A quick hash modulo 2**64 for candidate search alone: unequal strings can share it
# (some do for every base), so whoever uses it compares bytes afterwards.
_BASE = U64(0x9E3779B97F4A7C15 | 3)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every bit depends on all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_PLAIN = np.arange(1, 257, dtype=U64)
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] += U64(32)
_kept: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What a worker keeps from task to task under this name."""
    return _kept.setdefault(name, {})


def keep_only(*names: str) -> None:
    """Forget what other operators left in this worker, which may serve many of them."""
    for name, things in _kept.items():
        if name not in names:
            things.clear()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the quick hash's base and of its inverse modulo 2**64."""
    found = kept("powers")
    if not found or len(found[0]) < n:
        size = max(n, BLOCK_BYTES * 2)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            found[k] = np.multiply.accumulate(steps)
    return found[0][:n], found[1][:n]


def quick_sums(data: np.ndarray) -> np.ndarray:
    """Sums s with s[j] - s[i] a quick hash of bytes i..j, shifted by the base's i-th power."""
    forward, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUES[data] * forward, out=out[1:])
    return out


def quick_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Quick hashes of byte spans that depend on their content alone."""
    _, backward = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * backward[starts])


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it."""
    low, thirty = U64((1 << 31) - 1), U64((1 << 30) - 1)
    x1, x0, y1, y0 = x >> U64(31), x & low, y >> U64(31), y & low
    middle = x1 * y0 + x0 * y1
    return _reduced(((x1 * y1) << U64(1)) + (middle >> U64(30)) + ((middle & thirty) << U64(31)) + x0 * y0)


def random_base() -> int:
    """A base of span hashes: one for all tasks whose hashes meet, a new one for each run."""
    return secrets.randbelow(PRIME - 1000) + 500


class SpanHasher:
    """Polynomial hashes of byte spans modulo the prime 2**61 - 1, in a secret base, with the span's length.

    Two given unequal spans of up to n bytes share a hash for at most n of the
    2**61 bases, whatever their content, and no text can be made to fit a base
    that is drawn when the operator runs.
    """

    def __init__(self, base: int):
        self.base = base
        self.power = self._powers(base)
        self.back = self._powers(pow(base, -1, PRIME))
        self.low, self.high = self.power & U64(0xFFFFFFFF), self.power >> U64(32)

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.ones(SEGMENT, U64)
        size = 1
        while size < SEGMENT:
            out[size : 2 * size] = times(out[:size], np.full(size, pow(base, size, PRIME), U64))
            size *= 2
        return out

    def sums(self, data: np.ndarray, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of bytes times the halves of the base's powers; powers begin anew in each segment."""
        n = len(data)
        values = _FOLDED if fold_case else _PLAIN
        out = np.zeros((2, n + 1), U64)
        for at in range(0, n, SEGMENT):
            value = values[data[at : at + SEGMENT]]
            for half, row in zip((self.low, self.high), out, strict=True):
                part = row[at + 1 : at + 1 + len(value)]
                np.multiply(value, half[: len(value)], out=part)
                np.cumsum(part, out=part)
                part += row[at]
        return out[0], out[1]

    def hashes(self, sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans, equal for equal bytes wherever they stand."""
        low, high = sums[0][ends] - sums[0][starts], sums[1][ends] - sums[1][starts]
        shifted = ((high & U64((1 << 29) - 1)) << U64(32)) + (high >> U64(29))
        out = times(_reduced(_reduced(low) + _reduced(shifted)), self.back[starts & (SEGMENT - 1)])
        if len(sums[0]) > SEGMENT:
            for k in np.flatnonzero(starts // SEGMENT != (ends - 1) // SEGMENT).tolist():
                out[k] = self._across(sums, int(starts[k]), int(ends[k]))
        return mix(out + mix((ends - starts).astype(U64)))

    def _across(self, sums, start: int, end: int) -> int:
        """The hash of a span that lies in several segments."""
        total, at = 0, start
        while at < end:
            stop = min(end, (at // SEGMENT + 1) * SEGMENT)
            low, high = (int(s[stop] - s[at]) for s in sums)
            total += ((high << 32) + low) * int(self.back[at % SEGMENT]) * pow(self.base, at - start, PRIME)
            at = stop
        return total % PRIME


def span_hasher(base: int) -> SpanHasher:
    """The hasher of a base; a worker keeps the last one."""
    found = kept("hashers")
    if base not in found:
        found.clear()
        found[base] = SpanHasher(base)
    return found[base]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    where = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, where


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``size`` bytes; no row is cut."""
    raw, where = text_buffers(column)
    row, rows = 0, len(column)
    while row < rows:
        end = int(np.searchsorted(where, where[row] + size, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, raw[where[row] : where[end]], where[row : end + 1] - where[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total) of maximal runs of word bytes; rows end words."""
    inside = is_word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)
