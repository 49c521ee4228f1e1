"""Words and hashes of a UTF-8 text column, for many texts at once with numpy.

A slice is a run of rows whose texts lie one after another in a byte array; all
functions work on a slice, so memory is bounded by its bytes (one longer text
makes a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept while small."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = got
    return got[:n]


def byte_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span of bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes in every slice."""
    inverse = _power(_INVERSE, len(prefix))
    value = (prefix[ends] - prefix[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Slice:
    first: int  # row of the batch
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # start of each text, and the end of the last

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into slices of at most ``limit`` bytes; null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield Slice(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


@dataclass
class Spans:
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray  # row within the slice

    def __len__(self) -> int:
        return len(self.starts)


def spans(part: Slice, separator: np.ndarray = SPACE) -> Spans:
    """Longest runs of bytes that are no separators, within each text."""
    inside = ~separator[part.data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return Spans(none, none, none)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    full = part.offsets[1:] > part.offsets[:-1]
    before[part.offsets[:-1][full]] = False
    after[part.offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Spans(starts, ends, np.searchsorted(part.offsets, starts, "right") - 1)


def code_points(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the slice, and for each byte offset the number of code points before it."""
    points = np.frombuffer(part.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.zeros(len(part.data) + 1, np.int64)
    np.cumsum((part.data & 0xC0) != 0x80, out=before[1:])
    return points, before


def word_hashes(part: Slice) -> tuple[Spans, np.ndarray]:
    words = spans(part)
    return words, span_hash(byte_hash(part.data), words.starts, words.ends)


def window_hashes(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` neighbouring words of one text, and the index of each first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(0xA0761D6478BD642F) + hashes[k : k + n]
    first = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return mix(out[first]), first
