"""Fractions along chains of lots: runs in the Python workers.

Numbers are whole multiples of the last of twelve decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

KIND = pa.decimal128(18, 12)
ONE, HALF = 10**12, 10**6  # a whole, and the split of a number into two halves


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a decimal column, and which rows have one; a null counts as zero."""
    known = ~np.asarray(column.is_null())
    limbs = np.frombuffer(column.buffers()[1], np.int64).reshape(-1, 2)[column.offset : column.offset + len(column), 0]
    return np.where(known, limbs, 0), known


def decimals(values: np.ndarray, known: np.ndarray) -> pa.Array:
    limbs = np.stack([values, values >> 63], axis=1).astype(np.int64)
    mask = pa.py_buffer(np.packbits(known, bitorder="little").tobytes())
    return pa.Array.from_buffers(KIND, len(values), [mask, pa.py_buffer(limbs.tobytes())])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b / ONE rounded half up, for numbers that are not negative; exact for any that fit."""
    if max(a.max(initial=0), b.max(initial=0)) > ONE:
        return ((a.astype(object) * b + ONE // 2) // ONE).astype(np.int64)
    (a1, a0), (b1, b0) = divmod(a, HALF), divmod(b, HALF)
    return a1 * b1 + ((a1 * b0 + a0 * b1) * HALF + a0 * b0 + ONE // 2) // ONE


def add_fractions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the fraction before and after each hop to rows sorted by chain and hop.

    Each fraction is the one before times the part of the lot that was sold, rounded
    half up to twelve decimals. All chains of a batch advance together, a hop at a time;
    the last chain may go on in the next batch.
    """
    open_chain, open_fraction = None, (0, False)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lot, order = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("terminal_lot", "order_id"))
        part, given = units(batch.column("part"))
        before, known = units(batch.column("_last"))  # right where a chain begins
        begins = np.ones(n, bool)
        begins[1:] = (lot[1:] != lot[:-1]) | (order[1:] != order[:-1])
        if (lot[0], order[0]) == open_chain:
            before[0], known[0] = open_fraction
        after, right = np.zeros(n, np.int64), np.zeros(n, bool)
        first = np.flatnonzero(begins)
        left = np.diff(first, append=n)  # rows of each chain
        for hop in range(int(left.max())):
            at = first[left > hop] + hop
            if hop:
                before[at], known[at] = after[at - 1], right[at - 1]
            right[at] = known[at] & given[at]
            after[at] = np.where(right[at], product(before[at], part[at]), 0)
        open_chain, open_fraction = (lot[-1], order[-1]), (after[-1], right[-1])
        batch = batch.append_column("_fraction", decimals(before, known))
        yield batch.append_column("fraction", decimals(after, right))
