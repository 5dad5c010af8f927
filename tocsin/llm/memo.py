"""What a worker has worked out for segments of text, kept from batch to batch.

Most segments of a batch were in an earlier one.  A segment is known by its
64-bit hash; its result is a run of ids and some numbers.  The store is bounded in
bytes: when its arrays hold more than ``limit`` it starts anew.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def ragged(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[offsets[i]:offsets[i+1]] for each i of index, joined; and the offsets of the result."""
    sizes = offsets[index + 1] - offsets[index]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(out[-1]) + np.repeat(offsets[index] - out[:-1], sizes)], out


class Memo:
    """solve(data, starts, ends) gives (ids, offsets, numbers[segment, ...]) of segments not seen before."""

    def __init__(self, solve: Callable, numbers: int, dtype=np.int32, limit: int = 48 << 20):
        self.solve, self.limit, self.dtype, self.width = solve, limit, dtype, numbers
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.edges, self.numbers = np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros((0, self.width))

    def rows_of(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The store's row of each of the (sorted, distinct) keys; new ones are solved first."""
        if sum(x.nbytes for x in (self.keys, self.rows, self.flat, self.edges, self.numbers)) > self.limit:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        out = np.zeros(len(keys), dtype=np.int64)
        out[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            ids, edges, numbers = self.solve(data, starts[new], ends[new])
            rows = len(self.edges) - 1 + np.arange(len(new))
            out[new] = rows
            self.keys, self.rows = np.insert(self.keys, at[new], keys[new]), np.insert(self.rows, at[new], rows)
            self.edges = np.concatenate([self.edges, self.edges[-1] + edges[1:]])
            self.flat = np.concatenate([self.flat, ids.astype(self.dtype)])
            self.numbers = np.concatenate([self.numbers, numbers])
        return out
