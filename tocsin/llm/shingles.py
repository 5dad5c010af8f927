"""Vectorised word and shingle hashing shared by the set operators.

A batch of texts arrives from Spark as an Arrow string array; its UTF-8 buffer
is hashed with numpy, without making a Python string of any text.  A word is a
maximal run of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``, with A-Z lowered.
Words and shingles are 64-bit hashes: two different shingles of a pair of
documents agree by chance with a probability near 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15
#: Odd multipliers, one for each place of a shingle.
PLACES = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3],
    dtype=np.uint64,
)
_powers = np.ones(1, dtype=np.uint64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> np.ndarray:
    """The first n powers of BASE, modulo 2**64."""
    global _powers
    while len(_powers) < n:
        last = np.uint64(int(_powers[-1]) * BASE & 0xFFFFFFFFFFFFFFFF)
        _powers = np.concatenate([_powers, _powers * last])
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def hashed_runs(chars: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: run i is chars[edges[i]:edges[i + 1]], the last one reaches to the end; none is empty.

    Works in place, so it holds about 20 bytes for a byte of text.
    """
    if not len(edges):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(edges, len(chars)))
    place = np.arange(len(chars), dtype=np.int32 if len(chars) < 1 << 31 else np.int64)
    place -= np.repeat(edges.astype(place.dtype), lengths)
    terms = powers(int(lengths.max()))[place]
    del place
    terms *= chars.astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(terms, edges) + lengths.astype(np.uint64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and the n+1 offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of every word of a batch, and the n+1 word offsets of its texts."""
    data, offsets = buffers(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]  # a word never runs from one text into the next
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, np.zeros(len(offsets), np.int64)
    chars = LOWER[data[inside]] if lower else data[inside]
    before = np.cumsum(inside, dtype=np.int64)[starts] - 1  # place of each word's first byte among those kept
    lengths = np.diff(np.append(before, len(chars)))
    return hashed_runs(chars, before), starts, starts + lengths, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles in text order, the n+1 shingle offsets, and each shingle's first word.

    A text of fewer words (but at least one) has one shingle: its whole sequence.
    """
    counts = np.diff(offsets)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    place = np.arange(out[-1]) - np.repeat(out[:-1], sizes)
    first = place + np.repeat(offsets[:-1], sizes)
    value = np.zeros(out[-1], dtype=np.uint64)
    last = np.repeat(offsets[1:], sizes)
    padded = np.append(hashes, np.zeros(n, np.uint64))
    for k in range(n):
        value += np.where(first + k < last, padded[first + k], np.uint64(0)) * PLACES[k]
    return mix(value), out, first


def sort_within(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The values of each text in rising order."""
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    order = np.argsort(values)
    order = order[np.argsort(owner[order], kind="stable")]
    return values[order]


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, and their offsets."""
    if not len(values):
        return values, np.zeros_like(offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    values = sort_within(values, offsets)
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(offsets))).astype(np.int64)
