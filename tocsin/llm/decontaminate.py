"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A test item is contained in a document when at least ``least`` of its
distinct 5-word shingles are among the document's.  An item is far shorter than
most documents, so one signature of a whole document would hide it.  Items are
partitioned by size; for each partition every document is read as windows about
twice the items' size, each starting where half of the last has passed, so that
any passage as long as an item lies whole in some window.  The Jaccard similarity
of window and item is then bounded from below by the containment (0.17 at the
least for 0.75), and 32 MinHash values share none with a probability under 0.3 %
at that bound.  Windows are built from minima of blocks, and each wider partition
from pairs of the last one's blocks, so all partitions cost little more than one.

An item whose distinct shingles are at most half of its partition's block (8 in the
lowest partition) would fall below that bound, so it is looked up by shingles: a
document that holds enough of n shingles holds one of any n - need + 1 of them.
These items are found without a miss.

Candidates are verified against the whole document's shingles.  The items are a
stated query set: they are searched in lots of about ``LOT_BYTES``, one after the
other, each sent to the tasks that scan all documents; documents are never shuffled.

Defined cases: null or empty texts contain and match nothing.  An item or text of
fewer than five words is one shingle, its whole sequence.  Repeated items and
documents each give their rows.  No items or no documents: an empty result.
Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import cut, released, slices
from tocsin.llm.shingles import distinct, shingles, words

LEAST = 0.75
PERMUTATIONS = 32
BLOCK = 16
LOT_BYTES = 8_000_000
_rng = np.random.default_rng(20240501)
FACTORS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


class Items:
    """MinHash values of a lot of items by size partition, shingles of those too short for it, and their sets for verification."""

    def __init__(self, ids: list[int], texts: list[str], percent: int):
        hashes, _, _, offsets = words(pa.array(texts, pa.string()))
        values, offsets, _ = shingles(hashes, offsets)
        lengths = np.diff(offsets)
        sets, edges = distinct(values, offsets)
        self.ids = ids
        self.sets = [sets[edges[i] : edges[i + 1]] for i in range(len(ids))]
        self.level = [int(max(0, np.ceil(np.log2(max(n, 1) / BLOCK)))) for n in lengths]
        self.owners: dict[tuple[int, int], dict[int, list[int]]] = {}
        self.short: dict[int, list[int]] = {}
        for i, members in enumerate(self.sets):
            if 2 * len(members) <= BLOCK << self.level[i]:
                need = -(-percent * len(members) // 100)
                for x in members[: len(members) - max(need, 1) + 1].tolist():
                    self.short.setdefault(x, []).append(i)
                continue
            for k in range(PERMUTATIONS if len(members) else 0):
                least = int((members * FACTORS[k] + SHIFTS[k]).min())
                self.owners.setdefault((self.level[i], k), {}).setdefault(least, []).append(i)
        self.screen = {}
        for key, least in self.owners.items():
            self.screen[key] = np.zeros(1 << 16, dtype=bool)
            self.screen[key][[x & 0xFFFF for x in least]] = True
        self.levels = sorted({level for level, _ in self.owners})
        self.short_keys = np.array(sorted(self.short), dtype=np.uint64)
        self.short_screen = np.zeros(1 << 16, dtype=bool)
        self.short_screen[(self.short_keys & np.uint64(0xFFFF)).astype(np.int64)] = True


def _search(items: Items, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 2048):
                rows = [(batch["doc_id"][d].as_py(), items.ids[i], len(items.sets[i]), shared) for d, i, shared in _found(items, percent, batch["text"])]
                columns = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "item_id", "n_item", "n_shared"])

    return released(run)


def _clean(items: Items, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 2048):
                dirty = np.zeros(batch.num_rows, dtype=bool)
                dirty[[d for d, _, _ in _found(items, percent, batch["text"])]] = True
                yield batch.filter(pa.array(~dirty))

    return released(run)


def _found(items: Items, percent: int, texts: pa.Array) -> list[tuple[int, int, int]]:
    """(row, item, shared shingles) of the items that a batch's texts contain."""
    hashes, _, _, offsets = words(texts)
    values, offsets, _ = shingles(hashes, offsets)
    sizes = np.diff(offsets)
    found: set[tuple[int, int]] = set()
    if len(values) and len(items.short_keys):
        at = np.flatnonzero(items.short_screen[(values & np.uint64(0xFFFF)).astype(np.int64)])
        at = at[np.isin(values[at], items.short_keys)]
        for d, x in zip((np.searchsorted(offsets, at, side="right") - 1).tolist(), values[at].tolist(), strict=True):
            found.update((d, i) for i in items.short[x])
    if len(values) and items.levels:
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(sizes)), blocks)
        first = np.concatenate([[0], np.cumsum(blocks)])
        starts = offsets[owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        for k in range(PERMUTATIONS):
            least = np.minimum.reduceat(values * FACTORS[k] + SHIFTS[k], starts)
            own, level = owner, 0
            while True:
                if (level, k) in items.screen:
                    window = least.copy()
                    pair = own[1:] == own[:-1]
                    window[:-1] = np.where(pair, np.minimum(least[1:], least[:-1]), least[:-1])
                    for j in np.flatnonzero(items.screen[level, k][(window & np.uint64(0xFFFF)).astype(np.int64)]):
                        found.update((int(own[j]), i) for i in items.owners[level, k].get(int(window[j]), ()))
                if level >= items.levels[-1]:
                    break
                counts = np.bincount(own, minlength=len(sizes))
                place = np.arange(len(own)) - np.concatenate([[0], np.cumsum(counts)])[own]
                heads = np.flatnonzero(place % 2 == 0)
                least, own, level = np.minimum.reduceat(least, heads), own[heads], level + 1
    rows = []
    members: dict[int, np.ndarray] = {}
    for d, i in sorted(found):
        if d not in members:
            members[d] = np.unique(values[offsets[d] : offsets[d + 1]])
        shared = int(np.isin(items.sets[i], members[d]).sum())
        if 100 * shared >= percent * len(items.sets[i]):
            rows.append((d, i, shared))
    return rows


def _lots(benchmark: DataFrame, least: float) -> Iterator[Items]:
    """The benchmark's items in lots of about LOT_BYTES, one in the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    lots = int(size // LOT_BYTES) + 1
    for lot in range(lots):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == lot).collect()  # about LOT_BYTES
        yield Items([r.item_id for r in rows], [r.text for r in rows], round(100 * least))


def contained_items(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every test item found in a document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [cut(source.mapInArrow(_search(lot, round(100 * least)), "doc_id long, item_id long, n_item long, n_shared long"), "contained") for lot in _lots(benchmark, least)]
    return reduce(DataFrame.unionByName, parts).withColumn("containment", F.expr("n_shared / n_item"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without the rows whose own text contains a test item, whatever their ids; all columns stay. No shuffle."""
    out = docs.withColumn("text", F.col("text").cast("string"))
    for k, lot in enumerate(_lots(benchmark, least)):
        out = (cut(out, "clean") if k else out).mapInArrow(_clean(lot, round(100 * least)), out.schema)
    return out
