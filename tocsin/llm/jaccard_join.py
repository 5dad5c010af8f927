"""N-gram Jaccard self-join of documents, by set-relation skipping.

Every text becomes the set of its distinct 5-word shingles.  Two documents link
when ``100 * |A & B| >= 75 * |A | B|``; the result has each document's component.

1. Copies.  Documents with equal sets share a 64-bit set signature and are one
   vertex from here on, however many there are.
2. Order.  A count sketch of fixed size (all documents) puts frequent shingles
   last.  Any order gives the same links; this one keeps shared passages out of
   the prefixes.
3. Index-level skipping.  Only the prefix of each ordered set is indexed.  An
   index list is cut into blocks by position: a block whose position cannot
   leave enough overlap with the probing set is skipped whole, as are sizes
   below three quarters.
4. Answer-level skipping.  A list of more than ``SMALL_LIST`` sets isn't paired
   off: its first set is the leader, and only leader pairs are computed.  Two members
   linked with the leader are connected already.  The lists of one leader are a
   family; one whose members are all connected is done.  The members of every other
   family are dealt to blocks of about ``BLOCK``, and each block is compared inside a
   task, first with itself.  Members that are still outside their family's largest
   component are then dealt to lots, and every lot is compared with every block.  A
   task drops the members that no bitmap of another component lets link; the others'
   sets are multiplied out (sets by shingles, a matrix of zeros and ones).  What
   leaves a task is one row for each component that it has tied to another, so rows
   grow with members, not with pairs; only the work inside tasks, and how often a
   member of a family of many blocks is sent, grow with loose members times all.
5. Computing.  Each set has a parity bitmap of about a bit an element (an element
   flips one bit).  The bits in which two bitmaps differ are at most the elements
   that the sets don't share, which rules most pairs out exactly.  Whole sets are
   fetched for the others alone.

Given rows: null text or no words: empty set, linked with nothing.  A repeated
doc_id keeps its rows, each with its own set.  For components, a null doc_id links
with nothing: its row isn't indexed, and its component is null.  ``one_of_each``
takes rows as they are: of a group, copies and near copies of any id, one row stays,
the one with the least id (nulls last), then the least text hash.
Extra columns are ignored, or kept as they are.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import connected_components, cut, id_filter, merged_components, released, slices, tidy
from tocsin.llm.shingles import distinct, mix, shingles, sort_within, words

WORDS = 5
SKETCH_BITS, SKETCH_BLOCKS = 20, 16
SMALL_LIST = 8
BLOCK, BLOCK_ELEMENTS, COLUMNS = 256, 1 << 18, 4096
DESCRIBED = "doc_id long, key long, n_shingles long, sig long, parity binary, block int, counts binary"


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, offsets = words(texts)
    values, offsets, _ = shingles(hashes, offsets, WORDS)
    return distinct(values, offsets)


def _signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 for an empty one."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), dtype=np.uint64)
    some = sizes > 0
    if some.any():
        sums = np.add.reduceat(mix(values + np.uint64(0x51ED2701)), offsets[:-1][some])
        out[some] = mix(sums + sizes[some].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


def _parities(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each set a bitmap of 64 bits at least, else the power of two from its size on: bit i is the parity of the elements that hash to i."""
    sizes = np.diff(offsets)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    edges = np.concatenate([[0], np.cumsum(bits)])
    spots = (mix(values + np.uint64(0x2545F491)) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    flips = np.bincount(spots + np.repeat(edges[:-1], sizes), minlength=edges[-1]) & 1
    packed = np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.int64()), ("parity", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])
    for big in batches:
        for batch in slices(big, 4096):
            values, offsets = _sets(batch["text"])
            sig = _signatures(values, offsets)
            _, one = np.unique(sig, return_index=True)  # copies count once in a batch
            first = np.zeros(len(sig), dtype=bool)
            first[one] = True
            counted = values[np.repeat(first, np.diff(offsets))]
            sketch += np.bincount((counted & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
            n = len(sig)
            yield pa.record_batch([batch["doc_id"], batch["key"], np.diff(offsets), sig, pa.array(_parities(values, offsets), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
    if sketch.any():
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, SKETCH_BLOCKS)]
        none = pa.nulls(SKETCH_BLOCKS, pa.int64())
        yield pa.record_batch([none, none, none, none, pa.nulls(SKETCH_BLOCKS, pa.binary()), pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)


def _add_blocks(key: tuple, group: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCKS, dtype=np.uint64)
    for x in group["counts"]:
        total += np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint32)
    total = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "counts"])


def _levels(sketch: DataFrame, fan_in: int = 64) -> np.ndarray:
    """How far above chance each sketch counter is, 0 for most: a megabyte, whatever the input.

    The tasks' sketches are added in two steps, so no task adds more than about the square root of them.
    """
    halves = sketch.withColumn("lot", F.pmod(F.xxhash64("counts"), F.lit(fan_in)).cast("int"))
    halves = halves.groupBy("block", "lot").applyInArrow(_add_blocks, "block int, counts binary")
    rows = halves.groupBy("block").applyInArrow(_add_blocks, "block int, counts binary").collect()  # SKETCH_BLOCKS rows
    counts = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS))
    for r in rows:
        counts[r.block] = np.frombuffer(zlib.decompress(r.counts), dtype=np.uint32)
    counts = counts.ravel()
    mean = counts.mean()
    over = counts - mean - 8 * np.sqrt(mean) - 8
    return np.where(over > 0, 1 + np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


def _ordered(values: np.ndarray, offsets: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Each set's elements in the global order: rare first, then by hash."""
    level = levels[(values & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64)
    keys = (level << np.uint64(58)) | (mix(values) >> np.uint64(6))
    return sort_within(keys, offsets)


def _index(levels: np.ndarray, buckets: int):
    """Postings of the prefixes, packed: token (40 bits), set in this batch (16), block of position (8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = np.zeros(0, dtype=np.int64)
        for big in batches:
            for batch in slices(big, 4096):
                values, offsets = _sets(batch["text"])
                sig = _signatures(values, offsets)
                _, one = np.unique(sig, return_index=True)
                keep = np.zeros(len(sig), dtype=bool)
                keep[one] = True
                keep &= (sig != 0) & ~np.isin(sig, done)
                done = np.unique(np.append(done, sig[keep]))[: 1 << 20]
                sizes = np.diff(offsets)
                values, sizes, sig = values[np.repeat(keep, sizes)], sizes[keep], sig[keep]
                if not len(sig):
                    continue
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                keys = _ordered(values, offsets, levels)
                prefix = sizes - (3 * sizes + 3) // 4 + 1
                owner = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(keys)) - offsets[owner]
                inside = place < prefix[owner]
                keys, owner, place = keys[inside], owner[inside], place[inside]
                spread = mix(keys)
                bucket = (spread >> np.uint64(40)) % np.uint64(buckets)
                block = (place * 256 // prefix[owner]).astype(np.uint64)
                packed = (spread << np.uint64(24)) | (owner.astype(np.uint64) << np.uint64(8)) | block
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
                packed = packed[order]
                out = []
                for k in np.flatnonzero(np.diff(edges)):
                    mine = np.sort(packed[edges[k] : edges[k + 1]])
                    local = ((mine >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)
                    used, back = np.unique(local, return_inverse=True)
                    mine = (mine & ~np.uint64(0xFFFF00)) | (back.astype(np.uint64) << np.uint64(8))
                    out.append((int(k), mine.tobytes(), sig[used].tobytes(), sizes[used].astype(np.int32).tobytes()))
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int32())] + [pa.array([x[j] for x in out], pa.binary()) for j in (1, 2, 3)], names=["bucket", "postings", "sigs", "sizes"])

    return run


def _probe(group: pa.Table) -> pa.Table:
    """Pairs worth computing from one bucket of index lists: (a, b, family); family is 1 where a leads a list that has b, 0 for a pair of a short list."""
    tokens, sets, sizes, blocks = [], [], [], []
    for p, s, n in zip(group["postings"], group["sigs"], group["sizes"], strict=True):
        p = np.frombuffer(p.as_py(), dtype=np.uint64)
        local = ((p >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)
        tokens.append(p >> np.uint64(24))
        blocks.append((p & np.uint64(0xFF)).astype(np.int64))
        sets.append(np.frombuffer(s.as_py(), dtype=np.int64)[local])
        sizes.append(np.frombuffer(n.as_py(), dtype=np.int32)[local].astype(np.int64))
    token, sig, size, block = (np.concatenate(x) for x in (tokens, sets, sizes, blocks))
    order = np.lexsort((sig, token))
    token, sig, size, block = token[order], sig[order], size[order], block[order]
    keep = np.ones(len(token), dtype=bool)
    keep[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])  # copies that several tasks indexed
    token, sig, size, block = token[keep], sig[keep], size[keep], block[keep]
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    lengths = np.diff(np.append(starts, len(token)))
    member = np.repeat(lengths, lengths)
    prefix = size - (3 * size + 3) // 4 + 1
    after = size - (block * prefix + 255) // 256 - 1  # most elements that can follow any posting of this block
    left, right, kind = [], [], []
    big = (member > SMALL_LIST) & (np.arange(len(token)) != np.repeat(starts, lengths))
    left.append(np.repeat(sig[starts], lengths)[big])
    right.append(sig[big])
    kind.append(np.ones(big.sum(), dtype=np.int8))
    for step in range(1, SMALL_LIST):
        i = np.flatnonzero((member[:-step] <= SMALL_LIST) & (token[step:] == token[:-step])) if len(token) > step else np.zeros(0, np.int64)
        j = i + step
        need = (3 * (size[i] + size[j]) + 6) // 7
        ok = (1 + np.minimum(after[i], after[j]) >= need) & (4 * np.minimum(size[i], size[j]) >= 3 * np.maximum(size[i], size[j]))
        left.append(sig[i[ok]])
        right.append(sig[j[ok]])
        kind.append(np.zeros(ok.sum(), dtype=np.int8))
    a, b, k = (np.concatenate(x) for x in (left, right, kind))
    order = np.lexsort((k, b, a))
    a, b, k = a[order], b[order], k[order]
    keep = np.ones(len(a), dtype=bool)
    keep[:-1] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.table([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64()), pa.array(k[keep].astype(np.int32), pa.int32())], names=["a", "b", "family"])


def _emit_sets(bitmap: bytes):
    """The sets of texts whose bit is set, as sorted 64-bit integers, with their signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, dtype=np.uint32)
        for batch in batches:
            spot = batch["spot"].to_numpy(zero_copy_only=False)
            ok = (bits[spot // 32] >> (spot % 32).astype(np.uint32)) & np.uint32(1) == 1
            batch = batch.filter(pa.array(ok))
            for part in slices(batch, 512):
                values, offsets = _sets(part["text"])
                blobs = [values[offsets[i] : offsets[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.record_batch([part["key"], pa.array(_signatures(values, offsets)), pa.array(blobs, pa.binary())], names=["key", "sig", "elements"])

    return run


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    """A parity bitmap of the same set with fewer bits."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """open: the pair may link."""
    for batch in batches:
        n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
        differ = np.zeros(batch.num_rows, dtype=np.int64)
        for i, (x, y) in enumerate(zip(batch["parity_a"], batch["parity_b"], strict=True)):
            x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            size = min(len(x), len(y))
            differ[i] = np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()
        differ = np.maximum(differ, np.abs(n_a - n_b))
        total = n_a + n_b
        shared = (total - differ) // 2
        yield pa.record_batch([*(batch[c] for c in ("a", "b", "family", "key_a", "key_b", "n_a", "n_b")), pa.array(100 * shared >= 75 * (total - shared))], names=["a", "b", "family", "key_a", "key_b", "n_a", "n_b", "open"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of two sets that link."""
    for batch in batches:
        linked = []
        for x, y in zip(batch["left_set"], batch["right_set"], strict=True):
            x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
            small, large = (y, x) if len(x) > len(y) else (x, y)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            shared = int((large[at] == small).sum())
            linked.append(100 * shared >= 75 * (len(x) + len(y) - shared))
        yield pa.record_batch([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))


def _may_tie(group: pa.Table) -> pa.Table:
    """The rows of a block whose sizes and bitmaps let them link with one of another component (and side, where there are two), without the bitmaps."""
    side, c, n = (group[x].to_numpy() for x in ("side", "c", "n"))
    maps = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group["parity"]]
    words = np.array([len(x) for x in maps])
    may = np.zeros(len(maps), dtype=bool)
    for size in np.unique(words):
        own, near = np.flatnonzero(words == size), np.flatnonzero((words == size) | (words == 2 * size))  # sets that link are alike in size
        left, right = np.array([maps[k] for k in own]), np.array([_folded(maps[k], size) for k in near])
        step = max(1, (1 << 18) // right.size)
        for k in range(0, len(own), step):
            some = own[k : k + step, None]
            differ = np.bitwise_count(left[k : k + step, None] ^ right[None]).sum(axis=2, dtype=np.int64)
            total = n[some] + n[near]
            shared = (total - np.maximum(differ, np.abs(n[some] - n[near]))) // 2
            able = (100 * shared >= 75 * (total - shared)) & (c[some] != c[near])
            if side.any():
                able &= side[some] != side[near]
            may[own[k : k + step]] |= able.any(axis=1)
            may[near] |= able.any(axis=0)
    return group.select(["f", "i", "j", "side", "x", "key", "c"]).filter(pa.array(may))


def _tied(group: pa.Table) -> pa.Table:
    """(a, b): components a that a block's links tie to a component b, the least of those that they tie together.

    Rows of side 0 are held against those of side 1, or each other where there are none.
    """
    side = group["side"].to_numpy()
    component, back = np.unique(group["c"].to_numpy(), return_inverse=True)
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in group["elements"]]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.flatnonzero(side == 0)
    others = np.flatnonzero(side == 1) if side.any() else rows
    times = [np.bincount(column[(side == k)[owner]], minlength=column.max() + 1) for k in (0, 1)]
    met = (times[0] > 0) & (times[1] > 0) if side.any() else times[0] > 1
    number = np.cumsum(met) - 1
    owner, column = owner[met[column]], number[column[met[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(rows), len(others)), dtype=np.float32)  # whole numbers far under 2**24
    edges = np.searchsorted(column, np.arange(0, met.sum() + COLUMNS, COLUMNS))
    for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        present = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        present[owner[x:y], column[x:y] - k * COLUMNS] = 1
        shared += present[rows] @ present[others].T
    whole = sizes[rows][:, None] + sizes[others][None, :] - shared.astype(np.int64)
    i, j = np.nonzero(100 * shared.astype(np.int64) >= 75 * whole)
    tied = np.zeros((len(component), len(component)), dtype=bool)
    tied[back[rows[i]], back[others[j]]] = True
    tied |= tied.T
    least = np.full(len(component), -1)
    for k in range(len(component)):
        found = np.array([k]) if least[k] < 0 else np.zeros(0, dtype=np.int64)
        while len(found):
            least[found] = k
            found = np.flatnonzero(tied[found].any(axis=0) & (least < 0))
    some = np.flatnonzero(least != np.arange(len(component)))
    return pa.table([pa.array(component[some]), pa.array(component[least[some]])], names=["a", "b"])


class Sets:
    """The whole sets that are needed, fetched once each."""

    def __init__(self, source: DataFrame):
        self.spotted = source.withColumn("spot", F.pmod(F.xxhash64("key"), F.lit(1 << 23))).select("key", "text", "spot")
        self.sets = self.fetched = None

    def of(self, wanted: DataFrame) -> DataFrame:
        """(sig, elements) of wanted (sig, key), among others."""
        wanted = cut(wanted if self.fetched is None else wanted.join(self.fetched.hint("merge"), "sig", "left_anti"), "wanted")
        if self.sets is None or wanted.take(1):
            more = self.spotted.mapInArrow(released(_emit_sets(id_filter(wanted, "key"))), "key long, sig long, elements binary").join(wanted.hint("merge"), ["key", "sig"]).select("sig", "elements")
            more = cut(more.dropDuplicates(["sig"]), "sets", "none")
            self.sets = more if self.sets is None else self.sets.unionByName(more)
            self.fetched = wanted.select("sig") if self.fetched is None else self.fetched.unionByName(wanted.select("sig"))
        return self.sets


def _screen(pairs: DataFrame, lead: DataFrame) -> DataFrame:
    sides = [lead.select(F.col("sig").alias(x), F.col("key").alias(f"key_{x}"), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"parity_{x}")) for x in ("a", "b")]
    joined = pairs.join(sides[0].hint("merge"), "a").join(sides[1].hint("merge"), "b").select("a", "b", "family", "key_a", "key_b", "n_a", "n_b", "parity_a", "parity_b")
    return cut(joined.mapInArrow(released(_screened), "a long, b long, family int, key_a long, key_b long, n_a long, n_b long, open boolean"), "screened")


def _links(screened: DataFrame, sets: Sets) -> DataFrame:
    """The pairs (a, b) that link; only open pairs are computed.

    Rows carry two sets, so Arrow batches are kept short meanwhile.
    """
    spark = screened.sparkSession
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("sig"), F.col(f"key_{x}").alias("key")) for x in ("a", "b")]))
    whole = sets.of(screened.where("open").select(ends.alias("s")).select("s.*").distinct())
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "256")
    try:
        joined = screened.where("open").join(whole.select(F.col("sig").alias("a"), F.col("elements").alias("left_set")).hint("merge"), "a").join(whole.select(F.col("sig").alias("b"), F.col("elements").alias("right_set")).hint("merge"), "b")
        return cut(joined.select("a", "b", "left_set", "right_set").mapInArrow(released(_overlaps), "a long, b long"), "pairs")
    finally:
        spark.conf.set(key, before)


def _parts(many: str, elements: str):
    """How many blocks so many sets and elements are dealt to."""
    return F.greatest(F.ceil(F.col(many) / BLOCK), F.ceil(F.col(elements) / BLOCK_ELEMENTS)).cast("int")


def _settle(families: DataFrame, labels: DataFrame, lead: DataFrame, sets: Sets) -> DataFrame:
    """The components (id, component) after all links inside families.

    families: f (first leader), x, n (size of x). labels: the components of what is linked so far.
    First each block of a family that isn't connected yet is held against itself,
    then in families of several blocks each lot of loose members against every block.
    """
    for across in (False, True):
        placed = families.join(labels.withColumnRenamed("id", "x").hint("merge"), "x", "left").withColumn("c", F.coalesce("component", "x")).drop("component")
        placed = cut(placed, "placed")
        parts = placed.groupBy("f", "c").agg(F.count("*").alias("many"), F.sum("n").alias("elements"))
        apart = parts.groupBy("f").agg(F.count("*").alias("parts"), F.sum("many").alias("all_many"), F.sum("elements").alias("all_elements"), F.max(F.struct("many", "c", "elements")).alias("main")).where("parts > 1")
        apart = apart.select("f", "main.c", _parts("all_many", "all_elements").alias("blocks"), (F.col("all_many") - F.col("main.many")).alias("loose"), (F.col("all_elements") - F.col("main.elements")).alias("loose_elements"))
        apart = apart.select("f", F.col("c").alias("main"), "blocks", _parts("loose", "loose_elements").alias("lots"))
        tidy(labels.sparkSession)
        members = cut(placed.join((apart.where("blocks > 1") if across else apart).hint("merge"), "f"), "members")
        if not members.take(1):
            break
        members = members.join(lead.select(F.col("sig").alias("x"), "key", "parity").hint("merge"), "x")
        block, lot = (F.pmod(F.xxhash64("x"), F.col(k)).cast("int") for k in ("blocks", "lots"))
        if across:
            loose = members.where("c <> main").withColumns({"i": lot, "j": F.explode(F.expr("sequence(0, blocks - 1)")), "side": F.lit(0)})
            rows = loose.unionByName(members.withColumns({"j": block, "i": F.explode(F.expr("sequence(0, lots - 1)")), "side": F.lit(1)}))
        else:
            rows = members.withColumns({"i": block, "j": block, "side": F.lit(0)})
        rows = rows.select("f", "i", "j", "side", "x", "key", "c", "n", "parity").groupBy("f", "i", "j").applyInArrow(_may_tie, "f long, i int, j int, side int, x long, key long, c long")
        rows = cut(rows, "able")
        tidy(labels.sparkSession)
        if not rows.take(1):
            continue
        whole = rows.join(sets.of(rows.select(F.col("x").alias("sig"), "key").distinct()).withColumnRenamed("sig", "x").hint("merge"), "x")
        ties = cut(whole.select("f", "i", "j", "side", "c", "elements").groupBy("f", "i", "j").applyInArrow(_tied, "a long, b long"), "ties")
        if ties.take(1):
            labels = merged_components(labels, ties, "a", "b")
        tidy(labels.sparkSession)
    return labels


def jaccard_labels(docs: DataFrame, null_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """(described, labels): doc_id, key (text hash), n_shingles and sig of each row; the components (id, component) of all linked set signatures.

    Rows without a doc_id are indexed only if null_ids is set.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    both = cut(source.mapInArrow(released(_describe), DESCRIBED), "described")
    described = both.where("block is null").select("doc_id", "key", "n_shingles", "sig")
    levels = _levels(both.where("block is not null").select("block", "counts"))
    total = described.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = int(max(4, min(1 << 20, total // 2_000_000)))
    wanted = "true" if null_ids else "doc_id is not null"
    index = source.where(wanted).select("text").mapInArrow(released(_index(levels, buckets)), "bucket int, postings binary, sigs binary, sizes binary")
    found = index.groupBy("bucket").applyInArrow(_probe, "a long, b long, family int")
    pairs = cut(found.groupBy("a", "b").agg(F.max("family").alias("family")), "candidates")
    tidy(docs.sparkSession)
    named = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    each = both.where("block is null and sig <> 0").where(wanted).groupBy("sig").agg(F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.first("parity").alias("parity"))
    lead = cut(each.join(named.hint("merge"), "sig"), "named")
    screened = _screen(pairs, lead)
    tidy(docs.sparkSession)
    sets = Sets(source.where(wanted))
    labels = connected_components(_links(screened, sets), "a", "b")
    tidy(docs.sparkSession)
    led = screened.where("family = 1")
    families = led.select(F.col("a").alias("f"), F.col("b").alias("x"), F.col("n_b").alias("n"))
    families = families.unionByName(led.groupBy(F.col("a").alias("f")).agg(F.first("n_a").alias("n")).withColumn("x", F.col("f")))
    return described, _settle(families, labels, lead, sets)


def _labelled(described: DataFrame, labels: DataFrame) -> DataFrame:
    """described with label: one of the signatures of the row's group, null for an empty set."""
    labels = labels.select(F.col("id").alias("sig"), F.col("component").alias("label"))
    return described.join(labels, "sig", "left").withColumn("label", F.when(F.col("sig") != 0, F.coalesce("label", "sig")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of every row of docs."""
    placed = _labelled(*jaccard_labels(docs))
    least = placed.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "label", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of copies and near copies, with all columns; rows without words stay.

    Only ids and hashes are grouped; texts stay where they are but for rows of equal id and text.
    """
    placed = _labelled(*jaccard_labels(docs, null_ids=True)).where("label is not null")
    rows = cut(placed.groupBy("label", "doc_id", "key").agg(F.count("*").alias("many")), "rows")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first"))
    judged = rows.join(first, "label").withColumn("stays", F.expr("doc_id <=> first.doc_id and key = first.key")).where("not stays or many > 1")
    judged = judged.select(F.col("doc_id").alias("judged_id"), F.col("key").alias("judged_key"), "stays")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("text").cast("string")).alias("own_key"))
    met = whole.join(judged, F.col("own_id").eqNullSafe(F.col("judged_id")) & (F.col("own_key") == F.col("judged_key")), "left")
    single = met.where("stays is null").select("row.*")
    repeated = met.where("stays").groupBy("own_id", "own_key").agg(F.first("row").alias("row")).select("row.*")
    return single.unionByName(repeated)
