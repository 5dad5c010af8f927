"""Hard negatives by an inverted multi-index: exact top lists and score windows of integer inner products.

A vector falls into two halves.  A codebook of each half (k-means on a bounded
sample) gives a pair of codes, its cell.  The index holds all rows, sorted by cell
and cut to blocks of BLOCK rows; each block knows its cells and, for each code of a
half, the radius: how far its members lie from the centre at most.  For a query,
<q, centre> + |q| radius bounds the score of each half from above.  The half bounds
are sorted, and a heap walks the cells from the largest sum downward (the
multi-sequence order), so the walk stops as soon as no cell that is left can reach
what has been found: a window of results is then certified.  Bounds are widened by
SLACK for their rounding, scores are integers, so results are exact and the codebooks decide the
cost alone.

Anchors are the queries.  They go out in lots of LOT, each broadcast (a fixed
number of bytes); blocks answer for themselves, a task keeps the best of its blocks
(and prunes by them), and the tasks' lists are merged.  First come the positives,
then, with a window for each positive's score, the negatives.

Defined cases: rows with a null id, label or vector, an empty vector, or a component
that is null, not finite or (after scaling) LARGEST or more in magnitude take no
part. A vector shorter than the longest counts as continued by zeros. Ties go to the
smaller id. Several rows of one anchor's id are one anchor (the one with the least
label, then vector), and never its own positives or negatives; other repeated rows
count as often as they occur. An anchor without positives gives no rows, a positive
without negatives neither. Extra columns don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.common import cut, released

#: Rows of a block, anchors of a lot, centres of a half, and rows of the sample that these are fitted on.
BLOCK = 1 << 14
LOT = 1 << 13
CENTRES = 24
SAMPLE = 1 << 14
ROUNDS = 8
LARGEST = 1 << 27
SLACK = 1e-9
INDEX = "id long, label long, vector binary, code int"


def integers(rows: DataFrame, vector: str, scale: int) -> tuple:
    """Columns (components as long, whether the row takes part)."""
    big = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * scale < LARGEST))
    return big, F.coalesce(fine, F.lit(False))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows, continued by zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def centres(points: np.ndarray, most: int = CENTRES, rounds: int = ROUNDS) -> np.ndarray:
    """k-means by Lloyd's rounds from distinct points that are spread over the sample's order."""
    points = np.unique(points, axis=0).astype(np.float64)
    if not len(points):
        return np.zeros((1, points.shape[1]))
    out = points[np.random.default_rng(5).permutation(len(points))[:most]].copy()
    for _ in range(rounds):
        code = nearest(points, out)
        for k in range(len(out)):
            mine = points[code == k]
            if len(mine):
                out[k] = mine.mean(axis=0)
    return out


def nearest(points: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """The closest centre of each point."""
    out = np.empty(len(points), dtype=np.int64)
    for at in range(0, len(points), 4096):
        part = points[at : at + 4096]
        out[at : at + 4096] = np.argmin((middle * middle).sum(axis=1) - 2 * part @ middle.T, axis=1)
    return out


class Block:
    """Rows of the index, sorted by cell; each half's codes with their centres and radii."""

    def __init__(self, ids, labels, vectors, codes, books):
        half = vectors.shape[1] // 2
        order = np.lexsort((ids, codes))
        self.ids, self.labels, self.vectors, codes = ids[order], labels[order], vectors[order], codes[order]
        first, second = codes // len(books[1]), codes % len(books[1])
        self.halves = []
        for own, book, part in ((first, books[0], self.vectors[:, :half]), (second, books[1], self.vectors[:, half:])):
            used, row = np.unique(own, return_inverse=True)
            away = np.sqrt(((part - book[own]) ** 2).sum(axis=1))
            radius = np.zeros(len(used))
            np.maximum.at(radius, row, away)
            self.halves.append((used, book[used], radius))
        cells, heads = np.unique(codes, return_index=True)
        place = {int(c): k for k, c in enumerate(self.halves[0][0])}, {int(c): k for k, c in enumerate(self.halves[1][0])}
        self.edges = np.append(heads, len(codes))
        self.cells = {(place[0][int(c) // len(books[1])], place[1][int(c) % len(books[1])]): k for k, c in enumerate(cells)}

    def bounds(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Upper and lower bounds of the half scores of each code: (upper, lower) of the first, (upper, lower) of the second half."""
        half, out = self.vectors.shape[1] // 2, []
        for q, (_, middle, radius) in zip((query[:half], query[half:]), self.halves, strict=True):
            score, reach = middle @ q, np.sqrt(float(q @ q)) * radius
            slack = SLACK * (np.abs(score) + reach + 1) + SLACK
            out += [score + reach + slack, score - reach - slack]
        return tuple(out)


def walk(block: Block, query: np.ndarray, needed: Callable[[float, float], int], take: Callable[[np.ndarray, np.ndarray], None]) -> int:
    """Visit cells from the largest bound downward; take gets (row numbers, scores) of a cell.

    needed(upper, lower) of a cell: 1 to look into it, 0 to pass it by, -1 if no cell with a bound as low as
    this can matter any more. Returns how many cells were looked into.
    """
    up1, low1, up2, low2 = block.bounds(query)
    order1, order2 = np.argsort(-up1, kind="stable"), np.argsort(-up2, kind="stable")
    seen = 0
    heap = [(-(up1[order1[0]] + up2[order2[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        if needed(-bound, -np.inf) < 0:
            break
        a, b = order1[i], order2[j]
        if j + 1 < len(order2):
            heapq.heappush(heap, (-(up1[a] + up2[order2[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(order1):
            heapq.heappush(heap, (-(up1[order1[i + 1]] + up2[order2[0]]), i + 1, 0))
        k = block.cells.get((int(a), int(b)))
        if k is None or needed(-bound, low1[a] + low2[b]) <= 0:
            continue
        low, high = block.edges[k], block.edges[k + 1]
        take(np.arange(low, high), block.vectors[low:high] @ query)
        seen += 1
    return seen


class Best:
    """The first few (score down, id up) of what is offered."""

    def __init__(self, most: int):
        self.most, self.rows = most, []

    def floor(self) -> float:
        """A score below it can't get in."""
        return self.rows[-1][0] if len(self.rows) == self.most else -np.inf

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        first = np.lexsort((ids, -scores))[: self.most]
        both = [*self.rows, *zip(scores[first].tolist(), ids[first].tolist(), strict=True)]
        self.rows = sorted(both, key=lambda r: (-r[0], r[1]))[: self.most]


def same_label(block: Block, anchor: tuple, best: Best) -> None:
    """The anchor's best rows of its own label, its own id left out."""
    own, label, query, _ = anchor

    def take(rows: np.ndarray, scores: np.ndarray) -> None:
        ok = (block.labels[rows] == label) & (block.ids[rows] != own)
        best.offer(scores[ok], block.ids[rows[ok]])

    walk(block, query, lambda upper, lower: 1 if upper >= best.floor() else -1, take)


def in_windows(block: Block, anchor: tuple, bests: list[Best], share: tuple[int, int]) -> None:
    """For each of the anchor's positive scores, the best rows of other labels that score at most as much and at least the share of it."""
    own, label, query, windows = anchor
    tops = np.array(windows, dtype=np.int64)
    least = np.array([-(-share[0] * t // share[1]) for t in windows], dtype=np.int64)  # rounded up

    def needed(upper: float, lower: float) -> int:
        floors = [max(float(low), b.floor()) for low, b in zip(least, bests, strict=True)]
        if upper < min(floors):
            return -1
        return int(any(upper >= f and lower <= t for f, t in zip(floors, tops, strict=True)))

    def take(rows: np.ndarray, scores: np.ndarray) -> None:
        other = (block.labels[rows] != label) & (block.ids[rows] != own)
        rows, scores = rows[other], scores[other]
        for low, top, best in zip(least, tops, bests, strict=True):
            ok = (scores <= top) & (scores >= max(low, best.floor()))
            best.offer(scores[ok], block.ids[rows[ok]])

    if (least <= tops).any():
        walk(block, query, needed, take)


def _indexed(books: tuple[np.ndarray, np.ndarray], width: int):
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch["vector"], width)
            code = nearest(rows[:, :half], books[0]) * len(books[1]) + nearest(rows[:, half:], books[1])
            blob = np.ascontiguousarray(rows).astype("<i4")
            yield pa.record_batch([batch["id"], batch["label"], pa.array([r.tobytes() for r in blob], pa.binary()), pa.array(code.astype(np.int32))], names=["id", "label", "vector", "code"])

    return released(run)


def _blocks(batches: Iterator[pa.RecordBatch], books, width: int) -> Iterator[Block]:
    """The rows of a task in blocks of at most BLOCK rows."""
    held, n = [], 0

    def made() -> Block:
        table = pa.Table.from_batches(held)
        vectors = np.frombuffer(b"".join(table["vector"].to_pylist()), dtype="<i4").reshape(-1, width).astype(np.int64)
        return Block(table["id"].to_numpy(), table["label"].to_numpy(), vectors, table["code"].to_numpy().astype(np.int64), books)

    for big in batches:
        for at in range(0, big.num_rows, BLOCK):
            batch = big.slice(at, BLOCK)
            if n and n + batch.num_rows > BLOCK:
                yield made()
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
    if n:
        yield made()


def _answered(lot, books, width: int, most: int, share: tuple[int, int] | None):
    """Each anchor's best rows of a task: with a share the negatives of each positive's window, else the positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = lot.value
        best = {k: [Best(most) for _ in (a[3] if share else (None,))] for k, a in enumerate(anchors)}
        for block in _blocks(batches, books, width):
            for k, anchor in enumerate(anchors):
                if share:
                    in_windows(block, anchor, best[k], share)
                else:
                    same_label(block, anchor, best[k][0])
        rows = [(anchors[k][0], w, s, i) for k, bests in best.items() for w, b in enumerate(bests) for s, i in b.rows]
        yield pa.record_batch([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["anchor_id", "window", "score", "id"])

    return released(run)


def _merged(found: DataFrame, most: int) -> DataFrame:
    by = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def build_index(rows: DataFrame, width: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """(all rows with their cells, sorted by cell in files of the shared folder; the two codebooks). rows: id, label, vector."""
    sample = rows.select("vector").orderBy(F.xxhash64("id", "vector")).limit(SAMPLE).toArrow()["vector"]
    points, half = _matrix(sample, width), width // 2
    books = centres(points[:, :half]), centres(points[:, half:])
    coded = rows.mapInArrow(_indexed(books, width), INDEX)
    return cut(coded.repartitionByRange("code", "id").sortWithinPartitions("code", "id"), "index"), books


def hard_negatives(embeddings: DataFrame, anchors: str = "vec_id % 100 = 0", scale: int = 256, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: a predicate on vec_id. An anchor's positives are the other rows of its label with the highest scores; a
    positive's negatives are the rows of other labels that score at most as high as it and at least the share of it.
    """
    spark = embeddings.sparkSession
    vector, fine = integers(embeddings, "embedding", scale)
    rows = embeddings.where(fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 2
    width += width % 2
    index, books = build_index(rows, width)
    asked = rows.withColumnRenamed("id", "vec_id").where(anchors).withColumnRenamed("vec_id", "id")
    asked = asked.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("a")).select("id", "a.label", "a.vector")
    lots = max(1, -(-asked.count() // LOT))
    asked = cut(asked.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(lots))), "anchors")
    results = None
    for turn in range(lots):  # a lot is a bounded number of rows; its size is that of a fixed number of vectors, give or take chance
        got = asked.where(F.col("turn") == turn).toArrow()
        known = list(zip(got["id"].to_pylist(), got["label"].to_pylist(), _matrix(got["vector"], width), strict=True)) if got.num_rows else []
        if not known:
            continue
        lot = spark.sparkContext.broadcast([(*a, None) for a in known])
        top = cut(_merged(index.mapInArrow(_answered(lot, books, width, positives, None), "anchor_id long, window long, score long, id long"), positives), "positives")
        windows: dict[int, list[tuple[int, int]]] = {}
        for r in top.select("anchor_id", "rank", "score", "id").collect():  # a few rows for each anchor of a lot
            windows.setdefault(r.anchor_id, []).append((r.rank, r.score))
        lot = spark.sparkContext.broadcast([(*a, [s for _, s in sorted(windows[a[0]])]) for a in known if a[0] in windows])
        found = _merged(index.mapInArrow(_answered(lot, books, width, negatives, share), "anchor_id long, window long, score long, id long"), negatives)
        pairs = top.select("anchor_id", (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        part = cut(found.join(pairs, ["anchor_id", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        results = part if results is None else results.unionByName(part)
    if results is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return results


def shifted_labels(embeddings: DataFrame) -> DataFrame:
    """embeddings with a label made wrong where vec_id is divisible by 7."""
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
