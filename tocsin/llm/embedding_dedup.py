"""Near-duplicate vectors: randomised-rotation binary codes with correction factors.

A unit vector is rotated by a random orthogonal matrix; its code is the signs of
the result, its factor the inner product of the code (as a unit vector) with the
rotated vector.  For another rotated vector q, <code, q> / factor estimates the
cosine without bias, and its error stays within ``EPSILON * sqrt((1 - f*f) / (f*f
* (d - 1)))`` but with negligible probability.  Only pairs whose estimate plus
bound reaches the cosine asked for are computed exactly, in double precision.

Pairs are looked for in buckets of rotated sign bits: ``tables`` times ``bits``,
with bits so that a bucket holds about ``BUCKET`` vectors and tables so that a
pair of that cosine meets in none with a probability of at most ``MISS``.  Both
follow from the number of vectors, so work grows as its power 1.15.  Equal
vectors are one class from the start.  A bucket of over ``BLOCK`` classes is cut
into blocks, and each pair of blocks is a group of its own, so no task gets a
hot bucket whole.  A group returns at most one row for each of its vectors (how
many it links with, and one connecting edge), never its pairs; a pair that meets
in several tables counts in the first.

Defined cases: null, empty and all-zero vectors, and those with null or
non-finite components, link with nothing.  Vectors of different lengths don't
link.  Repeated rows each count as a vector; a null vec_id is a row of its own
that links with nothing.  Extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import connected_components, cut

COSINE = 0.95
EPSILON = 4.0
BUCKET, BLOCK, MISS, SEED = 64, 1024, 1e-5, 7
VALID = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"


def plan(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = max(0, min(30, round(math.log2(max(n, 1) / BUCKET))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(MISS) / math.log(1 - meet))


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component goes first, so squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kind(bits: int) -> type:
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.int32


def _hashed(d: int, bits: int, tables: int, single: bool):
    """A row for each vector and table: bucket, all its buckets, and the vector as it was given (four bytes a component if single)."""
    planes = np.random.default_rng([SEED + 1, d, bits, tables]).standard_normal((d, tables * bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                batch = big.slice(at, 1024)
                given = _matrix(batch["embedding"], d).astype(np.float32 if single else np.float64)
                x = unit(given.astype(np.float64))
                n = len(x)
                signs = (x @ planes > 0).reshape(n, tables, bits)
                buckets = (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
                rows, table = np.repeat(np.arange(n), tables), np.tile(np.arange(tables, dtype=np.int32), n)
                width = d * given.itemsize
                raw, every = given.tobytes(), buckets.astype(_kind(bits)).tobytes()
                size = len(every) // n
                vectors, keys = [raw[i * width : (i + 1) * width] for i in range(n)], [every[i * size : (i + 1) * size] for i in range(n)]
                yield pa.record_batch(
                    [batch["vec_id"].take(pa.array(rows)), batch["copies"].take(pa.array(rows)), pa.array(table), pa.array(buckets.ravel()), pa.array(keys, pa.binary()).take(pa.array(rows)), pa.array(vectors, pa.binary()).take(pa.array(rows))],
                    names=["vec_id", "copies", "tab", "bucket", "buckets", "vector"],
                )

    return run


def _pairs(x: np.ndarray, y: np.ndarray, turn: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the linked pairs between rows of x and of y."""
    d = x.shape[1]
    rx, ry = x @ turn, y @ turn
    code = np.where(rx > 0, 1.0, -1.0).astype(np.float32) / np.float32(math.sqrt(d))
    factor = (code * rx).sum(axis=1)
    bound = EPSILON * np.sqrt(np.maximum(1 - factor**2, 0) / (factor**2 * max(d - 1, 1)))
    estimate = (code @ ry.T.astype(np.float32)) / factor[:, None].astype(np.float32)
    i, j = np.nonzero(estimate + bound[:, None].astype(np.float32) >= cosine - 1e-4)
    if same:
        i, j = i[i < j], j[i < j]
    exact = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        exact[at : at + (1 << 16)] = np.einsum("nd,nd->n", x[i[at : at + (1 << 16)]], y[j[at : at + (1 << 16)]])
    ok = exact >= cosine
    return i[ok], j[ok]


def _compare(d: int, bits: int, tables: int, cosine: float, single: bool):
    turn = rotation(d)

    def run(group: pa.Table) -> pa.Table:
        ids, copies = group["vec_id"].to_numpy(), group["copies"].to_numpy()
        key = np.stack([group[c].to_numpy() for c in ("bucket", "b0", "b1")], axis=1)
        block, table = group["block"].to_numpy(), int(group["tab"][0].as_py())
        x = unit(np.frombuffer(b"".join(v.as_py() for v in group["vector"]), dtype=np.float32 if single else np.float64).reshape(-1, d).astype(np.float64))
        buckets = np.frombuffer(b"".join(v.as_py() for v in group["buckets"]), dtype=_kind(bits)).reshape(-1, tables)
        order = np.lexsort((ids, key[:, 2], key[:, 1], key[:, 0]))
        key = key[order]
        heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        links, root = np.zeros(len(ids), dtype=np.int64), ids.copy()
        for a, b in zip(heads, np.append(heads[1:], len(key)), strict=True):
            if b - a < 2:
                continue
            rows = order[a:b]
            if key[a, 1] == key[a, 2]:
                left = right = rows
            else:
                left, right = rows[block[rows] == key[a, 1]], rows[block[rows] == key[a, 2]]
            i, j = _pairs(x[left], x[right], turn, cosine, left is right)
            i, j = left[i], right[j]
            if not len(i):
                continue
            first = (buckets[i] == buckets[j]).argmax(axis=1) == table
            np.add.at(links, i[first], copies[j[first]])
            np.add.at(links, j[first], copies[i[first]])
            while True:  # least id reachable within the group
                low = np.minimum(root[i], root[j])
                if (root[i] == low).all() and (root[j] == low).all():
                    break
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
        some = (links > 0) | (root != ids)
        return pa.table([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])], names=["vec_id", "links", "root"])

    return run


def _of_length(classes: DataFrame, d: int, n: int, cosine: float) -> DataFrame:
    """(vec_id, links, root) parts of the classes of one length."""
    bits, tables = plan(n, cosine)
    single = dict(classes.dtypes)["embedding"] == "array<float>"
    rows = classes.where(F.col("d") == d).select("vec_id", "copies", "embedding").mapInArrow(_hashed(d, bits, tables, single), "vec_id long, copies long, tab int, bucket int, buckets binary, vector binary")
    sizes = classes.where(F.col("d") == d).select("vec_id", "copies", "embedding").mapInArrow(_hashed(d, bits, tables, single), "vec_id long, copies long, tab int, bucket int, buckets binary, vector binary")
    hot = sizes.groupBy("tab", "bucket").count().where(f"count > {BLOCK}").select("tab", "bucket", F.expr(f"cast(ceil(count / {BLOCK}) AS int)").alias("blocks"))
    rows = rows.join(hot, ["tab", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(vec_id), blocks) AS int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("b0", F.least("block", "other")).withColumn("b1", F.greatest("block", "other")).withColumn("cell", F.shiftright("bucket", max(0, min(bits, 4))))
    return rows.drop("blocks", "other").groupBy("tab", "cell", "b0", "b1").applyInArrow(_compare(d, bits, tables, cosine, single), "vec_id long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.withColumn("valid", F.coalesce(F.expr(f"vec_id IS NOT NULL AND {VALID}"), F.lit(False)))
    rows = rows.withColumns({"k1": F.expr("if(valid, xxhash64(embedding), NULL)"), "k2": F.expr("if(valid, hash(embedding), NULL)"), "d": F.expr("if(valid, size(embedding), NULL)")})
    classes = cut(rows.where("valid").groupBy("k1", "k2", "d").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "vectors")
    lengths = classes.groupBy("d").count().collect()  # one row for each length of vector that occurs
    parts = [_of_length(classes, r["d"], r["count"], cosine) for r in lengths]
    if parts:
        found = cut(reduce(DataFrame.unionByName, parts), "links")
    else:
        found = classes.sparkSession.createDataFrame([], "vec_id long, links long, root long")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    parent = connected_components(found.where("root <> vec_id"), "vec_id", "root").withColumnRenamed("id", "vec_id")
    of_class = classes.select("k1", "k2", "d", "vec_id", "copies").join(links, "vec_id", "left").join(parent, "vec_id", "left")
    of_class = of_class.select("k1", "k2", "d", F.expr("coalesce(links, 0) + copies - 1").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = rows.select("vec_id", "k1", "k2", "d").join(of_class, ["k1", "k2", "d"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.expr("coalesce(vec_id = component_id, true)"))
