"""Token ids in files: frequency-ranked, byte-aligned variable length, control bytes apart.

The tokenizer splits at white space, and between ASCII letters and ASCII marks
other than the apostrophe, so a text's ids are those of its runs between such
places; each distinct run is encoded once by the tokenizers library and
remembered (runs that differ in capitals are one only if the tokenizer lowers them).  (Where a batch has ``<|``, as special tokens begin, only white space
splits.)  ``end_id`` is appended to every document.

Format.  Ids are replaced by their rank among all ids of the corpus (most
frequent first, ties by id).  A rank takes 1 to 4 bytes, low byte first; four
lengths are packed into a control byte, and control bytes and data bytes are
stored in two separate streams.  A file row is a block of whole documents: shard,
ids of its shard before it, document ids, lengths, control and data.  Shards are
ranges of doc_id, and documents rise within a shard.  Reading looks the four
lengths up in a table of 256 rows, then gathers the bytes; nothing is decoded one
id at a time.

Defined cases: a null or empty text has only the end id.  Equal doc_ids each keep
their row, in the order of their ids' crc32; a null doc_id sorts first.  Extra
columns don't matter.  An empty table gives no files' rows and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm.common import cut, released, shared_path, slices
from tocsin.llm.memo import Memo, ragged
from tocsin.llm.shingles import LOWER, SPACE, buffers, mix, powers, words

END_ID = 2
BLOCK_IDS = 1 << 18
LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], dtype=np.int64)
FILE = "shard int, ids_before long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def solve(data, starts, ends):
        raw = data.tobytes()
        ids, sizes = [], []
        for at in range(0, len(starts), 4096):
            got = tokenizer.encode_batch([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at : at + 4096], ends[at : at + 4096], strict=True)], add_special_tokens=False)
            lists = [x.ids for x in got]
            sizes += map(len, lists)
            ids.append(np.fromiter((i for x in lists for i in x), dtype=np.int32))
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.zeros((len(starts), 0))

    return Memo(solve, 0)


KIND = np.zeros(256, dtype=np.uint8)  # 1 ASCII letter, 2 ASCII mark but the apostrophe, 0 other
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2


@lru_cache(maxsize=2)
def _byte_map(path: str) -> np.ndarray:
    """How bytes are told apart: as the tokenizer does, which may take capital ASCII letters for small ones."""
    from tokenizers import Tokenizer

    normalizer = Tokenizer.from_file(path).normalizer
    folds = normalizer is not None and normalizer.normalize_str("THE") == "the"
    return LOWER if folds else np.arange(256, dtype=np.uint8)


def runs(texts: pa.Array, alike: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, hash, start, end) of the runs of a batch, and the offsets of the texts."""
    data, offsets = buffers(texts)
    if b"<|" in data.tobytes():
        return data, *words(texts, lower=False)
    inside = ~SPACE[data]
    first = inside.copy()
    kind = KIND[data]
    first[1:] &= ~inside[:-1] | (kind[1:] + kind[:-1] == 3)
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return data, np.zeros(0, np.uint64), starts, starts, np.zeros(len(offsets), np.int64)
    reach = np.append(starts[1:], len(data))
    place = np.arange(len(data), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, reach - starts)
    terms = (alike[data].astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place]
    terms[~inside] = 0
    sizes = np.add.reduceat(inside, starts, dtype=np.int64)
    return data, mix(np.add.reduceat(terms, starts) + sizes.astype(np.uint64)), starts, starts + sizes, np.searchsorted(starts, offsets)


def encode(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a batch of texts, each with the end id, and the offsets of the texts."""
    data, hashes, starts, ends, offsets = runs(texts, _byte_map(path))
    keys, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    store = _memo(path)
    rows = store.rows_of(keys, data, starts[one], ends[one])
    ids, places = ragged(store.flat, store.edges, rows[back])
    bounds = places[offsets]
    out = np.empty(len(ids) + len(texts), dtype=np.int32)
    shift = np.repeat(np.arange(len(texts)), np.diff(bounds))
    out[np.arange(len(ids)) + shift] = ids
    new = bounds + np.arange(len(texts) + 1)
    out[new[1:] - 1] = end_id
    return out, new


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of ranks below 2**32."""
    ranks = ranks.astype(np.uint32)
    sizes = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    places = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for k in range(4):
        some = sizes > k
        data[places[some] + k] = (ranks[some] >> np.uint32(8 * k)) & np.uint32(0xFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = sizes - 1
    codes = codes.reshape(-1, 4)
    return (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of two streams."""
    sizes = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    places = np.cumsum(sizes) - sizes
    source = np.frombuffer(data, dtype=np.uint8)
    out = source[places].astype(np.uint32)
    for k in range(1, 4):
        some = np.flatnonzero(sizes > k)
        if not len(some):
            break
        out[some] |= source[places[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encoded(path: str, end_id: int, bounds: np.ndarray):
    """Documents by shard: their ids, compressed, one row for each shard that a batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for big in batches:
            for batch in slices(big, 2048):
                ids, edges = encode(batch["text"], path, end_id)
                docs, missing = batch["doc_id"].fill_null(0).to_numpy(), batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
                shard = np.where(missing, 0, np.searchsorted(bounds, docs))
                rows = []
                for s in np.unique(shard):
                    mine = np.flatnonzero(shard == s)
                    part, places = ragged(ids, edges, mine)
                    kind = np.uint16 if part.max() < 65536 else np.uint32
                    rows.append((int(s), docs[mine].tobytes(), missing[mine].tobytes(), np.diff(places).tobytes(), np.dtype(kind).itemsize, squeeze.compress(part.astype(kind).tobytes())))
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.int32()), pa.array([r[5] for r in rows], pa.binary())], names=["shard", "docs", "missing", "lengths", "width", "ids"])

    return released(run)


def _ids(width: int, blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint16 if width == 2 else np.uint32).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for w, blob in zip(batch["width"], batch["ids"], strict=True):
            more = np.bincount(_ids(w.as_py(), blob.as_py()))
            if len(more) > len(total):
                total = np.append(total, np.zeros(len(more) - len(total), dtype=np.int64))
            total[: len(more)] += more
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["id", "n"])


def _packed(rank: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        docs = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in group["docs"]])
        missing = np.concatenate([np.frombuffer(x.as_py(), dtype=bool) for x in group["missing"]])
        sizes = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in group["lengths"]])
        ids = np.concatenate([_ids(w.as_py(), x.as_py()) for w, x in zip(group["width"], group["ids"], strict=True)])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        order = np.lexsort((crc, docs, ~missing))
        block = (np.cumsum(sizes[order]) - sizes[order]) // BLOCK_IDS
        rows, before = [], 0
        for k in np.unique(block):
            mine = order[block == k]
            part, _ = ragged(ids, edges, mine)
            rows.append((shard, before, pa.array(docs[mine], mask=missing[mine]), sizes[mine], *pack(rank[part])))
            before += len(part)
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.binary()), pa.array([r[5] for r in rows], pa.binary())], names=[x.split()[0] for x in FILE.split(", ")])

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID) -> tuple[str, np.ndarray]:
    """Write all documents' ids under out; returns (out, id of each rank)."""
    path = tokenizer or default_tokenizer()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = max(8, 2 * source.rdd.getNumPartitions())
    cuts = source.select("doc_id").agg(F.percentile_approx("doc_id", F.array(*[F.lit(k / shards) for k in range(1, shards)]), F.lit(10_000))).first()[0]
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))
    encoded = cut(source.mapInArrow(_encoded(path, end_id, bounds), "shard int, docs binary, missing binary, lengths binary, width int, ids binary"), "encoded", "none")
    counts = encoded.select("width", "ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most one row for each id of the vocabulary
    by_rank = np.array([r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))], dtype=np.int64)
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype=np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    encoded.groupBy("shard").applyInArrow(_packed(rank), FILE).write.option("compression", "zstd").parquet(out)
    return out, by_rank


def read_token_files(spark: SparkSession, path: str, by_rank: np.ndarray, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document in the files; without ids none is handed to the JVM."""
    files = spark.read.schema(FILE).parquet(path)
    totals = files.select("shard", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).collect()  # one row a shard
    before, base = 0, {}
    for r in sorted(totals, key=lambda r: r.shard):
        base[r.shard] = before
        before += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, sizes = batch["doc_ids"][i].values, batch["lengths"][i].values.to_numpy()
                ids = by_rank[unpack(batch["control"][i].as_py(), batch["data"][i].as_py(), int(sizes.sum()))].astype("<u4")
                edges = np.concatenate([[0], np.cumsum(sizes)])
                start = base[batch["shard"][i].as_py()] + batch["ids_before"][i].as_py() + edges[:-1]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                out = {"doc_id": docs, "start": pa.array(start), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.record_batch(list(out.values()), names=list(out))

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files to the shared folder, read them back, and describe each document."""
    spark = docs.sparkSession
    out, by_rank = write_token_files(docs, shared_path(spark, "token-files"), tokenizer)
    return read_token_files(spark, out, by_rank, with_ids=False)
