"""SentencePiece N-best encoding, and decoding, over the piece lattice of whole texts.

The pieces and scores come from a public model file (path is a parameter); a
segmentation's score is the sum of its pieces' scores.  A text is preceded by
one space, spaces are the piece marker, and nothing else is changed.  A
character that is no piece falls back to its bytes, each at ``worst - 10``.

The lattice of a text falls apart into segments where no piece can cross: before
each run of spaces, and around bytes that occur in no longer piece.  Forward
Viterbi scores of every distinct segment of a batch are found with numpy.  The
N-best search runs backward from the end with A*: the forward scores are exact
estimates of what is left, so the first N finished paths are the N best.  It is
used twice: over the pieces of a segment, and over a text's chain of segments.
Only the N-1 segments that lose least by a second choice can differ in an N-best
path (any other change has N-1 changes that cost no more), so the chain holds
those; segments that tie are taken in text order.

Defined cases: a null or empty text has no pieces, score 0 and one (empty)
segmentation.  Rows are kept one for one, repeated ids included; a null id stays.
Extra columns don't matter.  Decoding undoes encoding exactly, for every text.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tocsin.llm.common import free_name, released, slices
from tocsin.llm.memo import Memo, ragged
from tocsin.llm.shingles import BASE, buffers, hashed_runs, mix, powers

MARK = "▁"
UNKNOWN_PENALTY = 10.0
LONGEST_BATCHED = 64
#: Bytes of text whose lattice is held at once.
SLICE = 1 << 20
NBEST = 4


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary as byte strings, with a hash table that numpy can probe."""

    PROBES = (43, 22, 1)

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.ids: dict[bytes, int] = {}
        self.score = np.zeros(n)
        for i in range(n):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:-1], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
                self.ids[self.bytes[i]] = i
                self.score[i] = sp.get_score(i)
        self.worst = min(self.score[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        self.crosses = any(b" " in x.lstrip(b" ") for x in self.ids)
        joined = np.zeros(256, dtype=bool)
        for x in self.ids:
            if len(x) > 1:
                joined[list(x)] = True
        self.alone = ~joined
        self.alone[128:] = False  # parts of longer characters
        self.alone[32] = False
        keys = np.array([self._hash(x) for x in self.ids], dtype=np.uint64)
        values = np.fromiter(self.ids.values(), dtype=np.int64)
        self.table_key, self.table_id = np.zeros(1 << 21, np.uint64), np.full(1 << 21, -1, np.int32)
        for key, value in zip(keys, values, strict=True):
            for shift in self.PROBES:
                if self.table_id[slot := int(key) >> shift & 0x1FFFFF] < 0:
                    self.table_key[slot], self.table_id[slot] = key, value
                    break
            else:
                raise ValueError("the vocabulary doesn't fit its hash table")
        self.flat = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.edges = np.concatenate([[0], np.cumsum([len(x) for x in self.bytes])])

    @staticmethod
    def _hash(x: bytes) -> int:
        h = 0
        for c in x:
            h = (h * BASE + c + 1) & 0xFFFFFFFFFFFFFFFF
        return int(mix(np.array([(h + len(x) * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])

    def find(self, rolled: np.ndarray, length: int) -> np.ndarray:
        """Piece id of each substring from its polynomial hash, -1 if it is none."""
        key = mix(rolled + np.uint64(length * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        out = np.full(len(key), -1, dtype=np.int32)
        for shift in self.PROBES:
            slot = ((key >> np.uint64(shift)) & np.uint64(0x1FFFFF)).astype(np.int64)
            hit = np.flatnonzero(self.table_key[slot] == key)
            out[hit] = self.table_id[slot[hit]]
        return out


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


def lattice(p: Pieces, text: bytes) -> list[list[tuple[int, float, int]]]:
    """edges[end] = (start, score, id) of each piece that ends there."""
    edges: list[list[tuple[int, float, int]]] = [[] for _ in range(len(text) + 1)]
    at = 0
    while at < len(text):
        lead = text[at]
        step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        found = text[at : at + step] in p.ids
        for n in range(1, min(p.longest, len(text) - at) + 1):
            i = p.ids.get(text[at : at + n])
            if i is not None:
                edges[at + n].append((at, float(p.score[i]), i))
        if not found:
            for k in range(at, min(at + step, len(text))):
                edges[k + 1].append((k, p.worst, int(p.byte_id[text[k]])))
        at += step
    return edges


def viterbi(edges: list[list[tuple[int, float, int]]]) -> list[float]:
    """The best score from the start to each place."""
    forward = [0.0] + [-np.inf] * (len(edges) - 1)
    for end in range(1, len(edges)):
        for start, score, _ in edges[end]:
            forward[end] = max(forward[end], forward[start] + score)
    return forward


def backward_a_star(edges: list[list[tuple[int, float, int]]], forward: list[float], n: int) -> list[tuple[float, list[int]]]:
    """The n best paths, best first: (score, labels in forward order).

    Among equal estimates the latest one is followed, so of many tying paths one is walked to its end first.
    """
    heap, pushed, out = [(-forward[-1], 0, len(edges) - 1, 0.0, None)], 0, []
    while heap and len(out) < n:
        _, _, place, behind, path = heapq.heappop(heap)
        if place == 0:
            labels = []
            while path:
                labels.append(path[0])
                path = path[1]
            out.append((behind, labels))
            continue
        for start, score, label in edges[place]:
            if forward[start] > -np.inf:
                pushed += 1
                heapq.heappush(heap, (-(behind + score + forward[start]), -pushed, start, behind + score, (label, path)))
    return out


@lru_cache(maxsize=1 << 13)
def segment_nbest(model: str, segment: bytes, n: int) -> tuple[tuple[float, tuple[int, ...]], ...]:
    edges = lattice(pieces(model), segment)
    return tuple((s, tuple(x)) for s, x in backward_a_star(edges, viterbi(edges), n))


def _batched(p: Pieces, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For segments of one length: best and second-best score, and the best path as (ids, lengths) per end place."""
    n, length = grid.shape
    pw = powers(length + 1)
    rolled = np.zeros((length + 1, n), dtype=np.uint64)
    for j in range(length):
        rolled[j + 1] = rolled[j] * np.uint64(BASE) + grid[:, j].astype(np.uint64) + np.uint64(1)
    best, second = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
    best[0] = 0
    via, step = np.zeros((length + 1, n), dtype=np.int32), np.zeros((length + 1, n), dtype=np.int16)
    known = np.zeros((length, n), dtype=bool)  # the character that begins here is a piece, or this isn't a beginning
    found: dict[tuple[int, int], np.ndarray] = {}
    for k in range(1, min(p.longest, length) + 1):
        for i in range(length - k + 1):
            found[i, k] = p.find(rolled[i + k] - rolled[i] * pw[k], k)
    lead = np.where(grid < 0x80, 1, np.where(grid < 0xC0, 0, np.where(grid < 0xE0, 2, np.where(grid < 0xF0, 3, 4))))
    for i in range(length):
        known[i] = lead[:, i] == 0
        for k in range(1, min(4, length - i) + 1):
            known[i] |= (lead[:, i] == k) & (found[i, k] >= 0)
    spelled = np.zeros((length, n), dtype=bool)  # bytes of characters that are no piece
    for i in range(length):
        for k in range(min(4, length - i)):
            spelled[i + k] |= ~known[i] & (lead[:, i] > k)
    for j in range(1, length + 1):
        for k in range(1, min(p.longest, j) + 1):
            i = j - k
            piece = found[i, k]
            cost = np.where(piece >= 0, p.score[piece], -np.inf)
            options = [(piece, cost)]
            if k == 1:
                options.append((p.byte_id[grid[:, i]].astype(np.int32), np.where(spelled[i], p.worst, -np.inf)))
            for label, cost in options:
                one, two = best[i] + cost, second[i] + cost
                better = one > best[j]
                second[j] = np.where(better, np.maximum(best[j], two), np.maximum(second[j], one))
                best[j] = np.where(better, one, best[j])
                via[j] = np.where(better, label, via[j])
                step[j] = np.where(better, k, step[j])
    return best[-1], second[-1], via, step


def solve(p: Pieces, model: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Of each segment: best score, loss of the second choice, and best ids (flat, with offsets)."""
    m = len(starts)
    sizes = ends - starts
    score, loss = np.zeros(m), np.full(m, np.inf)
    chunks: list[tuple[np.ndarray, np.ndarray]] = []  # (owner, id) in path order
    for length in np.unique(sizes):
        mine = np.flatnonzero(sizes == length)
        if length > LONGEST_BATCHED:
            for k in mine:
                edges = lattice(p, data[starts[k] : ends[k]].tobytes())
                got = backward_a_star(edges, viterbi(edges), 2)
                score[k] = got[0][0]
                loss[k] = got[0][0] - got[1][0] if len(got) > 1 else np.inf
                chunks.append((np.full(len(got[0][1]), k), np.array(got[0][1])))
            continue
        for part in np.array_split(mine, max(1, len(mine) * int(length) ** 2 // 4_000_000)):
            grid = data[starts[part][:, None] + np.arange(length)]
            one, two, via, step = _batched(p, grid)
            score[part], loss[part] = one, one - two
            place, back = np.full(len(part), length), []
            while (place > 0).any():
                live = np.flatnonzero(place > 0)
                back.append((part[live], via[place[live], live]))
                place[live] -= step[place[live], live]
            chunks += back[::-1]
    owner = np.concatenate([x for x, _ in chunks]) if chunks else np.zeros(0, np.int64)
    ids = np.concatenate([x for _, x in chunks]).astype(np.int32) if chunks else np.zeros(0, np.int32)
    ids = ids[np.argsort(owner, kind="stable")]
    return score, loss, ids, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=m))])


@lru_cache(maxsize=2)
def memo(model: str) -> Memo:
    def found(data, starts, ends):
        score, loss, ids, edges = solve(pieces(model), model, data, starts, ends)
        return ids, edges, np.stack([score, loss], axis=1)

    return Memo(found, 2)


def forget() -> None:
    """Drop what a task has worked out; the vocabulary stays."""
    segment_nbest.cache_clear()
    memo.cache_clear()


class Encoded:
    """One batch: pieces of each text, and what the N-best search needs."""

    def __init__(self, texts: pa.Array, model: str):
        p = self.pieces = pieces(model)
        texts = texts.fill_null("") if texts.null_count else texts
        texts = texts.cast(pa.large_string())
        marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        self.model, (self.data, self.offsets) = model, buffers(marked)
        data = self.data
        space, alone = data == 32, p.alone[data]
        first = np.zeros(len(data), dtype=bool)
        if len(data):
            if not p.crosses:  # else a piece may span words, and each text is one segment
                first[1:] = alone[1:] | alone[:-1] | (space[1:] & ~space[:-1])
            first[self.offsets[:-1][self.offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        key = np.zeros(0, np.uint64)
        if len(starts):
            key = hashed_runs(data, starts)
        key, one, self.back = np.unique(key, return_index=True, return_inverse=True)
        self.starts, self.ends = starts[one], ends[one]
        self.segments = np.searchsorted(starts, self.offsets)
        store = memo(model)
        rows = store.rows_of(key, data, self.starts, self.ends)
        self.score, self.loss = store.numbers[rows].T
        self.ids, places = ragged(store.flat, store.edges, rows[self.back])
        self.bounds = places[self.segments]
        self.best = np.array([self.score[self.back[a:b]].sum() for a, b in zip(self.segments[:-1], self.segments[1:], strict=True)])
        self.counts = store.edges[rows + 1] - store.edges[rows]

    def decoded(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids spell, and the offsets of the texts; each still has its leading space."""
        data, places = ragged(self.pieces.flat, self.pieces.edges, self.ids)
        return data, places[self.bounds]

    def nbest(self, row: int, n: int) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
        """The n best segmentations of a text: score, and the ids of segments (by place) that may differ from the best."""
        a, b = self.segments[row], self.segments[row + 1]
        loss = self.loss[self.back[a:b]]
        if n < 2 or a == b:
            return [(float(self.best[row]), {})]
        if len(loss) >= n:
            limit = np.partition(loss, n - 2)[n - 2]
            near = np.flatnonzero(loss <= limit)
            near = near[np.argsort(loss[near], kind="stable")][: n - 1]
        else:
            near = np.arange(len(loss))
        near = np.sort(near[np.isfinite(loss[near])])
        choices = [segment_nbest(self.model, self.data[self.starts[k] : self.ends[k]].tobytes(), n) for k in self.back[a + near]]
        chain: list[list[tuple[int, float, int]]] = [[]] + [[(i, s, j) for j, (s, _) in enumerate(c)] for i, c in enumerate(choices)]
        rest = float(self.best[row]) - sum(c[0][0] for c in choices)
        paths = backward_a_star(chain, viterbi(chain), n)
        return [(rest + s, {int(near[i]): choices[i][j][1] for i, j in enumerate(path)}) for s, path in paths]

    def path(self, row: int, changed: dict[int, tuple[int, ...]]) -> np.ndarray:
        """All ids of a text with the given segments replaced."""
        a, b = self.segments[row], self.segments[row + 1]
        ids, at = self.ids[self.bounds[row] : self.bounds[row + 1]], np.concatenate([[0], np.cumsum(self.counts[self.back[a:b]])])
        parts, last = [], 0
        for k, new in sorted(changed.items()):
            parts += [ids[last : at[k]], np.array(new, dtype=np.int32)]
            last = at[k + 1]
        return np.concatenate([*parts, ids[last:]])


DIGEST = "doc_id long, n_pieces long, score double, ids_crc32 long, nbest_scores array<double>, nbest_pieces array<long>, round_trip boolean"


def _digest(model: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 1024, most=SLICE):
                e = Encoded(batch["text"], model)
                text, places = e.decoded()
                crc, scores, counts, same = [], [], [], []
                for i in range(batch.num_rows):
                    ids = e.ids[e.bounds[i] : e.bounds[i + 1]]
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    paths = e.nbest(i, n)
                    scores.append([s for s, _ in paths])
                    counts.append([len(ids) + sum(len(v) - int(e.counts[e.back[e.segments[i] + k]]) for k, v in c.items()) for _, c in paths])
                    same.append(np.array_equal(text[places[i] : places[i + 1]], e.data[e.offsets[i] : e.offsets[i + 1]]))
                yield pa.record_batch(
                    [batch["doc_id"], pa.array(np.diff(e.bounds), pa.int64()), pa.array(e.best, pa.float64()), pa.array(crc, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(counts, pa.list_(pa.int64())), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_pieces", "score", "ids_crc32", "nbest_scores", "nbest_pieces", "round_trip"],
                )

    return released(run, forget)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def nbest_digest(docs: DataFrame, n: int = NBEST, model: str | None = None) -> DataFrame:
    """One row per document: pieces, score and crc32 (ids as little-endian u32) of the best segmentation, scores and sizes of the n best, and whether decoding gives the text."""
    return _source(docs).mapInArrow(_digest(model or default_model(), n), DIGEST)


def encode_nbest(docs: DataFrame, n: int = NBEST, model: str | None = None) -> DataFrame:
    """(doc_id, rank, score, ids): the n best segmentations of every text, rank 0 the best."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 512, most=SLICE):
                e = Encoded(batch["text"], model)
                rows = [(batch["doc_id"][i].as_py(), k, s, e.path(i, c)) for i in range(batch.num_rows) for k, (s, c) in enumerate(e.nbest(i, n))]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], names=["doc_id", "rank", "score", "ids"])

    return _source(docs).mapInArrow(released(run, forget), "doc_id long, rank int, score double, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """The text that each row's ids spell replaces them; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            texts = []
            for ids in batch["ids"]:
                raw = b"".join(p.bytes[i] for i in ids.as_py() or () if i is not None and 0 <= i < len(p.bytes))
                texts.append(raw.removeprefix(b" ").decode("utf-8", "replace") if ids.is_valid else None)
            yield batch.drop_columns(["ids"]).append_column("text", pa.array(texts, pa.string()))

    kept = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c != "ids")
    return encoded.mapInArrow(run, f"{kept}, text string")


def encode_and_decode(docs: DataFrame, model: str | None = None, n: int = NBEST) -> DataFrame:
    """docs with each text decoded from the best of its n best segmentations, with that one's n_pieces, score and ids_crc32.

    The segmentations come from the backward search, as in ``encode_nbest``; nbest_scores holds their scores, best first.
    All columns stay; an added one whose name is taken gets an underscore. A null text stays null.
    """
    model = model or default_model()
    names = docs.columns
    nbest, *added = [free_name(c, names) for c in ("nbest_scores", "n_pieces", "score", "ids_crc32")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for big in batches:
            for batch in slices(big, 1024, most=SLICE):
                e = Encoded(batch["text"], model)
                valid = batch["text"].is_valid().to_pylist()
                text, sizes, crc, scores = [], [], [], []
                for i, ok in enumerate(valid):
                    paths = e.nbest(i, n)
                    ids = e.path(i, paths[0][1])
                    data, _ = ragged(p.flat, p.edges, ids)
                    text.append(data[1:].tobytes().decode("utf-8", "replace") if ok else None)
                    sizes.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    scores.append([s for s, _ in paths])
                kept = [pa.array(text, pa.string()) if c == "text" else batch[c] for c in names]
                best = [s[0] for s in scores]
                yield pa.record_batch([*kept, pa.array(scores, pa.list_(pa.float64())), pa.array(sizes, pa.int64()), pa.array(best, pa.float64()), pa.array(crc, pa.int64())], names=[*names, nbest, *added])

    source = docs.withColumn("text", F.col("text").cast("string"))
    out = StructType([*source.schema.fields, StructField(nbest, ArrayType(DoubleType())), StructField(added[0], LongType()), StructField(added[1], DoubleType()), StructField(added[2], LongType())])
    return source.mapInArrow(released(run, forget), out)
