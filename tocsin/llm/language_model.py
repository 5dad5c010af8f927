"""Language-model scores by online logistic context mixing over hashed contexts.

Text is lower-cased (A-Z), ended by a byte that no UTF-8 text has, and predicted byte
by byte.  A byte is a few binary decisions along a Huffman code built from all training
documents.  There is a code for each frequent pair of the two bytes before it in its
segment (a word and the white space after it) and one for all others, so a byte takes
3.0 decisions where one code for all bytes takes 4.4; every predictor knows those two bytes.

Predictors.  Five contexts of a byte (the last 2, 4 and 6 bytes of the stream, words
and spaces alike; the word so far; the word so far and the whole word before) are
hashed into tables of fixed size that hold how often either branch of each node was
taken in all training documents.  A context's nodes lie in one group of ``GROUP``
slots, the most frequent ones each in a place of its own.  A predictor answers with the
log odds of its counts.
Mixing.  The answers are added with weights, one set for each gate (how much the
longest context and the word pair have been seen), and squashed.  A document begins
with weights learned on all training texts (one Newton step by moments that are summed
over all their bytes, each predicted without its own occurrence), and from there on its
weights take a step after every block of its bytes, by the gradient of what they got
wrong.  Blocks grow from 128 bytes to 8192, so a long text takes few steps.
Refinement.  A last stage maps the mixed probability to how often such predictions
came true in the document so far (an interpolated table, also updated after every
block); the result is the mean of both.  All this depends on earlier bytes alone, so
the product over a text is a proper distribution; ``-log2`` of it per byte is bits per
byte.

The base score's word counts come from all training documents: each batch sends its
distinct words and counts, in packed rows by hash of the word; what a bucket adds up
grows with the corpus and is never collected.  Words are looked up in the same
buckets; only words that make up at least 1/65536 of all tokens (so at most 65,536)
are sent to the tasks instead.  Tables, code and weights have fixed sizes.  Words are
known by 64-bit hashes.

Defined cases: a null or empty text has the end token only.  Rows are kept one for
one, repeated ids included; a row with a null id is neither held out nor learned
from.  Without training rows the tables are empty and every branch is even.  Extra
columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import crc_bucket, cut, give_back, released, slices
from tocsin.llm.shingles import LOWER, SPACE, hashed_runs, mix, powers

FOLDS, HELD_OUT = 7, 2
END = 0xFF
CHUNK = 2048
ORDERS = (2, 4, 6)
BITS = (18, 20, 21, 20, 21)  # of the three orders, the word so far, and the pair of words
GROUP, OWN = 64, 48
ROW_BITS, ROW_BLOCKS = 12, 16
ROWS = 1 << ROW_BITS
SIZES = np.array([1 << b for b in BITS], dtype=np.int64)
SHIFT = np.concatenate([[0], np.cumsum(SIZES)])
PREDICTORS, GATES = len(BITS), 9
LONGEST, PAIR = 2, 4
BLOCKS = 64
PRIOR, SCALE = 0.4, 4.0
FIRST_BLOCK, DOUBLINGS = 128, 6
RATE, INERTIA, START = 0.35, 32.0, 0.3
LEVELS, TOP, TRUST = 33, 10.0, 24.0
WINDOW_BYTES, SLICE_BYTES = 1 << 15, 1 << 18
COMMON = 65_536


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unzip(x, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), dtype=dtype)


def _doubled(k: int, context: np.ndarray) -> np.ndarray:
    return ((context >> np.uint64(64 - BITS[k])).astype(np.int32) + np.int32(SHIFT[k])) * np.int32(2)


class Stream:
    """The bytes of a batch of texts, each closed by END, and its segments: a word and the one white-space byte (or the end) after it."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("") if texts.null_count else texts
        closed = pc.binary_join_element_wise(texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(bytes([END]), pa.large_binary()))
        offsets = np.frombuffer(closed.buffers()[1], dtype=np.int64)[: len(closed) + 1]
        self.data = LOWER[np.frombuffer(closed.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]] if len(closed) else np.zeros(0, np.uint8)
        self.texts = offsets - offsets[0]
        self.ends = np.flatnonzero(SPACE[self.data] | (self.data == END)) + 1
        self.starts = np.append(0, self.ends[:-1])[: len(self.ends)]
        self.segments = np.searchsorted(self.starts, self.texts)
        sizes = self.ends - self.starts
        self.is_word = sizes > 1
        spelled = self.data.copy()
        spelled[self.ends - 1] = 0  # the byte after a word is no part of it
        self.word = hashed_runs(spelled, self.starts)

    def place_segments(self) -> None:
        """What contexts need: each byte's segment, and the running hash of the bytes before it."""
        sizes = self.ends - self.starts
        self.segment = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        place = np.arange(len(self.data), dtype=np.int32) - self.starts.astype(np.int32)[self.segment]
        terms = powers(int(sizes.max()) if len(sizes) else 1)[place]
        terms *= self.data.astype(np.uint64) + np.uint64(1)
        self.running = np.cumsum(terms) - terms
        self.before = np.append(np.uint64(0), mix(self.word[:-1] + np.uint64(0xABCD))) if len(self.word) else self.word
        self.before[self.segments[:-1]] = 0  # a text's first word has none before it

    def bases(self) -> list[np.ndarray]:
        """For each predictor twice the slot where each byte's context begins: with a step it gives 2 * slot + branch.

        The same as by ``contexts``, but window by window; only a text's first bytes are looked at one by one.
        """
        n = len(self.data)
        out = [np.empty(n, dtype=np.int32) for _ in BITS]
        plus = np.concatenate([np.zeros(ORDERS[-1], np.uint16), self.data.astype(np.uint16) + np.uint16(1)])
        begun = self.running.take(self.starts) + self.starts.astype(np.uint64) * np.uint64(0x9E3779B9)
        for a in range(0, n, WINDOW_BYTES):
            b = min(a + WINDOW_BYTES, n)
            known, segment = np.zeros(b - a, dtype=np.uint64), self.segment[a:b].astype(np.int64)
            for k in range(1, ORDERS[-1] + 1):
                known *= np.uint64(257)
                known += plus[ORDERS[-1] + a - k : ORDERS[-1] + b - k]
                if k in ORDERS:
                    i = ORDERS.index(k)
                    out[i][a:b] = _doubled(i, mix(known + np.uint64(k)))
            so_far = self.running[a:b] + np.arange(a, b, dtype=np.uint64) * np.uint64(0x9E3779B9)
            so_far -= begun.take(segment, mode="clip")
            out[-2][a:b] = _doubled(PREDICTORS - 2, mix(so_far + np.uint64(7)))
            so_far += self.before.take(segment, mode="clip")
            out[-1][a:b] = _doubled(PREDICTORS - 1, mix(so_far + np.uint64(8)))
        owner = np.repeat(np.arange(len(self.texts) - 1), np.minimum(np.diff(self.texts), ORDERS[-1]))
        at = np.arange(len(owner)) - np.searchsorted(owner, owner) + self.texts[owner]
        for i, x in enumerate(self.contexts(at, owner)[: len(ORDERS)]):
            out[i][at] = _doubled(i, x)
        return out

    def contexts(self, at: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
        """Hashed contexts of the bytes at these places; owner: the text of each."""
        place = at - self.texts[owner]
        out, known = [], np.zeros(len(at), dtype=np.uint64)
        for k in range(1, ORDERS[-1] + 1):
            known = known * np.uint64(257) + np.where(place >= k, self.data[np.maximum(at - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
            if k in ORDERS:
                out.append(mix(known + np.uint64(k)))
        segment = self.segment[at]
        first = self.starts[segment]
        so_far = self.running[at] - self.running[first] + (at - first).astype(np.uint64) * np.uint64(0x9E3779B9)
        out.append(mix(so_far + np.uint64(7)))
        out.append(mix(so_far + self.before[segment] + np.uint64(8)))
        return out


def _rows_of(s: Stream) -> np.ndarray:
    """The row of counts of each byte: by the two bytes before it in its segment (fewer at its start), hashed."""
    one, two = np.zeros(len(s.data), dtype=np.uint32), np.zeros(len(s.data), dtype=np.uint32)
    one[1:], two[2:] = s.data[:-1], s.data[:-2]
    one[s.starts], two[s.starts] = 0, 0
    two[s.starts[s.starts + 1 < len(two)] + 1] = 0
    two *= np.uint32(257)
    two += one
    two *= np.uint32(0x9E3779B1)
    two >>= np.uint32(32 - ROW_BITS)
    return two.astype(np.int32)


class Code:
    """Huffman codes over bytes: for each byte its decisions as nodes and branches.

    counts: of the 256 bytes, or such a row for each row of ``_rows_of``.  A row that makes up at least 1/ROWS of
    all bytes has a code of its own, the others share one.
    """

    def __init__(self, counts: np.ndarray):
        counts = np.atleast_2d(counts)
        self.of = None
        if len(counts) > 1:
            many = counts.sum(axis=1)
            own = np.flatnonzero((many > 0) & (many * ROWS >= many.sum()))
            self.of = np.zeros(len(counts), dtype=np.int32)
            self.of[own] = np.arange(1, len(own) + 1)
            counts = np.concatenate([counts[self.of == 0].sum(axis=0)[None], counts[own]])
        nodes, bits, sizes = zip(*(self._tree(x) for x in counts), strict=True)
        self.edges = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.sizes = np.diff(self.edges)
        self.nodes, self.bits = np.concatenate(nodes).astype(np.int16), np.concatenate(bits).astype(np.int8)
        rank = 254 - self.nodes  # nodes were made from the rarest up
        self.steps_of = (2 * np.where(rank < OWN, rank, OWN + rank % (GROUP - OWN)) + self.bits).astype(np.int8)

    @staticmethod
    def _tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, branches, number of them for each byte) of one code, from the root."""
        heap = [(int(n) + 1, k, k) for k, n in enumerate(counts)]
        heapq.heapify(heap)
        parent, branch = [0] * 511, np.zeros(511, dtype=np.int8)
        for node in range(256, 511):
            (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a], parent[b], branch[b] = node, node, 1
            heapq.heappush(heap, (n + m, node, node))
        parent, at, leaf, nodes, bits = np.array(parent), np.arange(256), np.arange(256), [], []
        leaves = []
        while len(at):
            nodes.append(parent[at] - 256)
            bits.append(branch[at])
            leaves.append(leaf)
            at, leaf = parent[at], leaf[parent[at] != 510]
            at = at[at != 510]
        leaves, up = np.concatenate(leaves), np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
        order = np.lexsort((-up, leaves))
        return np.concatenate(nodes)[order], np.concatenate(bits)[order], np.bincount(leaves, minlength=256)

    def symbols(self, s: Stream) -> np.ndarray:
        """The bytes of a stream, with the number of their code in the bits above."""
        return s.data if self.of is None else self.of.take(_rows_of(s), mode="clip") * np.int32(256) + s.data

    def steps(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(2 * place + branch of each decision, the byte that it is of, decisions of each byte)."""
        symbols = symbols.astype(np.int64)
        per, first = self.sizes.take(symbols, mode="clip"), self.edges.take(symbols, mode="clip")
        first -= np.cumsum(per) - per
        who = np.repeat(np.arange(len(per)), per)
        at = first.take(who, mode="clip")
        at += np.arange(len(who))
        return self.steps_of.take(at, mode="clip").astype(np.int64), who, per

    def decisions(self, symbols: np.ndarray, contexts: list[np.ndarray]):
        """(slots of each predictor, branch, decisions of each byte)."""
        steps, who, per = self.steps(symbols)
        slots = [(_doubled(k, x).take(who, mode="clip") ^ steps) >> 1 for k, x in enumerate(contexts)]  # within the context's group, in an order of its own
        return slots, (steps & 1).astype(np.int8), per


def _gathered(buckets: int):
    """Distinct training words of each chunk with their counts, by bucket of the word; and (bucket -1 and below, in ROW_BLOCKS blocks) the task's counts of bytes by row."""
    names = ["bucket", "words", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256 * ROWS, dtype=np.uint32)  # of one task, whose bytes are fewer than 2**32
        for big in batches:
            big = big.filter(big["learn"])
            for batch in slices(big, CHUNK):
                s = Stream(batch["text"])
                np.add.at(total, _rows_of(s) * np.int64(256) + s.data, np.uint32(1))
                words, counts = np.unique(s.word[s.is_word], return_counts=True)
                bucket = ((words >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = []
                for k in np.flatnonzero(np.diff(edges)):
                    mine = order[edges[k] : edges[k + 1]]
                    rows.append((int(k), words[mine].tobytes(), _zip(counts[mine].astype(np.uint64))))
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2))], names=names)
        if total.any():
            parts = [_zip(x.astype(np.uint64)) for x in np.split(total, ROW_BLOCKS)]
            yield pa.record_batch([pa.array(-1 - np.arange(ROW_BLOCKS), pa.int32()), pa.array([b""] * ROW_BLOCKS, pa.binary()), pa.array(parts, pa.binary())], names=names)

    return released(run)


def _vocabulary(key: tuple, group: pa.Table) -> pa.Table:
    """One bucket's words (sorted) with their corpus counts, and its number of words and tokens."""
    word = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in group["words"]])
    counts = np.concatenate([_unzip(x, np.uint64) for x in group["counts"]])
    order = np.argsort(word)
    word, counts = word[order], counts[order]
    heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    total = np.add.reduceat(counts, heads)
    row = [[key[0].as_py()], [word[heads].tobytes()], [_zip(total)], [int(total.sum())], [len(heads)]]
    return pa.table([pa.array(x, k) for x, k in zip(row, [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()], strict=True)], names=["bucket", "words", "counts", "tokens", "distinct"])


def _word_counts(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes of a bucket and their counts."""
    return np.frombuffer(batch["words"][i].as_py(), dtype=np.uint64), _unzip(batch["counts"][i], np.uint64).astype(np.int64)


def _branches(code: Code):
    """How often either branch was taken in each slot, over a task's training texts; in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SHIFT[-1], dtype=np.uint32)  # of one task, whose decisions are fewer than 2**32
        for big in batches:
            big = big.filter(big["learn"])
            for batch in slices(big, CHUNK, most=1 << 20):
                s = Stream(batch["text"])
                s.place_segments()
                symbols = code.symbols(s).astype(np.uint64)
                for x in s.bases():  # equal bytes in equal contexts are counted at once, and memory is gone through in order
                    x = x.astype(np.uint64) << np.uint64(32)
                    x |= symbols
                    x.sort()
                    heads = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                    many, x = np.diff(np.append(heads, len(x))).astype(np.uint32), x[heads]
                    for a in range(0, len(x), WINDOW_BYTES):
                        part = x[a : a + WINDOW_BYTES]
                        steps, who, _ = code.steps(part & np.uint64(0xFFFFFFFF))
                        np.add.at(total, (part >> np.uint64(32)).astype(np.int64).take(who, mode="clip") ^ steps, many[a : a + WINDOW_BYTES].take(who, mode="clip"))
        if total.any():
            parts = [_zip(x.astype(np.uint64)) for x in np.array_split(total, BLOCKS)]
            yield pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])

    return released(run)


def _added(key: tuple, group: pa.Table) -> pa.Table:
    total = np.uint64(0)
    for x in group["part"]:
        total = total + _unzip(x, np.uint64)
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([_zip(total)], pa.binary())], names=["block", "part"])


def _all_added(parts: DataFrame) -> DataFrame:
    """One row for each block, added up in two steps."""
    lots = parts.withColumn("lot", F.pmod(F.xxhash64("part"), F.lit(16))).groupBy("block", "lot").applyInArrow(_added, "block int, part binary")
    return lots.groupBy("block").applyInArrow(_added, "block int, part binary")


def _seen(n: np.ndarray) -> np.ndarray:
    return np.where(n < 1, 0, np.where(n < 8, 1, 2)).astype(np.int8)


class Mixer:
    """Weights and last stage of a batch's texts, as they stand after the blocks so far."""

    def __init__(self, texts: int, weights: np.ndarray):
        self.texts = texts
        self.weights = np.tile(weights.T.astype(np.float32), texts)  # [predictor, text * GATES + gate]
        center = 1 / (1 + np.exp(-np.linspace(-TOP, TOP, LEVELS)))
        self.came, self.tried = np.tile(center * TRUST, texts), np.full(texts * LEVELS, TRUST)
        self.set_rates()
        self.gradient, self.rows_seen = np.zeros_like(self.weights), np.zeros(texts * GATES, dtype=np.float32)
        self.cells_seen, self.cells_came = np.zeros(texts * LEVELS, dtype=np.float32), np.zeros(texts * LEVELS, dtype=np.float32)

    def block(self, rows: np.ndarray, many: np.ndarray, answers: list[np.ndarray], bits: np.ndarray) -> np.ndarray:
        """Natural logs of the decisions' probabilities, added up for each row, by the state before this block; what they teach is put by for ``step``.

        Decisions are in the order of their rows (text * GATES + gate); many: how many each row has.
        """
        starts = np.cumsum(many) - many
        total = np.zeros(len(bits), dtype=np.float32)
        for k in range(PREDICTORS):
            part = np.repeat(self.weights[k].take(rows), many)
            part *= answers[k]
            total += part
        np.clip(total, -TOP + 1e-3, TOP - 1e-3, out=total)
        mixed = np.exp(-total)
        mixed += np.float32(1)
        np.reciprocal(mixed, out=mixed)
        total += np.float32(TOP)
        total *= np.float32((LEVELS - 1) / (2 * TOP))
        cell = total.astype(np.int64)  # take is fastest with these, and in range by construction
        total -= cell.astype(np.float32)
        cell += np.repeat(rows // GATES * LEVELS, many)
        refined, above = self.rate.take(cell, mode="clip"), self.rise.take(cell, mode="clip")
        above *= total
        refined += above
        refined += mixed
        taken = bits.astype(bool)
        np.subtract(np.float32(2), refined, out=refined, where=~taken)
        refined *= np.float32(0.5)
        logs = np.log(np.maximum(refined, np.float32(1e-7), out=refined), out=refined)
        wrong = np.subtract(bits, mixed, dtype=np.float32)
        self.rows_seen[rows] += many
        for k in range(PREDICTORS):
            self.gradient[k][rows] += np.add.reduceat(wrong * answers[k], starts)
        cell += total >= 0.5
        self.cells_seen += np.bincount(cell, minlength=len(self.cells_seen))
        self.cells_came += np.bincount(cell[taken], minlength=len(self.cells_came))
        return np.add.reduceat(logs, starts, dtype=np.float64)

    def set_rates(self) -> None:
        self.rate = (self.came / self.tried).astype(np.float32)
        self.rise = np.append(self.rate[1:] - self.rate[:-1], np.float32(0))

    def step(self) -> None:
        """The end of a block: everything takes a step."""
        self.weights += self.gradient * (np.float32(RATE) / (self.rows_seen + np.float32(INERTIA)))
        self.tried += self.cells_seen
        self.came += self.cells_came
        self.set_rates()
        for x in (self.gradient, self.rows_seen, self.cells_seen, self.cells_came):
            x[...] = 0


def _block_of(place: np.ndarray) -> np.ndarray:
    """The block of a byte by its place in its text: 128 bytes, 256 and so on, then 8192 each."""
    grown = FIRST_BLOCK * ((1 << DOUBLINGS) - 1)
    early = np.floor(np.log2(np.minimum(place, grown) // FIRST_BLOCK + 1)).astype(np.int32)
    return np.where(place < grown, early, DOUBLINGS + (place - grown) // (FIRST_BLOCK << DOUBLINGS)).astype(np.int32)


def _in_blocks(s: Stream) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, owners) of the bytes of each block of all texts, first blocks first."""
    owner = np.repeat(np.arange(len(s.texts) - 1, dtype=np.int32), np.diff(s.texts))
    block = _block_of(np.arange(len(s.data)) - s.texts[owner])
    order = np.argsort(block, kind="stable")
    edges = np.searchsorted(block[order], np.arange(block.max() + 2 if len(block) else 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield order[a:b], owner[order[a:b]]


LOGS = np.log(np.arange(1 << 16) + PRIOR).astype(np.float32)


def packed(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Both counts of a slot in 32 bits; those that pass 16 bits are halved together until they fit."""
    big, shift = np.maximum(zero, one), np.zeros(len(zero), dtype=np.uint32)
    while ((big >> shift) > 0xFFFF).any():
        shift += (big >> shift) > 0xFFFF
    return zero >> shift << np.uint32(16) | one >> shift


class Unseen:
    """What a slot answers to each of its own occurrences, which is left out of its counts: place 2 * slot + branch."""

    def __init__(self, table: np.ndarray):
        self.table, self.answers = table, None

    def spread(self) -> None:
        """The log odds (53 MB), with how much is seen in their last two bits, made once where they are used; only the table of packed counts is sent."""
        if self.answers is None:
            self.answers = np.empty((len(self.table), 2), dtype=np.float32)
            for a in range(0, len(self.table), 1 << 20):
                part = slice(a, a + (1 << 20))
                n0, n1 = (self.table[part] >> np.uint32(16)).astype(np.int32), (self.table[part] & np.uint32(0xFFFF)).astype(np.int32)
                for branch, x, y in ((0, np.maximum(n0 - 1, 0), n1), (1, n0, np.maximum(n1 - 1, 0))):
                    odds = np.clip(LOGS.take(y) - LOGS.take(x), -31 / SCALE, 31 / SCALE)
                    self.answers[part, branch] = (odds.view(np.int32) & np.int32(-4) | _seen(x + y)).view(np.float32)
            self.answers = self.answers.ravel()


def moments(code: Code, table: Unseen, s: Stream) -> np.ndarray:
    """[gate, predictor + 1, predictor]: curvature and, last, gradient of the log likelihood at the even weights, over all bytes, each predicted without its own occurrence."""
    out = np.zeros((GATES, PREDICTORS + 1, PREDICTORS))
    table.spread()
    s.place_segments()
    symbols, bases = code.symbols(s), s.bases()
    for a in range(0, len(s.data), WINDOW_BYTES):
        steps, who, _ = code.steps(symbols[a : a + WINDOW_BYTES])
        bits = steps & 1
        answers = np.empty((PREDICTORS, len(bits)), dtype=np.float32)
        for k, x in enumerate(bases):
            x = x[a : a + WINDOW_BYTES].astype(np.int64).take(who, mode="clip")
            x ^= steps
            table.answers.take(x, out=answers[k], mode="clip")
        longest, pair = ((answers[k].view(np.int32) & np.int32(3)).astype(np.int8) for k in (LONGEST, PAIR))
        gate = longest * np.int8(3) + pair
        order = np.argsort(gate, kind="stable")
        edges = np.append(0, np.cumsum(np.bincount(gate, minlength=GATES)))
        answers = answers.take(order, axis=1, mode="clip")
        p = 1 / (1 + np.exp(-np.clip(np.float32(START) * answers.sum(axis=0), -TOP, TOP)))
        wrong, curve = bits.take(order, mode="clip") - p, (p * (1 - p)).astype(np.float64)
        answers = answers.astype(np.float64)  # of repeated text they hardly differ, which single precision would blur
        for g in range(GATES):
            mine = slice(edges[g], edges[g + 1])
            x = answers[:, mine]
            for i in range(PREDICTORS):  # products of long rows are faster than one of narrow matrices
                row = x[i] * curve[mine]
                for j in range(i + 1):
                    out[g, i, j] += row @ x[j]
                out[g, -1, i] += x[i] @ wrong[mine]
    for i in range(PREDICTORS):
        out[:, :i, i] = out[:, i, :i]
    return out


def weights_of(sums: np.ndarray) -> np.ndarray:
    """[gate, predictor]: the even weights after one Newton step by the moments of all texts (rounded: sums may differ in their last places)."""
    steps = [np.linalg.solve(m[:-1] + INERTIA * np.eye(PREDICTORS), m[-1]) for m in sums]
    return np.round(np.clip(START + np.array(steps), -1.0, 2.0), 3)


def first_weights(code: Code, zero: np.ndarray, one: np.ndarray, texts: list[str]) -> np.ndarray:
    """[gate, predictor]: the weights that texts teach, see ``learned_weights``, which does this for a table."""
    return weights_of(moments(code, Unseen(packed(zero, one)), Stream(pa.array(texts, pa.large_string()))))


def learned_weights(source: DataFrame, code: Code, zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """[gate, predictor]: the weights that all training texts teach; tasks send 270 sums each, which Spark adds up."""
    shared = source.sparkSession.sparkContext.broadcast(Unseen(packed(zero, one)))  # 26 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GATES * (PREDICTORS + 1) * PREDICTORS)
        for big in batches:
            for batch in slices(big.filter(big["learn"]), CHUNK, most=1 << 20):
                total += moments(code, shared.value, Stream(batch["text"])).ravel()
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "value"])

    rows = source.select("text", "learn").mapInArrow(released(run), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    shared.destroy()
    sums = np.zeros(GATES * (PREDICTORS + 1) * PREDICTORS)
    for r in rows:
        sums[r.cell] = r.value
    return weights_of(sums.reshape(GATES, PREDICTORS + 1, PREDICTORS))


def _odds(found: np.ndarray) -> np.ndarray:
    """The log odds that a mixture's bytes stand for."""
    out = (found >> 2).astype(np.float32)
    out -= np.float32(31)
    out *= np.float32(1 / SCALE)
    return out


class Mixture:
    """A byte for each slot (six bits of its log odds, two of how much it has been seen), the code and the first weights."""

    def __init__(self, code: Code, zero: np.ndarray, one: np.ndarray, weights: np.ndarray):
        self.code, self.weights = code, weights
        self.slots = np.zeros(len(zero), dtype=np.uint8)
        for a in range(0, len(zero), 1 << 20):
            n0, n1 = zero[a : a + (1 << 20)].astype(np.float32), one[a : a + (1 << 20)].astype(np.float32)
            odds = np.clip(np.round(np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR))) * SCALE), -31, 31) + 31
            self.slots[a : a + (1 << 20)] = odds.astype(np.uint8) * 4 + _seen(n0 + n1).astype(np.uint8)

    def scores(self, s: Stream) -> np.ndarray:
        """Natural log of each text's probability."""
        n = len(s.texts) - 1
        out, mixer = np.zeros(n), Mixer(n, self.weights)
        s.place_segments()
        symbols, bases = self.code.symbols(s), s.bases()
        for places, owners in _in_blocks(s):
            for a in range(0, len(places), WINDOW_BYTES):  # a block may be gone through in parts: nothing moves before its end
                at = places[a : a + WINDOW_BYTES]
                steps, who, _ = self.code.steps(symbols.take(at, mode="clip"))
                bits, owner = (steps & 1).astype(np.int8), owners[a : a + WINDOW_BYTES].take(who, mode="clip")
                who, found = at.take(who, mode="clip"), []
                for x in bases:
                    x = x.take(who, mode="clip") ^ steps
                    x >>= 1
                    found.append(self.slots.take(x, mode="clip"))
                row = (owner * np.int32(GATES) + ((found[LONGEST] & 3) * np.uint8(3) + (found[PAIR] & 3))).astype(np.uint16 if n * GATES < 1 << 16 else np.int32)
                order, many = np.argsort(row, kind="stable"), np.bincount(row)
                rows = np.flatnonzero(many)
                logs = mixer.block(rows, many[rows], [_odds(x.take(order, mode="clip")) for x in found], bits.take(order, mode="clip"))
                out += np.bincount(rows // GATES, weights=logs, minlength=n)
            mixer.step()
        return out


def _scored(shared, common_keys: np.ndarray, common_counts: np.ndarray, buckets: int):
    """A row for each document with its scores, and packed rows of the words whose counts are still to be looked up."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("owners", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for big in batches:
            for chunk in slices(big, CHUNK):
                n = chunk.num_rows
                score = np.concatenate([np.zeros(0), *(shared.value.scores(Stream(part["text"])) for part in slices(chunk, 512, most=SLICE_BYTES))]) / np.log(10)
                s = Stream(chunk["text"])
                owner = np.repeat(np.arange(n), np.diff(s.segments))
                spot = np.searchsorted(common_keys, s.word)
                spot[spot == len(common_keys)] = 0
                common = s.is_word & (common_keys[spot] == s.word) if len(common_keys) else np.zeros(len(s.word), dtype=bool)
                base = np.bincount(owner[common], weights=np.log10(common_counts[spot[common]] + 1.0), minlength=n)
                known = np.bincount(owner[common], minlength=n)
                tokens = np.bincount(owner[s.is_word], minlength=n) + 1
                blank = pa.nulls(n, pa.binary())
                yield pa.record_batch([pa.array(row + np.arange(n)), chunk["doc_id"], pa.array(tokens), pa.array(known), pa.array(base), pa.array(score), pa.array(np.diff(s.texts) - 1), pa.nulls(n, pa.int32()), blank, blank], schema=schema)
                rare = np.flatnonzero(s.is_word & ~common)
                if len(rare):
                    bucket = ((s.word[rare] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                    order = rare[np.argsort(bucket, kind="stable")]
                    edges = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
                    some = np.flatnonzero(np.diff(edges))
                    words = [s.word[order[edges[k] : edges[k + 1]]].tobytes() for k in some]
                    owners = [_zip(owner[order[edges[k] : edges[k + 1]]].astype(np.uint16)) for k in some]
                    m = len(some)
                    none = pa.nulls(m, pa.int64())
                    yield pa.record_batch([pa.array(np.full(m, row)), none, none, none, pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), none, pa.array(some.astype(np.int32)), pa.array(words, pa.binary()), pa.array(owners, pa.binary())], schema=schema)
                row += n

    return released(run)


def _looked_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each chunk's rare words of a bucket, summed up by document: packed sums of log10(count + 1) and of known words."""
    words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in right.to_batches():
        for i in range(batch.num_rows):
            words, counts = _word_counts(batch, i)
    rows = []
    for first, blob, owners in zip(left["row"], left["words"], left["owners"], strict=True):
        mine, owner = np.frombuffer(blob.as_py(), dtype=np.uint64), _unzip(owners, np.uint16).astype(np.int64)
        spot = np.searchsorted(words, mine)
        spot[spot == len(words)] = 0
        hit = words[spot] == mine if len(words) else np.zeros(len(mine), dtype=bool)
        docs = np.unique(owner[hit])
        logs = np.bincount(owner[hit], weights=np.log10(counts[spot[hit]] + 1.0))[docs] if len(docs) else np.zeros(0)
        rows.append((first.as_py(), docs.astype(np.uint16).tobytes(), logs.tobytes(), np.bincount(owner[hit])[docs].astype(np.uint32).tobytes() if len(docs) else b""))
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3))], names=["row", "docs", "logs", "known"])


def _summed(key: tuple, group: pa.Table) -> pa.Table:
    logs, known = np.zeros(CHUNK), np.zeros(CHUNK, dtype=np.int64)
    for d, x, k in zip(group["docs"], group["logs"], group["known"], strict=True):
        d = np.frombuffer(d.as_py(), dtype=np.uint16)
        logs[d] += np.frombuffer(x.as_py(), dtype=np.float64)
        known[d] += np.frombuffer(k.as_py(), dtype=np.uint32)
    some = np.flatnonzero(known)
    return pa.table([pa.array(key[0].as_py() + some), pa.array(logs[some]), pa.array(known[some])], names=["row", "rare_logs", "rare_known"])


def learned_tables(source: DataFrame, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(zero, one) branch counts of each slot over all training texts: 52 MB, whatever the corpus.

    They are added in 64 bits on the cluster; a block whose counts pass 32 bits is halved until it fits, which keeps its odds.
    """
    parts = _all_added(source.select("text", "learn").mapInArrow(_branches(code), "block int, part binary"))
    sizes = [len(x) for x in np.array_split(np.empty(2 * SHIFT[-1], np.int8), BLOCKS)]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    both = np.zeros(2 * SHIFT[-1], dtype=np.uint32)
    for r in parts.toLocalIterator():  # BLOCKS rows, one at a time
        block = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.part), dtype=np.uint64)
        while block.max() > 0xFFFFFFFF:
            block = block >> np.uint64(1)
        both[edges[r.block] : edges[r.block + 1]] = block
    return both[0::2], both[1::2]


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    spark = docs.sparkSession
    fold = crc_bucket("doc_id", FOLDS)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("learn", F.coalesce(fold != HELD_OUT, F.lit(False)))
    buckets = max(8, source.rdd.getNumPartitions())
    gathered = cut(source.select("text", "learn").mapInArrow(_gathered(buckets), "bucket int, words binary, counts binary"), "words", "none")
    vocabulary = cut(gathered.where("bucket >= 0").groupBy("bucket").applyInArrow(_vocabulary, "bucket int, words binary, counts binary, tokens long, distinct long"), "vocabulary", "none")
    learned = source.where("learn").count()
    sums = vocabulary.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    tokens, distinct = sums.n + learned, sums.v + (learned > 0)
    byte_counts = np.zeros((ROW_BLOCKS, 256 * ROWS // ROW_BLOCKS))
    for r in _all_added(gathered.where("bucket < 0").select((-1 - F.col("bucket")).alias("block"), F.col("counts").alias("part"))).toLocalIterator():  # ROW_BLOCKS rows
        byte_counts[r.block] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r.part), dtype=np.uint64)
    code = Code(byte_counts.reshape(ROWS, 256))
    zero, one = learned_tables(source, code)
    mixture = Mixture(code, zero, one, learned_weights(source, code, zero, one))
    del zero, one
    give_back()
    floor = max(1, -(-tokens // COMMON))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, n = _word_counts(batch, i)
                yield pa.record_batch([pa.array(words[n >= floor].view(np.int64)), pa.array(n[n >= floor])], names=["word", "n"])

    rows = vocabulary.mapInArrow(frequent, "word long, n long").collect()  # at most COMMON rows: each has 1/COMMON of all tokens
    keys, values = np.array([r.word for r in rows], dtype=np.int64).view(np.uint64), np.array([r.n for r in rows], dtype=np.int64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast(mixture)  # 6.6 MB
    scored = cut(source.select("doc_id", "text").mapInArrow(_scored(shared, keys[order], values[order], buckets), "row long, doc_id long, n_tokens long, known long, logs double, score double, n_bytes long, bucket int, words binary, owners binary"), "scored", "none")
    rare = scored.where("bucket is not null").select("bucket", "row", "words", "owners").groupBy("bucket").cogroup(vocabulary.select("bucket", "words", "counts").groupBy("bucket")).applyInArrow(_looked_up, "row long, docs binary, logs binary, known binary")
    sums = rare.groupBy("row").applyInArrow(_summed, "row long, rare_logs double, rare_known long")
    out = scored.where("bucket is null").join(sums, "row", "left")
    end = float(np.log10(learned + 1.0))
    total = float(np.log10(tokens + distinct + 1.0))
    return out.select(
        "doc_id",
        F.coalesce(crc_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(learned > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        "score",
        (-F.col("score") * F.lit(float(np.log2(10.0))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
