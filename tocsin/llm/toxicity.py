"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nystroem landmarks.

Kernel.  A word (with a space on either side) is the vector of its three-byte
subsequences that span at most five bytes; one of span s weighs ``DECAY**(s-3)``,
so ``idioot`` keeps much of what ``idiot`` has; a strange letter in the middle, as in
``idxiot``, costs most of it.  ASCII punctuation in a word is skipped, as in ``i-d-i-o-t``.  The kernel of
two words is the cosine of their vectors.

Training.  Labelled documents give labelled sentences of words: all words of a
clean document are clean; of a toxic one, the few words that the machine itself
finds worst are toxic (they are chosen anew three times, first by how much more
often toxic documents have them).  Landmarks are drawn from both kinds; words are
mapped to their kernel values with the landmarks, whitened by the landmarks' own
kernel matrix, and a squared-hinge machine is fitted by Newton steps.  Its
decision is linear in the subsequences, so it is folded into one weight table.
The fit's bounds: at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents, least
hash of the id first, at most ``MAX_BYTES`` of text in all and a twentieth of that in
one, and of their words at most ``MAX_WORDS``: a third each of the worst words of
toxic documents, the clean words that look worst, and the most frequent clean ones.
Scores and counts have no bounds.  (Labels are of whole documents and an insult is one
word in hundreds, so the machine's units are words and not sentences, whose kernel the
other words would outweigh; words of toxic documents are told apart as above.)

Score.  Every word of a whole text gets its decision.  Their maximum and their
counts over several bounds, in all and for each 1000 words, go into a logistic
model, fitted on documents whose words' decisions came from a machine that
hadn't seen them.

Defined cases: a null or empty text gets the score of no words at all.  Words
longer than ``SPAN`` bytes are read in overlapping parts.  Rows are kept one for
one, ids repeated or null included (a null id is not held out).  Without labels
of both kinds every score is 0.  Repeated labels of an id: toxic if any is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tocsin.llm.common import crc_bucket, free_name, give_back, released, slices
from tocsin.llm.shingles import LOWER, buffers, words

DECAY = 0.6
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
SPAN = 24
TABLE_BITS = 20
LANDMARKS = 256
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 1500, 1500, 4_000_000
MAX_WORDS = 30_000
FITTED = 2048
BOUNDS = (0.0, 0.5, 1.0)
CUTOFF = 0.7
FOLDS = 3
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a batch without ASCII punctuation: (bytes, hash, start, end, offsets of the texts)."""
    hashes, starts, ends, offsets = words(texts)
    data, _ = buffers(texts)
    keep = ~PUNCTUATION[data]
    before = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], hashes, before[starts], before[ends], offsets


def _grid(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes with a space before and behind, zeros after; and the word of each row."""
    sizes = ends - starts
    parts = np.where(sizes <= SPAN, 1, 1 + -(-(sizes - SPAN) // (SPAN // 2)))
    owner = np.repeat(np.arange(len(starts)), parts)
    shift = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * (SPAN // 2)
    begin = starts[owner] + shift
    left = np.minimum(ends[owner] - begin, SPAN)
    width = int(left.max()) if len(left) else 1
    out = np.zeros((len(owner), width + 2 + 4), dtype=np.uint8)
    out[:, 0] = 32
    for place in range(width if len(data) else 0):  # column by column: places of all at once would take 16 times the words' memory
        out[:, place + 1] = np.where(place < left, LOWER[data[np.minimum(begin + place, len(data) - 1)]], 0)
    out[np.arange(len(owner)), left + 1] = 32
    return out, owner


def _features(grid: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """(slots, weight): for each pattern the table slot of every place's subsequence, -1 beyond the word."""
    wide = grid.astype(np.uint32)
    n = grid.shape[1] - 4
    for a, b, c in PATTERNS:
        x, y, z = wide[:, a : a + n], wide[:, b : b + n], wide[:, c : c + n]
        slot = ((x * np.uint32(0x9E3779B1) + y) * np.uint32(0x85EBCA77) + z) * np.uint32(0xC2B2AE3D)
        slot ^= slot >> np.uint32(15)
        slot = (slot * np.uint32(0x27D4EB2F)) >> np.uint32(32 - TABLE_BITS)
        yield np.where(z > 0, slot.astype(np.int64), -1), DECAY ** (c - 2)


def _decide(table: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The folded machine's decision for each row, without its constant."""
    total, norm = np.zeros(len(grid)), np.zeros(len(grid))
    padded = np.append(table, 0.0).astype(np.float32)
    for slot, weight in _features(grid):
        total += weight * padded[slot].sum(axis=1)
        norm += weight * weight * (slot >= 0).sum(axis=1)
    return total / np.sqrt(np.maximum(norm, 1e-9))


def word_decisions(table: np.ndarray, bias: float, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.full(len(starts), -9.0)
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    for at in range(0, len(order), 16_384):
        part = order[at : at + 16_384]
        grid, owner = _grid(data, starts[part], ends[part])
        np.maximum.at(out, part[owner], _decide(table, grid) + bias)
    return out


def _fit_words(grid: np.ndarray, toxic: np.ndarray, weight: np.ndarray, lead: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """The machine on words (rows), folded into (table, constant); lead orders candidates for landmarks."""
    half = LANDMARKS // 2
    by_lead = np.argsort(-lead, kind="stable")
    marks = np.concatenate([by_lead[toxic[by_lead] > 0][:half], by_lead[toxic[by_lead] <= 0][:half]])
    used, columns = np.zeros(1 << TABLE_BITS, dtype=bool), []
    norms = np.zeros(len(grid))
    for slot, w in _features(grid):
        norms += w * w * (slot >= 0).sum(axis=1)
    norms = np.sqrt(np.maximum(norms, 1e-9))
    for slot, _ in _features(grid[marks]):
        used[slot[slot >= 0]] = True
    place = np.full((1 << TABLE_BITS) + 1, -1, dtype=np.int64)
    place[:-1][used] = np.arange(used.sum())
    vectors = np.zeros((used.sum() + 1, len(marks)), dtype=np.float32)
    for slot, w in _features(grid[marks]):
        row, col = np.nonzero(slot >= 0)
        np.add.at(vectors, (place[slot[row, col]], row), (w / norms[marks[row]]).astype(np.float32))
    kernel = np.zeros((len(grid), len(marks)), dtype=np.float32)
    for at in range(0, len(grid), 4096):
        for slot, w in _features(grid[at : at + 4096]):
            spot = place[slot]
            for j in range(spot.shape[1]):
                some = np.flatnonzero(spot[:, j] >= 0)
                kernel[at + some] += np.float32(w) * vectors[spot[some, j]]
    kernel /= norms[:, None].astype(np.float32)
    values, basis = np.linalg.eigh(kernel[marks].astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = basis[:, good] / np.sqrt(values[good])
    x, narrow = kernel[:, : whiten.shape[1]], whiten.astype(np.float32)
    for at in range(0, len(grid), FITTED):  # in the kernel's own place, as it is 30 MB and this runs in the driver
        x[at : at + FITTED] = kernel[at : at + FITTED] @ narrow
    y = np.where(toxic > 0, 1.0, -1.0).astype(np.float32)
    c = (weight / weight.sum()).astype(np.float32)
    w = np.zeros(x.shape[1] + 1)
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-8
    for _ in range(12):
        inside = y * (x @ w[:-1].astype(np.float32) + np.float32(w[-1])) < 1
        curve, slope = np.diag(reg), np.zeros(len(w))
        for at in range(0, len(x), FITTED):
            some = at + np.flatnonzero(inside[at : at + FITTED])
            xi, ci = np.column_stack([x[some], np.ones(len(some), np.float32)]), c[some]
            curve += (xi.T * ci) @ xi
            slope += xi.T @ (ci * y[some])
        new = np.linalg.solve(curve, slope)
        if np.abs(new - w).max() < 1e-4:
            break
        w = new
    alpha = whiten @ w[:-1]
    table = np.zeros(1 << TABLE_BITS)
    np.add.at(table, np.flatnonzero(used), vectors[:-1] @ alpha.astype(np.float32))
    return table, float(w[-1])


def _train_machine(vocab_grid: np.ndarray, doc: np.ndarray, word: np.ndarray, toxic_doc: np.ndarray) -> tuple[np.ndarray, float]:
    """doc and word: one entry for each distinct word of each document."""
    n = len(vocab_grid)
    pos = np.bincount(word[toxic_doc[doc]], minlength=n).astype(float)
    neg = np.bincount(word[~toxic_doc[doc]], minlength=n).astype(float)
    a, b = max(1, toxic_doc.sum()), max(1, (~toxic_doc).sum())
    decision = np.log((pos / a + 0.2 / a) / (neg / b + 0.2 / a))
    table, bias = np.zeros(1 << TABLE_BITS), -1.0
    in_toxic = toxic_doc[doc]
    for _ in range(FOLDS):
        d, w = doc[in_toxic], word[in_toxic]
        order = np.lexsort((-decision[w], d))
        d, w = d[order], w[order]
        heads = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        sizes = np.diff(np.append(heads, len(d)))
        rank = np.arange(len(d)) - np.repeat(heads, sizes)
        chosen = rank < np.repeat(np.maximum(1, sizes // 100), sizes)
        hits = np.bincount(w[chosen], minlength=n).astype(float)
        keep_pos = np.flatnonzero(hits > 0)
        keep_pos = keep_pos[np.argsort(-hits[keep_pos], kind="stable")][: MAX_WORDS // 3]
        keep_neg = np.flatnonzero(neg > 0)
        hard = np.argsort(-decision[keep_neg], kind="stable")[: MAX_WORDS // 3]  # clean words that look toxic, then the frequent
        often = np.argsort(-neg[keep_neg], kind="stable")[: MAX_WORDS // 3]
        keep_neg = keep_neg[np.unique(np.concatenate([hard, often]))]
        rows = np.concatenate([keep_pos, keep_neg])
        label = np.concatenate([np.ones(len(keep_pos)), np.zeros(len(keep_neg))])
        weight = np.concatenate([hits[keep_pos] / hits[keep_pos].sum(), neg[keep_neg] / neg[keep_neg].sum()])
        lead = np.concatenate([hits[keep_pos], neg[keep_neg]])
        table, bias = _fit_words(vocab_grid[rows], label, weight, lead)
        decision = np.concatenate([_decide(table, vocab_grid[at : at + 16_384]) for at in range(0, n, 16_384)]) + bias
    return table, bias


def _pool(decisions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What the logistic model sees of each text's word decisions."""
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), 2 + 2 * len(BOUNDS)))
    some = sizes > 0
    top = np.full(len(sizes), -1.0)
    if some.any():
        top[some] = np.maximum.reduceat(decisions, offsets[:-1][some])
    out[:, 0] = np.clip(top, -2, 2)
    out[:, 1] = np.log1p(sizes) / 5
    for k, bound in enumerate(BOUNDS):
        running = np.concatenate([[0], np.cumsum(decisions > bound)])
        count = running[offsets[1:]] - running[offsets[:-1]]
        out[:, 2 + 2 * k] = np.log1p(count)
        out[:, 3 + 2 * k] = np.log1p(1000 * count / np.maximum(sizes, 1)) / 3
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Weight table and constant of the machine, and the logistic model over its decisions."""

    def __init__(self, texts: list[str], toxic: list[bool]):
        self.table, self.bias, self.logistic = None, 0.0, None
        toxic = np.array(toxic, dtype=bool)
        if toxic.all() or not toxic.any():
            return
        array = pa.array(texts, pa.large_string())
        data, hashes, starts, ends, offsets = _letters(array)
        _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        starts, ends, back = starts[one].copy(), ends[one].copy(), back.astype(np.int32)
        del hashes, array
        give_back()
        grid, owner = _grid(data, starts, ends)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
        grid = grid[first]  # to learn, the first part of a word that is longer than SPAN is enough
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        pairs = np.unique(doc * (len(one) + 1) + back)
        doc, word = pairs // (len(one) + 1), pairs % (len(one) + 1)
        pooled = np.zeros((len(texts), 2 + 2 * len(BOUNDS)))
        fold = np.arange(len(texts)) % 2
        for k in (0, 1):
            mine = fold[doc] != k
            table, bias = _train_machine(grid, doc[mine], word[mine], toxic & (fold != k)) if (toxic & (fold != k)).any() else (np.zeros(1 << TABLE_BITS), -1.0)
            found = word_decisions(table, bias, data, starts, ends)[back]
            pooled[fold == k] = _pool(found, offsets)[fold == k]
        self.logistic = _logistic(pooled, toxic.astype(float))
        self.table, self.bias = _train_machine(grid, doc, word, toxic)
        self.table = self.table.astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.table is None:
            return np.zeros(len(texts))
        data, hashes, starts, ends, offsets = _letters(texts)
        _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        found = word_decisions(self.table, self.bias, data, starts[one], ends[one])[back]
        x = np.column_stack([_pool(found, offsets), np.ones(len(texts))])
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out fold."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marked = marked.where(crc_bucket("doc_id", 3) != 1).withColumn("lot", F.xxhash64("doc_id"))
    parts = [marked.where("toxic = 1").orderBy("lot", "doc_id").limit(max_toxic), marked.where("toxic = 0").orderBy("lot", "doc_id").limit(max_clean)]
    chosen = parts[0].unionByName(parts[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") <= max_bytes // 20)  # chosen: at most max_toxic + max_clean rows
    rows = rows.groupBy("doc_id", "toxic", "lot").agg(F.min("text").alias("text"))
    order = Window.orderBy("lot", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("used", F.sum(F.octet_length("text")).over(order)).where(F.col("used") <= max_bytes).orderBy("lot", "doc_id").collect()
    model = Model([r.text for r in out], [r.toxic == 1 for r in out])
    give_back()
    return model


def score(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """docs' columns with score and predicted; where a name is taken, the added column gets an underscore."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one weight table of 4 MB
    names = docs.columns
    added = [free_name(c, names) for c in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 2048):
                s = shared.value.scores(batch["text"])
                yield pa.record_batch([*(batch[c] for c in names), pa.array(s, pa.float64()), pa.array((s >= cutoff).astype(np.int32), pa.int32())], names=[*names, *added])

    source = docs.withColumn("text", F.col("text").cast("string"))
    return source.mapInArrow(released(run), StructType([*source.schema.fields, StructField(added[0], DoubleType()), StructField(added[1], IntegerType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(slim, train(docs, labels)).select("doc_id", F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """docs without the rows that the model rejects, with their own columns as they were."""
    scored = score(docs, train(docs, labels), cutoff)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*docs.columns)
