"""Maximal periodic runs of words, found in tiles of each octave of periods and stitched by document and period.

A run of period q is a stretch of words in which words q apart are identical, which
no neighbour extends, whose smallest period is q and whose length is at least
max(LEAST, 3 q).  For the periods of an octave, P to 2P (and for all below OCTAVE at
once), a document falls into overlapping tiles: P words before a border, 4P behind
it, a border every P words.  A run of such a period has a border behind which P
words recur q words later, so a tile matters only where a hash of P words recurs;
no other tile is looked at.  Tiles are solved by themselves: Z-functions to the
right and (reversed) to the left of the border give, for every period, how far words
recur around it.  That is a fragment of a run.  Fragments of the same run overlap or
touch, those of different runs of one period don't.  They are shuffled by document
and period and stitched; a hot document's periods go to different tasks.  Fragments
whose block is a power of a shorter block are dropped in the tile (the whole run then
has the shorter period), so the number of fragments follows the number of runs.

Short documents are tiled where they are read.  A document of more than SPLIT bytes
is dealt out: its word hashes are cut to pieces of tiles for each octave, which go to
different tasks.

Words are runs of bytes outside ``\\x20`` and ``\\x09``-``\\x0D``, as they are written; they are compared by 64-bit hashes.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text.
Rows are kept one for one: repeated ids are told apart by their texts, equal rows have
equal results, and a null id stays null. Runs that tie on exponent are ordered by
start, then period. Extra columns don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.common import cut, released, slices
from tocsin.llm.memo import ragged
from tocsin.llm.shingles import buffers, powers, words

LEAST = 24
REPEATS = 3
#: Periods below it share one octave; its border distance.
OCTAVE = 8
#: Texts of more bytes are dealt out in pieces of as many words (or of eight tiles, if that is more).
SPLIT = 4 << 20
PIECE = 1 << 18
RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, collapsed string"


def octaves(n: int) -> list[tuple[int, int, int]]:
    """(border distance, least, greatest period) of the octaves that a text of n words can have runs in."""
    out, most = [], n // REPEATS
    if n >= LEAST:
        out.append((OCTAVE, 1, OCTAVE - 1))
        low = OCTAVE
        while low <= most:
            out.append((low, low, 2 * low - 1))
            low *= 2
    return out


def prefix_function(w: list[int]) -> list[int]:
    """Z-function: how long the text from each place on agrees with the text's beginning."""
    n, z = len(w), [0] * len(w)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] if q > 1 else out


def candidates(h: np.ndarray, owner: np.ndarray, step: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(border, period) of the places, a border every step words, behind which step words recur a period later in the same text.

    h: words of all texts, one text after the other; owner: each word's text. Windows are compared by sums of words
    times powers, so some candidates may be false, but none is missed.
    """
    n = len(h)
    if n < 2 * step:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grown = powers(n + high + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * grown[:n])])
    window = np.zeros(-(-n // step) * step + 2 * step, dtype=np.uint64)
    window[: n - step + 1] = sums[step:] - sums[:-step]  # of the words from i on, times the i-th power
    heads = window[::step]
    count = len(heads) - 2
    at, period = [], []
    if low < step:
        for q in range(low, high + 1):
            hit = np.flatnonzero(heads[:count] * grown[q] == window[q::step][:count])
            at.append(hit)
            period.append(np.full(len(hit), q))
    else:
        rows = max(1, (1 << 20) // step)
        for a in range(0, count, rows):
            b = min(count, a + rows)
            same = heads[a:b, None] * grown[None, step : 2 * step] == window[(a + 1) * step : (b + 1) * step].reshape(b - a, step)
            border, more = np.nonzero(same)
            at.append(border + a)
            period.append(more + step)
    at, period = np.concatenate(at) * step, np.concatenate(period).astype(np.int64)
    inside = at + period + step <= n
    at, period = at[inside], period[inside]
    inside = owner[at] == owner[at + period + step - 1]
    return at[inside], period[inside]


def tile_fragments(h: np.ndarray, first: int, end: int, border: int, periods: list[int], step: int, factors: dict[int, list[int]]) -> list[tuple[int, int, int]]:
    """(period, from, to): the places around a border, in the text h[first:end], whose words recur a period later, as far as the tile shows.

    A period whose stretch behind the border has a shorter period that divides it is none.
    """
    most = max(periods)
    right = prefix_function(h[border : min(end, border + 2 * step + most)].tolist())
    before = h[max(first, border - step) : border][::-1].tolist()
    over = min(end, border + most) - border
    left, base = None, len(before) + 1
    out = []
    for q in periods:
        r = min(right[q], 2 * step)
        if r < step:
            continue  # only the sums agreed
        if q not in factors:
            factors[q] = [q // p for p in _primes(q)]
        if any(right[d] >= step + q - d for d in factors[q]):
            continue
        if left is None:  # words before the border against those before border + q: the reversed text from there on
            left = prefix_function([*before, -1, *h[max(first, border - step) : border + over][::-1].tolist()])
        out.append((q, border - min(left[base + over - q], len(before)), border + r))
    return out


def joined(found: np.ndarray) -> np.ndarray:
    """(text, period, from, to) with fragments of one text and period that overlap or touch made one."""
    if len(found) < 2:
        return found
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1) | (found[1:, 2] > found[:-1, 3])  # the ends of a period's fragments rise with their starts
    heads = np.flatnonzero(new)
    return np.stack([found[heads, 0], found[heads, 1], found[heads, 2], np.maximum.reduceat(found[:, 3], heads)], axis=1)


def octave_fragments(h: np.ndarray, offsets: np.ndarray, step: int, low: int, high: int) -> np.ndarray:
    """(text, period, from, to) of the fragments of one octave in texts that stand one after the other; places count from each text's start."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at, period = candidates(h, owner, step, low, high)
    order = np.argsort(at, kind="stable")
    at, period, rows, factors = at[order], period[order], [], {}
    heads = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(at)], strict=False):
        border = int(at[a])
        k = int(owner[border])
        first = int(offsets[k])
        rows += [(k, q, x - first, y - first) for q, x, y in tile_fragments(h, first, int(offsets[k + 1]), border, period[a:b].tolist(), step, factors)]
    return joined(np.array(rows, dtype=np.int64).reshape(-1, 4))


def all_fragments(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fragments of all octaves, by text."""
    sizes, out = np.diff(offsets), [np.zeros((0, 4), np.int64)]
    for step, low, high in octaves(int(sizes.max(initial=0))):
        long = np.flatnonzero(sizes >= max(LEAST, REPEATS * low))
        part, places = ragged(h, offsets, long)
        found = octave_fragments(part, places, step, low, high)
        found[:, 0] = long[found[:, 0]]
        out.append(found)
    found = np.concatenate(out)
    return found[np.argsort(found[:, 0], kind="stable")]


def spread(h: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(border distance, least, greatest period, first word, words) of the pieces of a long text: tiles of five borders' distance overlap."""
    for step, low, high in octaves(len(h)):
        size = max(PIECE, 8 * step)
        for at in range(0, max(1, len(h) - 5 * step), size):
            yield step, low, high, at, h[at : at + size + 5 * step]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Flags of the words that no run has after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


FOUND = pa.list_(pa.struct([("period", pa.int64()), ("from", pa.int64()), ("to", pa.int64())]))


def _structs(found: np.ndarray, bounds: np.ndarray, none: np.ndarray) -> pa.Array:
    fields = [pa.array(np.ascontiguousarray(found[:, k])) for k in (1, 2, 3)]
    flat = pa.StructArray.from_arrays(fields, fields=list(FOUND.value_type))
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), mask=np.append(none, False)), flat)


def _tiled(collapsed: bool):
    """Fragments of each text that isn't dealt out; the text goes on only if it has any, else what it comes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 2048, most=1 << 20):
                hashes, starts, ends, offsets = words(batch["text"], lower=False)
                data, _ = buffers(batch["text"])
                found = all_fragments(hashes, offsets)
                bounds = np.searchsorted(found[:, 0], np.arange(batch.num_rows + 1))
                none = np.diff(bounds) == 0
                raw, plain, digest = data.tobytes(), [], []
                for k in range(batch.num_rows):
                    a, b = offsets[k], offsets[k + 1]
                    whole = b" ".join([raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]) if none[k] else None
                    plain.append(whole if collapsed else None)
                    digest.append(hashlib.sha256(whole).hexdigest() if none[k] else None)
                text = batch["text"].take(pa.array(np.arange(batch.num_rows), mask=none))
                yield pa.record_batch([batch["doc_id"], batch["key"], text, _structs(found, bounds, none), pa.array(digest, pa.string()), pa.array(plain, pa.binary()).cast(pa.string())], names=["doc_id", "key", "text", "found", "digest", "plain"])

    return released(run)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in slices(big, 1):
            hashes, *_ = words(batch["text"], lower=False)
            for step, low, high, at, part in spread(hashes):
                yield pa.record_batch([batch["doc_id"], batch["key"], *[pa.array([x], pa.int64()) for x in (step, low, high, at)], pa.array([part.tobytes()], pa.binary())], names=["doc_id", "key", "step", "low", "high", "at", "words"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            h = np.frombuffer(batch["words"][k].as_py(), dtype=np.uint64)
            found = octave_fragments(h, np.array([0, len(h)]), *[batch[c][k].as_py() for c in ("step", "low", "high")])
            some = pa.array(np.full(len(found), k))
            at = batch["at"][k].as_py()
            yield pa.record_batch([batch["doc_id"].take(some), batch["key"].take(some), pa.array(found[:, 1]), pa.array(found[:, 2] + at), pa.array(found[:, 3] + at)], names=["doc_id", "key", "period", "from", "to"])


def _finished(collapsed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 1024, most=1 << 20):
                _, starts, ends, offsets = words(batch["text"], lower=False)
                data, _ = buffers(batch["text"])
                raw, out = data.tobytes(), []
                for k, told in enumerate(batch["runs"].to_pylist()):
                    a, b = offsets[k], offsets[k + 1]
                    runs = [(r["start"], r["length"], r["period"]) for r in told or []]
                    keep = np.flatnonzero(kept_words(b - a, runs)) + a
                    text = b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    out.append((len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if collapsed else None))
                kinds = [pa.int64()] * 5 + [pa.string()] * 3
                yield pa.record_batch([batch["doc_id"], *[pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]], names=["doc_id", *RESULT.replace(",", "").split()[::2]])

    return released(run)


def periodic_runs(docs: DataFrame, collapsed: bool = True) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli), digests of all runs and of the
    collapsed text, and that text itself if asked for, of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    source = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    long = F.octet_length("text") > SPLIT
    found = "array<struct<period: bigint, from: bigint, to: bigint>>"
    tiled = source.where(~F.coalesce(long, F.lit(False))).mapInArrow(_tiled(collapsed), f"doc_id {kind}, key long, text string, found {found}, digest string, plain string")
    tiled = cut(tiled, "tiles")
    dealt = source.where(long)
    pieces = dealt.mapInArrow(_dealt, f"doc_id {kind}, key long, step long, low long, high long, at long, words binary")
    pieces = pieces.repartition("key", "step", "at").mapInArrow(_solved, f"doc_id {kind}, key long, period long, `from` long, `to` long")
    parts = tiled.where("found is not null").select("doc_id", "key", F.inline("found")).unionByName(pieces)
    by = Window.partitionBy("doc_id", "key", "period").orderBy("from", "to")
    reach = F.max("to").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = parts.withColumn("new", F.coalesce(F.col("from") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by))
    runs = runs.groupBy("doc_id", "key", "period", "run").agg(F.min("from").alias("start"), (F.max("to") - F.min("from") + F.col("period")).alias("length"))
    runs = runs.where(F.col("length") >= F.greatest(F.lit(LEAST), REPEATS * F.col("period")))
    listed = runs.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))  # of one document
    listed = listed.withColumnRenamed("doc_id", "id_").withColumnRenamed("key", "key_")
    open_rows = tiled.where("found is not null").select("doc_id", "key", "text").unionByName(dealt.select("doc_id", "key", "text"))
    both = open_rows.join(listed, (F.col("key") == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("id_")), "left").select("doc_id", "text", "runs")
    whole = both.mapInArrow(_finished(collapsed), f"doc_id {kind}, {RESULT}")
    nothing = F.lit(None).cast("long")
    empty = hashlib.sha256(b"").hexdigest()
    plain = tiled.where("found is null").select("doc_id", F.lit(0).cast("long").alias("n_runs"), *[nothing.alias(c) for c in ("start", "length", "period", "exponent_milli")], F.lit(empty).alias("runs_sha256"), F.col("digest").alias("collapsed_sha256"), F.col("plain").alias("collapsed"))
    out = whole.unionByName(plain)
    return out if collapsed else out.drop("collapsed")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs with a tenth of the texts, chosen by the id's crc32, made periodic from some word on (a null id is never chosen)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words_of = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.expr("h % 10 = 0"), words_of)).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.expr("case when n > 0 then h div 10 % n end")).withColumn("p", F.expr("1 + (n - a) div (3 + h div 10 % 8)"))
    again = F.expr("array_join(concat(slice(w, 1, int(a)), slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int(3 + h div 10 % 8))), 1, int(n - a))), ' ')")
    return rows.select("doc_id", F.when(F.expr("n > 0"), again).otherwise(F.col("text")).alias("text"))
