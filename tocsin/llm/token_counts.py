"""Exact token counts of every prefix of every text, without encoding a text twice.

The tokenizer is a public byte-level merge vocabulary (``tokenizer``, a .json file
of the tokenizers library).  A text falls into words by a fixed pattern, and merges
never cross words.  Within a word a dynamic program over its prefixes finds the
last token of each: the only token t that ends there for which the last token u
before t stays as it is when u and t are merged by themselves.  A prefix then has
one token more than the prefix before its last token.  Each distinct word of a
batch is solved once; candidates come from an automaton over the vocabulary.

A prefix of a text can fall into words in another way than the text itself, and
its count says so: a run of white space is one word as long as nothing follows it,
half a contraction is two words, and half a special string is ordinary text.

``prefix_counts`` stores the counts, one byte a character in most cases;
``tokens_at`` and ``longest_within`` answer questions of truncation and budget
from what is stored.

Defined cases: a null or empty text has no prefixes, 0 bytes and 0 tokens. Null and
repeated ids are rows like any other, and equal rows have equal answers. A text of
any length is cut at word ends into parts of PART bytes, so memory doesn't grow with
it beyond its longest unbroken stretch. Extra columns don't matter. An empty table
gives an empty one. Special strings inside a text are one token each, as by default
in the library. Bytes that aren't UTF-8 count as marks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import give_back, slices
from tocsin.llm.memo import Memo, ragged
from tocsin.llm.shingles import buffers, hashed_runs

PART = 1 << 20
STORED = "n_chars long, n_bytes long, n_tokens long, steps binary, jumps array<int>"
#: A step that doesn't fit a byte; its value is among the jumps.
JUMP = -128
MARK, LETTER, NUMBER, SPACE = range(4)
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
NONE, START = -2, -1
NEVER = 1 << 30


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def character_classes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(first code points, classes) of the ranges of equal class, as the library's own pattern sees them.

    Characters of one class stand in one word when they follow each other, so a text of all characters in order
    falls apart where the class changes; the class of each part is found by three probes.
    """
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str

    def probe(c: str) -> int:
        joins = lambda x: len(split(x + c)) == 1
        return LETTER if joins("a") else NUMBER if joins("1") else MARK if joins("!") else SPACE

    firsts, classes = [], []
    for low in range(0, 0x110000, 0x4000):
        codes = [c for c in range(low, low + 0x4000) if not 0xD800 <= c < 0xE000]
        if not codes:
            continue
        text = "".join(map(chr, codes))
        for _, (a, _b) in split(text):
            firsts.append(codes[a])
            classes.append(probe(text[a]))
    # around the space and the apostrophe a part may hold two classes: ASCII is probed one by one
    keep = [k for k, c in enumerate(firsts) if c >= 128]
    return np.array([*range(128), 128, *[firsts[k] for k in keep]]), np.array([*[probe(chr(c)) for c in range(128)], probe(chr(128)), *[classes[k] for k in keep]], dtype=np.uint8)


class Vocabulary:
    """Tokens as bytes, ranks of merges, and the automaton that finds tokens in words."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before = told["model"], told["pre_tokenizer"] or {}
        odd = told["normalizer"] or model["type"] != "BPE" or model.get("dropout") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("ignore_merges")
        if odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError(f"{path} isn't a plain byte-level merge vocabulary")
        self.special = [t["content"].encode() for t in told["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        raw = lambda s: bytes(map(byte.__getitem__, s))
        self.tokens = {i: raw(s) for s, i in model["vocab"].items() if all(c in byte for c in s)}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.ids = {t: i for i, t in self.tokens.items()}
        self.pair_ranks = {self.ids[a] << 20 | self.ids[b]: k for (a, b), k in self.ranks.items()}
        self.made: dict[int, tuple[int, int, int] | None] = {}
        self.odd: set[int] = set()
        self.edges: tuple[dict, dict] = {}, {}
        self.sizes = [0] * (max(self.tokens) + 1)
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in self.tokens.items():
            self.sizes[i] = len(t)
            self.find.add_word(t.decode("latin-1"), i)
        self.find.make_automaton()
        self.known: dict[int, bool] = {}

    def halves(self, t: int) -> tuple[int, int, int] | None:
        """The two tokens whose merge, the last one, makes token t, and that merge's rank; None for a byte, and for a token that merges never make."""
        got = self.made.get(t, 0)
        if got == 0:
            parts, text = [self.tokens[t][k : k + 1] for k in range(self.sizes[t])], self.tokens[t]
            got = None
            while len(parts) > 1:
                rank, k = min((self.ranks.get(p, NEVER), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == NEVER:
                    self.odd.add(t)
                    break
                if len(parts) == 2:
                    got = self.ids[parts[0]], self.ids[parts[1]], rank
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert t in self.odd or b"".join(parts) == text
            self.made[t] = got
        return got

    def edge(self, t: int, side: int) -> list[tuple[int, int, int]]:
        """(token, rank that makes it, rank that ends it) of what stands at t's left (0) or right (1) edge while t is merged, the last first."""
        got = self.edges[side].get(t)
        if got is None:
            got, until, x = [], NEVER, t
            while (h := self.halves(x)) is not None:
                got.append((x, h[2], until))
                until, x = h[2], h[side]
            got.append((x, -1, until))
            self.edges[side][t] = got
        return got

    def stays(self, u: int, t: int) -> bool:
        """Whether tokens u and t (t alone at a word's start) are what their joined text is encoded as.

        They are if no merge across their border comes before what it would use is used up: the left one's own
        merges go first at equal rank, those of the right one don't.
        """
        for x in (u, t):
            if x != START:
                self.halves(x)
                if x in self.odd:
                    return False
        if u == START:
            return True
        left, right, ranks = self.edge(u, 1), self.edge(t, 0), self.pair_ranks
        for x, made_x, until_x in left:
            for y, made_y, until_y in right:
                rank = ranks.get(x << 20 | y)
                if rank is not None and rank < until_x and rank <= until_y and made_x < until_y and made_y < until_x:
                    return False
        return True

    def solve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """For Memo: token counts at every character's end of each word."""
        whole = data.tobytes()
        words = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        joined = "Ā".join(w.decode("latin-1") for w in words)  # the joint is in no token
        lengths = ends - starts
        begin = np.cumsum(lengths + 1) - lengths - 1
        last, count, sizes, known = [NONE] * (len(joined) + 2), [0] * (len(joined) + 2), self.sizes, self.known
        for at in begin.tolist():
            last[at] = START
        for end, t in self.find.iter(joined):
            end += 1
            if last[end] != NONE:  # only one token fits
                continue
            at = end - sizes[t]
            u = last[at]
            if u == NONE:
                continue
            key = u + 1 << 20 | t
            fits = known.get(key)
            if fits is None:
                if len(known) >= 1 << 20:
                    known.clear()
                fits = known[key] = self.stays(u, t)
            if fits:
                last[end], count[end] = t, count[at] + 1
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        place = np.arange(len(flat)) + np.repeat(np.arange(len(words)), lengths)
        counts = np.array(count, dtype=np.int32)[place + 1]
        edge = np.ones(len(flat), dtype=bool)
        edge[:-1] = flat[1:] & 0xC0 != 0x80
        stops = np.cumsum(lengths)
        edge[stops - 1] = True
        return counts[edge], np.concatenate([[0], np.cumsum(edge)[stops - 1]]), np.zeros((len(words), 0))


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> tuple[Vocabulary, Memo]:
    words = Vocabulary(path)
    return words, Memo(words.solve, 0)


def _codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that start at these bytes."""
    out = data[at].astype(np.int64)
    wide = np.flatnonzero(out >= 0xC0)
    if len(wide):
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
        b = [padded[at[wide] + k] & 0x3F for k in range(4)]
        lead = out[wide]
        two, three = (lead & 0x1F) << 6 | b[1], (lead & 0x0F) << 12 | b[1] << 6 | b[2]
        out[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, (lead & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]))
    return np.minimum(out, 0x10FFFF)


def word_starts(codes: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word starts as flags, starts and ends of runs of white space that something follows, contractions of three characters).

    first flags the characters at which a text (or what follows a special string) begins.
    """
    n = len(codes)
    new = first.copy()
    new[1:] |= kinds[1:] != kinds[:-1]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], n)
    space = kinds[heads] == SPACE
    a, b = heads[space], tails[space]
    followed = (b < n) & ~np.append(first, True)[b]
    a, b = a[followed], b[followed]
    starts = new.copy()
    starts[b - 1] = True  # the last of a run stands alone or before the next word
    joined = b[codes[b - 1] == 0x20]
    starts[joined] = False
    # an apostrophe that is a word's start and no part of more marks, with a letter behind
    lone = heads[(codes[heads] == 0x27) & (tails - heads == 1)]
    lone = lone[starts[lone] & (lone + 1 < n)]
    lone = lone[~first[lone + 1]]
    more = lambda k: np.where((lone + k < n) & ~first[np.minimum(lone + k, n - 1)], codes[np.minimum(lone + k, n - 1)], -1)
    one, two = more(1), more(2)
    size = np.zeros(len(lone), dtype=np.int64)
    for c in CONTRACTIONS:
        hit = one == ord(c[0])
        if len(c) == 2:
            hit &= two == ord(c[1])
        size[hit] = len(c)
    short = size > 0
    starts[lone[short] + 1] = False
    ends = lone[short] + 1 + size[short]
    ends = ends[ends < n]
    starts[ends] = True
    return starts, a, b, lone[size == 2]


def _specials(data: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> list[tuple[int, int]]:
    """(start, end) of the special strings inside texts, leftmost first, the longest of those that start together."""
    whole, found = data.tobytes(), []
    if not any(s in whole for s in special):
        return found
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        at = low
        while hits := [(k, -len(s)) for s in special if (k := whole.find(s, at, high)) >= 0]:
            k, size = min(hits)
            found.append((k, at := k - size))
    return found


def count_prefixes(data: np.ndarray, offsets: np.ndarray, path: str, classes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(count, places): tokens of the prefix that ends with each character of each text; text i's are count[places[i]:places[i + 1]]."""
    words, memo = _vocabulary(path)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    lead = data & 0xC0 != 0x80
    heads = offsets[:-1][np.diff(offsets) > 0]
    lead[heads] = True
    specials = _specials(data, offsets, words.special)
    closing = np.array([e - 1 for _, e in specials], dtype=np.int64)  # the last character of a special string ends it
    at = np.flatnonzero(lead)
    codes = _codes(data, at)
    kinds = classes[1][np.searchsorted(classes[0], codes, side="right") - 1]
    first = np.zeros(len(at), dtype=bool)
    first[np.searchsorted(at, heads)] = True
    closers = np.searchsorted(at, closing)
    first[closers] = True
    after = closers + 1
    first[after[after < len(at)]] = True
    starts, run, stop, thirds = word_starts(codes, kinds, first)
    heads_of = np.flatnonzero(starts)
    edges = at[heads_of]
    keys, one, back = np.unique(hashed_runs(data, edges), return_index=True, return_inverse=True)
    ends = np.append(edges[1:], len(data))
    flat, places = _looked_up(memo, keys, data, edges[one], ends[one], back)
    total = flat[places[1:] - 1].astype(np.int64)
    before = np.cumsum(total) - total
    part = np.searchsorted(heads_of, np.flatnonzero(first))  # the word with which each part begins
    before -= np.repeat(before[part], np.diff(np.append(part, len(heads_of))))
    count = flat + np.repeat(before, np.diff(places))
    # prefixes that end within what later becomes two words or one
    several = stop - run > 1
    if several.any():
        run, stop = run[several], stop[several]
        low, high = at[run], np.append(at, len(data))[stop]
        bounds = np.stack([low, high], axis=1).ravel()
        text, spots = ragged(data, bounds, 2 * np.arange(len(run)))
        keys, one, back = np.unique(hashed_runs(text, spots[:-1]), return_index=True, return_inverse=True)
        runs, spots = _looked_up(memo, keys, data, low[one], high[one], back)
        count[stop - 1] = count[run] - flat[run] + runs[spots[1:] - 1]
    if len(thirds):
        count[thirds + 1] = count[thirds] + 1
    bounds = np.searchsorted(at, offsets)
    owner = np.searchsorted(offsets, closing, side="right") - 1
    for k, closer in enumerate(closers):  # few texts have special strings
        head = int(np.searchsorted(at, specials[k][0]))
        begin = bounds[owner[k]]
        count[closer] = (count[head - 1] if head > begin else 0) + 1
        until = closers[k + 1] if k + 1 < len(closers) and owner[k + 1] == owner[k] else bounds[owner[k] + 1]
        count[closer + 1 : until] += count[closer]
    return count, bounds


def _looked_up(memo: Memo, keys, data, starts, ends, back):
    rows = memo.rows_of(keys, data, starts, ends)  # may renew the store's arrays, so they are read afterwards
    return ragged(memo.flat, memo.edges, rows[back])


def steps_of(count: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences from character to character as bytes, with JUMP for large ones, and the large ones."""
    step = np.diff(count, prepend=0)
    heads = bounds[:-1][np.diff(bounds) > 0]
    step[heads] = count[heads]
    large = np.abs(step) > 127
    jumps = step[large].astype(np.int32)
    step[large] = JUMP
    return step.astype(np.int8), jumps


def counts_of(steps: bytes, jumps) -> np.ndarray:
    """The stored counts: entry i is the number of tokens of the first i + 1 characters."""
    step = np.frombuffer(steps, dtype=np.int8).astype(np.int64)
    step[step == JUMP] = jumps
    return np.cumsum(step)


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that begin with a white space after none, where words end whatever follows."""
    at = 0
    while at < len(data):
        end = at + PART
        while end < len(data) and not (data[end] in (10, 32) and data[end - 1] > 32 and data[end - 1] < 128):
            end += 1
        yield data[at:end]
        at = end


def _rows(path: str, classes: tuple[np.ndarray, np.ndarray]):
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = buffers(batch["text"])
        if batch.num_rows == 1 and len(data) > PART:
            counts, base = [], 0
            for part in _parts(data):
                count, _ = count_prefixes(part, np.array([0, len(part)]), path, classes)
                counts.append(count + base)
                base = int(counts[-1][-1])
            count = np.concatenate(counts)
            bounds = np.array([0, len(count)])
        else:
            count, bounds = count_prefixes(data, offsets, path, classes)
        steps, jumps = steps_of(count, bounds)
        total = np.zeros(batch.num_rows, dtype=np.int64)
        some = np.diff(bounds) > 0
        total[some] = count[bounds[1:][some] - 1]
        large = np.searchsorted(np.flatnonzero(steps == JUMP), bounds)
        raw = steps.tobytes()
        blobs = pa.array([raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
        return pa.record_batch([batch["doc_id"], pa.array(np.diff(bounds)), pa.array(np.diff(offsets)), pa.array(total), blobs, pa.ListArray.from_arrays(pa.array(large, pa.int32()), pa.array(jumps))], names=["doc_id", "n_chars", "n_bytes", "n_tokens", "steps", "jumps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for big in batches:
                for batch in slices(big, 1024, most=PART):
                    yield one(batch)
        finally:
            _vocabulary(path)[1].clear()
            give_back()

    return run


def prefix_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_chars, n_bytes, n_tokens, steps, jumps) of every row: its counts at every prefix, as ``counts_of`` reads them."""
    path = tokenizer or default_tokenizer()
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_rows(path, character_classes(path)), f"doc_id {kind}, {STORED}")


def longest_within(stored: DataFrame, budget: int) -> DataFrame:
    """Stored rows without their counts, and fit_chars: characters of the longest prefix with at most so many tokens."""
    keep = [c for c in stored.columns if c not in ("steps", "jumps")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = batch["n_chars"].to_numpy(zero_copy_only=False).copy()
            for k in np.flatnonzero(batch["n_tokens"].to_numpy(zero_copy_only=False) > budget):
                count = counts_of(batch["steps"][k].as_py(), batch["jumps"][k].as_py())
                fits = np.flatnonzero(count <= budget)
                fit[k] = fits[-1] + 1 if len(fits) else 0
            yield pa.record_batch([*[batch[c] for c in keep], pa.array(fit)], names=[*keep, "fit_chars"])

    return stored.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name in keep) + ", fit_chars long")


def tokens_at(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (doc_id, position) with tokens: of the first so many characters of the text; null for a position outside it.

    An id without a stored row gives no row, one with several a row for each.
    """
    some = asked.groupBy("doc_id").agg(F.collect_set("position").alias("positions"))  # positions asked of one text
    both = stored.select("doc_id", "steps", "jumps").join(some, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spots, counts = [], [], []
            for k in range(batch.num_rows):
                count = np.concatenate([[0], counts_of(batch["steps"][k].as_py(), batch["jumps"][k].as_py())])
                for p in batch["positions"][k].as_py():
                    ids.append(k)
                    spots.append(p)
                    counts.append(int(count[p]) if 0 <= p < len(count) else None)
            yield pa.record_batch([batch["doc_id"].take(pa.array(ids, pa.int64())), pa.array(spots, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "position", "tokens"])

    return both.mapInArrow(run, f"doc_id {dict(stored.dtypes)['doc_id']}, position long, tokens long")


def token_counts(docs: DataFrame, limit: int = 512, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars (the longest prefix within the limit) of every row."""
    return longest_within(prefix_counts(docs, tokenizer), limit).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")
