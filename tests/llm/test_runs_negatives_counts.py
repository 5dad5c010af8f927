"""Periodic runs, hard negatives and token counts against brute force, and their defined cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tocsin.llm import hard_negatives, periodic_runs, registry, token_counts
from tocsin.llm.shingles import buffers

SCHEMA = "doc_id long, text string, key string, runs string, found string"


def runs_of(w):
    """All runs by definition: (start, length, period)."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(24, 3 * q):
                s = w[i : i + n]
                if not any(s[d:] == s[: n - d] for d in range(1, q)):
                    out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def expected_runs(doc_id, text, planted):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = runs_of(w)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), kept)


def repetitive(seed):
    rng, w = random.Random(seed), []
    for _ in range(rng.randint(1, 5)):
        if rng.random() < 0.4:
            w += [f"w{rng.randrange(rng.choice([2, 3, 60]))}" for _ in range(rng.randint(0, 60))]
        else:
            block = [f"w{rng.randrange(rng.choice([1, 2, 5, 60]))}" for _ in range(rng.randint(1, 40))]
            w += (block * rng.randint(2, 30))[: rng.randint(1, 300)]
    return rng.choice([" ", "\n", " \t "]).join(w)


def run_fixture():
    a, b = "x", "y"
    for _ in range(9):
        a, b = b, a + b  # Fibonacci: runs that overlap
    rows = [(k, repetitive(k)) for k in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, " ".join("a" * 23)), (205, " ".join("a" * 24)), (206, " ".join("ab" * 500)), (207, " ".join(b)), (208, "é 漢字 😀 " * 30), (209, "A a " * 20)]
    rows += [(None, "p q " * 40), (7, repetitive(7)), (7, "other text"), (210, " ".join("a" * 30 + "b" + "a" * 30))]
    return [(i, t, "k", "r", "f") for i, t in rows]


def result(rows):
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256, r.collapsed) for r in rows), key=repr)


def test_periodic_runs_equal_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame(run_fixture(), SCHEMA)
    want = sorted(((i, *expected_runs(i, t, False)) for i, t, *_ in run_fixture()), key=repr)
    assert sum(r[1] for r in want) > 150
    assert result(periodic_runs.periodic_runs(docs).collect()) == want
    # texts that are dealt out in pieces give the same
    monkeypatch.setattr(periodic_runs, "SPLIT", 150)
    monkeypatch.setattr(periodic_runs, "PIECE", 64)
    assert result(periodic_runs.periodic_runs(docs).collect()) == want
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_runs_query_equals_brute_force(spark, tmp_path):
    rows = [(k, repetitive(1000 + k)) for k in range(150)] + [(k, " ".join(f"w{j}" for j in range(k))) for k in range(150, 400, 3)] + [(None, "x " * 50), (991, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = {(i, *expected_runs(i, t, True)[:-1]) for i, t in rows}
    assert {tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in got} == want
    assert len(got) == len(rows)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PIECE", 64)
    names = np.random.default_rng(1).integers(0, 1 << 62, 100).astype(np.uint64)
    for seed in range(120):
        w = repetitive(5000 + seed).split()
        h = names[[int(x[1:]) for x in w]]
        found = [np.zeros((0, 4), np.int64)]
        for step, low, high, at, part in periodic_runs.spread(h):
            more = periodic_runs.octave_fragments(part, np.array([0, len(part)]), step, low, high)
            more[:, 2:] += at
            found.append(more)
        got = sorted((int(a), int(b - a + q), int(q)) for _, q, a, b in periodic_runs.joined(np.concatenate(found)) if b - a + q >= max(24, 3 * q))
        assert got == runs_of(w), seed


def test_long_text_of_one_word(spark):
    docs = spark.createDataFrame([(1, "la " * 60_000), (2, " ".join(f"w{k % 7000}" for k in range(40_000)))], "doc_id long, text string")
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.collapsed.count(" ")) for r in periodic_runs.periodic_runs(docs).collect()}
    assert got == {1: (1, 0, 60_000, 1, 0), 2: (1, 0, 40_000, 7000, 6999)}


def negatives_of(rows):
    """By definition, over rows (id, label, vector) that take part."""
    rows = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows if None not in (i, label, v) and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for *_, v in rows), default=0)
    rows = [(i, label, v + [0] * (width - len(v))) for i, label, v in rows]
    out, anchors = [], {}
    for i, label, v in sorted(rows):
        anchors.setdefault(i, (label, v))
    for i, (label, v) in anchors.items():
        if i % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j, other) for j, other, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(-t, k) for t, k, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(i, j, n + 1, k, -s, t) for n, (t, k) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 16)) / 4
    v = base[rng.integers(12, size=n)] + rng.normal(size=(n, 16)) / 10
    rows = [(k, int(rng.integers(3)), v[k].tolist()) for k in range(n)]
    rows += [(n + k, k % 3, v[5].tolist()) for k in range(60)]  # a group of copies
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed):
    rows = vectors(seed, 700)
    rows += [(None, 1, [0.5] * 16), (2000, None, [0.5] * 16), (2100, 1, None), (2200, 1, []), (2300, 1, [float("nan")] * 16), (2400, 2, [None] + [0.1] * 15), (2500, 2, [float("inf")] * 16), (2600, 1, [0.0] * 16), (2700, 0, [0.7] * 5), (300, 1, [0.25] * 16), (301, 1, rows[301][2]), (2800, 77, [0.3] * 16)]
    docs = spark.createDataFrame([(*r, "s", "w", 1) for r in rows], "vec_id long, label int, embedding array<double>, score string, window string, id int").repartition(5)
    want = negatives_of(rows)
    read = lambda: sorted(tuple(r) for r in hard_negatives.hard_negatives(docs).collect())
    assert len(want) > 50 and read() == want
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "LOT", 3)
    assert read() == want
    assert hard_negatives.hard_negatives(docs.limit(0)).count() == 0


def test_small_blocks_give_the_same(monkeypatch):
    rows = sorted(vectors(7, 500))
    points = np.floor(256 * np.array([v for *_, v in rows])).astype(np.int64)
    books = hard_negatives.centres(points[:, :8]), hard_negatives.centres(points[:, 8:])
    codes = hard_negatives.nearest(points[:, :8], books[0]) * len(books[1]) + hard_negatives.nearest(points[:, 8:], books[1])
    order = np.argsort(codes, kind="stable")
    batch = pa.record_batch([pa.array([rows[k][0] for k in order]), pa.array([rows[k][1] for k in order]), pa.array([points[k].astype("<i4").tobytes() for k in order]), pa.array(codes[order].astype(np.int32))], names=["id", "label", "vector", "code"])
    lot = type("Lot", (), {"value": [(i, label, points[k], [9000, 4000, -5]) for k, (i, label, _) in enumerate(rows) if i % 100 == 0]})
    for share in (None, (80, 100)):
        answers = []
        for size in (1 << 14, 40):
            monkeypatch.setattr(hard_negatives, "BLOCK", size)
            answers.append([b.to_pylist() for b in hard_negatives._answered(lot, books, 16, 5, share)(iter([batch]))])
        assert answers[0] == answers[1] and answers[0][0]


def test_walk_stops_before_all_cells():
    rng = np.random.default_rng(3)
    middle = rng.integers(-200, 200, size=(40, 16))
    points = (middle[rng.integers(40, size=4000)] + rng.integers(-6, 7, size=(4000, 16))).astype(np.int64)
    books = hard_negatives.centres(points[:, :8]), hard_negatives.centres(points[:, 8:])
    codes = hard_negatives.nearest(points[:, :8], books[0]) * len(books[1]) + hard_negatives.nearest(points[:, 8:], books[1])
    block = hard_negatives.Block(np.arange(4000), np.zeros(4000, np.int64), points, codes, books)
    looked = []
    for k in range(0, 4000, 200):
        best = hard_negatives.Best(5)
        looked.append(hard_negatives.walk(block, points[k], lambda up, low, b=best: 1 if up >= b.floor() else -1, lambda rows, scores, b=best: b.offer(scores, block.ids[rows])))
        scores = points @ points[k]
        order = np.lexsort((np.arange(4000), -scores))[:5]
        assert best.rows == [(int(scores[j]), int(j)) for j in order]
    assert np.mean(looked) < len(block.cells) / 2


PIECES = ["'s", "'ll", "'re", "'r", "'", " ", "''s", "  ", "\n", "\n\n", " \t", "the", "hello world", "don't", "é", "漢字", "😀", "123", "٣", "!!", "--", "=====", "<|endoftext|>", "<|endof", "|>", "a", "Z", " ", "　", "x" * 9, "'ve", "'v", "\r\n", "ſ", "́", "...", "\x00"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_counts.default_tokenizer())


def by_library(tokenizer, text):
    return [len(e.ids) for e in tokenizer.encode_batch([text[: k + 1] for k in range(len(text))], add_special_tokens=False)] if text else []


def test_counts_of_all_prefixes_equal_the_library(tokenizer):
    rng, path = random.Random(8), token_counts.default_tokenizer()
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12))) for _ in range(500)] + ["", " " * 90, "<|endoftext|>" * 3, "ab" * 150, "'re'll'"]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x2FFF), rng.randint(0xE000, 0x10FFFF), rng.randint(32, 126)])) for _ in range(30)) for _ in range(60)]
    count, places = token_counts.count_prefixes(*buffers(pa.array(texts)), path, token_counts.character_classes(path))
    for k, text in enumerate(texts):
        assert count[places[k] : places[k + 1]].tolist() == by_library(tokenizer, text), text


def test_stored_counts_answer_questions(spark, tokenizer):
    rng = random.Random(9)
    texts = [(k, "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60)))) for k in range(80)] + [(90, None), (91, ""), (None, "no id"), (3, "again"), (92, "=" * 3000 + " " * 400 + "é" * 300)]
    docs = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, steps string, n_tokens int")
    stored = token_counts.prefix_counts(docs)
    got = {(r.doc_id, r.n_chars, r.n_bytes, r.n_tokens): token_counts.counts_of(r.steps, r.jumps).tolist() for r in stored.collect()}
    want = {(i, len(t or ""), len((t or "").encode()), (by_library(tokenizer, t) or [0])[-1] if t else 0): by_library(tokenizer, t) if t else [] for i, t in texts}
    assert got == want
    fits = {(r.doc_id, r.n_chars): r.fit_chars for r in token_counts.longest_within(stored, 7).collect()}
    assert fits == {(i, len(t or "")): max([k + 1 for k, c in enumerate(by_library(tokenizer, t or "")) if c <= 7], default=0) for i, t in texts}
    asked = spark.createDataFrame([(5, 0), (5, 3), (5, 10_000), (6, 2), (90, 0), (90, 1), (777, 1)], "doc_id long, position long")
    counts = dict(texts)
    at = lambda i, p: 0 if p == 0 else by_library(tokenizer, counts[i])[p - 1]
    assert {(r.doc_id, r.position): r.tokens for r in token_counts.tokens_at(stored, asked).collect()} == {(5, 0): 0, (5, 3): at(5, 3), (5, 10_000): None, (6, 2): at(6, 2), (90, 0): 0, (90, 1): None}
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_long_texts_are_cut_where_words_end(tokenizer, monkeypatch):
    monkeypatch.setattr(token_counts, "PART", 50)
    texts = ["".join(random.Random(k).choices(PIECES, k=90)) for k in range(40)]
    path = token_counts.default_tokenizer()
    batch = pa.record_batch([pa.array(range(40)), pa.array(texts)], names=["doc_id", "text"])
    rows = [r for b in token_counts._rows(path, token_counts.character_classes(path))(iter([batch])) for r in b.to_pylist()]
    assert [token_counts.counts_of(r["steps"], r["jumps"]).tolist() for r in rows] == [by_library(tokenizer, t) for t in texts]


def test_steps_that_fit_no_byte():
    count = np.array([1, 2, 300, 5, 4, 1000, 1000])
    steps, jumps = token_counts.steps_of(count, np.array([0, 3, 3, 7]))
    assert jumps.tolist() == [298, 996] and token_counts.counts_of(steps[:3].tobytes(), jumps[:1]).tolist() == [1, 2, 300]
    assert token_counts.counts_of(steps[3:].tobytes(), jumps[1:]).tolist() == [5, 4, 1000, 1000]


def test_token_count_query(spark, tokenizer):
    got = {r.doc_id: r for r in registry.op13_token_counts(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    for r in rows:
        n = len(tokenizer.encode(r.text, add_special_tokens=False).ids)
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len(r.text.encode()), n, n > 512)
        assert len(tokenizer.encode(r.text[: got[r.doc_id].fit_chars], add_special_tokens=False).ids) <= 512
    assert len(got) == len(rows)
