"""The ten operators on small fixtures: brute force, round trips and defined cases."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tocsin.llm import decontaminate, embedding_dedup, html_text, jaccard_join, language_model, license_scan, pii, sentencepiece_nbest, token_files, toxicity
from tocsin.llm.common import connected_components

WORDS = "alpha bravo carbon delta echo fox gamma hotel india jazz kilo lima mike nova".split()


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(rng.integers(50)) for k in rng.integers(len(WORDS), size=n))


def fixture():
    base = text(1, 60)
    near = base.split()
    near[30] = "other"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, text(2, 40)), (5, None), (6, ""), (7, "two words"), (8, "Two\twords"), (9, " \n "), (10, text(3, 3000)), (None, "null id here"), (4, text(2, 40)), (11, "é漢字😀 ▁x  y z " + "q" * 300)]
    return [(i, t, "x", "y") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), "doc_id long, text string, bucket string, score string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 99), (99, 98), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in connected_components(edges, "a", "b").collect()}
    assert got == {k: 1 for k in range(1, 41)} | {98: 98, 99: 98, 100: 98}
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def test_jaccard_defined_cases(docs, none):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    sizes = {i: len(shingle_set(t)) for i, t, *_ in fixture()}
    assert {k: n for k, n in got} == sizes
    assert got[2, sizes[2]] == 1 and got[3, sizes[3]] == 1 and got[8, 1] == 7 and got[5, 0] == 5 and got[9, 0] == 9 and got[None, sizes[None]] is None
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(120):
        w = text(100 + k % 9, 60).split()
        for _ in range(int(rng.integers(0, 7))):
            w[int(rng.integers(len(w)))] = f"edit{rng.integers(99)}"
        rows.append((k, " ".join(w)))
    sets = {k: shingle_set(t) for k, t in rows}
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: find(k) for k in sets}


def least_signatures(texts, most):
    """The texts of the least set signatures, which lead their index lists."""
    sets = jaccard_join._sets(pa.array(texts))
    return [texts[k] for k in np.argsort(jaccard_join._signatures(*sets))[:most]]


def test_jaccard_large_family_gets_new_leaders(spark):
    passage, others = text(31, 44), [text(32, 16), text(33, 16)]  # the others are more frequent, so no prefix has them but their own
    lone = [least_signatures([f"{passage} w{k} {t}" for k in range(4000)], 1)[0] for t in others]
    rows = lone + [f"{passage} u{k} v{k}" for k in range(160)] + [f"{t} p{k}{j} q{k}{j}" for j, t in enumerate(others) for k in range(320)]
    assert set(least_signatures(rows[:162], 2)) == set(lone)
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k if k < 2 else 2 if k < 162 else 162 if k < 482 else 482 for k in range(len(rows))}


def test_jaccard_null_and_repeated_ids(spark):
    passage = text(34, 44)
    rows = [(None, least_signatures([f"{passage} n{k} m{k}" for k in range(4000)], 1)[0])] + [(k, f"{passage} u{k} v{k}") for k in range(20)]
    assert least_signatures([t for _, t in rows], 1) == [rows[0][1]]
    for k in range(12):  # two texts under one id, each with a near copy
        a, b = text(300 + k, 40), text(400 + k, 40)
        rows += [(1000 + k, a), (1000 + k, b), (100 + k, a + " end"), (200 + k, b + " end end")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None)
    assert found == sorted([(k, 0) for k in range(20)] + [(d, c) for k in range(12) for d, c in [(1000 + k, 100 + k), (1000 + k, 200 + k), (100 + k, 100 + k), (200 + k, 200 + k)]])
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_sentencepiece(docs, none):
    got = sentencepiece_nbest.nbest_digest(docs).collect()
    assert len(got) == len(fixture()) and all(r.round_trip for r in got)
    empty = next(r for r in got if r.doc_id == 5)
    assert (empty.n_pieces, empty.score, empty.nbest_scores) == (0, 0.0, [0.0])
    encoded = sentencepiece_nbest.encode_nbest(docs.where("doc_id in (4, 7, 11)"), 3)
    texts = {i: t for i, t, *_ in fixture()}
    assert all(r.text == texts[r.doc_id] for r in sentencepiece_nbest.decode(encoded).collect())
    assert sentencepiece_nbest.nbest_digest(none).count() == 0


def test_nbest_equals_the_whole_lattice():
    model = sentencepiece_nbest.default_model()
    p = sentencepiece_nbest.pieces(model)
    for t in ("the cat sat on it", "a  b\nc é", "x"):
        e = sentencepiece_nbest.Encoded(pa.array([t]), model)
        edges = sentencepiece_nbest.lattice(p, (" " + t).encode())
        whole = sentencepiece_nbest.backward_a_star(edges, sentencepiece_nbest.viterbi(edges), 5)
        assert [s for s, _ in e.nbest(0, 5)] == [s for s, _ in whole]


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((30, 16))
    rows = [(k, (base[k % 30] + 0.05 * rng.standard_normal(16)).tolist()) for k in range(90)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, rows[0][1]), (204, [1.0, 2.0]), (205, []), (None, rows[0][1])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    ids = [i for i, v in rows if i is not None and v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    x = np.array([dict(rows)[i] if i != 203 else rows[0][1] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    assert [got[i].n_links for i in ids] == links.tolist()
    assert got[203].component_id == got[0].component_id == 0 and got[200].n_links == 0 and got[201].kept and got[204].n_links == 0
    assert len(got) == len(rows)


def test_decontamination(spark, docs):
    item = " ".join(text(3, 3000).split()[500:540])
    bench = spark.createDataFrame([(1, item), (2, "never seen words in any of these texts at all"), (3, None), (4, "two words"), (5, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs, bench).collect()}
    assert got == {(10, 1), (7, 4), (8, 4)}
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0 and decontaminate.contained_items(docs.limit(0), bench).count() == 0


def test_decontamination_of_short_items(spark):
    rows, items, expected = [], [], set()
    for k in range(280):
        w, n = text(500 + k, 300).split(), 5 + k % 7
        item = w[100 : 100 + n]
        if k % 14 >= 7 and n >= 8:
            item[-1] = "other"  # one shingle of 4 to 7 is missing
        rows.append((k, " ".join(w)))
        items.append((k, " ".join(item)))
    items.append((999, "gone " * 30))  # one distinct shingle, however long
    rows.append((999, text(999, 200) + " gone" * 6 + " " + text(998, 200)))
    sets = {k: shingle_set(t) for k, t in rows}
    for i, t in items:
        s = shingle_set(t)
        expected |= {(d, i, len(s & x)) for d, x in sets.items() if 100 * len(s & x) >= 75 * len(s)}
    got = decontaminate.contained_items(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(expected) >= 281 and sorted((r.doc_id, r.item_id, r.n_shared) for r in got) == sorted(expected)


def test_html():
    page = "<title>no</title><p>one <b>two</b>\n three<p>four<ul><li>a<li>b</ul><table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table>x<br>y<div hidden>no</div>&amp;<script>no</script>"
    assert html_text.html_text(page) == "one two three\n\nfour\n\n- a\n- b\n\nName       Qty\napple pie  3\n\nx\ny&"
    assert html_text.html_text(None) is None and html_text.html_text("") == "" and html_text.html_text("1 < 2 <b") == "1 < 2"
    assert "deep" in html_text.html_text("<div>" * 5000 + "deep")


def test_html_stray_quotes_and_formulas():
    show = html_text.html_text
    assert show("<p class=\"a\"\">one</p><p>two \"x\"</p>") == "one\n\ntwo \"x\""
    assert show("<a title=it's>one</a> <b>two's</b> three") == "one two's three"
    assert show("<p title='a > b' x\"hidden y= \"<i>\" =\"z>one<p 'hidden>two<p hidden>no") == "one\n\ntwo"
    assert show("<p title=\"a>open <p>no") == ""
    assert show("let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> be") == "let x=2 be"
    assert show("<svg><title/><title>no</title><desc/><desc>no</desc><style>no</style><path d=1 /><text>one</text><text>two</text></svg><p>three <desc>four</desc>") == "one\ntwo\n\nthree four"
    assert show("<p " + "a" * 100000 + " " * 100000 + "=" * 1000 + ">one") == "one"


def test_pii(spark):
    t = "mail a.b@c.org or +1 (389) 555-5010 at 10.0.0.1, card 4111 1111 1111 1111, not 999.1.1.1"
    rows = spark.createDataFrame([(1, t), (2, None), (3, ""), (1, t)], "doc_id long, text string")
    got = [r for r in pii.pii_digest(rows).collect() if r.doc_id == 1]
    assert len(got) == 2 and (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (1, 1, 1, 1)
    assert got[0].spans.startswith("email:5:14,ip:")
    clean = {r.doc_id: r.text for r in pii.redacted(rows).collect()}[1]
    assert clean == "mail <EMAIL> or <PHONE> at <IP>, card <CARD>, not 999.1.1.1"
    assert pii.pii_digest(rows.limit(0)).count() == 0


def test_licenses(docs, spark):
    rows = spark.createDataFrame([(1, "é " + text(5, 30) + "\nReleased under the MIT License.\n" + text(6, 20)), (2, None), (3, "released under terms")], "doc_id long, text string")
    (r,) = license_scan.scan(rows).collect()
    assert (r.doc_id, r.license, r.coverage) == (1, "mit-notice", 1.0)
    assert rows.first().text[r.start : r.end] == "Released under the MIT License"
    assert license_scan.scan(docs).count() == 0


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        words = text(k, int(rng.integers(20, 60))).split()
        if bad:
            words[int(rng.integers(len(words)))] = str(rng.choice(["idiot", "scumbag", "idi-ot", "idiiot"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    rows += [(900, None), (901, "")]
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.default_tokenizer())
    got = token_files.token_digest(docs).orderBy("start").collect()
    at, texts = 0, {}
    for i, t, *_ in fixture():
        texts.setdefault(i, t or "")
    for r in got:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(fixture()) and token_files.token_digest(none).count() == 0


@pytest.mark.parametrize("t", ["don't stop'n \"go\" it's", "a<|endoftext|>b", "x,y.z'd!!'s", "é, naïve ISN'T"])
def test_runs_give_the_tokenizers_ids(t):
    from tokenizers import Tokenizer

    ids, _ = token_files.encode(pa.array([t]), token_files.default_tokenizer())
    assert ids.tolist() == Tokenizer.from_file(token_files.default_tokenizer()).encode(t, add_special_tokens=False).ids + [2]


def test_streams():
    ranks = np.random.default_rng(0).integers(0, 2**32, 1001, dtype=np.uint32) >> np.random.default_rng(1).integers(0, 32, 1001).astype(np.uint32)
    assert np.array_equal(token_files.unpack(*token_files.pack(ranks), len(ranks)), ranks)


def test_language_model(docs, none):
    got = language_model.lm_scores(docs).collect()
    tokens, counts, learned = {}, {}, 0
    for i, t, *_ in fixture():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower() if (t or "").isascii() else t)
        tokens[i] = w
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            learned += 1
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    total, distinct = sum(counts.values()) + learned, len(counts) + 1
    for r in got:
        w = tokens[r.doc_id]
        base = sum(np.log10((counts.get(x, 0) + 1) / (total + distinct + 1)) for x in w) + np.log10((learned + 1) / (total + distinct + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in counts for x in w) + 1, total)
        assert r.base_score == pytest.approx(base) and r.score < 0 and np.isfinite(r.score)
    assert len(got) == len(fixture()) and language_model.lm_scores(none).count() == 0


def test_more_edges_go_through_the_tied_components_only(spark, monkeypatch):
    from tocsin.llm import common

    rng = np.random.default_rng(8)
    first = [tuple(map(int, rng.integers(60, size=2))) for _ in range(25)]
    more = [tuple(map(int, rng.integers(60, 90, size=2))) for _ in range(6)] + [tuple(map(int, rng.integers(90, size=2))) for _ in range(8)] + [(3, None), (7, 7)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    rows = lambda df: sorted((r.id, r.component) for r in df.collect())
    labels = common.connected_components(frame(first), "a", "b")
    assert rows(common.merged_components(labels, frame(more), "a", "b")) == rows(common.connected_components(frame(first + more), "a", "b"))
    rounds = []
    plain = common._with_minimum
    monkeypatch.setattr(common, "_with_minimum", lambda *x: rounds.append(1) or plain(*x))
    assert rows(common.connected_components(frame([(5, 1), (6, 1), (9, 7)]), "a", "b")) == [(1, 1), (5, 1), (6, 1), (7, 7), (9, 7)] and not rounds
    assert rows(common.connected_components(frame([(5, 1), (6, 5)]), "a", "b")) == [(1, 1), (5, 1), (6, 1)] and rounds
