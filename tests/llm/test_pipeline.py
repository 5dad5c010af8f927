"""The corpus pipeline's stages: defined cases, columns, and results against brute force."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import shingle_set, text
from tocsin.llm import sentencepiece_nbest

EXTRA = ("score", "predicted", "digits", "base", "spans", "added", "picked", "m_email", "row", "key", "sig", "label", "stays", "own_id", "n_pieces", "ids_crc32", "c", "bucket")
ITEM = " ".join(text(77, 30).split())


def rows():
    near = text(50, 60).split()
    near[20] = "edited"
    out = [
        (1, text(50, 60)), (2, text(50, 60)), (3, " ".join(near)), (4, text(51, 40)), (4, text(51, 40)), (4, text(52, 40)), (None, text(51, 40)), (None, text(53, 40)), (None, text(53, 40)),
        (5, None), (6, None), (7, ""), (7, ""), (8, " \n "), (9, "two words"), (10, "Two\twords"), (11, text(54, 30) + " " + ITEM + " " + text(55, 30)), (11, text(56, 40)), (None, "x " + ITEM),
        (12, "mail a.b@c.org or +1 (389) 555-5010 at 10.0.0.1, card 4111 1111 1111 1111, not 999.1.1.1 " + text(57, 20)), (13, text(58, 6000)), (14, "é漢字😀 ▁x  y z " + "-" * 1006),
    ]
    return [(i, t, "en", f"s{k}", len(t) if t else None, *(f"{c}{k}" for c in EXTRA)) for k, (i, t) in enumerate(out)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    labelled = [(k, text(k, 30) + (" you scumbag idiot" if k % 4 == 0 else "")) for k in range(100, 400)]
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k, _ in labelled], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "never seen in any of these")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    more = [(k, t, "en", "s", len(t)) for k, t in labelled]
    spark.createDataFrame([r[:5] for r in rows()] + more, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def kept(df):
    return sorted(int(r.source[1:]) for r in df.collect())


def one_of_each(given):
    """Places of the rows that stay: of each group of equal or near sets the least (id, nulls last), one of equal rows."""
    sets = [shingle_set(t) for _, t, *_ in given]
    parent = list(range(len(given)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(given)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    groups = {}
    for k in range(len(given)):
        groups.setdefault(find(k), []).append(k)
    return list(groups.values())


@pytest.mark.parametrize("name", list(STAGES))
def test_columns_and_empty_tables(spark, docs, sf_dir, name):
    out = STAGES[name](spark, docs, sf_dir)
    assert out.columns[: len(docs.columns)] == docs.columns and (out.columns == docs.columns or name == "sentencepiece")
    by_source = {r.source: r for r in out.collect()}
    for r in rows():
        if r[3] in by_source:
            assert [by_source[r[3]][c] for c in EXTRA] == list(r[5:]), name  # columns of the same names as those in use come back as they were
            if r[1] is None or r[1] == "":
                assert by_source[r[3]].text == r[1]
    assert {f"s{k}" for k, r in enumerate(rows()) if not (r[1] or "").strip()} <= set(by_source), name  # rows without a text stay
    assert STAGES[name](spark, docs.limit(0), sf_dir).count() == 0


def test_toxicity_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {r.doc_id for r in STAGES["toxicity"](spark, docs, sf_dir).collect() if r.doc_id and r.doc_id >= 100}
    assert len(out ^ {k for k in range(100, 400) if k % 4}) <= 3


def test_jaccard_stage_equals_brute_force(spark, docs, sf_dir):
    out = kept(STAGES["jaccard_join"](spark, docs, sf_dir))
    assert len(out) == len(set(out))
    given = rows()
    for group in one_of_each(given):
        stay = [k for k in group if k in out]
        least = min((given[k][0] is None, given[k][0] or 0) for k in group)
        assert len(stay) == 1 and (given[stay[0]][0] is None, given[stay[0]][0] or 0) == least


def test_decontamination_stage_equals_brute_force(spark, docs, sf_dir):
    item = shingle_set(ITEM)
    clean = [k for k, (_, t, *_) in enumerate(rows()) if 100 * len(item & shingle_set(t)) < 75 * len(item)]
    assert kept(STAGES["decontamination"](spark, docs, sf_dir)) == clean and len(clean) == len(rows()) - 2


def test_pii_stage(spark, docs, sf_dir):
    got = {int(r.source[1:]): r for r in STAGES["pii"](spark, docs, sf_dir).collect()}
    assert len(got) == len(rows())
    for k, (_, t, _, _, n, *_) in enumerate(rows()):
        want = t
        if t and "a.b@" in t:
            for found, kind in (("a.b@c.org", "EMAIL"), ("+1 (389) 555-5010", "PHONE"), ("10.0.0.1", "IP"), ("4111 1111 1111 1111", "CARD")):
                want = want.replace(found, f"<{kind}>")
        assert got[k].text == want and got[k].n_chars == (n if want is None else len(want))


def test_sentencepiece_stage(spark, docs, sf_dir):
    out = STAGES["sentencepiece"](spark, docs, sf_dir)
    assert out.columns[-3:] == ["n_pieces_", "score_", "ids_crc32_"]
    got = {int(r.source[1:]): r for r in out.collect()}
    assert all(got[k].text == r[1] and (got[k].n_pieces_ > 0) == bool(r[1]) for k, r in enumerate(rows()))


def test_sentencepiece_stage_searches_the_n_best(spark, docs, sf_dir):
    got = {r.source: r for r in STAGES["sentencepiece"](spark, docs, sf_dir).collect()}
    n_best = {}
    for r in sentencepiece_nbest.encode_nbest(docs.selectExpr("cast(substr(source, 2) as long) as doc_id", "text")).collect():
        n_best.setdefault(r.doc_id, []).append((r["rank"], r.score, r.ids))
    assert len(got) == len(n_best) and any(len(r.nbest_scores) == 4 for r in got.values())
    for k, paths in n_best.items():
        paths.sort(key=lambda p: p[0])
        mine = got[f"{docs.first().source[0]}{k}"]
        assert mine.nbest_scores == [s for _, s, _ in paths] and mine.score_ == paths[0][1]
        assert mine.n_pieces_ == len(paths[0][2]) and mine.ids_crc32_ == zlib.crc32(np.array(paths[0][2], dtype="<u4").tobytes())


def test_run_is_the_stages_in_order(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, docs.collect()), key=str) and sorted(out, key=key)[0].doc_id == 1
    assert not any(re.search(r"scumbag", r.text or "") for r in out) and len(out) > 150
