"""Cases that earlier versions got wrong: wide table cells, closed details, cased tokenizers, disguised addresses."""

import json
import re
import time
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tocsin.llm import html_text, pii, token_files


def test_wide_cells_take_no_time():
    page = "<table>" + "<tr>" + "".join(f"<td colspan=1000>c{k}" for k in range(2000)) + "<tr><td>a<td>b</table>"
    began = time.perf_counter()
    out = html_text.html_text(page)
    assert time.perf_counter() - began < 1 and "c1999" in out and out.endswith("a  b")


def test_columns_stay_aligned_beside_spans():
    assert html_text.html_text("<table><tr><td>one<td>two<td>three<tr><td colspan=2>wide one<td>x<tr><td>a<td>bb<td>c</table>") == "one  two  three\nwide one  x\na    bb   c"


def test_closed_parts_are_invisible():
    page = "a<dialog>no</dialog><dialog open>yes</dialog><details><summary>head</summary>hidden<summary>second</summary></details><details open><summary>s</summary>shown</details><ruby>kan<rp>(</rp><rt>ji</rt><rp>)</rp></ruby>"
    got = html_text.html_text(page)
    assert [w for w in ("no", "hidden", "second", "(", ")") if re.search(rf"(^|\W){re.escape(w)}(\W|$)", got) and w in got.split()] == [] and "(" not in got
    assert all(w in got for w in ("yes", "head", "shown", "s", "kan", "ji"))


def test_cased_tokenizer_tells_capitals_apart(spark, tmp_path):
    told = json.loads(open(token_files.default_tokenizer(), encoding="utf-8").read())
    parts = told["normalizer"].get("normalizers", [told["normalizer"]])
    told["normalizer"] = {"type": "Sequence", "normalizers": [p for p in parts if p["type"] != "Lowercase"]}
    path = str(tmp_path / "cased.json")
    open(path, "w", encoding="utf-8").write(json.dumps(told))
    tokenizer = Tokenizer.from_file(path)
    rows = [(1, "The the THE tHe"), (2, "the The"), (3, None), (4, "Ab ab AB! ab!")]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.token_digest(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    want = {}
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, token_files.END_ID]
        want[i] = (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    assert got == want


@pytest.fixture(scope="module")
def forest(spark):
    words = "carbon echo fox gamma hotel india kilo lima nova".split()
    rng = np.random.default_rng(2)
    rows = [(" ".join(words[k] for k in rng.integers(len(words), size=12)) + f" +1 (389) 555-{rng.integers(1000, 9999)} mail a.b@c{k}.org",) for k in range(150)]
    return pii.train(spark.createDataFrame(rows, "text string"))


def spell(rng, form):
    return "".join(str(rng.integers(10)) if c == "#" else c for c in form)


#: None of these forms is among pii.EXAMPLES.
PRIVATE = ["kim## { at } mail { dot } org", "x.y##(AT)host##.net", "ann# < At > lab.example.net", "tom## at uni dot example dot net", "zoe##@ firm.example.com", "lou@@mail##.org", "pat##@web#,example,net", "j_doe AT site##.org", "###/###-####", "(0##) ####-####", "0###.######", "172-##-1#-#"]
PUBLIC = ["20##/11/0#", "p. 1##-2##", "20##-20##", "look at store.Then", "###-##-####", "#,###,###", "1#:##:##", "v#.##.#.#", "1#.##.19##", "lot at #.main", "ab######cd", "sizes at ##.cm"]


def test_forms_that_were_not_learned_are_found(spark, forest):
    rng = np.random.default_rng(11)
    rows = [(k, f"alpha bravo {('write' if k % 2 else 'or')} {spell(rng, forms[k // 2 % len(forms)])} then delta", int(forms is PRIVATE)) for forms in (PRIVATE, PUBLIC) for k in range(240)]
    docs = spark.createDataFrame(rows, "id long, text string, private int")
    found = {(r.private, r.hit): r.n for r in pii.with_spans(docs, forest).selectExpr("private", "size(added) > 0 as hit").groupBy("private", "hit").count().withColumnRenamed("count", "n").collect()}
    recall, false = found.get((1, True), 0) / 240, found.get((0, True), 0) / 240
    assert recall >= 0.8 and false <= 0.1, (recall, false)  # ten of the twelve forms, and none of the others
    kinds = {r.text.split()[3][:4]: r.kind for r in pii.with_spans(docs, forest).where("private = 1").selectExpr("text", "added[0].kind as kind").collect() if "172-" in r.text}
    assert set(kinds.values()) <= {"ip"}
