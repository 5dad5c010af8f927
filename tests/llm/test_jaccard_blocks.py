"""Large groups of near copies: what is made of them grows with their members, not with their pairs, and no link is lost."""

import itertools

import numpy as np
import pyarrow as pa
import pytest

from tocsin.llm import jaccard_join
from .test_operators import shingle_set, text


def near_copies(n, edits, seed=5):
    rng, own, out = np.random.default_rng(seed), text(90, 150).split(), []
    for k in range(n):
        w = list(own)
        for at in rng.choice(len(w), int(rng.integers(1, edits)), replace=False):
            w[at] = f"e{k}x{at}"
        out.append(" ".join(w))
    return out


def components(texts):
    """Least row number of each text's component, by brute force."""
    sets = [shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {k: find(k) for k in range(len(texts))}


@pytest.mark.parametrize("block", [256, 48])
def test_a_group_of_near_copies_makes_rows_by_members(spark, monkeypatch, block):
    texts = near_copies(360, 9)
    made, cut = {}, jaccard_join.cut

    def counted(df, name, *more):
        out = cut(df, name, *more)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard_join, "cut", counted)
    monkeypatch.setattr(jaccard_join, "BLOCK", block, raising=False)
    got = jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == components(texts)
    assert len({r.component_id for r in got}) > 20  # many are linked with none
    families = made["candidates"] + len(texts)
    sent = made.pop("able", 0)  # in a family of many blocks a member is sent once for each lot or block that it is held against
    assert max(made.values()) <= families and sent <= families * (1 if block == 256 else 2 * len(texts) / block), (made, sent)


def test_tied_equals_brute_force(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMNS", 16)
    texts = near_copies(80, 14, seed=6)
    values, offsets = jaccard_join._sets(pa.array(texts))
    blobs = [values[a:b].tobytes() for a, b in itertools.pairwise(offsets)]
    want = components(texts)
    group = pa.table({"side": [0] * 80, "c": list(range(80)), "elements": pa.array(blobs, pa.binary())})
    got = jaccard_join._tied(group)
    assert dict(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == {k: c for k, c in want.items() if k != c}
    halves = jaccard_join._tied(group.set_column(0, "side", pa.array([k % 2 for k in range(80)])).set_column(1, "c", pa.array([want[k] for k in range(80)])))
    assert halves.num_rows == 0  # what is connected already ties nothing
