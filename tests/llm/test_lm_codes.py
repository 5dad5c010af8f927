"""Codes by the two bytes before: fewer decisions, proper probabilities, and the same slots whether bytes are taken alone or in windows."""

import numpy as np
import pyarrow as pa
import pytest

from tocsin.llm import language_model as lm
from .test_models import Fixed
from .test_operators import text


def stream(texts):
    s = lm.Stream(pa.array(texts, pa.large_string()))
    s.place_segments()
    return s


def code_of(s):
    return lm.Code(np.bincount(lm._rows_of(s) * 256 + s.data, minlength=256 * lm.ROWS).reshape(lm.ROWS, 256))


def test_a_code_by_the_bytes_before_takes_fewer_decisions():
    s = stream([text(k, 400) for k in range(20)])
    one, many = lm.Code(np.bincount(s.data, minlength=256)), code_of(s)
    taken = [np.diff(c.edges)[c.symbols(s)].mean() for c in (one, many)]
    assert taken[1] < 0.7 * taken[0]
    told = {}
    for row, c in zip(lm._rows_of(s).tolist(), many.symbols(s).tolist(), strict=True):
        assert told.setdefault(row, c // 256) == c // 256


def test_rows_know_two_bytes_of_the_segment_alone():
    s = stream(["ab cde", "", None, "e", "x cde\tcde"])
    rows, data = lm._rows_of(s).tolist(), s.data.tobytes()
    starts = s.starts.tolist()
    seen = {}
    for at, row in enumerate(rows):
        first = max(x for x in starts if x <= at)
        assert seen.setdefault(data[max(first, at - 2) : at], row) == row
    assert len(set(seen.values())) == len(seen)


def test_windows_give_the_slots_of_single_bytes(monkeypatch):
    monkeypatch.setattr(lm, "WINDOW_BYTES", 50)
    s = stream([text(1, 30), "", None, "a", "ab\tÉcole  x", text(2, 30), "abcdefg"])
    owner = np.repeat(np.arange(7), np.diff(s.texts))
    want = [lm._doubled(k, x).tolist() for k, x in enumerate(s.contexts(np.arange(len(s.data)), owner))]
    assert [x.tolist() for x in s.bases()] == want


def test_probabilities_add_up_with_codes_by_the_bytes_before(spark):
    texts = [text(k, 60) for k in range(20)]
    code = code_of(stream(texts))
    zero, one = lm.learned_tables(spark.createDataFrame([(t, True) for t in texts], "text string, learn boolean"), code)
    mixture = lm.Mixture(code, zero, one, np.full((lm.GATES, lm.PREDICTORS), 0.3))
    for start in (text(3, 30).encode(), text(3, 30).encode()[:-1], text(3, 30).encode() + b" "):
        logs = [mixture.scores(Fixed(start + bytes([c])))[0] for c in range(256)]
        assert sum(np.exp(np.array(logs) - mixture.scores(Fixed(start))[0])) == pytest.approx(1, abs=0.01)
