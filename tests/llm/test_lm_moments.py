"""The moments of the language model's first weights, from precomputed answers, against the counts themselves."""

import numpy as np
import pyarrow as pa

from tocsin.llm import language_model as lm
from .test_operators import text


def test_moments_leave_each_occurrence_out():
    s = lm.Stream(pa.array([text(500, 90), text(501, 60), text(500, 90), None], pa.large_string()))
    code = lm.Code(np.bincount(s.data, minlength=256))
    s.place_segments()
    at = np.arange(len(s.data))
    slots, bits, _ = code.decisions(s.data, s.contexts(at, np.repeat(np.arange(4, dtype=np.int32), np.diff(s.texts))))
    counts = np.zeros((lm.SHIFT[-1], 2), dtype=np.uint32)
    for x in slots:
        np.add.at(counts, (x, bits), np.uint32(1))
    own = [counts[x].astype(np.int64) - np.eye(2, dtype=np.int64)[bits.astype(np.int64)] for x in slots]
    answers = np.array([np.clip(np.log(n[:, 1] + lm.PRIOR) - np.log(n[:, 0] + lm.PRIOR), -31 / lm.SCALE, 31 / lm.SCALE) for n in own])
    gate = lm._seen(own[lm.LONGEST].sum(axis=1)) * 3 + lm._seen(own[lm.PAIR].sum(axis=1))
    p = 1 / (1 + np.exp(-np.clip(lm.START * answers.sum(axis=0), -lm.TOP, lm.TOP)))
    want = np.zeros((lm.GATES, lm.PREDICTORS + 1, lm.PREDICTORS))
    for g in range(lm.GATES):
        x = answers[:, gate == g]
        want[g, :-1], want[g, -1] = (x * (p * (1 - p))[gate == g]) @ x.T, x @ (bits - p)[gate == g]
    got = lm.moments(code, lm.Unseen(lm.packed(counts[:, 0], counts[:, 1])), s)
    assert len(np.unique(gate)) > 3 and np.allclose(got, want, rtol=1e-4, atol=1e-3)
