"""One pass for the best rows and the place of a mark: equal to all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.functions import vectors
from ridgeline.operators import judging, nearest, places


def batch(ids, codes, names, x, **more):
    v = pa.array(x.tolist(), pa.list_(pa.float64()))
    return pa.RecordBatch.from_pydict({"id": ids, "code": codes, "name": names, "v": v} | {k: pa.array(c, pa.int64() if k == "mark_id" else pa.float64(), from_pandas=True) for k, c in more.items()})


@pytest.mark.parametrize("codes", [1, 3, 200])
@pytest.mark.parametrize("copies", [0, 150])
def test_held_queries_equal_all_pairs(monkeypatch, codes, copies):
    """Rows of few and of many codes, ties, marks far down or missing, floors, and copies of which too many come near."""
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "SHARD", 64)
    if not copies:
        monkeypatch.setattr(places.Held, "_dense", lambda *a: pytest.fail("all pairs were scored"))
    r = np.random.default_rng(codes)
    n, k = 600, 10
    x = r.normal(size=(n, 24))
    x[:copies] = x[0]
    x[n - 3] = 0
    code, name, ids = r.integers(0, codes + 1, n), r.integers(0, 9, n), r.permutation(n)
    score = np.round(vectors.cosines(x, x), 9)
    fits = ((code[:, None] == code) | (code == 0) | (code[:, None] == 0)) & (ids[:, None] != ids)
    order = [sorted(np.flatnonzero(fits[i]), key=lambda j: (-score[i, j], ids[j])) for i in range(n)]
    place = r.integers(0, 40, n) if not copies else r.integers(0, 400, n)
    at = [o[p] if i % 7 and p < len(o) else None for i, (o, p) in enumerate(zip(order, place))]
    mark, mark_id = ([None if j is None else c(i, j) for i, j in enumerate(at)] for c in (lambda i, j: score[i, j], lambda i, j: int(ids[j])))
    floor = [score[i, o[k + 3]] if i % 2 and len(o) > k + 3 else None for i, o in enumerate(order)]
    held = places.Held([batch(ids, code, name, x, mark=mark, mark_id=mark_id, floor=floor)], k)
    for part in np.array_split(r.permutation(n), 3):
        held.meet([batch(ids[part], code[part], name[part], x[part])])
    got = {q: (above, [(-b["below"], b["id"], b["good"]) for b in best]) for t in held.found() for q, above, best in zip(*(t[c].to_pylist() for c in ("query_id", "above", "best")))}
    for i, o in enumerate(order):
        above, best = got[ids[i]]
        assert above == (None if at[i] is None else o.index(at[i]))
        assert best == [(score[i, j], ids[j], name[i] == name[j] != 0) for j in o[:k]]


def test_relevant_rows_are_bounded_first():
    """The search for relevant rows compares in single precision and scores what is left, as other searches do."""
    assert judging.FITTING.sides() is not None
    r = np.random.default_rng(3)
    x = np.c_[r.integers(0, 3, 300), r.normal(size=(300, 12))]
    kernel = judging.FITTING
    row, col, score = nearest.Cell(x, np.arange(300), kernel).nearest(x[:20], np.arange(20), 7, np.full(20, -np.inf), True)
    every = np.round(kernel.score(x[:20], x), 9)
    every[np.arange(20), np.arange(20)] = -np.inf
    want = nearest.best(every, 7)
    assert row.tolist() == want[0].tolist() and col.tolist() == want[1].tolist() and np.allclose(score, every[want])
