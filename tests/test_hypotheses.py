"""Lists of alternatives, near copies and pools of distinct samples."""

import random

import numpy as np
import pytest

from ridgeline.functions import vectors
from ridgeline.operators import hypotheses, nearest, spread


def lists(r, n, dims=24, spread=0.05):
    out = []
    for i in range(n):
        base = r.normal(size=dims)
        out.append((i, i % 3, [(base + spread * r.normal(size=dims)).tolist() for _ in range(1 + i % 3)]))
    return out


@pytest.mark.parametrize("same", [False, True])
def test_lists_equal_all_pairs(spark, monkeypatch, same):
    monkeypatch.setattr(nearest, "SHARD", 17)
    monkeypatch.setattr(hypotheses, "PAIRS", 19)
    rows = lists(np.random.default_rng(1), 60, spread=0.5)
    df = spark.createDataFrame(rows + [(99, 0, [])], "id long, grp long, hs array<array<double>>").repartition(3)
    got = sorted((x.query_id, x.id, x.rank, x.left_at, x.right_at, round(x.score, 6)) for x in hypotheses.topk(df, df, 4, same_group=same).collect())
    want = []
    for q, g, a in rows:
        some = []
        for i, h, b in rows:
            if i != q and (not same or g == h):
                each = np.round(vectors.aligned(np.array(a), np.array(b)), 9)
                at = np.unravel_index(each.argmax(), each.shape)
                some.append((-each.max(), i, *map(int, at)))
        want += [(q, i, n + 1, left, right, round(-float(s), 6)) for n, (s, i, left, right) in enumerate(sorted(some)[:4])]
    assert got == sorted(want)


def test_most_lists_stay_whole():
    """Of close alternatives, bounds leave less than a tenth of all pairs of lists to be expanded, and nothing is lost."""
    rows = lists(np.random.default_rng(2), 300, dims=63, spread=0.02)
    padded = np.array([np.concatenate((hs + [hs[0]] * 3)[:3]) for _, _, hs in rows])
    some, share = hypotheses.scores(padded, padded, 3, 6)
    every, whole = hypotheses.scores(padded, padded, 3, 300)
    assert share < 0.1 and whole == 1.0
    assert np.allclose(np.sort(some, axis=1)[:, -6:], np.sort(every, axis=1)[:, -6:])


def sequential(rows, floor):
    kept = []
    for i, _, v in sorted(rows):
        if not any(round(float(vectors.cosines(np.array([v]), np.array([w]))[0, 0]), 9) >= floor for _, w in kept):
            kept.append((i, v))
    return [i for i, _ in kept]


@pytest.mark.parametrize("shard", [4096, 25])
def test_first_kept_equals_the_sequential_rule(spark, monkeypatch, shard):
    monkeypatch.setattr(nearest, "SHARD", shard)
    r = random.Random(shard)
    middle = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, 0, [x + r.gauss(0, 0.12) for x in middle[i % 6]]) for i in range(120)] + [(200 + i, 0, middle[0]) for i in range(30)] + [(300, 0, [0.0] * 8), (301, 0, [0.0] * 8)]
    df = spark.createDataFrame(rows + [(400, 0, None)], "id long, grp long, v array<double>").repartition(3)
    assert sorted(x.id for x in spread.first_kept(df, 0.97).select("id").collect()) == sequential(rows, 0.97)


def test_a_chain_waits_for_its_beginning(spark):
    """Each row resembles its neighbours only: the first is kept, the second goes, the third is kept, and so on."""
    rows = [(i, 0, [float(np.cos(i * 0.2)), float(np.sin(i * 0.2))]) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, grp long, v array<double>")
    assert sorted(x.id for x in spread.first_kept(df, 0.975).collect()) == sequential(rows, 0.975) == [0, 2, 4, 6, 8]
    assert spread.first_kept(df.limit(0), 0.9).count() == 0
    with pytest.raises(ValueError):
        spread.first_kept(df, 0.9, nearest.Kernel(vectors.aligned))


def test_one_sample_holds_the_first_500_places(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD", 200)
    r = np.random.default_rng(4)
    base = r.normal(size=6)
    rows = [(i, 1, (base + 0.001 * r.normal(size=6)).tolist()) for i in range(500)] + [(1000 + i, 2 + i % 40 if i % 7 else None, r.normal(size=6).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, grp long, v array<double>").repartition(3)
    queries = spark.createDataFrame([(5000, 0, base.tolist()), (5001, 0, (-base).tolist()), (1003, 5, rows[503][2])], "id long, grp long, v array<double>")
    got = sorted((x.query_id, x["rank"], x.id) for x in nearest.distinct_groups(df, queries, 8, pool=20).collect())
    want = []
    for q, _, v in queries.collect():
        best = {}
        for i, g, w in rows:
            if i != q:
                best[g] = min(best.get(g, (2, 0)), (-round(float(vectors.cosines(np.array([v]), np.array([w]))[0, 0]), 9), i))
        want += [(q, n, i) for n, (_, i) in enumerate(sorted(best.values())[:8], 1)]
    assert got == sorted(want)


def test_leading_rows_decide_most(spark, monkeypatch):
    """The first rows settle their copies without a round; what they leave is the rule's."""
    monkeypatch.setattr(nearest, "SHARD", 40)
    monkeypatch.setattr(spread, "has_earlier", lambda *a: pytest.fail("a round was made"))
    r = np.random.default_rng(4)
    middle = r.normal(size=(8, 12))
    rows = [(i, 0, (middle[i % 8] + 0.05 * r.normal(size=12)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, grp long, v array<double>").repartition(3)
    assert sorted(x.id for x in spread.first_kept(df, 0.9).collect()) == sequential(rows, 0.9)


def test_lists_of_known_floor_meet_in_tiles(monkeypatch):
    """Once floors are known, no products of all alternatives are held; lists, ties and near copies are those of all pairs."""
    monkeypatch.setattr(nearest, "TILE", 16)
    r = np.random.default_rng(6)
    x = np.array([np.concatenate((hs + [hs[0]] * 3)[:3]) for _, _, hs in lists(r, 120, spread=0.5)])
    x[100:104] = x[3]
    kernel = hypotheses.kernel(3)
    every = np.round(kernel.score(x[:30], x), 9)
    every[np.arange(30), np.arange(30)] = -np.inf
    floor = -np.sort(-every, axis=1)[:, 6]
    seen = []
    plain = nearest._by_tiles
    monkeypatch.setattr(nearest, "_by_tiles", lambda *a: seen.append(plain(*a)) or seen[-1])
    row, col, score = nearest.Cell(x, np.arange(120), kernel).nearest(x[:30], np.arange(30), 5, floor, True)
    want = nearest.best(every, 5)
    assert len(seen) == 1 and len(seen[0][0]) < 30 * 12
    assert row.tolist() == want[0].tolist() and col.tolist() == want[1].tolist() and np.allclose(score, every[want])
    monkeypatch.setattr(nearest, "_by_tiles", lambda *a: plain(*a[:-1], 3))  # too many reach
    again = nearest.Cell(x, np.arange(120), kernel).nearest(x[:30], np.arange(30), 5, floor, True)
    assert again[0].tolist() == row.tolist() and again[1].tolist() == col.tolist()
