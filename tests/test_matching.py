"""Series with a margin, and greedy matching against the sequential rule."""

import random

import numpy as np
import pytest

from ridgeline.functions import vectors
from ridgeline.operators import matching, nearest


def sequential(rows, gate):
    """All pairs of each key in order of distance, left, right; a pair is taken while both are free."""
    out = []
    for who in {r[0] for r in rows if r[0] is not None}:
        left, right = ([r for r in rows if r[0] == who and r[2] == side] for side in (False, True))
        used = set()
        for d, i, j in sorted((abs(a[1] - b[1]), a[3], b[3]) for a in left for b in right if abs(a[1] - b[1]) <= gate):
            if ("l", i) not in used and ("r", j) not in used:
                used |= {("l", i), ("r", j)}
                out.append((who, i, j, d))
    return sorted(out)


def made(seed, n, keys, width, ties):
    r = random.Random(seed)
    return [(0 if r.random() < 0.4 else r.randrange(keys), float(r.randrange(width)) if ties else r.uniform(0, width), r.random() < 0.5, i) for i in r.sample(range(10 * n), n)]


@pytest.mark.parametrize("seed, gate, width, ties", [(1, 3.0, 60, True), (2, 1e9, 60, True), (3, 5.0, 400, False), (4, 0.0, 20, True), (5, 40.0, 300, True)])
@pytest.mark.parametrize("alone", [1_000_000, 25])
def test_greedy_equals_the_sequential_rule(spark, monkeypatch, seed, gate, width, ties, alone):
    """Also in rounds: ranges of one hot key, whose ends are undecided until the rest is out of the way."""
    monkeypatch.setattr(matching, "ALONE", alone)
    rows = made(seed, 240, 5, width, ties)
    df = spark.createDataFrame(rows + [(None, 1.0, True, 1), (1, None, True, 2)], "who long, at double, right boolean, id long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges as there are partitions
    try:
        got = sorted((r.who, r.left, r.right, r.distance) for r in matching.greedy_matches(df, gate).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [g[:3] for g in got] == [w[:3] for w in sequential(rows, gate)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sequential(rows, gate)])


@pytest.mark.parametrize("seed", range(30))
def test_undecided_rows_are_those_that_others_may_change(seed):
    """Whatever lies outside of a range, what is decided inside stays as it is."""
    rows = sorted(made(seed, 60, 1, 30 if seed % 2 else 300, seed % 3 > 0), key=lambda r: (r[1], r[2], r[3]))
    whole = {(i, j) for _, i, j, _ in sequential(rows, 6.0)}
    cut = rows[15:45]
    at, right, ids = np.array([r[1] for r in cut]), np.array([r[2] for r in cut]), np.array([r[3] for r in cut])
    pairs, undecided = matching.greedy(at, right, ids, 6.0, at[0], at[-1])
    got = {(int(ids[a]), int(ids[b])) for a, b in pairs}
    assert got <= whole
    settled = {int(i) for i, u in zip(ids, undecided) if not u}
    inside = {(side, int(i)) for i, side, u in zip(ids, right, undecided) if not u}
    assert {(i, j) for i, j in whole if (False, i) in inside or (True, j) in inside} == got and settled


def test_match_series(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD", 5)
    r = np.random.default_rng(3)
    base = [r.normal(size=24) for _ in range(8)]
    series = [(i, i % 2, 5 + i % 4, v.tolist()) for i, v in enumerate(base)] + [(20, 0, 5, (base[0] + 0.01 * base[1]).tolist()), (21, 0, 9, base[2].tolist())]
    submitted = [(100, 0, 5, base[0].tolist()), (101, 1, 6, base[1].tolist()), (102, 1, 15, base[1].tolist()), (103, 7, 5, base[0].tolist()), (104, 0, 7, base[2].tolist()), (105, 0, 5, r.normal(size=24).tolist()), (106, 0, 8, base[4].tolist())]
    schema = "id long, source long, states int, v array<double>"
    got = {x.id: (x.status, x.series, x.similarity and round(x.similarity, 6)) for x in matching.match_series(spark.createDataFrame(submitted, schema), spark.createDataFrame(series, schema).repartition(3)).collect()}
    want = {}
    for q, source, states, v in submitted:
        scored = []
        for i, s, n, w in series:
            if s == source:
                sim = round(float(vectors.aligned(np.array([v]), np.array([w]))[0, 0]), 9)
                least = 0.97 if abs(n - states) <= 1 else 0.95 if {n, states} == {7, 9} else 9
                scored.append((sim < least, -sim, i))
        scored.sort()
        if not scored:
            want[q] = ("no_series", None, None)
        elif scored[0][0]:
            want[q] = ("rejected", None, round(-scored[0][1], 6))
        elif len(scored) > 1 and not scored[1][0] and round(scored[1][1] - scored[0][1], 9) < 0.015:
            want[q] = ("ambiguous", None, round(-scored[0][1], 6))
        else:
            want[q] = ("matched", scored[0][2], round(-scored[0][1], 6))
    assert got == want
    assert {s for s, _, _ in got.values()} == {"matched", "ambiguous", "rejected", "no_series"}
