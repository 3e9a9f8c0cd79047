"""Evaluation, checks and last steps of ranking on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import text, vectors
from ridgeline.operators import judging, nearest, retrieval


@pytest.mark.parametrize("shard", [4096, 13])
def test_leave_one_out(spark, monkeypatch, shard):
    """Also over several cells, with ties, blanks and rows that nothing is relevant to."""
    monkeypatch.setattr(nearest, "SHARD", shard)
    r = np.random.default_rng(1)
    rows = [(i, ["a", "b", "", None, " a "][i % 5], ["x", "y", None][i % 3] if i < 57 else f"alone{i}", (r.normal(size=4) if i % 6 else np.ones(4)).tolist()) for i in range(60)]
    got = {x.id: tuple(x)[1:] for x in judging.leave_one_out(spark.createDataFrame(rows, "id long, product string, similar string, v array<double>").repartition(3)).collect()}
    for i, g, s, v in rows:
        clean = lambda t: (t or "").strip()
        some = sorted((-round(float(vectors.cosines(np.array([v]), np.array([w]))[0, 0]), 9), j, clean(t) == clean(s) != "") for j, h, t, w in rows if j != i and (clean(g) == clean(h) or not clean(g) or not clean(h)))
        ranks = [n for n, x in enumerate(some, 1) if x[2]]
        assert got[i] == (len(some), len(ranks), ranks[0] if ranks else None, sum(n <= 5 for n in ranks), sum(n <= 10 for n in ranks))


def test_metrics_without_anything(spark):
    schema = "processed boolean, states int, expected int, observed int, expected_observed int, coverage string, source string, independence string, relevant long, first_rank long, at_5 long, at_10 long"
    row = judging.real_metrics(spark.createDataFrame([(False, None, None, None, None, None, "", None, 0, None, 0, 0)], schema)).first()
    assert row.manifest_images == row.failed_images == 1 and row.preprocessing_success_rate == 0
    assert row.top_1_accuracy is row.state_count_accuracy is row.mean_reciprocal_rank is row.recall_at_5 is None and row.source_count == 0


def test_cursors(spark):
    made = spark.createDataFrame([("2024-01-02 03:04:05", "shared-1")], "t string, k string").select(text.cursor(F.col("t"), F.col("k")).alias("c")).first().c
    import base64
    import json

    other = lambda v: base64.urlsafe_b64encode(json.dumps(v).encode()).decode().rstrip("=")
    bad = [None, "", "short", "!" * 12, made[:-4], other(["v2", "2024-01-02 03:04:05", "x"]), other(["v1", "2024-01-02", "x"]), other(["v1", "2024-01-02 03:04:05"]), other({"a": 1}), "A" * 300]
    df = spark.createDataFrame([(c,) for c in [made, *bad]], "c string")
    created, key = judging.decoded_cursor(F.col("c"))
    assert [tuple(x) for x in df.select(created, key).collect()] == [("2024-01-02 03:04:05", "shared-1")] + [(None, None)] * len(bad)


def test_model_errors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.5]), ([1.0, float("nan")], [0.5, 1.0]), (None, [float("inf")]), ([1.0, None], [2.0])], "w array<double>, b array<double>")
    got = [x[0] for x in df.select(judging.model_errors({"w": 2, "b": 1}, {"w": F.col("w"), "b": F.col("b")})).collect()]
    assert got == [[], ["w is invalid", "b is invalid"], ["w is invalid", "b is invalid"], ["w is invalid"]]


def test_leaders_change_places(spark):
    line = [float(i % 5) for i in range(63)]
    near, far = [x + 0.01 for x in line], [(-1.0) ** i for i in range(63)]
    rows = [
        (1, 10, 1, 0.80, 0.50, 0.700, 0.9, line), (1, 11, 2, 0.79, 0.90, 0.800, 0.9, near), (1, 12, 3, 0.5, 1.0, 1.0, 0.9, near),  # the image says so
        (2, 10, 1, 0.80, 0.50, 0.700, 0.999, line), (2, 11, 2, 0.79, 0.90, 0.800, 0.9, near),  # the leader is settled
        (3, 10, 1, 0.80, 0.50, 0.700, 0.9, line), (3, 11, 2, 0.79, 0.90, 0.800, 0.9, far),  # no neighbour of the leader
        (4, 10, 1, 0.80, 0.50, 0.700, 0.9, line), (4, 11, 2, 0.60, 0.90, 0.800, 0.9, near),  # too far behind
        (5, 10, 1, 0.80, 0.50, 0.700, None, line),
    ]
    df = spark.createDataFrame(rows, "query_id long, id long, rank long, score double, image double, profile double, curve double, view array<double>")
    got = sorted((x.query_id, x["rank"], x.id, x.score, x.swapped) for x in retrieval.swap_leaders(df).collect())
    assert got[:3] == [(1, 1, 11, 0.80, True), (1, 2, 10, 0.79, True), (1, 3, 12, 0.5, False)]
    assert [g[2] for g in got[3:]] == [10, 11, 10, 11, 10, 11, 10] and not any(g[4] for g in got[3:])


def test_shifted_profiles(spark):
    y = np.exp(-0.5 * ((np.arange(200) - 80) / 9) ** 2)
    df = spark.createDataFrame([(y.tolist(), np.roll(y, 8).tolist()), (y.tolist(), y[::-1].tolist()), (y.tolist(), None)], "a array<double>, b array<double>")
    got = [x[0] for x in retrieval.shifted_similarity(df.select(retrieval.views(F.col("a")).alias("x"), retrieval.views(F.col("b")).alias("y")), "x", "y", "s").select("s").collect()]
    assert got[0] > 0.99 > got[1] and got[2] is None


def test_rescue(spark):
    rows = [
        (1, 0, False, 6, 1, 0.30), (1, 1, True, 6, 1, 0.90), (1, 2, True, 6, 1, 0.95),  # the better of two rescues
        (2, 0, False, 6, 1, 0.60), (2, 1, True, 6, 1, 0.95),  # the first reading is strong enough
        (3, 0, False, 4, 1, 0.60), (3, 1, True, 8, 3, 0.80), (3, 2, False, 8, 1, 0.99),  # eight states from four
        (4, 0, False, 6, 1, None), (4, 1, True, 7, 1, 0.99),  # another state count
    ]
    df = spark.createDataFrame(rows, "query_id long, hypothesis long, rescue boolean, states long, rank long, image double")
    got = sorted((x.query_id, x.hypothesis, round(x.advantage, 6)) for x in retrieval.rescued(df).collect())
    assert got == [(1, 2, 0.65), (2, 0, 0.0), (3, 1, 0.2), (4, 0, 0.0)]
