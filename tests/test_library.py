"""Operators against plain Python on small fixtures with edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline import sources, streaming
from ridgeline.functions import irregular, shape, text, vectors
from ridgeline.operators import feedback, intake, learn, metrics, nearest, search, tables

T_PAIR = T.StructType([T.StructField("q", shape.DESCRIPTOR), T.StructField("c", shape.DESCRIPTOR)])


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} array<double>" for k in values))
    return df.select(column).first()[0]


def test_sequences(spark):
    r = random.Random(1)
    for n in (1, 2, 5, 17):
        a = [r.random() for _ in range(n)]
        assert np.allclose(one(spark, vectors.resample(F.col("a"), 9), a=a), np.interp(np.linspace(0, n - 1, 9), np.arange(n), a))
        if n > 1:
            assert np.allclose(one(spark, vectors.gradient(F.col("a")), a=a), np.gradient(a))
            assert math.isclose(one(spark, vectors.area(F.col("a")), a=a), np.trapezoid(a) / (n - 1))
        b = [r.random() for _ in range(7)]
        m = max(n, 7)
        grid = np.linspace(0, 1, m)
        both = [np.interp(grid, np.linspace(0, 1, len(x)), x) if len(x) > 1 else np.full(m, x[0]) for x in (a, b)]
        assert math.isclose(one(spark, vectors.sequence_distance(F.col("a"), F.col("b")), a=a, b=b), np.abs(both[0] - both[1]).mean())
    assert one(spark, vectors.sequence_distance(F.col("a"), F.col("b")), a=[], b=[]) == 0
    assert one(spark, vectors.sequence_distance(F.col("a"), F.col("b")), a=[1.0], b=[]) == 1
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 2.0]) == 0
    assert one(spark, vectors.floor_quantile(F.col("a"), 0.5), a=[]) == 0


def test_aligned_finds_a_shift():
    y = np.exp(-0.5 * ((np.arange(30) - 12) / 3) ** 2)
    z = np.roll(y, 4)
    a, b = np.tile(y, 3)[None], np.tile(z, 3)[None]
    assert vectors.aligned(a, b)[0, 0] > 0.99 > vectors.cosines(a, b)[0, 0]
    assert vectors.aligned(a[:, :10], b[:, :10])[0, 0] == vectors.cosines(a[:, :10], b[:, :10])[0, 0]


def curve(centres, width=0.02, n=256):
    x = np.linspace(0, 1, n)
    return np.max([np.exp(-0.5 * ((x - c) / width) ** 2) for c in centres], axis=0)


def test_descriptor():
    for k in (2, 4, 8):
        d = shape.descriptor(curve((np.arange(k) + 0.5) / k, 0.16 / k))
        assert d["peak_count"] == d["observed_peak_count"] == k and len(d["valley_depths"]) == k - 1 and len(d["tail_slopes"]) == 2 * (k - 1)
        assert np.allclose(d["peak_locations"], (np.arange(k) + 0.5) / k, atol=0.01)
    edge = shape.descriptor(curve([0.0, 0.5], 0.05))
    assert edge["peak_count"] == 2 and edge["peak_locations"][0] == 0
    assert shape.descriptor(np.zeros(256))["peak_count"] == 0
    assert [shape.regular_states(a, b) for a, b in ((0, 0), (1, 9), (3, 4), (3, 6), (7, 15), (7, 16), (12, 12), (13, 13))] == [0, 1, 2, 4, 8, 16, 8, 16]


def test_embeddings():
    y = curve([0.35], 0.11)
    assert [len(f(y)) for f in (shape.curve_embedding, shape.image_embedding, shape.fused_embedding)] == [384, 3200, 3584]
    assert all(abs(np.linalg.norm(f(y)) - 1) < 1e-9 for f in (shape.curve_embedding, shape.image_embedding, shape.fused_embedding))


def test_profile_predicate(spark):
    good = curve([0.3]).tolist()
    rows = [(good,), ([0.5] * 256,), (good[:-1],), ([math.nan] + good[1:],), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "p array<double>").select(shape.is_profile(F.col("p"))).collect()] == [True, False, False, False, False]


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "id long, grp long, v array<double>")


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 7)
    r = random.Random(3)
    rows = [(i, i % 3, [r.gauss(0, 1) for _ in range(6)]) for i in range(40)] + [(50, 0, [0.0] * 6), (51, 0, [1.0] * 6), (52, 1, [1.0] * 6), (53, 0, None)]
    got = sorted(map(tuple, search.topk(vectors_table(spark, rows).repartition(3), vectors_table(spark, rows), 3, same_group=True).select("query_id", "id", "rank").collect()))
    want = []
    for q, g, a in rows:
        if a:
            best = sorted((-round(float(vectors.cosines(np.array([a]), np.array([b]))[0, 0]), 9), i) for i, h, b in rows if b and h == g and i != q)[:3]
            want += [(q, i, n + 1) for n, (_, i) in enumerate(best)]
    assert got == sorted(want)
    with pytest.raises(ValueError):
        search.topk(vectors_table(spark, rows), vectors_table(spark, rows), 0)
    with pytest.raises(ValueError):
        search.two_views(0, 0)
    assert search.topk(vectors_table(spark, []), vectors_table(spark, []), 3).count() == 0


def test_components_of_equal_descriptors(spark):
    d = shape.descriptor(curve((np.arange(8) + 0.5) / 8, 0.05))
    df = spark.createDataFrame([(d, d)], T_PAIR)
    got = df.select([c.alias(n) for n, c in search.components().items()]).first()
    assert all(got[n] == 1 for n in got.asDict() if n.endswith("similarity"))
    assert got.peak_valley_weight in (0.0, 0.18)


def test_auc_and_ndcg(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "y int, s double")
    assert metrics.auc(df, "y", "s").first()[0] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert metrics.auc(df.where("y = 1"), "y", "s").first()[0] is None
    g = spark.createDataFrame([(1, 1, 0.2), (1, 2, 1.0), (2, 1, 0.0)], "query_id long, rank long, gain double")
    got = {r.query_id: r.ndcg for r in metrics.ndcg(g, ndcg=5).collect()}
    want = ((2**0.2 - 1) + 1 / math.log2(3)) / (1 + (2**0.2 - 1) / math.log2(3))
    assert got == {1: pytest.approx(want), 2: 0.0}


def test_feedback(spark):
    rows = [("q", "a", r, f"2024-01-0{d}", n, y) for n, (r, d, y) in enumerate([(1, 1, 1), (2, 1, 1), (3, 1, 0), (1, 3, 0), (1, 2, 1)])]
    df = spark.createDataFrame(rows, "query string, candidate string, rater int, created_at string, arrived int, label int")
    key = ["query", "candidate", "rater"]
    last = feedback.latest(df, key, ["created_at", "arrived"])
    assert {r.rater: r.label for r in last.collect()} == {1: 0, 2: 1, 3: 0}
    assert tuple(feedback.encounters(df, key, "created_at", "arrived", "label").first()) == (2, 2)
    pairs = feedback.consensus(last, ["query", "candidate"], "rater", "label")
    assert (pairs.first().label, feedback.agreement(pairs).first()[0]) == (0, pytest.approx(1 / 3))
    assert feedback.agreement(pairs.where("false")).first()[0] is None


def test_tables(spark):
    t = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, at int")
    s = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, at int")
    assert sorted((r.id, r.v) for r in tables.upsert(t, s, "id", ["at"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    keep = spark.createDataFrame([(2,)], "id int")
    assert sorted(r.id for r in tables.prune(t, F.col("v") == "a", keep, "id").collect()) == [2]
    page = tables.keyset_page(t, "at", "id", 1).collect()
    assert [(r.id, r.has_more) for r in page] == [(2, True)]
    assert [(r.id, r.has_more) for r in tables.keyset_page(t, "at", "id", 1, (0, 2)).collect()] == [(1, False)]
    split = tables.group_split(spark.range(9).withColumnRenamed("id", "k"), "k", 5, 1 / 3)
    assert split.where("held_out").count() == 3


def test_versioned_table(spark, tmp_path):
    table = sources.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    rows = lambda *r: spark.createDataFrame(r, "id int, v string, at int")
    assert table.upsert(rows((1, "a", 0)), "id", ["at"]) == 1
    table.upsert(rows((1, "b", 1), (2, "c", 0)), "id", ["at"])
    assert sorted((r.id, r.v) for r in table.read().collect()) == [(1, "b"), (2, "c")]
    table.clear()
    assert table.read().count() == 0


def test_streamed_upserts(spark, tmp_path):
    table = sources.VersionedTable(spark, str(tmp_path / "t"))
    for n, rows in enumerate(([(1, "a", 0)], [(1, "b", 1), (2, "c", 0)])):
        spark.createDataFrame(rows, "id int, v string, at int").write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema("id int, v string, at int").json(str(tmp_path / "in"))
        streaming.upserts(stream, table, "id", ["at"], str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.id, r.v) for r in table.read().collect()) == [(1, "b"), (2, "c")]


def test_snapshot_as_a_table(spark, tmp_path):
    rows = [{"id": f"c{i}", "n": i} for i in range(5)]

    def fetch(cursor, size):
        at = int(cursor or 0)
        return {"candidateCount": 5, "nextCursor": str(at + size) if at + size < 5 else None, "candidates": rows[at : at + size]}

    got = sources.snapshot_table(spark, fetch, "id string, n long", f"{tmp_path}/s", 2, 10)
    assert sorted(map(tuple, got.collect())) == [(r["id"], r["n"]) for r in rows]
    for bad in (lambda c, s: fetch("0", s) | {"nextCursor": "2"}, lambda c, s: fetch(c, s) | {"candidateCount": 6}, lambda c, s: fetch(c, s) | {"candidates": rows[:2]}, lambda c, s: fetch(c, s + 1)):
        with pytest.raises(ValueError):
            sources.snapshot_table(spark, bad, "id string, n long", f"{tmp_path}/s", 2, 10)


def test_irregularity(spark):
    def plainly(p, d):
        clamp = lambda x: max(0.0, min(1.0, x))
        avg = lambda a: sum(a) / len(a) if len(a) else 0.0
        cv = lambda a: float(np.std(a) / abs(np.mean(a))) if len(a) > 1 else 0.0
        at = [math.floor(x * (len(p) - 1) + 0.5) for x in d["peak_locations"]]
        sides = []
        for i, k in enumerate(at):
            low = (at[i - 1] + k) // 2 if i else 0
            high = -(-(k + at[i + 1]) // 2) if i + 1 < len(at) else len(p) - 1
            r = min(k - low, high - k)
            sides.append(avg([abs(p[k - o] - p[k + o]) for o in range(1, r + 1)]) if r >= 2 else 0.0)
        smooth = [sum(p[j] * (7 - abs(j - i)) for j in range(max(0, i - 6), min(len(p), i + 7))) / sum(7 - abs(j - i) for j in range(max(0, i - 6), min(len(p), i + 7))) for i in range(len(p))]
        t, n, m = d["tail_slopes"], d["peak_count"], d["observed_peak_count"]
        states = max(clamp(0.25 + abs(m - n) / max(1, m, n)) if d["regularized"] else 0.0, 0.0 if 1 <= n <= 20 else 1.0)
        return clamp(
            0.3 * states + 0.17 * clamp(cv(np.diff(d["peak_locations"])) / 0.55) + 0.13 * clamp(cv(d["peak_widths"]) / 0.75) + 0.13 * clamp(avg([abs(x - 0.5) * 2 for x in d["valley_position_ratios"]]) / 0.75)
            + 0.11 * clamp(avg(sides) / 0.35) + 0.07 * clamp(avg([abs(t[2 * i] - t[2 * i + 1]) / max(1e-6, t[2 * i] + t[2 * i + 1]) for i in range(len(t) // 2)])) + 0.05 * clamp(avg(d["valley_heights"]))
            + 0.04 * clamp(avg([abs(x - y) for x, y in zip(p, smooth)]) / 0.08)
        )

    r = random.Random(3)
    rows = []
    for k in (0, 1, 2, 5, 21):
        d = {"peak_locations": sorted(r.random() for _ in range(k)), "peak_widths": [r.random() for _ in range(k)], "valley_heights": [r.random() for _ in range(max(0, k - 1))], "tail_slopes": [r.random() for _ in range(2 * max(0, k - 1))], "valley_position_ratios": [r.random() for _ in range(max(0, k - 1))], "peak_count": k, "observed_peak_count": max(0, k - k % 2), "regularized": k % 2 == 1}
        rows.append(([r.random() for _ in range(40)], d))
    kind = "p array<double>, d struct<peak_locations: array<double>, peak_widths: array<double>, valley_heights: array<double>, tail_slopes: array<double>, valley_position_ratios: array<double>, peak_count: int, observed_peak_count: int, regularized: boolean>"
    got = [x[0] for x in spark.createDataFrame(rows, kind).select(irregular.irregularity(F.col("p"), F.col("d"))).collect()]
    assert np.allclose(got, [plainly(p, d) for p, d in rows])


def test_snapshot():
    rows = [{"id": str(i)} for i in range(5)]

    def fetch(cursor, size):
        at = int(cursor or 0)
        return {"candidateCount": 5, "candidates": rows[at : at + size], "nextCursor": str(at + size) if at + size < 5 else None}

    assert sources.snapshot(fetch, 2, 10) == rows
    with pytest.raises(ValueError):
        sources.snapshot(lambda c, s: fetch("0", s) | {"nextCursor": "2"}, 2, 10)
    with pytest.raises(ValueError):
        sources.snapshot(lambda c, s: fetch(c, s) | {"candidateCount": 6}, 2, 10)


def test_csv_with_mark(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿image_path,image_id,state_count,observed_state_count,y_scale,is_measured\na.png,,8,,log,yes\na.png,x,0,,linear,maybe\n,y,2,3,,\n", encoding="utf-8")
    rows = {r.position: r for r in intake.manifest(sources.csv_text(spark, str(tmp_path / "m.csv"))).collect()}
    assert rows[0].valid and rows[0].image_id == "image-0001" and rows[0].coverage == "full" and rows[0].row_number == 2
    assert [e.split()[0] for e in rows[1].errors] == ["image_path", "state_count", "y_scale", "is_measured"]
    assert [e.split()[0] for e in rows[2].errors] == ["image_path", "observed_state_count"]


def test_text(spark):
    df = spark.createDataFrame([("  a b//c ",), ("---",), (None,)], "x string")
    assert [r[0] for r in df.select(text.code(F.col("x"))).collect()] == ["a-b-c", "anonymous", "anonymous"]
    words = spark.createDataFrame([("Yes ",), ("measured",), ("0",), ("maybe",), (None,)], "x string")
    assert [r[0] for r in words.select(text.truth(F.col("x"))).collect()] == [True, True, False, None, None]


def test_monotone_logistic(spark):
    r = np.random.default_rng(0)
    x = r.random((400, 2))
    y = (r.random(400) < 1 / (1 + np.exp(-(4 * x[:, 0] - 3 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    weights, _ = learn.monotone_logistic(df, ["a", "b"], "y")
    assert weights["a"] > 0.3 and weights["b"] == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        learn.monotone_logistic(df.where("y = 1"), ["a", "b"], "y")


def chosen_plainly(rows, most, seeds=()):
    """Row by row: the least similar to those chosen before, or to the middle at first."""
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-12) for i, v in sorted(rows)}
    out = [i for i in sorted(unit) if i in seeds][:most]
    while len(out) < min(most, len(unit)):
        middle = np.mean(list(unit.values()), axis=0)
        before = [unit[i] for i in out] or [middle / max(np.linalg.norm(middle), 1e-12)]
        out.append(min((max(round(float(v @ b), 9) for b in before), i) for i, v in unit.items() if i not in out)[1])
    return out


@pytest.mark.parametrize("alone", [16_384, 25])
@pytest.mark.parametrize("seeds", [(), (4, 7, 58)])
def test_farthest_points(spark, monkeypatch, alone, seeds):
    """Groups within one task, and in passes over their rows; with rows chosen beforehand in one group."""
    monkeypatch.setattr(learn, "ALONE", alone)
    r = random.Random(2)
    rows = [(i, i % 2 if i < 60 else None, [r.gauss(0, 1) for _ in range(4)]) for i in range(66)]
    df = vectors_table(spark, rows).withColumn("first", F.col("id").isin(*seeds) if seeds else F.lit(None).cast("boolean")).repartition(3)
    got = learn.farthest_points(df, "grp", "id", "v", 10, "first").collect()
    for g in (0, 1, None):
        want = chosen_plainly([(i, v) for i, h, v in rows if h == g], 10, seeds)
        assert [x.id for x in sorted((x for x in got if x.grp == g), key=lambda x: x.step)] == want


def test_choose_blend(spark):
    df = spark.createDataFrame([(0.0, 0.5, 0.8, 0.9, 0.6), (0.1, 0.6, 0.7, 0.9, 0.7), (0.2, 0.6, 0.8, 0.9, 0.6)], "weight double, top_1 double, recall_at_5 double, recall_at_10 double, mrr double")
    assert learn.choose_blend(df).first().weight == 0.2


def test_batches_of_profiles_equal_single_ones(spark):
    """Descriptors and embeddings of a batch, with profiles of several lengths and a null one, against one profile at a time; prominence against its definition."""
    r = np.random.default_rng(3)
    x = [np.linspace(0, 1, n) for n in (256, 256, 100, 256, 64)]
    rows = [np.clip(sum(np.exp(-0.5 * ((v - c) / 0.02) ** 2) for c in r.random(6)), 0, 1) for v in x]
    df = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(rows)] + [(9, None)], "id int, p array<double>").coalesce(1)
    got = {d["id"]: d for d in (row.asDict() for row in shape.describe(df, "p").collect())}
    assert got[9]["peak_count"] is None
    for i, y in enumerate(rows):
        want = shape.descriptor(y)
        assert all(np.allclose(got[i][k], want[k], atol=1e-12) for k in want)
    vectors_ = {row[0]: row[1] for row in df.select("id", shape.fused_embedding_column(F.col("p"))).collect()}
    assert vectors_[9] is None and all(np.allclose(vectors_[i], shape.fused_embedding(y)) for i, y in enumerate(rows))
    y = np.round(r.random((4, 50)), 1)
    row, at = shape.plateaus(y)
    for k, p, rise in zip(row.tolist(), at.tolist(), shape.prominences(y, row, at)):
        sides = [[], []]
        for side, step in ((0, -1), (1, 1)):
            j = p
            while 0 <= j < 50 and y[k, j] <= y[k, p]:
                sides[side].append(y[k, j])
                j += step
        assert rise == y[k, p] - max(map(min, sides))


def test_topk_in_blocks_and_shards(spark, monkeypatch):
    """Blocks of queries meet cells of the corpus, one large group and null groups included."""
    monkeypatch.setattr(nearest, "BLOCK", 7)
    monkeypatch.setattr(nearest, "SHARD", 11)
    r = np.random.default_rng(6)
    rows = [(i, (0 if i % 3 else i % 4) if i % 10 else None, r.normal(size=5).tolist()) for i in range(90)] + [(None, 0, [1.0] * 5), (95, 1, None)]
    df = spark.createDataFrame(rows, "id long, grp long, v array<double>")
    good = [x for x in rows if x[0] is not None and x[2] is not None]
    for same in (False, True):
        want = []
        for i, g, v in good:
            some = [(-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, h, w in good if j != i and (not same or g is not None and g == h)]
            want += [(i, j, n + 1, -s) for n, (s, j) in enumerate(sorted(some)[:4])]
        got = search.topk(df, df, 4, same_group=same).select("query_id", "id", "rank", "score").collect()
        assert sorted((a, b, c) for a, b, c, _ in got) == sorted((a, b, c) for a, b, c, _ in want)
    assert search.topk(df.limit(0), df, 4).count() == search.topk(df, df.limit(0), 4).count() == 0


def test_auc_by_groups_with_nulls(spark):
    r = np.random.default_rng(8)
    rows = [(int(r.integers(0, 2)), float(r.integers(0, 9)), ["a", "b", None][i % 3]) for i in range(300)] + [(1, None, "a")]
    df = spark.createDataFrame(rows, "y int, s double, g string").repartition(5)
    for by in ([], ["g"]):
        for row in metrics.auc(df, "y", "s", by).collect():
            some = [(y, s) for y, s, g in rows if s is not None and (not by or g == row["g"])]
            pairs = [(s > t) + (s == t) / 2 for y, s in some if y for z, t in some if not z]
            assert row["auc"] == pytest.approx(sum(pairs) / len(pairs))


def test_numbers_over_ranges(spark):
    r = np.random.default_rng(2)
    rows = [(["a", "b", None][int(r.integers(0, 3)) if i % 4 else 0], i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(7)
    for by in ([], ["g"]):
        got = {x["k"]: (x["n"], x["n_of"]) for x in tables.numbered(df, by, ["k"], "n").collect()}
        for g, k in rows:
            some = sorted(j for h, j in rows if not by or h == g)
            assert got[k] == (some.index(k) + 1, len(some))
    assert tables.numbered(df.limit(0), ["g"], ["k"], "n").count() == 0


def test_versions_are_replaced_at_once_and_vacuumed(spark, tmp_path):
    table = sources.VersionedTable(spark, str(tmp_path / "t"))
    for n in range(3):
        assert table.upsert(spark.createDataFrame([(i, n) for i in range(n, n + 3)] * 2, "id long, at int"), "id", ["at"]) == 3
    assert sorted(map(tuple, table.read().collect())) == [(0, 0), (1, 1), (2, 2), (3, 2), (4, 2)]
    assert table.vacuum() == 2 and table.vacuum() == 0 and table.read().count() == 5


def test_selection(spark):
    from ridgeline.operators import selection

    df = spark.createDataFrame([(1, "a.PNG", None, 10), (2, "b.txt", None, 10), (3, "c", "image/jpeg", 0), (4, "d.webp", "", 5), (5, "e.jpg", "x", 13 * 1024 * 1024), (6, None, None, None)], "i int, name string, mime string, size long")
    assert [x.fate for x in selection.batch_files(df, "name", "mime", "size", "i", 1).orderBy("i").collect()] == ["accepted", "unsupported", "oversized", "over_limit", "oversized", "unsupported"]
    m = selection.smoothing(20)
    line = np.arange(20) ** 2 + 3.0 * np.arange(20) - 1
    assert np.allclose(m @ line, line) and np.allclose(m.sum(axis=1), 1) and np.allclose(m[10, 6:15] * 231, [-21, 14, 39, 54, 59, 54, 39, 14, -21])
    assert (selection.smoothing(2) == np.eye(2)).all()
    row = spark.createDataFrame([([1.0, None],), (None,)], "p array<double>")
    assert [x.smooth for x in selection.smooth(row, "p", 2).collect()] == [None, None]
    errors = spark.range(1).select(selection.descriptor_errors(F.lit(1), F.array(F.lit(0.5)), F.array().cast("array<double>"), F.array().cast("array<double>")).alias("e")).first()[0]
    assert errors == []
