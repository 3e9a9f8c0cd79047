"""Boxes, encoder, reports and the command line."""

import random

import numpy as np
from pyspark.sql import functions as F

from ridgeline.__main__ import main
from ridgeline.operators import boxes, encoder, reports


def test_overlaps_equal_brute_force(spark):
    r = random.Random(4)
    rows = []
    for i in range(60):
        x, y = r.uniform(0, 900), r.uniform(0, 900)
        rows.append((i % 2, i, x, y, x + r.uniform(5, 300), y + r.uniform(5, 300), r.random()))
    df = spark.createDataFrame(rows, "page int, id int, left double, top double, right double, bottom double, confidence double")
    got = sorted((x.page, x.a, x.b, round(x.iou, 9)) for x in boxes.overlaps(df, 100.0).collect())
    want = []
    for p, i, l1, t1, r1, b1, _ in rows:
        for q, j, l2, t2, r2, b2, _ in rows:
            w, h = min(r1, r2) - max(l1, l2), min(b1, b2) - max(t1, t2)
            if p == q and i < j and w > 0 and h > 0:
                want.append((p, i, j, round(w * h / ((r1 - l1) * (b1 - t1) + (r2 - l2) * (b2 - t2) - w * h), 9)))
    assert got == sorted(want)
    assert boxes.best_boxes(df, 5).count() == 10


def test_overlaps_broadcast_no_boxes(spark, tmp_path):
    """Boxes in small files, each in many cells: the join deals both sides out, whatever the files' size says."""
    rows = [(0, i, 0.0, 0.0, 500.0 + i, 400.0, 0.5) for i in range(20)]
    spark.createDataFrame(rows, "page int, id int, left double, top double, right double, bottom double, confidence double").write.parquet(str(tmp_path / "boxes"))
    found = boxes.overlaps(spark.read.parquet(str(tmp_path / "boxes")), 8.0)
    assert found.count() == 190
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_islands_and_gaps(spark):
    df = spark.createDataFrame([(1, i) for i in (1, 2, 4, 9, 10)], "g int, i int")
    assert [tuple(x) for x in boxes.islands(df, "g", "i").orderBy("first").select("first", "last", "centre", "n").collect()] == [(1, 4, 2, 3), (9, 10, 10, 2)]
    v = spark.createDataFrame([(0, None), (1, 1.0), (2, None), (3, 3.0), (4, None)], "i int, v double")
    assert [x[0] for x in v.select(boxes.fill_gaps(F.col("v"), F.col("i"), []).alias("f"), "i").orderBy("i").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_encoder(spark):
    r = np.random.default_rng(1)
    code = r.normal(size=(200, 3))
    target = code @ r.normal(size=(3, 12))
    query = target + 0.05 * r.normal(size=target.shape)
    for hidden in (0, 16):
        m = encoder.fit(query, target, dims=3, ridge=1.0, hidden=hidden)
        nearest = (m.query(query) @ m.candidate(target).T).argsort(axis=1)[:, -5:]
        assert np.mean([i in n for i, n in enumerate(nearest)]) > 0.8
    df = spark.createDataFrame([(target[0].tolist(),)], "v array<double>")
    assert np.allclose(encoder.encoded(df, "v", m, False).first().code, m.candidate(target[:1])[0])


def test_encoder_from_sums_equals_that_from_rows(spark):
    """Axes and regression from sums over partitions, with repeated targets and a component that never changes."""
    r = np.random.default_rng(7)
    target = np.repeat(r.normal(size=(60, 6)), 3, axis=0)
    query = np.concatenate([target[:, :4] + 0.1 * r.normal(size=(180, 4)), np.full((180, 1), 2.5)], axis=1)
    df = spark.createDataFrame([(q.tolist(), t.tolist()) for q, t in zip(query, target)] + [(None, target[0].tolist())], "q array<double>, t array<double>").repartition(7)
    for options in ({"dims": 3, "ridge": 2.0}, {"dims": 40, "ridge": 0.5}):
        a, b = encoder.train(df, "q", "t", **options), encoder.fit(query, target, **options)
        assert np.allclose(a.candidate(target), b.candidate(target), atol=1e-8) and np.allclose(a.query(query), b.query(query), atol=1e-8)
    net = encoder.train(df.where("q IS NOT NULL"), "q", "t", dims=3, hidden=8, steps=50)
    assert net.query(query).shape == (180, 3)
    for few in (df.limit(0), df.where("q IS NOT NULL").limit(1)):
        try:
            encoder.train(few, "q", "t")
            raise AssertionError
        except ValueError:
            pass


def test_pairs(spark):
    df = spark.createDataFrame([("s", i) for i in range(4)] + [("t", 9)], "sample string, id int")
    assert sorted((x.a, x.b) for x in reports.positives(df, "sample", "id", 1).collect()) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (9, 9)]
    ok = spark.createDataFrame([(0, 1, 0, 1), (2, 2, 0, 1), (0, 31, 0, 1), (None, 1, 0, 1)], "p int, n int, s int, c int")
    assert [x[0] for x in ok.select(reports.source_selection(F.col("p"), F.col("n"), F.col("s"), F.col("c"))).collect()] == [True, False, False, False]


def report(**changes):
    x = np.linspace(0, 1, 256)
    judgment = {"candidate_id": "c1", "relevance": "similar"} | {f: 0.5 for f in reports.FEATURES}
    return {"schema_version": 3, "created_at": "2024-01-01", "privacy": dict(reports.PRIVACY), "annotator": {"id": "a"}, "query": {"id": "q", "profile": np.exp(-((x - 0.4) ** 2) * 50).tolist()}, "judgments": [judgment]} | changes


def test_reports(spark):
    schema = "report struct<schema_version int, created_at string, privacy struct<query_image_included boolean, original_filename_included boolean, external_upload_performed boolean, normalized_shape_features_included boolean>, annotator struct<id string>, query struct<id string, profile array<double>>, judgments array<struct<candidate_id string, relevance string, " + ", ".join(f"{f} double" for f in reports.FEATURES) + ">>>, position int"
    good = report()
    twice = report(judgments=good["judgments"] * 2)
    bad = report(schema_version=1, query={"id": " ", "profile": [1.0]}, judgments=[good["judgments"][0] | {"relevance": "maybe", "tail_score": 2.0}])
    df = spark.createDataFrame([(good, 0), (twice, 1), (bad, 2)], schema)
    found = [x.e for x in df.select(reports.report_errors().alias("e"), "position").orderBy("position").collect()]
    assert found[0] == [] and found[1] == ["a candidate is judged twice"] and len(found[2]) == 5
    rows = reports.ratings(df.where("position = 0")).collect()
    assert [(x.query, x.candidate, x.rater, x.label) for x in rows] == [("q", "c1", "a", 1)]


def test_command_line(spark, capsys, tmp_path):
    assert main(["list"]) == 0 and "vector_topk" in capsys.readouterr().out
    out = str(tmp_path / "o")
    assert main(["run", "equi_self_pairs", "/root/testdata/sf0.001", "--out", out]) == 0
    assert spark.read.parquet(out).count() == 10
