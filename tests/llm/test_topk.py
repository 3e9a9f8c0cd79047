import math
import random

from pyspark.sql import functions as F

from ridgeline.llm import topk


def brute(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({i: v for i, v in reversed(sorted(good, key=lambda r: (r[0], r[1])))}.items()):
        if q % 5 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, monkeypatch, shard=40, block=7):
    """Blocks of 7 queries; shards of 40 rows, so that a task carries its kth scores from one to the next."""
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SHARD", shard)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    return sorted(map(tuple, topk.search(df, "vec_id", "embedding", F.col("id") % 5 == 0, k=4).collect()))


def test_equals_brute_force(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(80)]  # ties
    rows += [(500, None), (505, []), (510, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (515, [math.nan] + [0.0] * 5), (520, [math.inf] * 6), (None, [1.0] * 6)]
    rows += [(10, rows[10][1]), (525, [0.0] * 6), (530, [9e5] * 6), (535, [1.0, 2.0]), (536, [3.0, 4.0])]
    assert run(spark, rows, monkeypatch) == brute(rows, 4)


def test_scores_beyond_floats_and_longs():
    import numpy as np

    for size in (2**20, 2**28, 2**40, 2**62):
        a = np.array([[size, -size, 3], [size - 1, 5, -7]], np.int64)
        b = np.array([[size + 1, 2, size], [1, size, -size], [0, 0, 1]], np.int64)
        want = [[max(-(2**63) + 2, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in b] for u in a]
        assert topk.products(a, b).tolist() == want


def test_great_components(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.choice([-1, 1]) * 2.0 ** r.randint(0, 17) + r.random() for _ in range(4)]) for i in range(120)]
    assert run(spark, rows, monkeypatch) == brute(rows, 4)
    great = [(0, [2.0**40, 0.0]), (1, [2.0**40, 1.0]), (2, [-(2.0**40), 0.0]), (3, [1.0, 1.0])]
    assert run(spark, great, monkeypatch) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**60), (0, 3, 2, -(2**63) + 2)]


def test_few_and_none(spark, monkeypatch):
    assert run(spark, [(0, [1.0]), (1, [2.0])], monkeypatch) == [(0, 1, 1, 1024 * 2048)]
    assert run(spark, [(0, [1.0])], monkeypatch) == run(spark, [], monkeypatch) == run(spark, [(1, [1.0]), (2, [1.0])], monkeypatch) == []


def test_tree_prunes_and_agrees():
    import numpy as np

    r = np.random.default_rng(2)
    rows = r.integers(-3000, 3000, (3000, 3))
    ids = np.arange(3000)
    s = topk.Search(ids[:50], rows[:50], 3)
    visited = []
    add = s.add
    s.add = lambda who, i, p: (visited.append(len(who) * len(i)), add(who, i, p))
    s.visit(topk.Ball(ids, rows), np.arange(50))
    full = rows[:50] @ rows.T
    full[np.arange(50), np.arange(50)] = topk.NONE
    want = np.lexsort((np.broadcast_to(ids, full.shape), -full.astype(float)), axis=-1)[:, :3]
    assert (s.found == want).all() and sum(visited) < 0.3 * full.size


def test_query_equals_brute_force(spark):
    import numpy as np

    from ridgeline.llm.queries import op6_topk

    sf = "/root/testdata/sf0.01"
    pdf = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.floor(1024 * np.stack(pdf.embedding).astype(float)).astype(np.int64)
    want = []
    for q in pdf.vec_id[pdf.vec_id % 100 == 0]:
        s = x @ x[pdf.vec_id == q][0]
        best = sorted((-int(v), int(i)) for i, v in zip(pdf.vec_id, s) if i != q)[:10]
        want += [(q, r + 1, i, -v) for r, (v, i) in enumerate(best)]
    got = op6_topk(spark, sf)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_bounds_spare_balls(spark, monkeypatch):
    """Of clustered vectors, queries go on to few of the other balls, and the result is that of all pairs."""
    r = random.Random(7)
    middle = [[r.gauss(0, 8) for _ in range(6)] for _ in range(10)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in middle[i % 10]]) for i in range(400)]
    sent = []

    def counted(placed, asked, k):
        sent.append(asked.count())
        return met(placed, asked, k)

    met = topk._met
    monkeypatch.setattr(topk, "_met", counted)
    assert run(spark, rows, monkeypatch) == brute(rows, 4)
    assert len(sent) == 2 and sum(sent) < 0.7 * 80 * 10  # ten shards of 40 rows
