"""Search over cells: equal to all pairs, and what pruning spares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import vectors
from ridgeline.operators import nearest, search


def clustered(seed, clusters=12, each=40, dims=16, spread=0.05):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(clusters, dims))
    return [(c * each + i, c, (middle[c] + spread * r.normal(size=dims)).tolist()) for c in range(clusters) for i in range(each)]


def all_pairs(rows, queries, k, kernel, exclude_self=True):
    x, q = (np.array([v for _, _, v in t]) for t in (rows, queries))
    score = np.round(kernel.score(q, x), 9)
    out = []
    for i, (key, _, _) in enumerate(queries):
        order = sorted((-score[i, j], rows[j][0]) for j in range(len(rows)) if not exclude_self or rows[j][0] != key)[:k]
        out += [(key, other, n + 1) for n, (_, other) in enumerate(order)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, grp long, v array<double>").repartition(3)


def answers(rows):
    return sorted(map(tuple, rows.select("query_id", "id", "rank").collect()))


@pytest.mark.parametrize("kernel", [nearest.COSINE, search.two_views(), search.two_views(1.0, 0.0), nearest.Kernel(vectors.cosines)])
@pytest.mark.parametrize("k", [1, 7, 60])
def test_cells_equal_all_pairs(spark, monkeypatch, kernel, k):
    """Also lists that need rows of several centres, rows without length, and halves without length."""
    monkeypatch.setattr(nearest, "SHARD", 30)
    rows = clustered(2) + [(900, 0, [0.0] * 16), (901, 0, [1.0] * 8 + [0.0] * 8), (902, 1, [0.0] * 8 + [1.0] * 8)]
    queries = rows[::11] + rows[-3:]
    assert answers(nearest.topk(frame(spark, rows), frame(spark, queries), k, kernel)) == all_pairs(rows, queries, k, kernel)


def test_a_cell_larger_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD", 30)
    monkeypatch.setattr(nearest, "CENTRES", 3)
    rows = clustered(3)
    assert answers(nearest.topk(frame(spark, rows), frame(spark, rows[::7]), 5, exclude_self=False)) == all_pairs(rows, rows[::7], 5, nearest.COSINE, False)


def test_bounds_spare_most_cells(spark, monkeypatch):
    """Queries that go on to other centres, against all that there would be without bounds; the corpus is never copied."""
    monkeypatch.setattr(nearest, "SHARD", 40)
    seen = []

    def counted(rows, asked, *rest):
        seen.append((rows.count(), asked.count()))
        return plain(rows, asked, *rest)

    plain = nearest.meet
    monkeypatch.setattr(nearest, "meet", counted)
    rows = clustered(5, spread=0.02)
    df = frame(spark, rows)
    assert answers(nearest.topk(df, df, 5)) == all_pairs(rows, rows, 5, nearest.COSINE)
    (kept, first), (again, then) = seen
    assert kept == again == len(rows)
    assert first + then < 0.35 * len(rows) * -(-len(rows) // 40)


def test_ties_and_best():
    score = np.array([[0.5, 0.5, np.nan, 0.9, -np.inf, 0.5], [np.nan] * 6])
    assert [x.tolist() for x in nearest.best(score, 3)] == [[0, 0, 0], [3, 0, 1]]
    assert [x.tolist() for x in nearest.best(score, 9)] == [[0] * 4, [3, 0, 1, 5]]


def test_lengths_must_agree(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 1, [1.0])], "id long, grp long, v array<double>")
    with pytest.raises(Exception, match="one length"):
        nearest.topk(df, df.where(F.col("id") == 1), 1).collect()


@pytest.mark.parametrize("n", [2306, 4096])
def test_what_is_left_out_comes_last_in_wide_cells(n):
    """What stands for -inf times the columns of a whole cell must stay within 64 bits."""
    r = np.random.default_rng(n)
    score = np.round(r.uniform(-1, 1, size=(3, n)), 9)
    score[:, :5] = -np.inf
    score[1, 7:] = -np.inf
    row, col = nearest.best(score, 10)
    want = [np.argsort(-s, kind="stable")[: min(10, np.isfinite(s).sum())] for s in score]
    assert [col[row == i].tolist() for i in range(3)] == [w.tolist() for w in want]
    row, col = nearest.best_of_groups(score, np.arange(n) % 4, 2)
    assert [len(set((col[row == i] % 4).tolist())) for i in range(3)] == [2, 2, 2] and np.isfinite(score[row, col]).all()


def test_scores_of_any_size_keep_their_order():
    score = np.array([[3e6, -3e6, -np.inf, 3e6] * 1000])
    assert nearest.best(score, 2001)[1].tolist() == [c for c in range(4000) if c % 4 in (0, 3)] + [1]


@pytest.mark.parametrize("name", ["cosine", "views", "aligned", "series"])
@pytest.mark.parametrize("k", [1, 6, 50])
def test_a_cell_in_chunks_equals_all_scores(monkeypatch, name, k):
    """Also copies, rows without length and null components; scores come in single precision first."""
    from ridgeline.operators import hypotheses, matching

    monkeypatch.setattr(nearest, "SHARD", 90)
    kernel = {"cosine": nearest.COSINE, "views": search.two_views(), "aligned": hypotheses.ALIGNED, "series": matching.SERIES}[name]
    r = np.random.default_rng(k)
    x = r.normal(size=(400, 24))
    x[200:260] = x[:60]
    x[300], x[301, 3] = 0.0, np.nan
    if name == "series":
        x = np.concatenate([(np.arange(400) % 12)[:, None], x], axis=1)
    ids, asking = np.arange(400) * 3, np.arange(150) * 3
    floor = np.where(np.arange(150) % 4 == 0, 0.2, -np.inf)
    want = np.round(kernel.score(x[:150], x), 9)
    want[asking[:, None] == ids[None, :]] = -np.inf
    want[want < floor[:, None]] = -np.inf
    row, col = nearest.best(want, k)
    got = nearest.Cell(x, ids, kernel).nearest(x[:150], asking, k, floor, True)
    assert [g.tolist() for g in got] == [row.tolist(), col.tolist(), want[row, col].tolist()]


def test_without_bounds_few_copies_are_dealt(spark, monkeypatch):
    """Vectors of no order: the grid copies less than a query for every cell of SHARD rows, and nothing is lost."""
    monkeypatch.setattr(nearest, "SHARD", 20)
    monkeypatch.setattr(nearest, "WIDE", 320)
    monkeypatch.setattr(nearest, "TASKS", 4)
    seen, plain = [], nearest.meet

    def counted(rows, asked, *rest):
        seen.append(rows.count() + asked.count())
        return plain(rows, asked, *rest)

    monkeypatch.setattr(nearest, "meet", counted)
    r = np.random.default_rng(9)
    rows = [(i, i % 3, r.normal(size=24).tolist()) for i in range(600)]
    df = frame(spark, rows)
    assert answers(nearest.topk(df, df, 5)) == all_pairs(rows, rows, 5, nearest.COSINE)
    assert seen[-1] <= 600 * (2 + 2)


@pytest.mark.parametrize("same_group", [False, True])
@pytest.mark.parametrize("kernel", [nearest.COSINE, search.two_views(), nearest.Kernel(vectors.cosines)])
def test_lists_do_not_grow_with_the_cells(spark, monkeypatch, kernel, same_group):
    """Many cells of rows, copies and null groups among them: a task gives k rows a query, and results are those of all pairs."""
    for name, value in (("SHARD", 20), ("WIDE", 40), ("TASKS", 4), ("PROBE", 50), ("BLOCK", 64)):
        monkeypatch.setattr(nearest, name, value)
    seen, plain = [], nearest.gather

    def counted(rows, asked, k, *rest):
        out = plain(rows, asked, k, *rest)
        seen.append((asked.count(), rows.count() / 20, out.count(), k))
        return out

    monkeypatch.setattr(nearest, "gather", counted)
    r = np.random.default_rng(4)
    rows = [(i, i % 7 and 1, r.normal(size=16).tolist()) for i in range(500)]
    rows += [(500 + i, g, v) for i, (_, g, v) in enumerate(rows[:90])] + [(600 + i, 2, r.normal(size=16).tolist()) for i in range(15)]
    if not same_group:
        rows = [(i, g or None, v) for i, g, v in rows]
    df = frame(spark, rows)
    got = nearest.topk(df, df, 6, kernel, same_group)
    groups = [[x for x in rows if x[1] == g] for g in (0, 1, 2)] if same_group else [rows]
    assert answers(got) == sorted(a for g in groups for a in all_pairs(g, g, 6, kernel))
    kinds = {key: g for key, g, _ in rows}
    assert all(x.grp == kinds[x.id] and x.query_grp == kinds[x.query_id] for x in got.collect())
    assert seen and all(lists <= asked * k and cells > 3 for asked, cells, lists, k in seen)


def test_a_task_holds_its_queries_and_little_beside_them():
    """Products of a whole cell with many queries, and vectors of the batches that came, aren't in memory at once."""
    import tracemalloc

    import pyarrow as pa

    n, dims = 6000, 64
    r = np.random.default_rng(6)

    def batches(first):
        for s in range(0, n, 1000):
            v = pa.ListArray.from_arrays(pa.array(np.arange(1001, dtype=np.int32) * dims), pa.array(r.normal(size=1000 * dims)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(s, s + 1000) + first), pa.array(np.ones(1000, np.int64)), v, pa.array([None] * 1000, pa.float64())], names=["id", "grp", "v", "floor"])

    asked, rows = list(batches(0)), list(batches(n))
    tracemalloc.start()
    lists = nearest.Lists(asked, 5, nearest.COSINE, True)
    lists.meet(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and not asked and not rows
    assert sum(b.num_rows for b in lists.found()) == 5 * n
    with pytest.raises(ValueError, match="one length"):
        nearest.stacked([pa.RecordBatch.from_arrays([pa.array([[1.0] * d], pa.list_(pa.float64()))], names=["v"]) for d in (2, 3)])
