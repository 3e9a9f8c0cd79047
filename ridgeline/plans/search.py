"""Search and retrieval metrics over `embeddings`: every vector is a query against all others (leave one out)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import vectors
from ridgeline.operators import hypotheses, learn, metrics, search
from ridgeline.sources import parquet

HALF = 32


def corpus(spark: SparkSession, sf_dir: str, part: str = "v") -> DataFrame:
    """(id, grp, v): the whole vector, its first half (a) or its second half (b)."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    v = {"v": whole, "a": F.slice(whole, 1, HALF), "b": F.slice(whole, HALF + 1, HALF), "c": F.slice(whole, 1, 63)}[part]
    return parquet(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), v.alias("v"))


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def vector_topk_state_filtered(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shown(search.topk(c, c, 5, same_group=True))


def vector_topk(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shown(search.topk(c, c, 5))


def weighted_two_view_topk(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shown(search.topk(c, c, 5, search.two_views(), same_group=True))


def aligned_similarity_topk(spark, sf_dir):
    c = corpus(spark, sf_dir, "c")
    return shown(search.topk(c, c, 5, hypotheses.ALIGNED, same_group=True))


def sample_collapse_topk(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return shown(search.collapse(search.topk(c, c, 80), "grp", 3))


def state_pool_fallback(spark, sf_dir):
    c = corpus(spark, sf_dir)
    rows = search.pool(search.topk(c, c, 20), k=8)
    return rows.groupBy("query_id", "pool").agg(F.count("*").alias("n"), F.min_by("id", "rank").alias("best_id"), F.round(F.max("score"), 6).alias("best_score"))


def _with_learned(spark, sf_dir, k: int) -> DataFrame:
    """The k best by the first half, with a learned score from the second."""
    c = corpus(spark, sf_dir, "a")
    other = corpus(spark, sf_dir, "b").select("id", "v")
    rows = search.topk(c, c, k, same_group=True).join(other.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id").join(other, "id")
    return rows.withColumn("learned", F.round((vectors.cosine(F.col("qv"), F.col("v")) + 1) / 2, 9)).drop("qv", "v")


def head_rerank_blend(spark, sf_dir):
    rows = search.rerank_head(_with_learned(spark, sf_dir, 10), "learned", limit=5, weight=0.08)
    return rows.select("query_id", "id", "rank", "final_rank", F.round("final_score", 6).alias("final_score"))


def score_slot_projection(spark, sf_dir):
    rows = search.keep_slots(search.rerank_head(_with_learned(spark, sf_dir, 10), "learned", limit=5, weight=0.08))
    return rows.select("query_id", "id", "final_rank", F.round("shown_score", 6).alias("shown_score"))


def _facts(spark, sf_dir) -> DataFrame:
    c = corpus(spark, sf_dir)
    return c.select("id", F.size(F.filter("v", lambda x: x > 0.2)).cast("long").alias("peaks"), F.round(vectors.total(F.col("v")) / 64, 6).alias("area"))


def similarity_reasons(spark, sf_dir):
    f = _facts(spark, sf_dir)
    rows = search.topk(corpus(spark, sf_dir), corpus(spark, sf_dir), 5, same_group=True)
    rows = rows.join(f.select(F.col("id").alias("query_id"), F.col("peaks").alias("qp"), F.col("area").alias("qa")), "query_id").join(f, "id")
    rows = rows.withColumns({"peak_gap": F.abs(F.col("qp") - F.col("peaks")), "curve_cosine": F.round("score", 6), "area_similarity": search.closeness(F.abs(F.col("qa") - F.col("area")), 5.0)})
    return rows.select("query_id", "id", F.array_join(search.reasons({"peak_gap", "curve_cosine", "area_similarity"}), "; ").alias("reasons"))


def nearest_coverage(spark, sf_dir):
    c = corpus(spark, sf_dir)
    first = c.withColumn("_n", F.row_number().over(Window.partitionBy("grp").orderBy("id"))).where("_n <= 10").drop("_n")
    near = search.topk(first, c, 1, same_group=True, exclude_self=False)
    return near.groupBy("query_grp").agg(F.count("*").alias("n"), F.round(F.avg("score"), 5).alias("mean_nearest"), F.round(F.min("score"), 6).alias("min_nearest"))


def farthest_point_selection(spark, sf_dir):
    return learn.farthest_points(corpus(spark, sf_dir), "grp", "id", "v", 10)


def _ranks(spark, sf_dir) -> DataFrame:
    c = corpus(spark, sf_dir)
    return metrics.first_relevant(search.topk(c, c, 10), F.col("grp") == F.col("query_grp"))


def topk_recall_mrr(spark, sf_dir):
    return _ranks(spark, sf_dir).agg(*metrics.ranking(F.col("first_rank")))


def metric_block_by_label(spark, sf_dir):
    return _ranks(spark, sf_dir).groupBy("query_grp").agg(*metrics.ranking(F.col("first_rank")))


def grouped_metrics_grouping_sets(spark, sf_dir):
    rows = _ranks(spark, sf_dir).withColumn("odd", F.col("query_id") % 2)
    out = rows.groupingSets([["query_grp"], ["odd"], []], "query_grp", "odd").agg(F.grouping_id().cast("long").alias("level"), *metrics.ranking(F.col("first_rank")))
    return out.select(F.coalesce(F.col("query_grp").cast("string"), F.lit("none")).alias("label_key"), F.coalesce(F.col("odd").cast("string"), F.lit("none")).alias("odd_key"), "level", "queries", "top_1", "recall_at_5", "mrr", "missing")


def _graded(spark, sf_dir) -> DataFrame:
    c = corpus(spark, sf_dir, "a")
    whole = corpus(spark, sf_dir).select("id", "v")
    rows = search.topk(c, c, 20, same_group=True).join(whole.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id").join(whole, "id")
    return rows.withColumn("sim", F.round(vectors.cosine(F.col("qv"), F.col("v")), 9)).drop("qv", "v")


def graded_ndcg(spark, sf_dir):
    rows = metrics.gains(_graded(spark, sf_dir), "sim")
    return metrics.ndcg(rows, ndcg_at_5=5, ndcg_at_10=10).select("query_id", F.round("ndcg_at_5", 6).alias("ndcg_at_5"), F.round("ndcg_at_10", 6).alias("ndcg_at_10"))


def neighbor_recall(spark, sf_dir):
    a, v = corpus(spark, sf_dir, "a"), corpus(spark, sf_dir)
    want = search.topk(v, v, 5, same_group=True).groupBy("query_id").agg(F.collect_set("id").alias("want"))
    got = search.topk(a, a, 10, same_group=True).groupBy("query_id").agg(F.collect_set(F.when(F.col("rank") <= 5, F.col("id"))).alias("five"), F.collect_set("id").alias("ten"))
    share = lambda c: F.round(F.size(F.array_intersect("want", c)) / F.size("want"), 6)
    return want.join(got, "query_id").select("query_id", share("five").alias("recall_at_5"), share("ten").alias("recall_at_10"))


def style_invariance_pairs(spark, sf_dir):
    """The mean cosine over all unordered pairs of a group, from the length of the sum of its unit vectors: no pair is made."""
    units = corpus(spark, sf_dir).select("grp", vectors.unit(F.col("v")).alias("u"))
    sums = units.groupBy("grp").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("u")))).alias("s"), F.sum(vectors.dot(F.col("u"), F.col("u"))).alias("own"), F.count("*").alias("n"))
    n = F.col("n")
    return sums.select("grp", (n * (n - 1) / 2).cast("long").alias("pairs"), F.round((vectors.dot(F.col("s"), F.col("s")) - F.col("own")) / (n * (n - 1)), 6).alias("mean_cosine"))


def topk_set_overlap(spark, sf_dir):
    c = corpus(spark, sf_dir)
    rows = search.topk(c, c, 5, same_group=True)
    sets = rows.groupBy("query_id").agg(F.collect_set("id").alias("ids"), F.min_by("id", "rank").alias("nearest"))
    other = sets.select(F.col("query_id").alias("nearest"), F.col("ids").alias("theirs"))
    return sets.join(other, "nearest").select("query_id", "nearest", F.round(F.size(F.array_intersect("ids", "theirs")) / 5, 6).alias("overlap"))


def pca_encoder(spark, sf_dir):
    return learn.centred_pca(corpus(spark, sf_dir), "v", 8).select("id", "grp", F.transform("encoded", lambda x: F.round(x, 6)).alias("encoded"))


QUERIES = {f.__name__: f for f in (
    vector_topk_state_filtered, vector_topk, weighted_two_view_topk, aligned_similarity_topk, sample_collapse_topk, state_pool_fallback, head_rerank_blend, score_slot_projection,
    similarity_reasons, nearest_coverage, farthest_point_selection, topk_recall_mrr, metric_block_by_label, grouped_metrics_grouping_sets, graded_ndcg, neighbor_recall,
    style_invariance_pairs, topk_set_overlap, pca_encoder,
)}

_E = "WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v, CAST(embedding AS DOUBLE[])[1:32] AS a, CAST(embedding AS DOUBLE[])[33:64] AS b FROM embeddings)"
_COS = "greatest(-1.0, least(1.0, list_cosine_similarity({0}, {1})))"


def _top(name: str, k: int, score: str, same: bool) -> str:
    """CTEs: all pairs with their score, and the k best of each query."""
    return (
        f"{name}_s AS (SELECT x.vec_id AS query_id, x.label AS query_grp, y.vec_id AS id, y.label AS grp, round({score}, 9) AS score FROM e x JOIN e y ON x.vec_id <> y.vec_id{' AND x.label = y.label' if same else ''}), "
        f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_s) WHERE rank <= {k})"
    )


_WHOLE, _FIRST = _COS.format("x.v", "y.v"), _COS.format("x.a", "y.a")
_SHOWN = "SELECT query_id, id, rank, round(score, 6) AS score FROM t"
_RANKS = f"{_E}, {_top('t', 10, _WHOLE, False)}, r AS (SELECT query_id, query_grp, min(CASE WHEN grp = query_grp THEN rank END) AS first_rank FROM t GROUP BY ALL)"
_BLOCK = "count(*) AS queries, round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top_1, round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, round(avg(coalesce(1.0 / first_rank, 0.0)), 6) AS mrr, round(coalesce(avg(1.0 / first_rank), 0.0), 6) AS mrr_found, count(*) FILTER (first_rank IS NULL) AS missing"
_LEARNED = f"{_E}, {_top('t', 10, _FIRST, True)}, l AS (SELECT t.*, round(({_COS.format('x.b', 'y.b')} + 1) / 2, 9) AS learned FROM t JOIN e x ON x.vec_id = t.query_id JOIN e y ON y.vec_id = t.id), f AS (SELECT *, CASE WHEN rank <= 5 THEN round(0.92 * score + 0.08 * learned, 9) ELSE score END AS final_score FROM l), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 5 THEN 0 ELSE 1 END, CASE WHEN rank <= 5 THEN final_score END DESC NULLS LAST, rank) AS final_rank FROM f)"
_SEG = " + ".join(f"{w} * list_cosine_similarity(CASE WHEN s >= 0 THEN x.v[{a} + s:{b}] ELSE x.v[{a}:{b} + s] END, CASE WHEN s >= 0 THEN y.v[{a}:{b} - s] ELSE y.v[{a} - s:{b}] END)" for w, a, b in ((0.72, 1, 21), (0.20, 22, 42), (0.08, 43, 63)))

ORACLE_SQL = {
    "vector_topk_state_filtered": f"{_E}, {_top('t', 5, _WHOLE, True)} {_SHOWN}",
    "vector_topk": f"{_E}, {_top('t', 5, _WHOLE, False)} {_SHOWN}",
    "weighted_two_view_topk": f"{_E}, {_top('t', 5, '0.18 * ' + _FIRST + ' + 0.82 * ' + _COS.format('x.b', 'y.b'), True)} {_SHOWN}",
    "aligned_similarity_topk": f"{_E}, p AS (SELECT x.vec_id AS query_id, y.vec_id AS id, max({_SEG}) AS m FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id, range(-9, 10) r(s) GROUP BY ALL), q AS (SELECT query_id, id, round(greatest(-1.0, least(1.0, m)), 9) AS score FROM p), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM q) {_SHOWN} WHERE rank <= 5",
    "sample_collapse_topk": f"{_E}, {_top('c', 80, _WHOLE, False)}, d AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, id) AS n FROM c), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM d WHERE n = 1) {_SHOWN} WHERE rank <= 3",
    "state_pool_fallback": f"{_E}, {_top('t', 20, _WHOLE, False)}, o AS (SELECT *, count(*) FILTER (grp = query_grp) OVER (PARTITION BY query_id) >= 10 AS own FROM t) SELECT query_id, CASE WHEN own THEN 'own' ELSE 'all' END AS pool, count(*) AS n, arg_min(id, rank) AS best_id, round(max(score), 6) AS best_score FROM o WHERE NOT own OR grp = query_grp GROUP BY query_id, own",
    "head_rerank_blend": f"{_LEARNED} SELECT query_id, id, rank, final_rank, round(final_score, 6) AS final_score FROM g",
    "score_slot_projection": f"{_LEARNED} SELECT g.query_id, g.id, g.final_rank, round(o.score, 6) AS shown_score FROM g JOIN g o ON o.query_id = g.query_id AND o.rank = g.final_rank",
    "similarity_reasons": f"{_E}, {_top('t', 5, _WHOLE, True)}, f AS (SELECT vec_id, len(list_filter(v, lambda x: x > 0.2)) AS peaks, round(list_sum(v) / 64, 6) AS area FROM e), c AS (SELECT t.query_id, t.id, abs(q.peaks - y.peaks) AS gap, round(score, 6) AS cosine, exp(-5.0 * abs(q.area - y.area)) AS area FROM t JOIN f q ON q.vec_id = t.query_id JOIN f y ON y.vec_id = t.id), r AS (SELECT query_id, id, list_filter([CASE WHEN gap = 0 THEN 'same number of peaks' WHEN gap <= 1 THEN 'nearly the same number of peaks' END, CASE WHEN cosine >= 0.9 THEN 'very similar outline' WHEN cosine >= 0.8 THEN 'similar outline' END, CASE WHEN area >= 0.9 THEN 'similar area' END], lambda x: x IS NOT NULL) AS held FROM c) SELECT query_id, id, CASE WHEN len(held) = 0 THEN 'overall distance is small' ELSE array_to_string(held[1:3], '; ') END AS reasons FROM r",
    "nearest_coverage": f"{_E}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM e), m AS (SELECT x.vec_id, x.label AS query_grp, max(round({_WHOLE}, 9)) AS score FROM e x JOIN n y ON x.label = y.label AND y.n <= 10 GROUP BY ALL) SELECT query_grp, count(*) AS n, round(avg(score), 5) AS mean_nearest, round(min(score), 6) AS min_nearest FROM m GROUP BY query_grp",
    "topk_recall_mrr": f"{_RANKS} SELECT {_BLOCK} FROM r",
    "metric_block_by_label": f"{_RANKS} SELECT query_grp, {_BLOCK} FROM r GROUP BY query_grp",
    "grouped_metrics_grouping_sets": f"{_RANKS}, o AS (SELECT *, query_id % 2 AS odd FROM r), b AS (SELECT query_grp, odd, CAST(grouping_id(query_grp, odd) AS BIGINT) AS level, {_BLOCK} FROM o GROUP BY GROUPING SETS ((query_grp), (odd), ())) SELECT coalesce(CAST(query_grp AS VARCHAR), 'none') AS label_key, coalesce(CAST(odd AS VARCHAR), 'none') AS odd_key, level, queries, top_1, recall_at_5, mrr, missing FROM b",
    "graded_ndcg": f"{_E}, {_top('t', 20, _FIRST, True)}, g AS (SELECT t.query_id, rank, round({_WHOLE}, 9) AS sim FROM t JOIN e x ON x.vec_id = t.query_id JOIN e y ON y.vec_id = t.id), h AS (SELECT *, quantile_cont(sim, 0.25) OVER (PARTITION BY query_id) AS lo FROM g), i AS (SELECT query_id, rank, pow(greatest(0.0, least(1.0, (sim - lo) / greatest(1.0 - lo, 2.220446049250313e-16))), 2) AS gain FROM h), j AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS best FROM i), k AS (SELECT query_id, "
    + ", ".join(f"sum(CASE WHEN {r} <= {n} THEN (pow(2.0, gain) - 1) / log2({r} + 1.0) ELSE 0.0 END) AS {r}{n}" for n in (5, 10) for r in ("rank", "best"))
    + " FROM j GROUP BY query_id) SELECT query_id, round(CASE WHEN best5 > 2.220446049250313e-16 THEN rank5 / best5 ELSE 0.0 END, 6) AS ndcg_at_5, round(CASE WHEN best10 > 2.220446049250313e-16 THEN rank10 / best10 ELSE 0.0 END, 6) AS ndcg_at_10 FROM k",
    "neighbor_recall": f"{_E}, {_top('w', 5, _WHOLE, True)}, {_top('g', 10, _FIRST, True)} SELECT w.query_id, round(count(*) FILTER (g.rank <= 5) / 5, 6) AS recall_at_5, round(count(g.id) / 5, 6) AS recall_at_10 FROM w LEFT JOIN g ON g.query_id = w.query_id AND g.id = w.id GROUP BY w.query_id",
    "style_invariance_pairs": f"{_E} SELECT x.label AS grp, count(*) AS pairs, round(avg({_WHOLE}), 6) AS mean_cosine FROM e x JOIN e y ON x.label = y.label AND x.vec_id < y.vec_id GROUP BY x.label",
    "topk_set_overlap": f"{_E}, {_top('t', 5, _WHOLE, True)}, s AS (SELECT query_id, list(id) AS ids, arg_min(id, rank) AS nearest FROM t GROUP BY query_id) SELECT a.query_id, a.nearest, round(len(list_intersect(a.ids, b.ids)) / 5, 6) AS overlap FROM s a JOIN s b ON b.query_id = a.nearest",
}
