"""Descriptor search, and the browser's last steps of ranking, over `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.functions import vectors
from ridgeline.operators import hypotheses, retrieval, search
from ridgeline.plans.search import _E, _FIRST, _WHOLE, _top, corpus
from ridgeline.sources import parquet
from ridgeline.storage import written

LEAST_PEAK = 0.12


def described(spark, sf_dir):
    """Every embedding with a descriptor of its local maxima: sample, state count, and sequences of peaks and valleys."""
    e = parquet(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    at = lambda i: F.element_at("v", i)
    peaks = F.filter(F.sequence(F.lit(2), F.lit(63)), lambda i: (at(i) > at(i - 1)) & (at(i) >= at(i + 1)) & (at(i) > LEAST_PEAK))
    e = e.withColumn("p", peaks)
    e = e.withColumn("w", F.filter(F.zip_with(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s: s["a"].isNotNull()))
    low = lambda s: F.array_min(F.slice(F.col("v"), s["a"], s["b"] - s["a"] + 1))
    desc = F.struct(
        F.size("p").cast("long").alias("peak_count"), (vectors.total(F.col("v")) / 64).alias("area"),
        F.transform("p", lambda i: (i - 1) / 63.0).alias("peak_locations"), F.transform("p", lambda i: F.abs(at(i - 1)) + F.abs(at(i + 1))).alias("peak_widths"),
        F.transform("w", low).alias("valley_heights"), F.transform("p", lambda i: at(i) - at(i - 1)).alias("tail_slopes"), F.transform("w", lambda s: at(s["a"]) - low(s)).alias("valley_depths"),
        F.transform("w", lambda s: (s["b"] - s["a"]) / 126.0).alias("peak_valley_distances"), F.transform("w", lambda s: (s["a"] % 5) / 5.0).alias("valley_position_ratios"),
    )
    return e.select(F.col("vec_id").alias("id"), (F.col("label") * 20 + F.col("vec_id") % 20).alias("sample"), F.size("p").cast("long").alias("states"), "v", desc.alias("desc"))


def descriptor_search(spark, sf_dir):
    d = written(described(spark, sf_dir))  # read by every step
    out = retrieval.search_similar(d, d, 8)
    return out.select("query_id", "id", "rank", "pool", F.round("retrieval", 6).alias("retrieval"), F.round("base", 6).alias("base"), F.round("score", 6).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


def leader_swap(spark, sf_dir):
    """The three nearest by the first half; the second half is the image, the whole the profile."""
    c, a, b = corpus(spark, sf_dir), corpus(spark, sf_dir, "a"), corpus(spark, sf_dir, "b")
    rows = search.topk(a, a, 3, same_group=True).select("query_id", "id", "rank", "score")
    sides = c.select("id", "v", F.slice("v", 1, 63).alias("view")).join(b.select(F.col("id").alias("_id"), F.col("v").alias("image_v")), F.col("id") == F.col("_id")).drop("_id")
    rows = rows.join(sides.select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.col("image_v").alias("qi")), "query_id").join(sides, "id")
    rows = rows.select("query_id", "id", "rank", "score", F.round(vectors.cosine(F.col("qi"), F.col("image_v")), 9).alias("image"), F.round(vectors.cosine(F.col("qv"), F.col("v")), 9).alias("profile"), F.col("score").alias("curve"), F.array_repeat(F.lit(1.0), 63).alias("view"))
    return retrieval.swap_leaders(rows).select("query_id", "id", "rank", "swapped", F.round("score", 6).alias("score"))


def shifted_neighbours(spark, sf_dir):
    """Each curve and the next one of its key, as profiles with slope and curvature, over all shifts."""
    p = corpus(spark, sf_dir).select("id", retrieval.views(F.col("v")).alias("x"))
    pairs = p.join(p.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id")
    return retrieval.shifted_similarity(pairs, "x", "y", "similarity").select("id", F.round("similarity", 6).alias("similarity"))


def artifact_rescue(spark, sf_dir):
    """Parts as queries, their line items as results of up to three readings."""
    li = parquet(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_partkey").alias("query_id"), (F.col("l_linenumber") % 3).cast("long").alias("hypothesis"), (F.col("l_linenumber") % 3 > 0).alias("rescue"),
        F.when(F.col("l_partkey") % 2 == 0, 4 + 4 * (F.col("l_linenumber") % 3 % 2)).otherwise(6).cast("long").alias("states"),
        (F.col("l_orderkey") % 12 + 1).cast("long").alias("rank"), (F.col("l_quantity") / 50).cast("double").alias("image"),
    )
    return retrieval.rescued(rows).select("query_id", "hypothesis", F.round("advantage", 6).alias("advantage"))


QUERIES = {f.__name__: f for f in (descriptor_search, leader_swap, shifted_neighbours, artifact_rescue)}


def _distance(name: str) -> str:
    """The mean gap of two sequences, brought to the longer length."""
    a, b = f"q.{name}", f"c.{name}"
    n = f"greatest(len({a}), len({b}))"

    def at(x: str) -> str:
        p = f"CASE WHEN {n} > 1 THEN i * (len({x}) - 1) / ({n} - 1)::DOUBLE ELSE 0.0 END"
        low = f"least(CAST(floor({p}) AS INT), len({x}) - 1)"
        return f"({x}[{low} + 1] + ({x}[least({low} + 2, len({x}))] - {x}[{low} + 1]) * ({p} - {low}))"

    return f"CASE WHEN {n} = 0 THEN 0.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 1.0 ELSE list_sum(list_transform(range({n}), lambda i: abs({at(a)} - {at(b)}))) / {n} END"


def _median(x: str) -> str:
    return f"coalesce(list_median({x}), 1.0)"


_RATES = {"peak_locations": 5, "peak_widths": 8, "valley_heights": 5, "tail_slopes": 18, "valley_depths": 10, "peak_valley_distances": 18, "valley_position_ratios": 4}
_SIMS = ", ".join(f"exp(-{rate}.0 * ({_distance(n)})) AS s_{n}" for n, rate in _RATES.items())
_DESCRIBED = (
    f"o AS (SELECT vec_id AS id, label, v, list_filter(range(2, 64), lambda i: v[i] > v[i - 1] AND v[i] >= v[i + 1] AND v[i] > {LEAST_PEAK}) AS p FROM e), "
    "d AS (SELECT id, label * 20 + id % 20 AS sample, len(p) AS states, v, list_sum(v) / 64 AS area, list_transform(p, lambda i: (i - 1) / 63.0::DOUBLE) AS peak_locations, list_transform(p, lambda i: abs(v[i - 1]) + abs(v[i + 1])) AS peak_widths, "
    "list_transform(range(1, len(p)), lambda j: list_min(v[p[j]:p[j + 1]])) AS valley_heights, list_transform(p, lambda i: v[i] - v[i - 1]) AS tail_slopes, list_transform(range(1, len(p)), lambda j: v[p[j]] - list_min(v[p[j]:p[j + 1]])) AS valley_depths, "
    "list_transform(range(1, len(p)), lambda j: (p[j + 1] - p[j]) / 126.0::DOUBLE) AS peak_valley_distances, list_transform(range(1, len(p)), lambda j: (p[j] % 5) / 5.0::DOUBLE) AS valley_position_ratios FROM o)"
)
_COS = "greatest(-1.0, least(1.0, list_cosine_similarity({0}, {1})))"
_IMAGE = _COS.format("x.v[1:32]", "y.v[1:32]")
_RETRIEVED = (
    f"s AS (SELECT x.id AS query_id, y.id, y.sample, x.states AS query_states, y.states, round((0.18 * {_IMAGE} + 0.82 * {_COS.format('x.v[33:64]', 'y.v[33:64]')}) / (0.18 + 0.82), 9) AS score FROM d x JOIN d y ON x.id <> y.id), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s), u AS (SELECT *, row_number() OVER (PARTITION BY query_id, sample ORDER BY score DESC, id) AS m FROM t WHERE n <= 80), "
    "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM u WHERE m = 1) WHERE r <= 24), own AS (SELECT query_id FROM f WHERE states = query_states GROUP BY query_id HAVING count(*) >= 10), "
    "g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n2 FROM s WHERE states = query_states AND query_id NOT IN (SELECT query_id FROM own)), h AS (SELECT *, row_number() OVER (PARTITION BY query_id, sample ORDER BY score DESC, id) AS m FROM g WHERE n2 <= 160), "
    "w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM h WHERE m = 1) WHERE r <= 24), wide AS (SELECT query_id FROM w GROUP BY query_id HAVING count(*) >= 10), "
    "pool AS (SELECT query_id, id, score, 'matched' AS pool FROM f WHERE states = query_states AND query_id IN (FROM own) UNION ALL SELECT query_id, id, score, 'expanded' FROM w WHERE query_id IN (FROM wide) UNION ALL SELECT query_id, id, score, 'all' FROM f WHERE query_id NOT IN (FROM own) AND query_id NOT IN (FROM wide))"
)
_SCORED = (
    f"k AS (SELECT z.*, abs(q.states - c.states) AS gap, {_COS.format('q.v[1:32]', 'c.v[1:32]')} AS image, exp(-0.6 * abs(q.states - c.states)) AS s_count, exp(-5.0 * abs(q.area - c.area)) AS s_area, {_SIMS}, "
    f"len(q.valley_depths) > 0 AND len(c.valley_depths) > 0 AND {_median('q.valley_depths')} <= 0.18 AND {_median('c.valley_depths')} <= 0.18 AS shallow, "
    f"CASE WHEN len(q.valley_depths) = 7 AND {_median('q.valley_depths')} <= 0.16 AND list_max(q.valley_depths) <= 0.20 THEN 0.18 ELSE 0.0 END AS weight FROM pool z JOIN d q ON q.id = z.query_id JOIN d c ON c.id = z.id), "
    "l AS (SELECT *, (score - 0.18 * image) / 0.82 AS curve, 0.55 * s_valley_depths + 0.30 * s_peak_valley_distances + 0.15 * s_valley_position_ratios AS relation FROM k), "
    "m AS (SELECT *, 0.30 * image + 0.38 * curve + 0.10 * s_count + 0.07 * s_peak_locations + 0.05 * s_peak_widths + 0.05 * s_valley_heights + 0.05 * s_tail_slopes AS base FROM l), "
    "n AS (SELECT *, round(0.7 * ((1 - weight) * base + weight * relation) + 0.3 * score, 9) AS final FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS rank, list_filter(["
    "CASE WHEN gap = 0 THEN 'same number of peaks' WHEN gap <= 1 THEN 'nearly the same number of peaks' END, CASE WHEN shallow THEN 'shallow valleys close to the peaks on both sides' WHEN relation >= 0.86 THEN 'similar depth and spacing of valleys' END, "
    "CASE WHEN s_peak_locations >= 0.82 THEN 'similar peak positions' END, CASE WHEN s_peak_widths >= 0.82 THEN 'similar peak widths' END, CASE WHEN curve >= 0.9 THEN 'very similar outline' WHEN curve >= 0.8 THEN 'similar outline' END, "
    "CASE WHEN s_area >= 0.9 THEN 'similar area' END, CASE WHEN s_valley_heights >= 0.88 AND s_tail_slopes >= 0.82 THEN 'similar valleys and tail slopes' END], lambda x: x IS NOT NULL) AS held FROM n)"
)
_GRADIENT = "list_transform(range(1, 129), lambda i: CASE WHEN i = 1 THEN {0}[2] - {0}[1] WHEN i = 128 THEN {0}[128] - {0}[127] ELSE ({0}[i + 1] - {0}[i - 1]) / 2 END)"
_PARTS = "(0.72 * {0} + 0.20 * {1} + 0.08 * {2})".format(*(f"list_cosine_similarity(x.{c}[1 + greatest(s, 0):128 + least(s, 0)], y.{c}[1 - least(s, 0):128 - greatest(s, 0)])" for c in ("r", "g", "h")))

ORACLE_SQL = {
    "descriptor_search": f"{_E}, {_DESCRIBED}, {_RETRIEVED}, {_SCORED} SELECT query_id, id, rank, pool, round(score, 6) AS retrieval, round(base, 6) AS base, round(final, 6) AS score, CASE WHEN len(held) = 0 THEN 'overall distance is small' ELSE array_to_string(held[1:3], '; ') END AS reasons FROM r WHERE rank <= 8",
    "leader_swap": f"{_E}, {_top('t', 3, _FIRST, True)}, p AS (SELECT t.query_id, t.id, rank, score, round({_COS.format('x.b', 'y.b')}, 9) AS image, round({_WHOLE}, 9) AS profile FROM t JOIN e x ON x.vec_id = t.query_id JOIN e y ON y.vec_id = t.id), "
    "w AS (SELECT a.query_id, a.score AS s1, b.score AS s2 FROM p a JOIN p b ON a.query_id = b.query_id AND a.rank = 1 AND b.rank = 2 WHERE a.score < 0.995 AND b.image >= a.image + 0.02 AND b.profile >= a.profile + 0.002 AND 0.92 * b.score + 0.08 * b.image > 0.92 * a.score + 0.08 * a.image) "
    "SELECT p.query_id, id, CASE WHEN s1 IS NOT NULL AND rank <= 2 THEN 3 - rank ELSE rank END AS rank, s1 IS NOT NULL AND rank <= 2 AS swapped, round(CASE WHEN s1 IS NOT NULL AND rank = 1 THEN least(s1, s2) WHEN s1 IS NOT NULL AND rank = 2 THEN greatest(s1, s2) ELSE score END, 6) AS score FROM p LEFT JOIN w USING (query_id)",
    "shifted_neighbours": f"{_E}, r AS (SELECT vec_id, list_transform(range(128), lambda i: v[CAST(floor(i * 63 / 127.0::DOUBLE) AS INT) + 1] + (v[least(CAST(floor(i * 63 / 127.0::DOUBLE) AS INT) + 2, 64)] - v[CAST(floor(i * 63 / 127.0::DOUBLE) AS INT) + 1]) * (i * 63 / 127.0::DOUBLE - floor(i * 63 / 127.0::DOUBLE))) AS r FROM e), "
    f"g AS (SELECT *, {_GRADIENT.format('r')} AS g FROM r), h AS (SELECT *, {_GRADIENT.format('g')} AS h FROM g) SELECT x.vec_id AS id, round(greatest(0.0, least(1.0, max({_PARTS}))), 6) AS similarity FROM h x JOIN h y ON y.vec_id = x.vec_id + 1, range(-10, 11) k(s) GROUP BY x.vec_id",
    "artifact_rescue": "WITH r AS (SELECT l_partkey AS query_id, l_linenumber % 3 AS hypothesis, l_linenumber % 3 > 0 AS rescue, CASE WHEN l_partkey % 2 = 0 THEN 4 + 4 * (l_linenumber % 3 % 2) ELSE 6 END AS states, l_orderkey % 12 + 1 AS rank, CAST(l_quantity / 50 AS DOUBLE) AS image FROM lineitem), "
    "c AS (SELECT query_id, hypothesis, max(states) AS states, bool_or(rescue) AS rescue, max(image) FILTER (rank <= 10) AS most, max(image) FILTER (rank = 1) AS lead FROM r GROUP BY ALL), d AS (SELECT *, 0.65 * lead + 0.35 * most AS consensus FROM c), "
    "j AS (SELECT a.*, round(CASE WHEN a.states = b.states THEN a.consensus - b.consensus ELSE a.most - b.most END, 9) AS adv, coalesce(a.states = b.states AND b.consensus < 0.55 AND a.consensus >= 0.70, false) OR (b.states = 4 AND a.states = 8) AS fits FROM d a JOIN d b ON a.query_id = b.query_id AND b.hypothesis = 0), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adv DESC, hypothesis) AS n FROM j WHERE rescue AND fits AND adv >= 0.18) SELECT DISTINCT j.query_id, coalesce(k.hypothesis, 0)::BIGINT AS hypothesis, round(coalesce(k.adv, 0.0), 6) AS advantage FROM j LEFT JOIN k ON k.query_id = j.query_id AND k.n = 1",
}
