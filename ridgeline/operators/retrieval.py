"""From a descriptor to results: retrieval, distinct samples, the state's own pool, components, base and final scores, reasons.

Rows are (id, sample, states, v, desc): a key, the sample that a variant belongs to, a state count, a vector whose first
half is the image's embedding and whose second is the curve's, and a descriptor as `search.components` takes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import vectors
from ridgeline.operators import hypotheses, search
from ridgeline.operators.nearest import ranked
from ridgeline.storage import written

# The pair model's features in order, its blend, pool sizes, and what leader and challenger must reach.
FEATURES = ("image_cosine", "curve_cosine", "peak_count_similarity", "peak_location_similarity", "peak_width_similarity", "area_similarity", "valley_similarity", "tail_slope_similarity")
LEAST_POOL, EXPANDED = 10, 160
SETTLED, NEIGHBOURS, IMAGE_MARGIN, PROFILE_MARGIN, SWAP_BLEND = 0.995, 0.80, 0.02, 0.002, 0.08
RESCUE_TOP, RESCUE_CEILING, RESCUE_FLOOR, RESCUE_MARGIN = 10, 0.55, 0.70, 0.18
CONSENSUS = (0.65, 0.35)
#: Points that profiles are brought to before they are compared.
POINTS = 128


def feature_vector() -> Column:
    """The features of a pair in the model's order."""
    return F.array(*[F.col(f).cast("double") for f in FEATURES])


def model_score(weights: dict[str, float], intercept: float) -> Column:
    """The pair model's probability."""
    return 1 / (1 + F.exp(-(F.lit(float(intercept)) + search.weighted(weights))))


def _pool(corpus: DataFrame, queries: DataFrame, k: int, pool: int, exclude_self: bool) -> DataFrame:
    """query_id, id, score, states, query_states and `pool`: what is ranked further, with where it comes from.

    The best rows of distinct samples are found first. Where LEAST_POOL of them (or k) have the query's state count, they
    are the pool. Else rows of that state count alone are searched, further down; if those are too few as well, all of the
    first ones stay.
    """
    kernel, least = search.two_views(), max(LEAST_POOL, k)
    by = lambda t, g: t.select("id", F.col(g).cast("long").alias("grp"), "v")
    first = max(pool, 4 * k)
    facts = corpus.select(F.col("id").alias("_id"), "states", F.col("sample").cast("long").alias("sample"))
    asked = queries.select(F.col("id").alias("_query"), F.col("states").alias("query_states"))
    found = search.topk(by(corpus, "sample"), by(queries, "sample"), first, kernel, exclude_self=exclude_self)
    unique = search.collapse(found, "grp", 3 * k).join(facts, F.col("id") == F.col("_id")).join(asked, F.col("query_id") == F.col("_query"))
    unique = written(unique.select("query_id", "id", "score", "states", "query_states"))
    same = unique.where("states = query_states")
    own = same.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("query_id")
    rest = queries.join(own, F.col("id") == F.col("query_id"), "left_anti")
    further = search.topk(by(corpus, "states"), by(rest, "states"), max(2 * first, 16 * k, EXPANDED), kernel, same_group=True, exclude_self=exclude_self)
    further = search.collapse(further.join(facts, F.col("id") == F.col("_id")), "sample", max(least, 3 * k))
    further = written(further.select("query_id", "id", "score", "states", F.col("states").alias("query_states")))
    wide = further.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("query_id")
    settled = own.unionByName(wide)
    parts = (same.join(own, "query_id", "left_semi"), "matched"), (further.join(wide, "query_id", "left_semi"), "expanded"), (unique.join(settled, "query_id", "left_anti"), "all")
    out = None
    for rows, name in parts:
        rows = rows.withColumn("pool", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def pair_features(pairs: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs (query_id, id, score) with all components of both descriptors, image_cosine and curve_cosine.

    The retrieval score is a weighted sum of both cosines, so the curve's follows from the image's.
    """
    half = F.floor(F.size("v") / 2).cast("int")
    side = lambda t, key, c: t.select(F.col("id").alias(key), F.slice("v", F.lit(1), half).alias(f"_{c}"), F.col("desc").alias(c))
    rows = pairs.join(side(queries, "query_id", "q"), "query_id").join(side(corpus, "id", "c"), "id")
    rows = rows.withColumns(search.components()).withColumn("image_cosine", vectors.cosine(F.col("_q"), F.col("_c")))
    rows = rows.withColumn("curve_cosine", (F.col("score") - search.IMAGE_WEIGHT * F.col("image_cosine")) / search.CURVE_WEIGHT)
    gap = F.abs(F.col("q.peak_count") - F.col("c.peak_count"))
    return rows.withColumns({"peak_gap": gap, "shallow": F.col("shallow_peak_valley_overlap")}).drop("q", "c", "_q", "_c")


def search_similar(corpus: DataFrame, queries: DataFrame, k: int = 8, pool: int = 80, model: tuple[dict[str, float], float] | None = None, exclude_self: bool = True) -> DataFrame:
    """query_id, id, rank, pool, retrieval, base, score, reasons of the k best rows of distinct samples of each query.

    model: weights and intercept over FEATURES; without one the base score is the fixed blend of components. Raises
    ValueError if k < 1.
    """
    rows = pair_features(_pool(corpus, queries, k, pool, exclude_self), corpus, queries).withColumn("retrieval_score", F.col("score"))
    if model is not None:
        rows = rows.withColumn("model_score", model_score(*model))
    rows = rows.withColumn("base", search.base_score(model is not None))
    local = search.blend(F.col("base"), F.col("peak_valley_similarity"), F.col("peak_valley_weight"))
    rows = rows.withColumn("score", F.round(search.calibrated(local, F.col("retrieval_score")), 9)).withColumn("reasons", search.reasons())
    return ranked(rows, k).select("query_id", "id", "rank", "pool", F.col("retrieval_score").alias("retrieval"), "base", "score", "reasons")


def views(profile: Column) -> Column:
    """A profile, its slope and its curvature at POINTS points each, one after the other: what shifted comparisons take."""
    level = vectors.resample(profile, POINTS)
    return vectors.let(level, lambda p: vectors.let(vectors.gradient(p), lambda g: F.concat(p, g, vectors.gradient(g))))


def shifted_similarity(rows: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """rows with the best weighted cosine of two views over all shifts, from 0 to 1; null where one is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch[c].to_numpy(zero_copy_only=False) for c in (left, right))
            at = np.array([i for i, (a, b) in enumerate(zip(x, y)) if a is not None and b is not None], int)
            out = np.full(len(x), np.nan)
            if len(at):
                a, b = (np.stack([v[i] for i in at]).astype(float) for v in (x, y))
                each = [(hypotheses.shifted(a, s, True) * hypotheses.shifted(b, s, False)).sum(axis=1) for s in hypotheses.shifts(a.shape[1])]
                out[at] = np.clip(np.max(each, axis=0), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, from_pandas=True)], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast("double").alias(name)).schema)


def swap_leaders(rows: DataFrame) -> DataFrame:
    """rows (query_id, id, rank, score, image, profile, curve, view) with the first two changed places where the image says so.

    The challenger must resemble the leader, be the better match by image and by profile, and win when the image has its
    share in the score; a leader whose curve all but equals the query stays. Both keep the scores of their new places.
    Only two rows of a query meet, as partial maxima.
    """
    fields = ("id", "score", "image", "profile", "curve", "view")
    two = rows.where("rank <= 2").groupBy("query_id").agg(*[F.max(F.when(F.col("rank") == n, F.struct(*fields))).alias(c) for n, c in ((1, "a"), (2, "b"))])
    two = shifted_similarity(two.select("query_id", "a", "b", F.col("a.view").alias("_x"), F.col("b.view").alias("_y")), "_x", "_y", "beside")
    blended = lambda c: (1 - SWAP_BLEND) * F.col(f"{c}.score") + SWAP_BLEND * F.col(f"{c}.image")
    swaps = (
        (F.coalesce(F.col("a.curve"), F.lit(0.0)) < SETTLED) & (F.col("beside") >= NEIGHBOURS) & (F.col("b.image") >= F.col("a.image") + IMAGE_MARGIN)
        & (F.col("b.profile") >= F.col("a.profile") + PROFILE_MARGIN) & (blended("b") > blended("a"))
    )
    hit = two.where(swaps).select(F.col("query_id").alias("_query"), F.col("a.score").alias("_first"), F.col("b.score").alias("_second"))
    out = rows.join(hit, F.col("query_id") == F.col("_query"), "left")
    swapped = F.col("_query").isNotNull() & (F.col("rank") <= 2)
    score = F.when(swapped, F.when(F.col("rank") == 1, F.least("_first", "_second")).otherwise(F.greatest("_first", "_second"))).otherwise(F.col("score"))
    return out.withColumns({"score": score, "rank": F.when(swapped, 3 - F.col("rank")).otherwise(F.col("rank")), "swapped": swapped}).drop("_query", "_first", "_second")


def rescued(rankings: DataFrame) -> DataFrame:
    """query_id, hypothesis, advantage: which reading of each query stands for it, 0 being the first.

    rankings: (query_id, hypothesis, rescue, states, rank, image), one row for each result. A reading's consensus is its
    first result's image score with the best of its RESCUE_TOP first ones. A rescue of the same state count needs a weak
    first reading, a strong own one and the margin; one that restores eight states from four needs the margin in the best
    image score. The greatest advantage wins, of equal ones the earlier reading.
    """
    image = F.coalesce("image", F.lit(0.0))
    top = F.max(F.when(F.col("rank") <= RESCUE_TOP, image))
    each = rankings.groupBy("query_id", "hypothesis").agg(F.max("rescue").alias("rescue"), F.max("states").alias("states"), top.alias("most"), F.max(F.when(F.col("rank") == 1, image)).alias("lead"))
    each = each.withColumn("consensus", CONSENSUS[0] * F.col("lead") + CONSENSUS[1] * F.col("most"))
    first = each.where("hypothesis = 0").select(F.col("query_id").alias("_query"), F.col("states").alias("_states"), F.col("consensus").alias("_consensus"), F.col("most").alias("_most"))
    both = each.join(first, F.col("query_id") == F.col("_query"))
    same, restores = F.col("states") == F.col("_states"), (F.col("_states") == 4) & (F.col("states") == 8)
    advantage = F.round(F.when(same, F.col("consensus") - F.col("_consensus")).otherwise(F.col("most") - F.col("_most")), 9)
    fits = F.coalesce(F.col("rescue"), F.lit(False)) & (F.col("hypothesis") > 0) & (advantage >= RESCUE_MARGIN)
    fits = fits & (same & (F.col("_consensus") < RESCUE_CEILING) & (F.col("consensus") >= RESCUE_FLOOR) | restores)
    chosen = both.withColumn("advantage", advantage).withColumn("_key", F.when(fits, F.struct((-advantage).alias("a"), F.col("hypothesis").alias("h"))))
    return chosen.groupBy("query_id").agg(F.coalesce(F.min("_key")["h"], F.lit(0)).cast("long").alias("hypothesis"), F.coalesce(-F.min("_key")["a"], F.lit(0.0)).alias("advantage"))
