"""Exact filtered top-k search, collapse, pools, blends, head re-ranking and reasons.

`nearest` has the search itself; here is what comes before and after it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import vectors
from ridgeline.operators.nearest import Kernel, ranked, topk  # noqa: F401

# Weights of the views, of the retrieval score in the final one, and of base score parts.
IMAGE_WEIGHT, CURVE_WEIGHT, CALIBRATION = 0.18, 0.82, 0.30
BASE_WEIGHTS = {"image_cosine": 0.30, "curve_cosine": 0.38, "peak_count_similarity": 0.10, "peak_location_similarity": 0.07, "peak_width_similarity": 0.05, "valley_similarity": 0.05, "tail_slope_similarity": 0.05}
MODEL_WEIGHTS = {"curve_cosine": 0.70, "model_score": 0.25, "retrieval_score": 0.05}


def two_views(image: float = IMAGE_WEIGHT, curve: float = CURVE_WEIGHT, aligned: bool = False) -> Kernel:
    """The weighted cosine of a vector's first and second half. Raises ValueError unless weights are >= 0 and not all 0."""
    if image < 0 or curve < 0 or image + curve <= 0:
        raise ValueError("weights must not be negative, nor all zero")

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a.shape[1] // 2
        second = vectors.aligned if aligned else vectors.cosines
        return (image * vectors.cosines(a[:, :h], b[:, :h]) + curve * second(a[:, h:], b[:, h:])) / (image + curve)

    def embed(a: np.ndarray) -> np.ndarray:
        h = a.shape[1] // 2
        parts = [np.sqrt(w / (image + curve)) * vectors.units(x) for w, x in ((image, a[:, :h]), (curve, a[:, h:]))]
        return np.concatenate(parts, axis=1)

    return Kernel(score, None if aligned else embed)


def collapse(rows: DataFrame, sample: str, limit: int) -> DataFrame:
    """The best row of each sample for each query, ranked, the first `limit`."""
    first = Window.partitionBy("query_id", sample).orderBy(F.desc("score"), F.asc("id"))
    return ranked(rows.drop("rank").withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first"), limit)


def pool(rows: DataFrame, k: int) -> DataFrame:
    """Rows of the query's own group if there are max(10, k) of them, else all; with what was chosen (own or all)."""
    own = F.count_if(F.col("grp") == F.col("query_grp")).over(Window.partitionBy("query_id"))
    out = rows.withColumn("_own", own >= max(10, k)).withColumn("pool", F.when(F.col("_own"), "own").otherwise("all"))
    return out.where(~F.col("_own") | (F.col("grp") == F.col("query_grp"))).drop("_own")


def weighted(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + w * F.col(name)
    return out


def base_score(model: bool = False) -> Column:
    return weighted(MODEL_WEIGHTS if model else BASE_WEIGHTS)


def blend(base: Column, other: Column, weight: Column | float) -> Column:
    return (1 - F.lit(weight) if isinstance(weight, float) else 1 - weight) * base + weight * other


def calibrated(reranked: Column, retrieval: Column) -> Column:
    return (1 - CALIBRATION) * reranked + CALIBRATION * retrieval


def rerank_head(rows: DataFrame, learned: str, limit: int, weight: float) -> DataFrame:
    """Within the first `limit` ranks the blended score decides; the tail keeps its order. Adds final_score, final_rank."""
    head = F.col("rank") <= limit
    out = rows.withColumn("final_score", F.when(head, F.round((1 - weight) * F.col("score") + weight * F.col(learned), 9)).otherwise(F.col("score")))
    order = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.when(head, F.col("final_score")).desc_nulls_last(), "rank")
    return out.withColumn("final_rank", F.row_number().over(order).cast("long"))


def keep_slots(rows: DataFrame) -> DataFrame:
    """The row of a final rank shows the score that had that rank before, so shown scores stay descending."""
    shown = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("shown_score", F.element_at(F.collect_list("score").over(shown), F.col("final_rank").cast("int")))


def closeness(distance: Column, rate: float) -> Column:
    return F.exp(-rate * distance)


def components(q: str = "q", c: str = "c") -> dict[str, Column]:
    """Similarities of two descriptor structs, by name. Rates are fixed values."""
    x, y = (lambda n: F.col(f"{q}.{n}")), (lambda n: F.col(f"{c}.{n}"))
    d = lambda n: vectors.sequence_distance(x(n), y(n))
    parts = {
        "peak_count_similarity": closeness(F.abs(x("peak_count") - y("peak_count")), 0.6),
        "peak_location_similarity": closeness(d("peak_locations"), 5.0),
        "peak_width_similarity": closeness(d("peak_widths"), 8.0),
        "area_similarity": closeness(F.abs(x("area") - y("area")), 5.0),
        "valley_similarity": closeness(d("valley_heights"), 5.0),
        "tail_slope_similarity": closeness(d("tail_slopes"), 18.0),
        "valley_depth_similarity": closeness(d("valley_depths"), 10.0),
        "peak_valley_distance_similarity": closeness(d("peak_valley_distances"), 18.0),
        "valley_position_similarity": closeness(d("valley_position_ratios"), 4.0),
    }
    parts["peak_valley_similarity"] = 0.55 * parts["valley_depth_similarity"] + 0.30 * parts["peak_valley_distance_similarity"] + 0.15 * parts["valley_position_similarity"]

    def median(a: Column) -> Column:
        s, n = F.array_sort(a), F.size(a)
        return F.when(n == 0, F.lit(1.0)).otherwise((F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)

    qm, cm = median(x("valley_depths")), median(y("valley_depths"))
    parts["query_median_valley_depth"], parts["candidate_median_valley_depth"] = qm, cm
    parts["shallow_peak_valley_overlap"] = (F.size(x("valley_depths")) > 0) & (F.size(y("valley_depths")) > 0) & (qm <= 0.18) & (cm <= 0.18)
    parts["peak_valley_weight"] = F.when((F.size(x("valley_depths")) == 7) & (qm <= 0.16) & (F.array_max(x("valley_depths")) <= 0.20), 0.18).otherwise(0.0)
    return parts


#: Conditions in order, each with its reason; an earlier one of a group hides the later. Thresholds are fixed values.
REASONS = [
    ("count", "peak_gap = 0", "same number of peaks"),
    ("count", "peak_gap <= 1", "nearly the same number of peaks"),
    ("valley", "shallow", "shallow valleys close to the peaks on both sides"),
    ("valley", "peak_valley_similarity >= 0.86", "similar depth and spacing of valleys"),
    ("location", "peak_location_similarity >= 0.82", "similar peak positions"),
    ("width", "peak_width_similarity >= 0.82", "similar peak widths"),
    ("curve", "curve_cosine >= 0.9", "very similar outline"),
    ("curve", "curve_cosine >= 0.8", "similar outline"),
    ("area", "area_similarity >= 0.9", "similar area"),
    ("tail", "valley_similarity >= 0.88 AND tail_slope_similarity >= 0.82", "similar valleys and tail slopes"),
]
DEFAULT_REASON = "overall distance is small"


def reasons(names: set[str] | None = None) -> Column:
    """The first three reasons that hold, or the default one. names: the columns there are; rules on others are left out."""
    groups: dict[str, Column] = {}
    for group, condition, text in REASONS:
        if names is not None and not {w for w in condition.replace("AND", " ").split() if w[0].isalpha()} <= names:
            continue
        groups[group] = groups[group].when(F.expr(condition), text) if group in groups else F.when(F.expr(condition), text)
    held = F.slice(F.array_compact(F.array(*groups.values())), 1, 3)
    return F.when(F.size(held) == 0, F.array(F.lit(DEFAULT_REASON))).otherwise(held)
