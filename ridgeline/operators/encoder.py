"""Dual encoder: candidates by centred PCA, queries by ridge regression or a small tanh network onto those codes.

Axes and regression follow from sums over all rows, which tasks add up; the driver sees matrices of the vectors' size, never
a row. The network is trained on BOUND rows at most (a parameter) in one task. Encoding runs in Arrow batches.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import vectors
from ridgeline.operators.nearest import matrix

BOUND = 20_000


@dataclass
class DualEncoder:
    mean: np.ndarray
    axes: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    hidden: tuple[np.ndarray, np.ndarray] | None
    out: tuple[np.ndarray, np.ndarray]

    def candidate(self, x: np.ndarray) -> np.ndarray:
        return _unit((x - self.mean) @ self.axes)

    def query(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        if self.hidden is not None:
            z = np.tanh(z @ self.hidden[0] + self.hidden[1])
        return _unit(z @ self.out[0] + self.out[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), np.finfo(float).eps)


def fit(queries: np.ndarray, targets: np.ndarray, dims: int = 8, ridge: float = 10.0, hidden: int = 0, alpha: float = 0.01, steps: int = 1000, seed: int = 20260727) -> DualEncoder:
    """Row i of the queries belongs to row i of the targets. hidden: 0 for ridge regression, else the number of tanh units."""
    unique = np.unique(targets, axis=0)
    mean = unique.mean(axis=0)
    dims = max(2, min(dims, len(unique) - 1, unique.shape[1]))
    _, _, vt = np.linalg.svd(unique - mean, full_matrices=False)
    axes = vt[:dims].T
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] >= 0, 1.0, -1.0)
    centre, scale = queries.mean(axis=0), queries.std(axis=0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    x, y = (queries - centre) / scale, (targets - mean) @ axes
    if not hidden:
        bias = y.mean(axis=0)
        w = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - bias))
        return DualEncoder(mean, axes, centre, scale, None, (w, bias))
    r = np.random.default_rng(seed)
    p = [r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, 1 / np.sqrt(hidden), (hidden, y.shape[1])), y.mean(axis=0)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        h = np.tanh(x @ p[0] + p[1])
        e = (h @ p[2] + p[3] - y) / len(x)
        back = e @ p[2].T * (1 - h * h)
        for i, g in enumerate((x.T @ back + alpha * p[0] / len(x), back.sum(axis=0), h.T @ e + alpha * p[2] / len(x), e.sum(axis=0))):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.001 * (g * g - v[i])
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return DualEncoder(mean, axes, centre, scale, (p[0], p[1]), (p[2], p[3]))


def moments(rows: DataFrame, left: str, right: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of rows, the sums of both vectors, and of the products left x left and left x right.

    A task adds up its rows in products of whole batches and gives one row for each component of the left vector.
    """

    def run(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x, y = matrix(batch.column(0)), matrix(batch.column(1))
                both = np.concatenate([np.ones((len(x), 1)), x, y], axis=1)
                part = both.T @ both
                n, total = n + len(x), part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "s"])

    whole = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).cast("array<double>").alias("x"), F.col(right).cast("array<double>").alias("y"))
    dims = whole.select(F.size("x"), F.size("y")).first()
    if dims is None:
        raise ValueError("no rows to train on")
    sums = whole.mapInArrow(run, "i long, s array<double>").groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).toArrow()
    order = np.argsort(sums["i"].to_numpy())
    total = matrix(sums["s"].combine_chunks())[order]
    a = 1 + dims[0]
    return int(round(total[0, 0])), total[0, 1:a], total[0, a:], total[1:a, 1:a], total[1:a, a:]


def axes_of(targets: DataFrame, target: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes of the distinct targets; the largest component of an axis is positive. Raises ValueError below two axes."""
    distinct = targets.select(target).distinct()
    n, total, _, products, _ = moments(distinct, target, target)
    dims = min(dims, n - 1, len(total))
    if dims < 2:
        raise ValueError("at least two dimensions are needed")
    mean = total / n
    _, vectors_ = np.linalg.eigh(products - n * np.outer(mean, mean))
    axes = vectors_[:, ::-1][:, :dims]
    return mean, axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(dims)] >= 0, 1.0, -1.0)


def train(pairs: DataFrame, query: str, target: str, dims: int = 8, ridge: float = 10.0, hidden: int = 0, bound: int = BOUND, **options) -> DualEncoder:
    """Like `fit` on all pairs; with hidden units, on the `bound` pairs of least hash."""
    if not hidden:
        mean, axes = axes_of(pairs, target, dims)
        n, sx, sy, xx, xy = moments(pairs, query, target)
        centre = sx / n
        deviation = np.sqrt(np.maximum(np.diag(xx) / n - centre**2, 0))
        scale = np.where(deviation > 1e-6, deviation, 1.0)
        gram = (xx - n * np.outer(centre, centre)) / np.outer(scale, scale)
        cross = (xy - np.outer(centre, sy)) / scale[:, None] @ axes  # of centred queries with targets, whose own mean drops out
        return DualEncoder(mean, axes, centre, scale, None, (np.linalg.solve(gram + ridge * np.eye(len(gram)), cross), (sy / n - mean) @ axes))
    sample = pairs.select(F.col(query).cast("array<double>").alias("q"), F.col(target).cast("array<double>").alias("t")).orderBy(F.xxhash64(query, target)).limit(bound)

    def run(batches):
        whole = pa.Table.from_batches(list(batches))
        model = fit(*(matrix(whole[c].combine_chunks()) for c in ("q", "t")), dims=dims, ridge=ridge, hidden=hidden, **options)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").first()["model"])


def similarity(query_code: Column, candidate_code: Column) -> Column:
    """How close two codes are, from 0 to 1."""
    return (vectors.cosine(query_code, candidate_code) + 1) / 2


def blended_ranks(scored: DataFrame, weights: list[float], limit: int) -> DataFrame:
    """weight, queries, top_1, recall_at_5, recall_at_10, mrr: what each share of the learned score in the first `limit` ranks makes of the ranking.

    scored: (query_id, id, rank, score, learned, relevant). Queries without a relevant row count as misses. What a row's
    rank becomes depends on the rows of its query alone, at most `limit` of them.
    """
    every = scored.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    head = F.col("rank") <= limit
    blended = F.round((1 - F.col("weight")) * F.col("score") + F.col("weight") * F.col("learned"), 9)
    lists = every.groupBy("weight", "query_id").agg(
        F.array_sort(F.collect_list(F.when(head, F.struct((-blended).alias("s"), "rank", "relevant")))).alias("head"), F.min(F.when(~head & F.col("relevant"), F.col("rank"))).alias("tail"),
    )
    place = F.array_position(F.transform("head", lambda r: r["relevant"]), True)
    first = lists.select("weight", "query_id", F.when(place > 0, place).otherwise(F.col("tail")).alias("first"))
    share = lambda n: F.avg((F.coalesce(F.col("first"), F.lit(1 << 40)) <= n).cast("double"))
    return first.groupBy("weight").agg(F.count("*").alias("queries"), share(1).alias("top_1"), share(5).alias("recall_at_5"), share(10).alias("recall_at_10"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


# Suites that an audit needs, and what their groups must reach.
SUITES, STRICT_SUITE = ("public", "measured-multisource", "user-peak-valley"), "user-peak-valley"


def group_passed() -> Column:
    """Whether one style group of a suite stays consistent: columns suite, states, top, top_two and the least profile, top_five, top_ten."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    low = lambda c, v: F.coalesce(F.col(c), F.lit(0.0)) >= v
    strict = yes("states") & yes("top") & low("profile", 0.92) & low("top_five", 1.0) & low("top_ten", 0.8)
    lists = (low("top_five", 0.8) & (yes("top") | low("top_five", 1.0))) | (low("profile", 0.96) & low("top_ten", 0.7))
    close = low("profile", 0.98) & low("top_five", 0.6) & ((yes("top") & low("top_ten", 0.8)) | (yes("top_two") & low("top_ten", 0.9)))
    return F.when(F.col("suite") == STRICT_SUITE, strict).otherwise(yes("states") & low("profile", 0.95) & (lists | close))


def audit(reports: DataFrame, groups: DataFrame) -> DataFrame:
    """suite, counts_passed, groups_passed and passed of every report.

    reports: (suite, fixtures, preprocessing, states, search, end_to_end), counts; groups: as `group_passed` takes them.
    A suite without fixtures or groups doesn't pass.
    """
    counts = F.col("fixtures") > 0
    for c in ("preprocessing", "states", "search", "end_to_end"):
        counts = counts & (F.coalesce(F.col(c), F.lit(-1)) == F.col("fixtures"))
    judged = groups.select(F.col("suite").alias("_suite"), group_passed().alias("ok")).groupBy("_suite").agg(F.every("ok").alias("_groups"))
    out = reports.select("suite", F.coalesce(counts, F.lit(False)).alias("counts_passed")).join(judged, F.col("suite") == F.col("_suite"), "left")
    out = out.select("suite", "counts_passed", F.coalesce("_groups", F.lit(False)).alias("groups_passed"))
    return out.withColumn("passed", F.col("counts_passed") & F.col("groups_passed"))


def promoted(audited: DataFrame, synthetic_passed: bool, blend: float) -> DataFrame:
    """One row: whether a model may go live, and which suites are missing or failed."""
    wanted = F.array(*map(F.lit, SUITES))
    found = audited.agg(F.collect_set("suite").alias("seen"), F.coalesce(F.every("passed"), F.lit(False)).alias("all"), F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("suite")))).alias("failed"))
    missing = F.array_except(wanted, "seen")
    return found.select((F.lit(synthetic_passed and blend > 0) & F.col("all") & (F.size(missing) == 0)).alias("promoted"), F.array_join(missing, ",").alias("missing"), F.array_join("failed", ",").alias("failed"))


def encoded(df: DataFrame, vector: str, model: DualEncoder, as_query: bool, name: str = "code") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        side = shared.value.query if as_query else shared.value.candidate
        return pd.Series(list(side(np.stack(v.to_numpy()).astype(float)))) if len(v) else pd.Series([], dtype=object)

    return df.withColumn(name, run(F.col(vector)))
