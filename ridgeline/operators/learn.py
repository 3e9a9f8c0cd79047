"""Learning: monotone logistic re-ranker, PCA encoder, blend choice, diverse selection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import vectors
from ridgeline.operators.nearest import matrix
from ridgeline.storage import written

#: Rows of a group that one task takes at once.
ALONE = 16_384
# Fixed values.
RIDGE, MOST_WEIGHT, BLENDS = 0.05, 8.0, (0.0, 0.02, 0.05, 0.08, 0.10, 0.15, 0.20)


def monotone_logistic(rows: DataFrame, features: list[str], label: str, weight: str | None = None) -> tuple[dict[str, float], float]:
    """Weights in [0, 8] and a free intercept, minimising weighted log-loss + 0.025 |w|^2. Raises ValueError without two classes."""
    if rows.select(label).distinct().count() < 2:
        raise ValueError("both classes are needed")
    n = len(features)
    data = rows.select(array_to_vector(F.array(*[F.col(f).cast("double") for f in features])).alias("features"), F.col(label).cast("double").alias("label"), *([F.col(weight).cast("double").alias("weight")] if weight else []))
    fit = LogisticRegression(
        regParam=RIDGE, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-12,
        lowerBoundsOnCoefficients=Matrices.dense(1, n, [0.0] * n), upperBoundsOnCoefficients=Matrices.dense(1, n, [MOST_WEIGHT] * n),
    )
    if weight:
        fit = fit.setWeightCol("weight")
    model = fit.fit(data)
    return dict(zip(features, map(float, model.coefficients))), float(model.intercept)


def centred_pca(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """rows with `encoded`: the first principal components of the centred vectors (signs: the largest loading is positive)."""
    size = rows.select(F.size(vector)).first()[0]
    mean = rows.agg(*[F.avg(F.col(vector)[i]).alias(f"m{i}") for i in range(size)]).first()
    centre = F.array(*[F.lit(float(m)) for m in mean])
    data = rows.withColumn("_x", array_to_vector(F.zip_with(F.col(vector), centre, lambda a, b: a.cast("double") - b)))
    model = PCA(k=dims, inputCol="_x", outputCol="_y").fit(data)
    pc = model.pc.toArray()
    signs = [1.0 if pc[np.abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(dims)]
    out = model.transform(data).withColumn("encoded", F.zip_with(vector_to_array("_y"), F.array(*map(F.lit, signs)), lambda a, s: a * s))
    return out.drop("_x", "_y")


def choose_blend(ranks: DataFrame) -> DataFrame:
    """The best row of (weight, top_1, recall_at_5, recall_at_10, mrr): not worse than weight 0 in the last three, then by top_1, mrr, recall, small weight."""
    base = F.broadcast(ranks.where("weight = 0").select(*[F.col(c).alias(f"_{c}") for c in ("recall_at_5", "recall_at_10", "mrr")]))  # one row
    fine = ranks.join(base, (F.col("recall_at_5") >= F.col("_recall_at_5") - 1e-12) & (F.col("recall_at_10") >= F.col("_recall_at_10") - 1e-12) & (F.col("mrr") >= F.col("_mrr") - 1e-12))
    return fine.select(ranks.columns).orderBy(F.desc("top_1"), F.desc("mrr"), F.desc("recall_at_5"), "weight").limit(1)


def _spread(x: np.ndarray, most: int, first: np.ndarray | None = None) -> list[int]:
    """Greedy k-centre: positions of rows, each the least similar to those before it, ties to the earlier row.

    first: which rows are chosen beforehand. Without any, the row least similar to the middle begins.
    """
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    chosen = [] if first is None else np.flatnonzero(first)[:most].tolist()
    if not chosen:
        middle = unit.mean(axis=0)
        chosen = [int(np.round(unit @ (middle / max(np.linalg.norm(middle), 1e-12)), 9).argmin())]
    near = np.round(unit @ unit[chosen].T, 9).max(axis=1)
    near[chosen] = np.inf
    while len(chosen) < min(most, len(x)):
        nxt = int(near.argmin())
        chosen.append(nxt)
        near = np.maximum(near, np.round(unit @ unit[nxt], 9))
        near[chosen] = np.inf
    return chosen


def _at_once(rows: DataFrame, most: int) -> DataFrame:
    """g, k, step of groups that fit one task each."""
    schema = pa.schema([("g", pa.int64()), ("k", pa.int64()), ("step", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        keys = group["k"].to_numpy(zero_copy_only=False)
        order = np.argsort(keys, kind="stable")
        chosen = order[_spread(matrix(group["v"].combine_chunks())[order], most, group["seed"].to_numpy()[order])]
        return pa.Table.from_arrays([group["g"].take(pa.array(chosen)), group["k"].take(pa.array(chosen)), pa.array(np.arange(1, len(chosen) + 1))], schema=schema)

    return rows.groupBy("g").applyInArrow(run, "g long, k long, step long")


def farthest_points(rows: DataFrame, group: str, key: str, vector: str, most: int, seed: str | None = None) -> DataFrame:
    """group, key, step of the rows chosen in each group: exact at every size.

    seed: a boolean column; its rows are chosen first, by key. Groups of up to ALONE rows are gone through in one task
    each, larger ones in `most` passes over their rows: each pass takes the row of the smallest nearest similarity as an
    aggregate. Null groups are one group.
    """
    known = F.coalesce(F.col(seed), F.lit(False)) if seed else F.lit(False)
    rows = rows.select(F.col(group).cast("long").alias("g"), F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), known.alias("seed")).where("v IS NOT NULL")
    large = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > ALONE).select(F.col("g").alias("_large"))
    if large.isEmpty():
        out = _at_once(rows, most)
    else:
        large = written(large)
        is_large = F.col("g").eqNullSafe(F.col("_large"))
        out = _at_once(rows.join(large, is_large, "left_anti"), most).unionByName(_by_steps(rows.join(large, is_large, "left_semi"), most))
    return out.select(F.col("g").alias(group), F.col("k").alias(key), "step")


def _by_steps(rows: DataFrame, most: int) -> DataFrame:
    """g, k, step of groups of any size. Rows keep their greatest similarity to what is chosen, and meet the newest one only."""
    rows = rows.withColumn("v", vectors.let(F.greatest(F.sqrt(_dot(F.col("v"), F.col("v"))), F.lit(1e-12)), lambda n: F.transform("v", lambda x: x / n)))
    rows = written(rows.withColumn("r", F.monotonically_increasing_id()))
    seeds = rows.where("seed").groupBy("g").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "r", "v"))), 1, most).alias("first"))
    middle = rows.groupBy("g").agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("v")))).alias("m"))
    length = F.greatest(F.sqrt(_dot(F.col("m"), F.col("m"))), F.lit(1e-12))
    begun = middle.withColumn("m", F.transform("m", lambda x: x / length)).join(seeds.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")), "left")
    none = F.array().cast("array<long>")
    seeded = F.col("first").isNotNull()
    seen = begun.select("g", F.when(seeded, F.col("first.v")).otherwise(F.array("m")).alias("new"), F.coalesce("first.r", none).alias("rs"), F.coalesce("first.k", none).alias("ks"), seeded.alias("kept"))
    near = rows.select("g", "k", "r", "v", F.lit(None).cast("double").alias("s"))
    for _ in range(most):
        seen = written(seen)  # one row a group
        if seen.where(F.size("ks") < most).isEmpty():
            break
        met = near.join(seen.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")))
        now = F.array_max(F.transform("new", lambda c: F.round(_dot(F.col("v"), c), 9)))
        near_kept = F.when(F.col("kept"), F.greatest("s", now)).alias("s")  # the middle only chooses the first
        met = written(met.select("g", "k", "r", "v", near_kept, F.greatest("s", now).alias("_now"), F.array_contains("rs", F.col("r")).alias("_had")))
        best = met.where("NOT _had").groupBy("g").agg(F.min(F.struct("_now", "k", "r", "v")).alias("n")).withColumnRenamed("g", "_g")
        had = seen.join(best, F.col("g").eqNullSafe(F.col("_g")), "left")
        more = F.col("n").isNotNull() & (F.size("ks") < most)
        grown = [F.when(more, F.concat(c, F.array(f"n.{c[0]}"))).otherwise(F.col(c)).alias(c) for c in ("rs", "ks")]
        seen = had.select("g", F.when(more, F.array("n.v")).otherwise(F.array().cast("array<array<double>>")).alias("new"), *grown, F.lit(True).alias("kept"))
        near = met.select("g", "k", "r", "v", "s")
    return seen.select("g", F.posexplode("ks").alias("step", "k")).select("g", "k", (F.col("step") + 1).cast("long").alias("step"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
