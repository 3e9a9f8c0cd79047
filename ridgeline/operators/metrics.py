"""Ranking, classification and agreement metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.storage import written

# Fixed values of the comparison of two models.
EVIDENCE = {"pairs": 20, "groups": 3, "agreement": 0.75}


def share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def ranking(rank: Column) -> list[Column]:
    """Aggregates over one row per query, rank null if nothing relevant was found; the MRR counts such as 0."""
    return [
        F.count("*").alias("queries"),
        F.round(share(rank <= 1), 6).alias("top_1"),
        F.round(share(rank <= 5), 6).alias("recall_at_5"),
        F.round(share(rank <= 10), 6).alias("recall_at_10"),
        F.round(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), 6).alias("mrr"),
        F.round(F.coalesce(F.avg(1.0 / rank), F.lit(0.0)), 6).alias("mrr_found"),
        F.count_if(rank.isNull()).alias("missing"),
    ]


def first_relevant(rows: DataFrame, relevant: Column) -> DataFrame:
    """query_id, query_grp, first_rank: the rank of the first relevant row, or null."""
    return rows.groupBy("query_id", "query_grp").agg(F.min(F.when(relevant, F.col("rank"))).alias("first_rank"))


def gains(rows: DataFrame, similarity: str) -> DataFrame:
    """gain: how far a similarity is above the query's lower quartile, squared."""
    floor = F.percentile(similarity, 0.25).over(Window.partitionBy("query_id"))
    x = (F.col(similarity) - floor) / F.greatest(1.0 - floor, F.lit(2.220446049250313e-16))
    return rows.withColumn("gain", F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 2))


def discounted(gain: Column, rank: Column, limit: int) -> Column:
    return F.sum(F.when(rank <= limit, (F.pow(F.lit(2.0), gain) - 1) / F.log2(rank + 1.0)).otherwise(0.0))


def ndcg(rows: DataFrame, **limits: int) -> DataFrame:
    """query_id and a column for each limit, by its name, from (query_id, rank, gain): over the best order of the same gains; 0 if that is 0."""
    ideal = Window.partitionBy("query_id").orderBy(F.desc("gain"))
    got, best = ([discounted(F.col("gain"), F.col(rank), limit).alias(f"_{rank}_{name}") for name, limit in limits.items()] for rank in ("rank", "ideal_rank"))
    both = rows.withColumn("ideal_rank", F.row_number().over(ideal)).groupBy("query_id").agg(*got, *best)
    return both.select("query_id", *[F.when(F.col(f"_ideal_rank_{n}") > 2.220446049250313e-16, F.col(f"_rank_{n}") / F.col(f"_ideal_rank_{n}")).otherwise(0.0).alias(n) for n in limits])


def auc(rows: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """The chance that a positive scores above a negative, ties half; null with one class only.

    Scores are counted first, so the running sums are over distinct scores and not over rows. Null scores take no part.
    """
    by = by or []
    # Distinct scores are dealt to ranges: sums within a range, then over ranges, so that no task sorts all scores.
    counted = rows.groupBy(*by, score).agg(F.sum(F.col(label).cast("double")).alias("_p"), F.sum(1.0 - F.col(label)).alias("_n")).where(F.col(score).isNotNull())
    placed = written(counted.repartitionByRange(score).withColumn("_part", F.spark_partition_id()))  # ranges stay as first dealt
    sums = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_in"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0.0))).drop("_in")
    below = Window.partitionBy(*by, "_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0.0)))
    same = [within[c].eqNullSafe(sums[c]) for c in by]
    condition = within["_part"] == sums["_part"]
    for c in same:
        condition = condition & c
    pairs = within.join(sums, condition).select(*[within[c] for c in by], "_p", "_n", (F.col("_p") * (F.col("_before") + F.col("_below") + F.col("_n") / 2)).alias("_wins"))
    return pairs.groupBy(*by).agg((F.sum("_wins") / F.nullif(F.sum("_p") * F.sum("_n"), F.lit(0.0))).alias("auc"))


def log_loss(label: Column, p: Column) -> Column:
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return F.avg(-(label * F.log(q) + (1 - label) * F.log(1 - q)))


def brier(label: Column, p: Column) -> Column:
    return F.avg(F.pow(p - label, 2))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def promotion(d: dict[str, Column], evidence: Column) -> Column:
    """Whether a candidate replaces the baseline, from the differences candidate - baseline. Limits are fixed values."""
    guard = F.coalesce(d["auc"] >= -0.01, F.lit(False)) & (d["accuracy"] >= -0.02) & (d["log_loss"] <= 0.02) & (d["macro_accuracy"] >= -0.02)
    better = F.coalesce(d["auc"] >= 0.005, F.lit(False)) | (d["log_loss"] <= -0.01) | (d["macro_accuracy"] >= 0.02)
    return F.when(~evidence, "insufficient-evidence").when(guard & better, "promote-candidate").otherwise("keep-baseline")
