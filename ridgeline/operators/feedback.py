"""Ratings of several raters: the latest of each, consensus and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import runs
from ridgeline.operators.tables import latest  # noqa: F401


def encounters(rows: DataFrame, key: list[str], created: str, arrived: str, label: str) -> DataFrame:
    """duplicates, conflicts: rows that met one retained before, and those of them with another label than it.

    Rows arrive in the order of `arrived`, a key; the retained row is that of the largest (created, arrived) so far.
    """
    known = rows.select(*key, arrived, F.col(label).alias("mine"), F.struct(created, arrived, label).alias("_row"))
    met = runs.running(known, key, [arrived], "_row", "max", "_kept").select(F.col(f"_kept.{label}").alias("kept"), "mine")
    return met.agg(F.count("kept").alias("duplicates"), F.count_if(F.col("kept") != F.col("mine")).alias("conflicts"))


def consensus(rows: DataFrame, pair: list[str], rater: str, label: str, features: list[str] | None = None) -> DataFrame:
    """One row per pair: positives, negatives, raters, agreement, the majority label (null on a tie) and feature means."""
    p, n = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    means = [F.avg(f).alias(f"mean_{f}") for f in features or []]
    out = rows.groupBy(*pair).agg(p.alias("positives"), n.alias("negatives"), F.count_distinct(rater).alias("raters"), *means)
    majority = F.when(F.col("positives") > F.col("negatives"), 1).when(F.col("positives") < F.col("negatives"), 0)
    return out.withColumn("label", majority).withColumn("agreement", F.greatest("positives", "negatives") / (F.col("positives") + F.col("negatives")))


def pairs_of(n: Column) -> Column:
    return n * (n - 1) / 2


def agreement(pairs: DataFrame) -> DataFrame:
    """Rater pairs that agree over all rater pairs; null without any."""
    p, n = F.col("positives"), F.col("negatives")
    return pairs.agg((F.sum(pairs_of(p) + pairs_of(n)) / F.nullif(F.sum(pairs_of(p + n)), F.lit(0.0))).alias("agreement"))


def classes(pairs: DataFrame) -> DataFrame:
    p, n = F.col("positives"), F.col("negatives")
    many = p + n >= 2
    return pairs.agg(
        F.count("*").alias("pairs"),
        F.count_if(many).alias("multi"),
        F.count_if(many & ((p == 0) | (n == 0))).alias("unanimous"),
        F.count_if(many & (p > 0) & (n > 0)).alias("conflict"),
        F.count_if((p > 0) & (n > 0) & (p != n)).alias("majority"),
        F.count_if(p == n).alias("tie"),
    )
