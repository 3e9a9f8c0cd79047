"""Expert reports: validation, judgments, record builders and training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import shape
from ridgeline.operators.intake import errors

# Fixed values of the report format.
VERSIONS, FEATURES = (2, 3), ("image_score", "curve_score", "peak_count_score", "location_score", "width_score", "area_score", "valley_score", "tail_score")
PRIVACY = {"query_image_included": False, "original_filename_included": False, "external_upload_performed": False, "normalized_shape_features_included": True}
MOST_JUDGMENTS, MOST_PANELS = 10, 30


def unit_score(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & c.between(0.0, 1.0), F.lit(False))


def report_errors(r: str = "report") -> Column:
    """What is wrong with a report struct, in order."""
    c = lambda n: F.col(f"{r}.{n}")
    judged = c("judgments")
    ids = F.transform(judged, lambda j: j["candidate_id"])
    scores = F.forall(judged, lambda j: F.forall(F.array(*[j[f] for f in FEATURES]), lambda v: v.isNotNull() & v.between(0.0, 1.0)))
    private = F.lit(True)
    for flag, wanted in PRIVACY.items():
        private = private & F.coalesce(c(f"privacy.{flag}") == wanted, F.lit(False))
    return errors(
        (~F.coalesce(c("schema_version").isin(*VERSIONS), F.lit(False)), "schema_version is not supported"),
        (~private, "privacy flags are wrong"),
        (F.coalesce(F.trim(c("query.id")), F.lit("")) == "", "query id is missing"),
        (~shape.is_profile(c("query.profile")), "profile is invalid"),
        (~F.coalesce(F.size(judged).between(1, MOST_JUDGMENTS), F.lit(False)), "there must be 1 to 10 judgments"),
        (F.size(F.array_distinct(ids)) != F.size(ids), "a candidate is judged twice"),
        (~F.coalesce(F.forall(judged, lambda j: j["relevance"].isin("similar", "dissimilar")), F.lit(False)), "relevance is unknown"),
        (~F.coalesce(scores, F.lit(False)), "a score is outside [0, 1]"),
    )


def ratings(reports: DataFrame, r: str = "report", order: str = "position") -> DataFrame:
    """One row per judgment: query, candidate, rater, label, created_at, arrived and the pair features."""
    c = lambda n: F.col(f"{r}.{n}")
    rows = reports.select(c("query.id").alias("query"), c("annotator.id").alias("rater"), c("created_at").alias("created_at"), F.col(order).alias("arrived"), F.explode(c("judgments")).alias("j"))
    return rows.select("query", F.col("j.candidate_id").alias("candidate"), "rater", (F.col("j.relevance") == "similar").cast("int").alias("label"), "created_at", "arrived", *[F.col(f"j.{f}").alias(f) for f in FEATURES])


def source_selection(panel: Column, panels: Column, series: Column, count: Column) -> Column:
    """Whether a selection of one series in one panel is possible; counts start at 1, positions at 0."""
    return F.coalesce(panels.between(1, MOST_PANELS) & panel.between(0, panels - 1) & (count >= 1) & series.between(0, count - 1), F.lit(False))


def positives(rows: DataFrame, sample: str, key: str, most: int) -> DataFrame:
    """Pairs of variants of a sample, each with the `most` next ones by key: linear in rows, unlike all pairs."""
    w = Window.partitionBy(sample).orderBy(key)
    following = [F.lead(key, i).over(w) for i in range(most + 1)]
    near = rows.withColumn("_following", F.array_compact(F.array(*following)))
    return near.select(F.col(key).alias("a"), sample, F.explode("_following").alias("b"))


def hard_negatives(scored: DataFrame, oracle: DataFrame, query: str, sample: str, score: str) -> DataFrame:
    """The best-scored row of each wrong sample of a query that isn't among its oracle neighbours."""
    wrong = scored.join(oracle.select(query, sample).distinct(), [query, sample], "left_anti")
    return wrong.groupBy(query, sample).agg(F.max(F.struct(F.col(score), F.col("id"))).alias("m")).select(query, sample, F.col("m.id").alias("id"), F.col(f"m.{score}").alias(score))


def balanced(rows: DataFrame, query: str, score: str, take: int) -> DataFrame:
    """The hardest row of every query, then the second ones, until `take` rows."""
    depth = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), "id"))
    return rows.withColumn("depth", depth).where(F.col("depth") <= take).orderBy("depth", query).limit(take)
