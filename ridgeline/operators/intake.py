"""Validation of text manifests and source registries: typed rows, error lists, summaries and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import text

# Fixed values.
SUFFIXES, LOG_SCALES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"), ("log", "log10")
STATUSES = ("calibration", "stress-only", "rejected", "pending")


def errors(*rules: tuple[Column, str]) -> Column:
    """The messages of all rules that are broken, in order; a rule that is null isn't."""
    return F.array_compact(F.array(*[F.when(broken, message) for broken, message in rules]))


def repeated(key: str, position: str) -> Column:
    """Whether an earlier row has the same key; null keys never repeat."""
    apart = F.when(F.col(key).isNull(), F.col(position))  # so that they don't meet in one task
    return F.col(key).isNotNull() & (F.row_number().over(Window.partitionBy(key, apart).orderBy(position)) > 1)


def manifest(rows: DataFrame, position: str = "position") -> DataFrame:
    """Typed rows of (position, image_path, image_id, state_count, observed_state_count, y_scale, is_measured) with errors.

    row_number is the line in the file, headed by one. A missing id is made from the position; of rows with the same id
    or path the later ones are in error. A partial view may show fewer states than there are, never more.
    """
    raw = {c: text.blank_to_null(F.col(c)) for c in ("image_path", "image_id", "state_count", "observed_state_count", "y_scale", "is_measured")}
    typed = rows.select(
        position,
        (F.col(position) + 2).alias("row_number"),
        raw["image_path"].alias("image_path"),
        F.coalesce(raw["image_id"], F.format_string("image-%04d", F.col(position) + 1)).alias("image_id"),
        raw["state_count"].alias("_states"),
        raw["observed_state_count"].alias("_observed"),
        text.positive_int(raw["state_count"]).alias("state_count"),
        text.positive_int(raw["observed_state_count"]).alias("_seen"),
        F.when(F.lower(raw["y_scale"]).isin(*LOG_SCALES), "log10").otherwise(F.lower(raw["y_scale"])).alias("y_scale"),
        raw["is_measured"].alias("_measured"),
        text.truth(raw["is_measured"]).alias("is_measured"),
    )
    typed = typed.withColumn("observed_state_count", F.when(F.col("_observed").isNull(), F.col("state_count")).otherwise(F.col("_seen")))
    coverage = F.when(F.col("_observed").isNull() & F.col("state_count").isNotNull(), "full").when(F.col("state_count") == F.col("_seen"), "full").when(F.col("state_count") != F.col("_seen"), "partial").otherwise("unknown")
    out = typed.withColumn("coverage", coverage).withColumn("_again", repeated("image_id", position)).withColumn("_path_again", repeated("image_path", position))
    wrong = errors(
        (F.col("image_path").isNull(), "image_path is required"),
        (~F.lower(F.substring_index("image_path", ".", -1)).isin(*SUFFIXES), "image_path has an unsupported suffix"),
        (F.col("_path_again"), "image_path repeats an earlier row"),
        (F.col("_again"), "image_id repeats an earlier row"),
        (F.col("_states").isNotNull() & F.col("state_count").isNull(), "state_count must be a positive integer"),
        (F.col("_observed").isNotNull() & F.col("_seen").isNull(), "observed_state_count must be a positive integer"),
        (F.col("_seen") > F.col("state_count"), "observed_state_count exceeds state_count"),
        (F.col("y_scale").isNotNull() & (F.col("y_scale") != "log10"), "y_scale must be log10"),
        (F.col("_measured").isNotNull() & F.col("is_measured").isNull(), "is_measured must be a truth value"),
    )
    out = out.withColumn("errors", wrong).withColumn("valid", F.size("errors") == 0)
    return out.drop("_states", "_observed", "_seen", "_measured", "_again", "_path_again")


def manifest_summary(checked: DataFrame, group: str) -> DataFrame:
    """Counts over valid rows and groups, and the gates that depend on them."""
    by = checked.groupBy(group).agg(F.count_if("valid").alias("n"), F.count("*").alias("rows"), F.sum(F.size("errors")).alias("e"))
    n = F.col("n")
    out = by.agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("valid_rows"), F.sum("e").alias("errors"), F.count_if(n > 0).alias("groups"),
        F.count_if(n >= 2).alias("evaluable_groups"), F.count_if(n == 1).alias("singleton_groups"), F.sum(n * (n - 1)).alias("positive_pairs"),
    )
    return out.withColumn("ready", (F.col("errors") == 0) & (F.col("evaluable_groups") >= 3))


def orphans(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows whose parent isn't a key of the table."""
    known = rows.select(F.col(key).alias("_known")).distinct()
    return rows.where(F.col(parent).isNotNull()).join(known, F.col(parent) == F.col("_known"), "left_anti")


def counts_with_zeros(rows: DataFrame, status: str, statuses: tuple[str, ...]) -> DataFrame:
    every = rows.sparkSession.createDataFrame([(s,) for s in statuses], f"{status} string")
    return every.join(rows.groupBy(status).agg(F.count("*").alias("n")), status, "left").select(status, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
