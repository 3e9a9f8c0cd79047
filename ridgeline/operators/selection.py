"""Choosing rows: files for a batch, pools of candidates, hypotheses, states, representatives, and the checks before it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import vectors
from ridgeline.operators.tables import numbered

# Fixed values of formats, limits and priors.
IMAGE_TYPES, IMAGE_NAME = ("image/png", "image/jpeg", "image/webp"), r"(?i)\.(png|jpe?g|webp)$"
MOST_BYTES = 12 * 1024 * 1024
SIGNATURES = {"image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF"}
TOKEN = r"^[A-Za-z0-9_-]{32,128}$"
STATE_PRIOR, MOST_STATES, LEAST_RANGE = 0.03, 20, 0.035
REASONS = ("no_foreground", "table", "ambiguous", "low_resolution", "rejected", "no_waveform")


def is_image_file(name: Column, mime: Column) -> Column:
    """By its type or, without a known one, by its name."""
    return F.coalesce(mime.isin(*IMAGE_TYPES), F.lit(False)) | F.coalesce(name.rlike(IMAGE_NAME), F.lit(False))


def batch_files(files: DataFrame, name: str, mime: str, size: str, order: str, most: int) -> DataFrame:
    """files with `fate`: accepted, unsupported, oversized (or empty), or over_limit behind the first `most` good ones."""
    fate = F.when(~is_image_file(F.col(name), F.col(mime)), "unsupported").when(~F.coalesce((F.col(size) > 0) & (F.col(size) <= MOST_BYTES), F.lit(False)), "oversized")
    judged = files.withColumn("fate", fate)
    good = judged.where("fate IS NULL").orderBy(order).limit(most).select(F.col(order).alias("_accepted"))
    out = judged.join(good, F.col(order) == F.col("_accepted"), "left")
    return out.withColumn("fate", F.coalesce("fate", F.when(F.col("_accepted").isNotNull(), "accepted").otherwise("over_limit"))).drop("_accepted")


def candidate_counts(k: Column, total: Column) -> dict[str, Column]:
    """How many candidates a search for k takes, keeps apart, and may expand to."""
    c = F.least(F.greatest(F.lit(80), 4 * k), total)
    return {"candidates": c, "unique_cap": F.greatest(3 * k, k), "expansion": F.least(total, F.greatest(2 * c, 16 * k, F.lit(160)))}


def top_k_argument(text: Column) -> Column:
    """1 to 10 as written, 8 if blank; null if it is anything else."""
    n = F.when(text.rlike(r"^\s*[0-9]{1,2}\s*$"), F.trim(text).cast("int"))
    return F.when(text.isNull() | (F.trim(text) == ""), 8).when(n.between(1, 10), n)


def best_hypotheses(pairs: DataFrame, query: str, candidate: str, left: str, right: str) -> DataFrame:
    """query, candidate, left_at, right_at, score of the best pair of their alternatives (arrays of vectors); of equal ones the first by left, then right."""
    every = pairs.select(query, candidate, F.posexplode(left).alias("left_at", "_l"), right).select(query, candidate, "left_at", "_l", F.posexplode(right).alias("right_at", "_r"))
    scored = every.select(query, candidate, "left_at", "right_at", F.round(vectors.cosine(F.col("_l"), F.col("_r")), 9).alias("score"))
    best = scored.groupBy(query, candidate).agg(F.min(F.struct((-F.col("score")).alias("s"), "left_at", "right_at")).alias("m"))
    return best.select(query, candidate, F.col("m.left_at").alias("left_at"), F.col("m.right_at").alias("right_at"), (-F.col("m.s")).alias("score"))


def compatible(a: Column, b: Column) -> Column:
    """Product groups differ only where both are given."""
    x, y = F.coalesce(F.trim(a), F.lit("")), F.coalesce(F.trim(b), F.lit(""))
    return (x == "") | (y == "") | (x == y)


def graded_negatives(rows: DataFrame, oracle: DataFrame) -> DataFrame:
    """Rows (query_id, query_grp, id, grp) of the query's own state, other than itself, that aren't among its oracle neighbours."""
    near = oracle.select("query_id", "id").distinct()
    return rows.where((F.col("query_id") != F.col("id")) & (F.col("grp") == F.col("query_grp"))).join(near, ["query_id", "id"], "left_anti")


def mean_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """group, mean: the mean vector of each group, by partial sums of whole vectors."""
    dense = rows.where(F.col(vector).isNotNull()).select(group, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    return dense.groupBy(group).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("mean"))


def prototypes(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """group, at, value: the mean vector of each group, of length 1 unless it is next to nothing."""
    unit = vectors.let(vectors.norm(F.col("mean")), lambda n: F.transform("mean", lambda m: F.when(n > vectors.EPS32, m / n).otherwise(m)))
    out = mean_vectors(rows, group, vector).select(group, F.posexplode(unit).alias("at", "value"))
    return out.select(group, F.col("at").cast("long").alias("at"), "value")


def best_state(rows: DataFrame) -> DataFrame:
    """query_id, state, score: the state of the best score, where the query's own state counts STATE_PRIOR more; of equal ones the smaller state."""
    prior = F.when(F.col("grp") == F.col("query_grp"), STATE_PRIOR).otherwise(0.0)
    states = rows.groupBy("query_id", F.col("grp").alias("state")).agg(F.round(F.max(F.col("score") + prior), 9).alias("score"))
    best = states.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "state")).alias("m"))
    return best.select("query_id", F.col("m.state").alias("state"), (-F.col("m.s")).alias("score"))


def weighted_union(sets: list[tuple[DataFrame, float]]) -> DataFrame:
    """The rows of all sets with the weight of each."""
    out = None
    for rows, weight in sets:
        rows = rows.withColumn("weight", F.lit(float(weight)))
        out = rows if out is None else out.unionByName(rows)
    return out


def text_page(rows: DataFrame, text: str, wanted: str, order: list[str], offset: int, size: int) -> DataFrame:
    """A slice of the rows whose text holds the wanted one, whatever the case; a blank one matches all."""
    found = rows if not wanted.strip() else rows.where(F.contains(F.lower(text), F.lit(wanted.strip().lower())))
    return found.orderBy(*order).offset(offset).limit(size)


def one_of(rows: DataFrame, group: str, key: str, previous: str, r: float) -> DataFrame:
    """The row at floor(r n) of each group by key, the previous one left out where there are others."""
    n = rows.groupBy(group).agg(F.count("*").alias("_n")).withColumnRenamed(group, "_group")
    known = rows.join(n, F.col(group).eqNullSafe(F.col("_group")))
    left = known.where((F.col("_n") == 1) | (F.col(key) != F.col(previous)) | F.col(previous).isNull()).select(*rows.columns)
    placed = numbered(left, [group], [key], "_at")
    return placed.where(F.col("_at") - 1 == F.least(F.floor(F.lit(r) * F.col("_at_of")), F.col("_at_of") - 1)).drop("_at", "_at_of")


def normalised(profile: Column) -> Column:
    """From 0 to 1; null if it hardly moves."""
    low, high = F.array_min(profile), F.array_max(profile)
    return F.when(high - low >= LEAST_RANGE, F.transform(profile, lambda v: (v - low) / (high - low)))


def variation(value: str) -> Column:
    """The standard deviation over the mean; 0 if that is 0."""
    return F.coalesce(F.stddev_pop(value) / F.nullif(F.abs(F.avg(value)), F.lit(0.0)), F.lit(0.0))


def data_url(url: Column) -> tuple[Column, Column]:
    """Content type and bytes of a base64 data URL; null for anything else."""
    shape = r"^data:([a-z0-9.+-]+/[a-z0-9.+-]+)(;[a-z0-9=-]+)*;base64,([A-Za-z0-9+/]*={0,2})$"
    fits = url.rlike(shape)
    return F.when(fits, F.regexp_extract(url, shape, 1)), F.when(fits, F.unbase64(F.regexp_extract(url, shape, 3)))


def content_type(header: Column) -> Column:
    return F.lower(F.trim(F.split_part(header, F.lit(";"), F.lit(1))))


def sniffed(raw: Column) -> Column:
    """The image type that the first bytes say, or null."""
    first = F.hex(F.substring(raw, 1, 12))
    out = F.when((F.substring(first, 1, 8) == "52494646") & (F.substring(first, 17, 8) == "57454250"), "image/webp")
    for kind, mark in SIGNATURES.items():
        out = out.when(first.startswith(mark), kind)
    return out


def png_size(raw: Column) -> tuple[Column, Column]:
    """Width and height as a PNG's header has them; null for anything else."""
    number = lambda at: F.when((sniffed(raw) == "image/png") & (F.octet_length(raw) >= 24), F.conv(F.hex(F.substring(raw, at, 4)), 16, 10).cast("long"))
    return number(17), number(21)


def diagnosis(found: dict[str, Column]) -> Column:
    """The first reason that holds; null if none does."""
    out = F.when(F.coalesce(found[REASONS[0]], F.lit(False)), REASONS[0])
    for reason in REASONS[1:]:
        out = out.when(F.coalesce(found[reason], F.lit(False)), reason)
    return out


def descriptor_errors(states: Column, peaks: Column, valleys: Column, depths: Column) -> Column:
    """What is wrong with positions on the axis: counts, order, valleys between their peaks, ranges."""
    inside = lambda a: F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0.0, 1.0))
    ordered = F.forall(F.sequence(F.lit(1), F.greatest(F.size(peaks) - 1, F.lit(1))), lambda i: (i >= F.size(peaks)) | (F.get(peaks, i - 1) < F.get(peaks, i)))
    between = F.forall(F.sequence(F.lit(0), F.greatest(F.size(valleys) - 1, F.lit(0))), lambda i: (i >= F.size(valleys)) | ((F.get(valleys, i) >= F.get(peaks, i)) & (F.get(valleys, i) <= F.get(peaks, i + 1))))
    rules = (
        (~F.coalesce(states.between(1, MOST_STATES), F.lit(False)), "state count is outside 1 to 20"),
        (F.size(peaks) != states, "peaks don't match the state count"),
        (~inside(peaks), "a peak is outside the axis"),
        (~F.coalesce(ordered, F.lit(False)), "peaks aren't in order"),
        (F.size(valleys) != F.greatest(F.size(peaks) - 1, F.lit(0)), "there must be a valley between any two peaks"),
        (~F.coalesce(between, F.lit(False)), "a valley isn't between its peaks"),
        (~inside(depths), "a depth is outside [0, 1]"),
    )
    return F.array_compact(F.array(*[F.when(broken, message) for broken, message in rules]))


def promoted(pending: DataFrame, ready: DataFrame, key: str, checked: Column) -> DataFrame:
    """Pending rows that passed their check become ready, once; others wait. Rows that are ready already stay as they are."""
    have = ready.select(F.col(key).alias("_ready")).distinct()
    waiting = pending.join(have, F.col(key) == F.col("_ready"), "left_anti")
    return ready.withColumn("status", F.lit("ready")).unionByName(waiting.withColumn("status", F.when(F.coalesce(checked, F.lit(False)), "ready").otherwise("pending")))


def smoothing(n: int, window: int = 9, order: int = 2) -> np.ndarray:
    """The matrix that fits a polynomial to each value's neighbours and takes its value there; near the ends, that of the first or last window."""
    window = min(window, n if n % 2 else n - 1)
    if window <= order:
        return np.eye(n)
    x = np.vander(np.arange(window) - window // 2, order + 1).astype(float)
    fit = x @ np.linalg.pinv(x)
    out = np.zeros((n, n))
    for i in range(n):
        at = min(max(i - window // 2, 0), n - window)
        out[i, at : at + window] = fit[i - at]
    return out


def smooth(df: DataFrame, profile: str, n: int) -> DataFrame:
    """df with `smooth`: the profile of n points smoothed, cut at 0 and scaled to a maximum of 1. A profile of another length or with nulls: null."""
    matrix = smoothing(n)
    place = df.columns.index(profile)

    def run(batches):
        for batch in batches:
            column = batch.column(place)
            size = column.value_lengths().to_numpy(zero_copy_only=False)
            fits = np.flatnonzero(np.nan_to_num(size, nan=-1) == n)
            values = column.take(pa.array(fits)).flatten()
            y = values.to_numpy(zero_copy_only=False).astype(float).reshape(len(fits), n)
            whole = ~values.is_null().to_numpy(zero_copy_only=False).reshape(len(fits), n).any(axis=1)
            y = np.clip(y[whole] @ matrix.T, 0, None)
            top = y.max(axis=1, initial=0.0, keepdims=True)
            found = dict(zip(fits[whole].tolist(), (y / np.where(top > 0, top, 1.0)).tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([found.get(i) for i in range(batch.num_rows)], pa.list_(pa.float64()))], names=[*batch.schema.names, "smooth"])

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("array<double>").alias("smooth")).schema)
