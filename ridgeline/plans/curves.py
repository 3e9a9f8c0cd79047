"""Curves over `events`: histograms of values by event type, their log profiles, peaks, valleys and descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import shape, vectors
from ridgeline.sources import parquet

BINS, WIDTH, FLOOR = 64, 8.0, 1e-6


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, bin, n: empty bins too."""
    e = parquet(spark, sf_dir, "events")
    counts = e.groupBy("event_type", F.least(F.lit(BINS - 1), F.floor(F.col("value") / WIDTH)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    every = counts.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long"))).alias("bin"))
    return every.join(counts, ["event_type", "bin"], "left").select("event_type", "bin", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def profiles(spark, sf_dir) -> DataFrame:
    """event_type and its profile: the log of each bin's share of the largest, rounded so that both engines see one curve."""
    rows = histogram(spark, sf_dir).groupBy("event_type").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("h"))
    counts = F.transform("h", lambda b: b["n"])
    y = vectors.let(F.array_max(counts), lambda top: F.transform("h", lambda b: b["n"] / top))
    p = vectors.let(y, lambda bound: F.transform(vectors.log_profile(bound, 1e-4), lambda v: F.round(v, 6)))
    return rows.select("event_type", p.alias("p"))


def long(rows: DataFrame, column: str, name: str, digits: int = 6) -> DataFrame:
    return rows.select("event_type", F.posexplode(column).alias("bin", name)).select("event_type", F.col("bin").cast("long").alias("bin"), F.round(name, digits).alias(name))


def histogram_profile(spark, sf_dir):
    return histogram(spark, sf_dir)


def log_profile(spark, sf_dir):
    return long(profiles(spark, sf_dir), "p", "value")


def inverse_log_profile(spark, sf_dir):
    return long(profiles(spark, sf_dir).withColumn("x", F.transform("p", lambda v: F.pow(F.lit(10.0), -4 + v * 4))), "x", "value")


def profile_gradients(spark, sf_dir):
    return long(profiles(spark, sf_dir).withColumn("g", vectors.gradient(F.col("p"))), "g", "gradient")


def profile_moving_average(spark, sf_dir):
    return long(profiles(spark, sf_dir).withColumn("m", vectors.moving_average(F.col("p"), 2)), "m", "smooth")


def profile_resample(spark, sf_dir):
    return long(profiles(spark, sf_dir).withColumn("r", vectors.resample(F.col("p"), 128)), "r", "value")


def _peaks(spark, sf_dir) -> DataFrame:
    by = Window.partitionBy("event_type").orderBy("bin")
    near = lambda a, b: F.max("value").over(by.rowsBetween(a, b))
    return log_profile(spark, sf_dir).withColumns({"before": near(-2, -1), "after": near(1, 2)}).where((F.col("value") > F.col("before")) & (F.col("value") >= F.col("after"))).select("event_type", "bin", "value")


def local_peaks(spark, sf_dir):
    return _peaks(spark, sf_dir)


def valley_between_peaks(spark, sf_dir):
    tops = _peaks(spark, sf_dir).withColumn("to", F.lead("bin").over(Window.partitionBy("event_type").orderBy("bin"))).where("to IS NOT NULL").select("event_type", F.col("bin").alias("left_peak"), F.col("to").alias("right_peak"))
    inside = tops.join(log_profile(spark, sf_dir), "event_type").where(F.col("bin").between(F.col("left_peak"), F.col("right_peak")))
    return inside.groupBy("event_type", "left_peak", "right_peak").agg(F.min_by("bin", F.struct("value", "bin")).alias("valley"), F.min("value").alias("depth_value"))


def descriptor_scalars(spark, sf_dir):
    p = F.col("p")
    return profiles(spark, sf_dir).select("event_type", F.round(vectors.area(p), 6).alias("area"), F.round(vectors.centre_of_mass(p), 6).alias("center_of_mass"), F.round(vectors.roughness(p), 6).alias("roughness"))


def floor_quantiles(spark, sf_dir):
    return profiles(spark, sf_dir).select("event_type", *[F.round(vectors.floor_quantile(F.col("p"), f), 6).alias(f"q{int(100 * f)}") for f in (0.08, 0.5, 0.92)])


def sequence_distance(spark, sf_dir):
    """Between the positions of the peaks of every two event types; the types are few."""
    tops = _peaks(spark, sf_dir).groupBy("event_type").agg(F.sort_array(F.collect_list(F.col("bin") / (BINS - 1))).alias("x"))
    a, b = tops.select(F.col("event_type").alias("left_type"), F.col("x").alias("a")), tops.select(F.col("event_type").alias("right_type"), F.col("x").alias("b"))
    return a.join(b, F.col("left_type") < F.col("right_type")).select("left_type", "right_type", F.round(vectors.sequence_distance(F.col("a"), F.col("b")), 6).alias("distance"))


def _owned(spark, sf_dir) -> DataFrame:
    rows = histogram(spark, sf_dir)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("n"), "event_type")))


def dominant_state_overlap(spark, sf_dir):
    """Each bin belongs to the type with most rows in it, ties to the first name; the others keep nothing there."""
    return _owned(spark, sf_dir).select("event_type", "bin", F.when(F.col("place") == 1, F.col("n")).otherwise(0).cast("long").alias("kept"))


def overlap_mass(spark, sf_dir):
    return _owned(spark, sf_dir).agg(F.round((F.sum("n") - F.sum(F.when(F.col("place") == 1, F.col("n")))) / F.sum("n"), 6).alias("overlap"))


def composite_curve(spark, sf_dir):
    return histogram(spark, sf_dir).groupBy("bin").agg(F.max("n").alias("n"))


def regularize_state_count(spark, sf_dir):
    s = parquet(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 18).alias("observed"), (F.col("p_partkey") % 18).alias("found"))
    return s.select("p_partkey", "observed", "found", shape.regular_states_column(F.col("observed"), F.col("found")).cast("long").alias("states"))


def curve_descriptor(spark, sf_dir):
    p = profiles(spark, sf_dir).withColumn("p", vectors.resample(F.col("p"), shape.POINTS))
    return shape.describe(p, "p")


def shape_embeddings(spark, sf_dir):
    p = profiles(spark, sf_dir).withColumn("p", vectors.resample(F.col("p"), shape.POINTS)).where(shape.is_profile(F.col("p")))
    return p.select("event_type", shape.curve_embedding_column(F.col("p")).alias("curve"), shape.image_embedding_column(F.col("p")).alias("image"), shape.fused_embedding_column(F.col("p")).alias("fused"))


QUERIES = {f.__name__: f for f in (
    histogram_profile, log_profile, inverse_log_profile, profile_gradients, profile_moving_average, profile_resample, local_peaks, valley_between_peaks, descriptor_scalars, floor_quantiles,
    sequence_distance, dominant_state_overlap, overlap_mass, composite_curve, regularize_state_count, curve_descriptor, shape_embeddings,
)}

_H = f"WITH c AS (SELECT event_type, CAST(least({BINS - 1}, floor(value / {WIDTH})) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY ALL), h AS (SELECT t.event_type, b.bin, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT event_type FROM c) t CROSS JOIN (SELECT range AS bin FROM range({BINS})) b LEFT JOIN c ON c.event_type = t.event_type AND c.bin = b.bin)"
_P = f"{_H}, y AS (SELECT event_type, bin, CAST(n AS DOUBLE) / max(n) OVER (PARTITION BY event_type) AS y FROM h), p AS (SELECT event_type, bin, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (log10(greatest(y, 1e-4::DOUBLE)) + 4) / (log10(greatest(max(y) OVER (PARTITION BY event_type), 1e-3::DOUBLE)) + 4))), 6) AS value FROM y)"
_T = f"{_P}, k AS (SELECT *, max(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before, max(value) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS after FROM p WINDOW w AS (PARTITION BY event_type ORDER BY bin)), t AS (SELECT event_type, bin, value FROM k WHERE value > before AND value >= after)"
_O = f"{_H}, o AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY n DESC, event_type) AS place FROM h)"
_W = "WINDOW w AS (PARTITION BY event_type ORDER BY bin)"

ORACLE_SQL = {
    "histogram_profile": f"{_H} SELECT event_type, bin, n FROM h",
    "log_profile": f"{_P} SELECT event_type, bin, value FROM p",
    "inverse_log_profile": f"{_P} SELECT event_type, bin, round(pow(10.0::DOUBLE, -4 + value * 4), 6) AS value FROM p",
    "profile_gradients": f"{_P} SELECT event_type, bin, round(CASE WHEN bin = 0 THEN lead(value) OVER w - value WHEN bin = {BINS - 1} THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END, 6) AS gradient FROM p {_W}",
    "profile_moving_average": f"{_P} SELECT a.event_type, a.bin, round(sum(b.value * (3 - abs(a.bin - b.bin))) / sum(3 - abs(a.bin - b.bin)), 6) AS smooth FROM p a JOIN p b ON a.event_type = b.event_type AND b.bin BETWEEN a.bin - 2 AND a.bin + 2 GROUP BY ALL",
    "profile_resample": f"{_P}, r AS (SELECT range AS bin, range * 63.0::DOUBLE / 127 AS x FROM range(128)) SELECT p.event_type, r.bin, round(p.value + (q.value - p.value) * (r.x - p.bin), 6) AS value FROM r JOIN p ON p.bin = least({BINS - 1}, CAST(floor(r.x) AS BIGINT)) JOIN p q ON q.event_type = p.event_type AND q.bin = least({BINS - 1}, p.bin + 1)",
    "local_peaks": f"{_T} SELECT event_type, bin, value FROM t",
    "valley_between_peaks": f"{_T}, g AS (SELECT event_type, bin AS left_peak, lead(bin) OVER (PARTITION BY event_type ORDER BY bin) AS right_peak FROM t) SELECT g.event_type, left_peak, right_peak, arg_min(p.bin, (p.value, p.bin)) AS valley, min(p.value) AS depth_value FROM g JOIN p ON p.event_type = g.event_type AND p.bin BETWEEN left_peak AND right_peak WHERE right_peak IS NOT NULL GROUP BY ALL",
    "descriptor_scalars": f"{_P}, d AS (SELECT *, value - lag(value) OVER w AS step FROM p {_W}) SELECT event_type, round((sum(value) - (sum(CASE WHEN bin IN (0, {BINS - 1}) THEN value END)) / 2) / {BINS - 1}, 6) AS area, round(sum(value * bin / {BINS - 1}) / sum(value), 6) AS center_of_mass, round(sum(abs(step)) / {BINS - 1}, 6) AS roughness FROM d GROUP BY event_type",
    "floor_quantiles": f"{_P}, s AS (SELECT event_type, list_sort(list(value)) AS v FROM p GROUP BY event_type) SELECT event_type, round(v[least(64, CAST(floor(64 * 0.08) AS INT) + 1)], 6) AS q8, round(v[33], 6) AS q50, round(v[least(64, CAST(floor(64 * 0.92) AS INT) + 1)], 6) AS q92 FROM s",
    "sequence_distance": f"{_T}, x AS (SELECT event_type, list_sort(list(CAST(bin AS DOUBLE) / {BINS - 1})) AS x FROM t GROUP BY event_type), j AS (SELECT a.event_type AS left_type, b.event_type AS right_type, a.x AS a, b.x AS b, greatest(len(a.x), len(b.x)) AS n FROM x a JOIN x b ON a.event_type < b.event_type), i AS (SELECT *, unnest(range(n)) AS i FROM j), q AS (SELECT *, CASE WHEN n > 1 THEN CAST(i AS DOUBLE) * (len(a) - 1) / (n - 1) ELSE 0.0 END AS pa, CASE WHEN n > 1 THEN CAST(i AS DOUBLE) * (len(b) - 1) / (n - 1) ELSE 0.0 END AS pb FROM i), l AS (SELECT *, CAST(floor(pa) AS INT) AS la, CAST(floor(pb) AS INT) AS lb FROM q) SELECT left_type, right_type, round(avg(abs((a[la + 1] + (a[least(la + 2, len(a))] - a[la + 1]) * (pa - la)) - (b[lb + 1] + (b[least(lb + 2, len(b))] - b[lb + 1]) * (pb - lb)))), 6) AS distance FROM l GROUP BY ALL",
    "dominant_state_overlap": f"{_O} SELECT event_type, bin, CASE WHEN place = 1 THEN n ELSE 0 END AS kept FROM o",
    "overlap_mass": f"{_O} SELECT round((sum(n) - sum(n) FILTER (place = 1)) / sum(n), 6) AS overlap FROM o",
    "composite_curve": f"{_H} SELECT bin, max(n) AS n FROM h GROUP BY bin",
    "regularize_state_count": "WITH s AS (SELECT p_partkey, p_size % 18 AS observed, p_partkey % 18 AS found FROM part) SELECT p_partkey, observed, found, CAST(CASE WHEN observed < 2 THEN observed WHEN observed = 3 AND found BETWEEN 5 AND 7 THEN 4 WHEN observed = 7 AND found = 15 THEN 8 WHEN found >= 15 THEN 16 WHEN observed <= 3 THEN 2 WHEN observed <= 6 THEN 4 WHEN observed <= 12 THEN 8 ELSE 16 END AS BIGINT) AS states FROM s",
}
