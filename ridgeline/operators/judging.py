"""Evaluation of real images, one left out at a time, and the checks of shared candidates and their cursors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import vectors
from ridgeline.operators import nearest, places, quotas
from ridgeline.operators.intake import errors
from ridgeline.storage import written

# Tokens, ids, state counts, ranges and formats of a shared candidate and of a page cursor.
TOKEN, CANDIDATE_ID = r"^[A-Za-z0-9_-]{32,128}$", r"^shared-[A-Za-z0-9-]{1,96}$"
STATES, MOST_VALUE, LEAST_RANGE, POINTS, MOST_STATES = (2, 4, 8, 16), 1.5, 0.05, 256, 20
CURSOR, CREATED = r"^[a-zA-Z0-9_-]{8,256}$", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the codes that rows begin with are the same, or one is blank (0)."""
    g, h = a[:, 0][:, None], b[:, 0][None, :]
    return (g == h) | (g == 0) | (h == 0)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(np.einsum("ij,ij->i", vectors.units(a[:, 1:]), vectors.units(b[:, 1:])), -1.0, 1.0)


#: The cosine of everything after a code, of rows that fit.
FITTING = nearest.Kernel(
    lambda a, b: np.where(_fits(a, b), vectors.cosines(a[:, 1:], b[:, 1:]), -np.inf), left=lambda a: [vectors.units(a[:, 1:])], right=lambda b: [vectors.units(b[:, 1:])], pairs=_paired, fits=_fits
)


def _code(c: str) -> Column:
    """A number below 2^53 for a name, 0 for a blank one."""
    name = F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    return F.when(name == "", 0.0).otherwise((F.pmod(F.xxhash64(name), F.lit((1 << 52) - 1)) + 1).cast("double"))


def leave_one_out(rows: DataFrame) -> DataFrame:
    """id, candidates, relevant, first_rank and hits at 5 and at 10 of every row against all others.

    rows: (id, product, similar, v). Rows of different products aren't candidates of each other unless one has none; those
    of the same `similar`, if it isn't blank, are relevant. Candidates and relevant ones are counted by group. The ten best
    relevant ones come from a search within each `similar`; the rank of the first is how many stand before it, and the
    tenth is a floor of the ten best. No row's full ranking is made.
    """
    code = lambda c: _code(c).cast("long")
    coded = rows.where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), code("product").alias("code"), code("similar").alias("name"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    coded = written(coded)
    counts = quotas.compatible_counts(rows.select("id", "product", "similar"), "id", "product", "similar")
    named = coded.select("id", F.nullif("name", F.lit(0)).alias("grp"), F.concat(F.array(F.col("code").cast("double")), "v").alias("v"))
    rank = F.col("rank")
    first = nearest.topk(named, named, 10, FITTING, same_group=True).groupBy(F.col("query_id").alias("_id")).agg(
        F.max(F.when(rank == 1, F.col("score"))).alias("mark"), F.max(F.when(rank == 1, F.col("id"))).alias("mark_id"), F.max(F.when(rank == 10, F.col("score"))).alias("floor")
    )
    placed = places.places(coded, coded.join(first, F.col("id") == F.col("_id"), "left").drop("_id"), 10)
    hits = lambda k: F.greatest(F.size(F.filter(F.slice("best", 1, k), lambda x: x["good"])), F.lit(0)).cast("long").alias(f"at_{k}")
    out = counts.join(placed, F.col("id") == F.col("query_id"), "left")
    return out.select("id", "candidates", F.col("relevant_candidates").alias("relevant"), (F.col("above") + 1).alias("first_rank"), *(hits(k) for k in (5, 10)))


def share(hit: Column, of: Column) -> Column:
    """How many of those for which `of` holds have `hit` too; null if it holds for none."""
    return F.count_if(of & hit) / F.nullif(F.count_if(of), F.lit(0))


def real_metrics(judged: DataFrame) -> DataFrame:
    """One row of metrics, null where nothing is to be measured.

    judged: a row an image, with processed, states, expected, observed, expected_observed, coverage, source,
    independence, and relevant, first_rank, at_5, at_10 of `leave_one_out`.
    """
    done = F.col("processed")
    labelled, seen = done & F.col("expected").isNotNull(), done & F.col("expected_observed").isNotNull()
    partial = done & (F.col("coverage") == "partial")
    asked = done & (F.col("relevant") > 0)
    mean = lambda c: F.avg(F.when(asked, c))
    return judged.agg(
        F.count("*").alias("manifest_images"), F.count_if(done).alias("processed_images"), F.count_if(~done).alias("failed_images"), share(done, F.lit(True)).alias("preprocessing_success_rate"),
        F.count_if(labelled).alias("state_labelled_queries"), share(F.col("states") == F.col("expected"), labelled).alias("state_count_accuracy"),
        F.count_if(seen).alias("observed_state_labelled_queries"), share(F.col("observed") == F.col("expected_observed"), seen).alias("raw_peak_count_matches_manifest_observed_rate"),
        F.count_if(partial).alias("partial_state_coverage_queries"), share(F.col("states") == F.col("expected"), partial & labelled).alias("partial_coverage_state_count_accuracy"),
        F.count_if(asked).alias("relevance_queries"), share(F.col("first_rank") == 1, asked).alias("top_1_accuracy"), mean(F.col("at_5") / F.col("relevant")).alias("recall_at_5"),
        mean(F.col("at_10") / F.col("relevant")).alias("recall_at_10"), mean(1 / F.col("first_rank")).alias("mean_reciprocal_rank"),
        F.count_distinct(F.when(done, F.nullif("source", F.lit("")))).alias("source_count"), F.count_distinct(F.when(done, F.nullif("independence", F.lit("")))).alias("independence_group_count"),
    )


def bad_numbers(name: str, values: Column, least: Column | int, most: Column | int) -> tuple[Column, str]:
    """A rule for an array of numbers: how many there may be, and that all lie between 0 and MOST_VALUE."""
    n = F.size(values)
    inside = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0.0, MOST_VALUE))
    return ~F.coalesce((n >= least) & (n <= most) & inside, F.lit(False)), f"{name} is invalid"


def candidate_errors(c: str = "candidate") -> Column:
    """What is wrong with a remote candidate: its id, state count, profile, and sequences whose sizes follow from its peaks."""
    f = lambda n: F.col(f"{c}.{n}")
    peaks = F.greatest(F.size(f("peak_locations")), F.lit(0))
    valleys = F.greatest(peaks - 1, F.lit(0))
    flat = F.array_max(f("profile")) - F.array_min(f("profile")) < LEAST_RANGE
    return errors(
        (~F.coalesce(f("id").rlike(CANDIDATE_ID), F.lit(False)), "id is invalid"),
        (~F.coalesce(f("state_count").isin(*STATES), F.lit(False)), "state count is invalid"),
        bad_numbers("profile", f("profile"), POINTS, POINTS),
        (F.coalesce(flat, F.lit(False)), "profile has insufficient variation"),
        bad_numbers("peak locations", f("peak_locations"), 2, F.coalesce(f("state_count"), F.lit(0))),
        bad_numbers("peak widths", f("peak_widths"), peaks, peaks),
        *[bad_numbers(n.replace("_", " "), f(n), valleys, valleys) for n in ("valley_heights", "valley_depths")],
    )


def payload_errors(p: str = "payload") -> Column:
    """What is wrong with a submission: consent, tokens, and a profile and descriptor of 1 to MOST_STATES states."""
    f = lambda n: F.col(f"{p}.{n}")
    token = lambda n: ~F.coalesce(f(n).rlike(TOKEN), F.lit(False))
    states = f("state_count")
    flat = F.array_max(f("profile")) - F.array_min(f("profile")) < LEAST_RANGE
    return errors(
        (~F.coalesce(f("consent"), F.lit(False)), "consent is missing"),
        (token("contributor"), "contributor token is invalid"),
        (token("deletion"), "deletion token is invalid"),
        bad_numbers("profile", f("profile"), POINTS, POINTS),
        (F.coalesce(flat, F.lit(False)), "profile has insufficient variation"),
        (~F.coalesce(states.between(1, MOST_STATES), F.lit(False)), "state count is invalid"),
        bad_numbers("peak locations", f("peak_locations"), F.coalesce(states, F.lit(-1)), F.coalesce(states, F.lit(-1))),
        (~F.coalesce(f("area").between(0.0, MOST_VALUE) & ~F.isnan(f("area")), F.lit(False)), "area is invalid"),
    )


def decoded_cursor(cursor: Column) -> tuple[Column, Column]:
    """Creation time and id of a page cursor; both null for anything that isn't one."""
    fits = cursor.rlike(CURSOR)
    padded = F.rpad(F.translate(cursor, "-_", "+/"), (F.ceil(F.length(cursor) / 4) * 4).cast("int"), F.lit("="))
    parts = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "array<string>")
    right = fits & (F.size(parts) == 3) & (parts[0] == "v1") & parts[1].rlike(CREATED)
    return F.when(right, parts[1]), F.when(right, parts[2])


def model_errors(sizes: dict[str, int], arrays: dict[str, Column]) -> Column:
    """What is wrong with a stored encoder's arrays: another size than it must have, or values that aren't finite."""
    return errors(*[(~F.coalesce((F.size(a) == sizes[n]) & F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)), f"{n} is invalid") for n, a in arrays.items()])
