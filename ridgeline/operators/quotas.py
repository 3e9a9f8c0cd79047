"""Examples by quota, counts over keys with blanks, and batches in which bad items fail alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.tables import hash_order, numbered

# Shares of hard negatives, of those from the same family, and of those with the same state count.
HARD, FAMILY, STATE = 0.75, 0.55, 0.85


def quotas(wanted: Column, shares: list[float]) -> list[Column]:
    """How many rows each stratum is asked for: its share of what those before leave, rounded half to even; the last gets the rest."""
    out, left = [], wanted.cast("long")
    for share in shares:
        n = F.bround(left * F.lit(share)).cast("long")
        out.append(n)
        left = left - n
    return [*out, left]


def by_quota(rows: DataFrame, group: str, key: str, strata: list[tuple[Column, float]], wanted: Column | int, seed: int) -> DataFrame:
    """The rows chosen in each group, with `stratum` (from 0): `wanted` of them, or all if there are fewer.

    A row belongs to the first stratum whose condition holds, or to the last one, of rows for which none does. A stratum
    with fewer rows than its quota hands the rest on to the next one, and what the last can't give goes back to the first
    that has rows left. Within a stratum rows are taken by the hash of their key, so any partitioning gives the same rows.
    Rows are numbered over ranges and counted by group and stratum, so no group is sorted in one task.
    """
    stratum = F.lit(len(strata))
    for at in range(len(strata) - 1, -1, -1):
        stratum = F.when(F.coalesce(strata[at][0], F.lit(False)), at).otherwise(stratum)
    placed = numbered(rows.withColumn("stratum", stratum.cast("long")).withColumn("_hash", hash_order(F.col(key), seed)), [group, "stratum"], ["_hash", key], "_place")
    n = len(strata) + 1
    counts = rows.withColumn("stratum", stratum.cast("long")).groupBy(group).agg(*[F.count_if(F.col("stratum") == i).alias(f"_n{i}") for i in range(n)])
    want = F.lit(wanted) if isinstance(wanted, int) else wanted
    asked = counts.withColumns({f"_q{i}": q for i, q in enumerate(quotas(want, [s for _, s in strata]))})
    over: Column = F.lit(0).cast("long")
    first = []
    for i in range(n):
        first.append(F.least(F.col(f"_n{i}"), F.col(f"_q{i}") + over))
        over = F.col(f"_q{i}") + over - first[i]
    asked = asked.withColumns({f"_t{i}": t for i, t in enumerate(first)}).withColumn("_over", over)
    over = F.col("_over")
    takes = []
    for i in range(n):
        more = F.least(F.col(f"_n{i}") - F.col(f"_t{i}"), over)
        takes.append(F.col(f"_t{i}") + more)
        over = over - more
    take = asked.select(F.col(group).alias("_group"), F.array(*takes).alias("_takes"))
    out = placed.join(take, F.col(group).eqNullSafe(F.col("_group")))
    return out.where(F.col("_place") <= F.element_at("_takes", (F.col("stratum") + 1).cast("int"))).select(*rows.columns, "stratum")


def compatible_counts(rows: DataFrame, key: str, group: str, relevant: str) -> DataFrame:
    """key, candidates and relevant_candidates of each row: how many others it may be held against, and how many of them share its `relevant`.

    Groups differ only where both are given: a blank one goes with all. Pairs are counted, not made: rows are counted by
    (group, relevant) with partial sums, and each row looks up the count of its group, of the blank one, or of all.
    A blank `relevant` shares nothing.
    """
    clean = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))
    slim = rows.select(F.col(key).alias("_key"), clean(group).alias("_g"), clean(relevant).alias("_r"))
    cells = slim.groupBy("_g", "_r").agg(F.count("*").alias("n"))
    by = lambda t, *c: t.groupBy(*c).agg(F.sum("n").alias("n"))
    total, blank = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_g") == "", F.col("n"))), F.lit(0))).first()
    in_group = by(cells, "_g").select(F.col("_g").alias("_gg"), F.col("n").alias("_in_group"))
    alike = by(cells, "_r").select(F.col("_r").alias("_ra"), F.col("n").alias("_alike"))
    alike_blank = cells.where("_g = ''").select(F.col("_r").alias("_rb"), F.col("n").alias("_alike_blank"))
    alike_group = cells.select(F.col("_g").alias("_gc"), F.col("_r").alias("_rc"), F.col("n").alias("_alike_group"))
    # what a row finds is the same for all rows of its cell, so look-ups are by cell; rows then meet their cell's row
    known = cells.join(in_group, F.col("_g") == F.col("_gg")).join(alike, F.col("_r") == F.col("_ra")).join(alike_blank, F.col("_r") == F.col("_rb"), "left")
    known = known.join(alike_group, (F.col("_g") == F.col("_gc")) & (F.col("_r") == F.col("_rc")))
    open_ = F.col("_g") == ""
    found = known.select(
        F.col("_g").alias("_g2"), F.col("_r").alias("_r2"), F.when(open_, F.lit(total)).otherwise(F.col("_in_group") + F.lit(blank)).alias("_candidates"),
        F.when(F.col("_r") == "", 0).when(open_, F.col("_alike")).otherwise(F.col("_alike_group") + F.coalesce("_alike_blank", F.lit(0))).alias("_relevant"),
    )
    out = slim.join(found, (F.col("_g") == F.col("_g2")) & (F.col("_r") == F.col("_r2")))
    return out.select(F.col("_key").alias(key), (F.col("_candidates") - 1).alias("candidates"), F.when(F.col("_r") == "", 0).otherwise(F.col("_relevant") - 1).cast("long").alias("relevant_candidates"))


def attempted(rows: DataFrame, make: Callable[[dict], object], result: str, ddl: str) -> DataFrame:
    """rows with `result` (of the type ddl) and `error`: what an item raised stands in its own row, and the others go on.

    make gets a row as a dict in a task and gives the result; the error is the class and message of what it raised. A
    failing task is another matter: Spark runs it again.
    """
    names = rows.columns
    schema = rows.select("*", F.lit(None).cast(ddl).alias(result), F.lit(None).cast("string").alias("error")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            values, errors = [], []
            for row in batch.to_pylist():
                try:
                    values.append(make(row))
                    errors.append(None)
                except Exception as e:  # whatever it is, it is this item's
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            kind = kind or _arrow(ddl)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind), pa.array(errors, pa.string())], names=[*names, result, "error"])

    return rows.mapInArrow(run, schema)


def _arrow(ddl: str) -> pa.DataType:
    return {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}[ddl]


def parted(outcome: DataFrame, result: str) -> tuple[DataFrame, DataFrame]:
    """Results, without `error`; and dead letters, without the result. Write the outcome first, else items run twice."""
    return outcome.where("error IS NULL").drop("error"), outcome.where("error IS NOT NULL").drop(result)


def retried(dead: DataFrame, make: Callable[[dict], object], result: str, ddl: str) -> DataFrame:
    """The outcome of another attempt at the dead letters alone; `tries` counts attempts, 1 where it isn't there yet."""
    had = dead if "tries" in dead.columns else dead.withColumn("tries", F.lit(1))
    return attempted(had.withColumn("tries", F.col("tries") + 1).drop("error"), make, result, ddl)
