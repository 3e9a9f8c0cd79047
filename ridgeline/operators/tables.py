"""Keyed tables: upsert, prune, soft delete, pages, rate limits, fingerprints, merges and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.storage import written


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; a partial maximum, so a key of any size is met before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    first = [c for c in order if c in rest]
    best = rows.groupBy(*key).agg(F.max(F.struct(*first, *[c for c in rest if c not in first])).alias("_m"))
    return best.select(*key, *[F.col(f"_m.{c}").alias(c) for c in rest])


def upsert(target: DataFrame, source: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The target with the last source row of each key in place of its own."""
    last = latest(source, [key], order)
    return target.join(last, key, "left_anti").unionByName(last.select(target.columns))


def prune(target: DataFrame, origin: Column, retained: DataFrame, key: str) -> DataFrame:
    """Without the rows of one origin whose key isn't retained; null origins stay."""
    kept = target.where(~F.coalesce(origin, F.lit(False)))
    return kept.unionByName(target.where(origin).join(retained.select(key).distinct(), key, "left_semi"))


def soft_delete(target: DataFrame, condition: Column, status: str = "status") -> DataFrame:
    return target.withColumn(status, F.when(condition & (F.col(status) == "active"), "deleted").otherwise(F.col(status)))


def keyset_page(rows: DataFrame, created: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """The page after a (created, key), newest first, with has_more; one row more is read to know that."""
    if after is not None:
        rows = rows.where((F.col(created) < F.lit(after[0])) | ((F.col(created) == F.lit(after[0])) & (F.col(key) < F.lit(after[1]))))
    page = rows.orderBy(F.desc(created), F.desc(key)).limit(size + 1)
    place = Window.orderBy(F.desc(created), F.desc(key))  # over a page, not the table
    out = page.withColumn("_n", F.row_number().over(place)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size)
    return out.where(F.col("_n") <= size).drop("_n")


def rolling_count(rows: DataFrame, who: str, ts: str, seconds: int = 86_400) -> DataFrame:
    """in_window: rows of the same contributor within the last seconds, up to and with this one, and those of the same time.

    Time is cut into pieces of the window's length, and each row also goes to the next piece as its history: so a
    contributor with very many rows is as many windows as there are pieces.
    """
    micros, length = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    piece = F.floor(micros / length).cast("long")
    spread = rows.withColumn("_at", micros).withColumn("_piece", F.explode(F.array_distinct(F.array(piece, piece + 1))))
    w = Window.partitionBy(who, "_piece").orderBy("_at").rangeBetween(-length, 0)
    out = spread.withColumn("in_window", F.count("*").over(w)).where(F.floor(F.col("_at") / length).eqNullSafe(F.col("_piece")))
    return out.drop("_at", "_piece")


def fingerprint_dedup(rows: DataFrame, content: Column, key: str) -> DataFrame:
    """fingerprint, the first key of it and its count, by partial minima."""
    return rows.groupBy(F.sha2(content, 256).alias("fingerprint")).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def merge_sets(sets: list[DataFrame], key: str, flag: str) -> DataFrame:
    """Rows of all sets by key: of each column the last value that isn't null, of the flag whether any is true."""
    columns = [c for c in sets[0].columns if c not in (key, flag)]
    every = None
    for n, s in enumerate(sets):
        s = s.select(key, flag, *columns, F.lit(n).alias("_set"))
        every = s if every is None else every.unionByName(s)
    return every.groupBy(key).agg(F.min("_set").alias("first_set"), F.bool_or(flag).alias(flag), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_set"))).alias(c) for c in columns])


def hash_order(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with their number from 1 within each group, and `name`_of, the size of the group.

    Rows are dealt to ranges of (by, order), numbered there and moved by what lies in ranges before, so that no task sorts
    a large group, or all rows where there is no group. Ties in the order: in any order, so it should be a key.
    """
    placed = written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    some = Window.partitionBy(*by)
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"))  # a row for each range that a group reaches
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(some.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), f"{name}_of": F.sum("_n").over(some)}).drop("_n")
    counts = counts.toDF(*[f"_of_{c}" for c in by], "_of_part", "_before", f"{name}_of")
    within = placed.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)))
    same = F.col("_part") == F.col("_of_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return within.join(counts, same).withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).select(*rows.columns, name, f"{name}_of")


def group_split(groups: DataFrame, key: str, seed: int, fraction: float, by: str | None = None, least: int = 1) -> DataFrame:
    """groups with held_out: the first max(1, min(n - 1, round(n * fraction))) by hash, in each stratum if `by` is given.

    Rounding is half to even. A stratum of fewer than two groups has none held out. Groups are distinct keys.
    """
    hashed = groups.withColumn("_hash", hash_order(F.col(key), seed))
    placed = numbered(hashed, [by] if by else [], ["_hash", key], "_place")
    n = F.col("_place_of")
    want = F.greatest(F.lit(least), F.least(n - 1, F.bround(n * fraction).cast("long")))
    return placed.withColumn("held_out", (n >= 2) & (F.col("_place") <= want)).drop("_hash", "_place", "_place_of")


def round_robin(rows: DataFrame, group: str, order: list[Column], take: int) -> DataFrame:
    """The first rows of every group, then the second ones, and so on, until `take`."""
    depth = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")
    return rows.withColumn("depth", depth).where(F.col("depth") <= take).orderBy("depth", group).limit(take)
