"""Near copies of curves: of rows that resemble an earlier kept one, only the earlier stays.

The rule is sequential: in the order of ids, a row is kept unless a kept one before it is at least as similar as `floor`.
Rounds find what doesn't depend on the order of work: a row without an undecided earlier neighbour is kept, and its later
neighbours go. A round asks only whether there is such a neighbour, so no list of pairs is made, however many copies a row
has. Rounds are as many as the longest chain of rows that wait for one another; copies and dense groups take one or two.
Once no more rows are undecided than a cell holds, one task goes through them in order.

The rounds come last. Before them the first rows, as many as a cell holds, are gone through in order in one task, and what
resembles those of them that are kept goes: they are sent to all tasks, so no row is copied. That is repeated as long as it
decides a quarter of what is left. Where rows resemble one another at all, few are undecided then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import vectors
from ridgeline.operators import nearest
from ridgeline.storage import written


def has_earlier(rows: DataFrame, asked: DataFrame, floor: float, kernel: nearest.Kernel, centres: np.ndarray, reach: np.ndarray) -> DataFrame:
    """id of every asked row that has a row of a smaller id at least so similar.

    Both sides are (id, grp, v, _g), _g their centre. A row is sent to the centres whose angle leaves room for the
    similarity, so pairs further apart never meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, cell = None, [], None
        for (g, c, kind), batch in nearest.runs(batches, 3):
            if (g, c) != now:
                now, parts, cell = (g, c), [], None
            if not kind:
                parts.append(batch)
                continue
            if not parts:
                continue
            if cell is None:
                whole = pa.Table.from_batches(parts)
                cell = nearest.matrix(whole["v"].combine_chunks()), whole["id"].to_numpy()
            x, ids = cell
            for at in range(0, batch.num_rows, nearest.BLOCK):
                some = batch.slice(at, nearest.BLOCK)
                asking = some["id"].to_numpy()
                near = (np.round(kernel.score(nearest.matrix(some["v"]), x), 9) >= floor) & (ids[None, :] < asking[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(asking[near.any(axis=1)])], names=["id"])

    counts = rows.groupBy("_g").agg(F.count("*").alias("n"))
    own = asked.select("_g", "id", "grp", "v")
    others = nearest.sent_on(asked.withColumn("floor", F.lit(floor)), centres, reach, kernel.embed).drop("floor")
    here, there = nearest.split(rows, own.unionByName(others), counts)
    columns = ["_g", "_c", "_kind", "id", "v"]
    both = here.withColumn("_kind", F.lit(0).cast("long")).select(columns).unionByName(there.withColumn("_kind", F.lit(1).cast("long")).select(columns))
    return both.repartition("_g", "_c").sortWithinPartitions("_g", "_c", "_kind").mapInArrow(run, "id long").distinct()


def _settled(rows: DataFrame, floor: float, kernel: nearest.Kernel) -> DataFrame:
    """The kept ones of at most SHARD rows, by the sequential rule in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            whole = pa.Table.from_batches(parts)
            x = nearest.matrix(whole["v"].combine_chunks())
            kept: list[int] = []
            blocked = np.zeros(len(x), bool)
            for n in np.argsort(whole["id"].to_numpy(), kind="stable").tolist():
                if not blocked[n]:
                    kept.append(n)
                    blocked |= np.round(kernel.score(x[n : n + 1], x)[0], 9) >= floor
            yield from whole.take(pa.array(kept)).to_batches()

    return rows.select("id", "grp", "v").repartition(1).mapInArrow(run, "id long, grp long, v array<double>")


def _unlike(rows: DataFrame, kept: np.ndarray, floor: float, kernel: nearest.Kernel) -> DataFrame:
    """Rows that resemble none of the kept ones, SHARD at most. Single precision decides what is beyond its error."""
    left, right, pairs = kernel.sides()
    theirs = [np.asarray(v, np.float32) for v in right(kept)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = nearest.matrix(batch["v"])
            near = np.max([np.asarray(a, np.float32) @ b.T for a, b in zip(left(x), theirs)], axis=0) if len(x) else np.zeros((0, len(kept)))
            slack = (x.shape[1] + 8) * 2.0**-22
            gone = (near >= floor + slack).any(axis=1)
            row, col = np.nonzero((near >= floor - slack) & ~gone[:, None])
            for at in range(0, len(row), nearest.SHARD):
                i, j = row[at : at + nearest.SHARD], col[at : at + nearest.SHARD]
                gone[i[np.round(pairs(x[i], kept[j]), 9) >= floor]] = True
            yield batch.filter(pa.array(~gone))

    return rows.mapInArrow(run, rows.schema)


def _led(rows: DataFrame, n: int, floor: float, kernel: nearest.Kernel) -> tuple[list[DataFrame], DataFrame, int]:
    """What is kept of the first rows, what is undecided then, and how many these are."""
    kept = []
    while n > nearest.SHARD:
        first = rows.orderBy("id").limit(nearest.SHARD).select("id").agg(F.max("id")).first()[0]
        some = written(_settled(rows.where(F.col("id") <= first), floor, kernel))
        kept.append(some)
        found = some.select("v").toArrow()  # SHARD rows at most
        rows = written(_unlike(rows.where(F.col("id") > first), nearest.matrix(found["v"].combine_chunks()), floor, kernel))
        before, n = n, rows.count()
        if n > 0.75 * before:
            break
    return kept, rows, n


def first_kept(rows: DataFrame, floor: float, kernel: nearest.Kernel = nearest.COSINE) -> DataFrame:
    """(id, grp, v) of the rows that are kept. Ids are keys and give the order; rows without an id or a vector are left out.

    Raises ValueError for a kernel that has no embedding, as its angles bound the search.
    """
    if kernel.embed is None:
        raise ValueError("the kernel must have an embedding")
    plain = nearest._plain(rows)
    n = plain.count()
    if n <= nearest.SHARD:
        return _settled(plain, floor, kernel)
    leading, plain, n = _led(plain, n, floor, kernel)
    before = None
    for t in leading:
        before = t if before is None else before.unionByName(t)
    if n <= nearest.SHARD:
        return before.unionByName(_settled(plain, floor, kernel))
    most = max(1, min(nearest.CENTRES, -(-n // nearest.SHARD)))
    seeds = plain.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(most).select("v").toArrow()  # CENTRES rows at most
    centres = vectors.units(kernel.embed(nearest.matrix(seeds["v"].combine_chunks())))
    placed = written(nearest.near_centres(plain, centres, kernel.embed))
    known = placed.groupBy("_g").agg(F.max("angle").alias("angle")).toArrow()
    reach = np.full(len(centres), np.nan)
    reach[known["_g"].to_numpy()] = known["angle"].to_numpy()
    open_, kept = placed.drop("angle"), None
    while open_.count() > nearest.SHARD:
        waits = written(has_earlier(open_, open_, floor, kernel, centres, reach))
        free = written(open_.join(waits, "id", "left_anti"))
        kept = free if kept is None else kept.unionByName(free)
        rest = open_.join(waits, "id", "left_semi")
        gone = has_earlier(free, rest, floor, kernel, centres, reach)
        open_ = written(rest.join(gone, "id", "left_anti"))
    rest = _settled(open_, floor, kernel)
    return before.unionByName(rest if kept is None else kept.select("id", "grp", "v").unionByName(rest))
