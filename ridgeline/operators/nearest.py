"""Exact nearest rows: a corpus dealt to cells once, and queries copied only to the cells that may still better their list.

A corpus is a DataFrame of (id, grp, v): a key, a state count or other group, and a vector; queries have the same columns.
A cell holds about SHARD rows of the corpus. A task reads a cell first, then streams the queries that were sent to it, and
keeps the k best of each. Scores are compared at nine decimals, ties go to the smaller id.

Kernels whose score is the cosine of embedded vectors prune: cells are rows near one of CENTRES rows at most, known with
the largest angle to it. Each query first meets the cells of its own centre; its kth score there is the floor that the
bound of any other centre must reach, else the query isn't sent to it. The corpus isn't copied then.

Where bounds spare less than that costs, a cell of up to WIDE rows is dealt to as many tasks as there are parts of the
queries. More rows go through the tasks instead (`gather`): a task holds HELD bytes of queries and their lists, meets one
cell of rows after the other, and gives k rows a query, however many cells it met. A task goes through a cell in chunks of
SHARD rows. Kernels whose score is the largest of some products (views) are held to the kth score so far in single
precision, and only what may reach it is scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import vectors
from ridgeline.storage import written

#: Rows of a cell; centres, whose vectors are sent to all tasks; groups of more than SHARD rows that may be broadcast.
SHARD, CENTRES, FEW = 4096, 4096, 65_536
#: Rows of a cell of the grid for a kernel of one view (with more views fewer, SHARD at least), and tasks that a search has at least.
WIDE, TASKS = 16_384, 32
#: Bytes of queries and their lists that a task holds; queries that are asked first to see whether bounds spare anything.
HELD, PROBE = 1 << 27, 8192
#: Queries that meet a cell in one matrix product. With SHARD rows that is a million scores, of which a worker holds some copies.
BLOCK = 256
#: Alternatives of a cell's lists that a block of queries meets at once, in all views, when it is known what they must reach.
TILE = 256
#: What rounding may add to a bound.
SLACK = 1e-7


@dataclass(frozen=True)
class Kernel:
    """score: of every row of a with every row of b. embed: rows of length 1 (or 0) whose products are the scores.

    left, right: matrices, the views of rows of a and of b; the score is the largest product of two views of one place.
    views: how many there are. lists: gives the alternatives of all rows as rows, and where each row's begin; views are of
    these. pairs: the score of row i of a with row i of b. always: pairs whose largest product reaches this are scored
    exactly, as `pairs` may raise them above all others. fits: which rows of b each row of a may have; `score` is -inf
    elsewhere, views and `pairs` needn't know of it.
    """

    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    embed: Callable[[np.ndarray], np.ndarray] | None = None
    left: Callable[[np.ndarray], list[np.ndarray]] | None = None
    right: Callable[[np.ndarray], list[np.ndarray]] | None = None
    views: int = 1
    lists: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None
    pairs: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    always: float = np.inf
    fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def sides(self) -> tuple[Callable, Callable, Callable] | None:
        """left, right and pairs; those of the embedding where they aren't given, None without either."""
        if self.left is not None:
            return self.left, self.right, self.pairs
        if self.embed is None:
            return None
        return (lambda a: [self.embed(a)]), (lambda b: [self.embed(b)]), (lambda a, b: np.clip(np.einsum("ij,ij->i", self.embed(a), self.embed(b)), -1.0, 1.0))


COSINE = Kernel(vectors.cosines, vectors.units)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows; null components as NaN. Raises ValueError unless all have one length."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if n and len(flat) % n:
        raise ValueError("vectors must be of one length")
    return flat.reshape(n, -1)


def stacked(batches: list[pa.RecordBatch]) -> np.ndarray:
    """The vectors `v` of all batches as rows. Takes the batches out of the list one by one, so that they needn't stay in memory."""
    n, at, out = sum(b.num_rows for b in batches), 0, np.zeros((0, 0))
    batches.reverse()
    while batches:
        part = matrix(batches.pop()["v"])
        if not at:
            out = np.empty((n, part.shape[1]))
        if part.shape[1] != out.shape[1]:
            raise ValueError("vectors must be of one length")
        out[at : at + len(part)] = part
        at += len(part)
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Slices of sorted batches within which the first `keys` columns (longs, not null) are the same."""
    for batch in batches:
        values = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        edges = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if e > s:
                yield tuple(values[:, s].tolist()), batch.slice(s, e - s)


def _rank(score: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the scores at nine decimals, then of falling columns; those that aren't finite come first.

    They count from the least score on: what stands for -inf must not leave the range of 64 bits, however many columns there are.
    """
    n = score.shape[1]
    finite = np.isfinite(score)
    steps = np.rint(np.where(finite, score, 0.0) * 1e9)
    low = steps.min(initial=0.0, where=finite)
    if (steps.max(initial=0.0, where=finite) - low + 2) * n < 2.0**62:
        code = np.where(finite, steps - low + 1, 0.0).astype(np.int64)
    else:
        code = np.where(finite, np.unique(steps, return_inverse=True)[1].reshape(score.shape) + 1, 0)
    return code * n + np.arange(n - 1, -1, -1)


def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest finite scores of each row, in order, ties to the smaller column."""
    n = score.shape[1]
    rank = _rank(score)
    at = np.argpartition(rank, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), score.shape)
    at = np.take_along_axis(at, np.argsort(-np.take_along_axis(rank, at, 1), axis=1), 1)
    row, place = np.nonzero(np.isfinite(np.take_along_axis(score, at, 1)))
    return row, at[row, place]


def best_of_groups(score: np.ndarray, groups: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the best finite score of each group, for the k best groups of each row."""
    order = np.argsort(groups, kind="stable")
    starts = np.flatnonzero(np.r_[True, groups[order][1:] != groups[order][:-1]])
    n = score.shape[1]
    rank = _rank(score)
    first = np.maximum.reduceat(rank[:, order], starts, axis=1)
    at = np.argsort(-first, axis=1, kind="stable")[:, :k]
    column = n - 1 - np.take_along_axis(first, at, 1) % n
    row, place = np.nonzero(np.isfinite(np.take_along_axis(score, column, 1)))
    return row, column[row, place]


def hits_of(hit: np.ndarray) -> np.ndarray:
    """Flat places of what is true, eight at a time: few are."""
    flat = hit.reshape(-1)
    if flat.size % 8:
        return np.flatnonzero(flat)
    eight = np.flatnonzero(flat.view(np.uint64))
    at, n = np.nonzero(flat.reshape(-1, 8)[eight])
    return eight[at] * 8 + n


def _owners(starts: np.ndarray, n: int) -> np.ndarray:
    """The list that each of n alternatives belongs to."""
    return np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))


def _by_tiles(asked: list[np.ndarray], views: list[np.ndarray], mine: np.ndarray, theirs: np.ndarray, reach: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Row, column and largest product of the lists with a product that reaches the row's number; None if more than `most` alternatives do.

    mine, theirs: the lists of the rows of all asked and of all views. Products of a tile stay where they were made until
    all views are through, and lists are told apart only where something reaches.
    """
    need, found, n = reach[mine][:, None], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))], 0
    near, more = (np.empty((len(mine), TILE), np.float32) for _ in range(2))
    for at in range(0, len(theirs), TILE):
        some = min(TILE, len(theirs) - at)
        if some < TILE:
            near, more = near[:, :some].copy(), more[:, :some].copy()
        np.matmul(asked[0], views[0][at : at + some].T, out=near)
        for x, y in zip(asked[1:], views[1:]):
            np.maximum(near, np.matmul(x, y[at : at + some].T, out=more), out=near)
        flat = hits_of(near >= need)
        n += len(flat)
        if n > most:
            return None
        i, j = np.divmod(flat, some)
        found.append((mine[i], theirs[at + j], near.reshape(-1)[flat]))
    row, col, product = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((-product, col, row))
    row, col, product = row[order], col[order], product[order]
    first = np.r_[True, (row[1:] != row[:-1]) | (col[1:] != col[:-1])][: len(row)]
    return row[first], col[first], product[first]


def _single(views: list[np.ndarray]) -> list[np.ndarray]:
    return [np.ascontiguousarray(v, np.float32) for v in views]


class Cell:
    """The rows of a cell in the order of their ids, in chunks of SHARD, and the best of them for blocks of queries."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, kernel: Kernel):
        self.x, self.ids, self.kernel, self.sides = x, ids, kernel, kernel.sides()
        self.chunks = [(s, min(s + SHARD, len(x))) for s in range(0, len(x), SHARD)]
        self.views = []
        for s, e in self.chunks if self.sides else ():
            rows, starts = kernel.lists(x[s:e]) if kernel.lists else (x[s:e], None)
            self.views.append((_single(self.sides[1](rows)), starts))

    def _exact(self, q: np.ndarray, asking: np.ndarray, s: int, e: int, k: int, floor: np.ndarray, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = np.round(self.kernel.score(q, self.x[s:e]), 9)
        if exclude_self:
            score[asking[:, None] == self.ids[None, s:e]] = -np.inf
        score[score < floor[:, None]] = -np.inf
        row, col = best(score, k)
        return row, col + s, score[row, col]

    def nearest(self, q: np.ndarray, asking: np.ndarray, k: int, floor: np.ndarray, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and score of the k best rows of each query that reach its floor, ties to the smaller id."""
        found = []
        if self.sides is None:
            found = [self._exact(q, asking, s, e, k, floor, exclude_self) for s, e in self.chunks]
        else:
            found = self._hopeful(q, asking, k, floor, exclude_self)
        row, col, score = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((col, -score, row))
        order = order[_place(row[order]) < k]
        return row[order], col[order], score[order]

    def _hopeful(self, q: np.ndarray, asking: np.ndarray, k: int, floor: np.ndarray, exclude_self: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What may be among the k best, scored exactly. Products in single precision are off by less than half of `slack`."""
        left, _, pairs = self.sides
        rows, starts = self.kernel.lists(q) if self.kernel.lists else (q, None)
        asked = _single(left(rows))
        slack = (max(v.shape[1] for v in asked) + 8) * 2.0**-22
        floor = np.nan_to_num(floor, nan=-np.inf)
        least, done, hits = floor - slack, [], []
        for n, ((s, e), (views, begins)) in enumerate(zip(self.chunks, self.views)):
            if starts is not None and self.kernel.fits is None and (least > -1.5).all():
                reach = np.nextafter(np.minimum(least, self.kernel.always - slack).astype(np.float32), np.float32(-np.inf))
                some = _by_tiles(asked, views, _owners(starts, len(rows)), _owners(begins, len(views[0])), reach, max(4 * k, 256) * len(q))
                if some is not None:
                    row, col, near = some
                    other = (self.ids[s + col] != asking[row]) if exclude_self else np.ones(len(row), bool)
                    hits.append((row[other], col[other] + s, near[other]))
                    continue
            near = asked[0] @ views[0].T
            for a, b in zip(asked[1:], views[1:]):
                np.maximum(near, a @ b.T, out=near)
            if starts is not None:
                near = np.maximum.reduceat(np.maximum.reduceat(near, begins, axis=1), starts, axis=0)
            if self.kernel.fits:
                near[~self.kernel.fits(q, self.x[s:e])] = -np.inf
            if exclude_self:
                at = np.searchsorted(self.ids[s:e], asking)
                for i in np.flatnonzero((at < e - s) & (self.ids[s:e][np.minimum(at, e - s - 1)] == asking)).tolist():
                    near[i, at[i] : np.searchsorted(self.ids[s:e], asking[i], "right")] = -np.inf
            if not n and e - s >= k and not (floor > np.finfo(float).min).all():  # that stands for -inf
                first = np.where(np.isnan(near), -np.inf, near)
                least = np.maximum(least, np.partition(first, e - s - k, axis=1)[:, e - s - k] - slack)
            with np.errstate(over="ignore"):
                reach = np.nextafter(np.minimum(least, self.kernel.always - slack).astype(np.float32), np.float32(-np.inf))
            hit = near >= reach[:, None]
            if not np.isfinite(reach).all():
                hit &= near > -np.inf
            row, col = np.divmod(np.flatnonzero(hit), e - s)
            if len(row) > max(4 * k, 256) * len(q):
                done.append(self._exact(q, asking, s, e, k, floor, exclude_self))
            else:
                hits.append((row, col + s, near[row, col]))
        if hits:
            row, col, near = (np.concatenate(c) for c in zip(*hits))
            order = np.lexsort((-near, row))
            row, col, near = row[order], col[order], near[order]
            last = np.full(len(q), -np.inf)
            kth = _place(row) == k - 1
            last[row[kth]] = near[kth]
            keep = near >= np.minimum(last - slack, self.kernel.always - slack)[row]
            row, col = row[keep], col[keep]
            score = np.concatenate([np.zeros(0), *[np.round(pairs(q[row[at : at + SHARD]], self.x[col[at : at + SHARD]]), 9) for at in range(0, len(row), SHARD)]])
            good = np.isfinite(score) & (score >= floor[row])
            done.append((row[good], col[good], score[good]))
        return done


def _place(row: np.ndarray) -> np.ndarray:
    """How many equal numbers stand before each, in a sorted array."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    return np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))


class Lists:
    """Queries that a task holds, and the k best rows of each so far; those without a row have the score -inf."""

    def __init__(self, asked: list[pa.RecordBatch], k: int, kernel: Kernel, exclude_self: bool):
        """asked: emptied, as rows are in `meet`."""
        self.k, self.kernel, self.exclude_self = k, kernel, exclude_self
        known = pa.Table.from_batches([b.select(["id", "grp", "floor"]) for b in asked])
        self.ids, self.groups = known["id"].to_numpy(), known["grp"].combine_chunks()
        self.floor = np.nan_to_num(known["floor"].to_numpy().astype(float), nan=-np.inf)
        del known
        self.q = stacked(asked)
        shape = len(self.ids), k
        self.score, self.id, self.grp, self.known = np.full(shape, -np.inf), np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool)

    def meet(self, rows: list[pa.RecordBatch]) -> None:
        keys = pa.Table.from_batches([b.select(["id", "grp"]) for b in rows])
        order = np.argsort(keys["id"].to_numpy(), kind="stable")
        ids, groups = keys["id"].to_numpy()[order], keys["grp"].combine_chunks().take(pa.array(order))
        grp, known = groups.fill_null(0).to_numpy(zero_copy_only=False), groups.is_valid().to_numpy(zero_copy_only=False)
        del keys
        cell = Cell(stacked(rows)[order], ids, self.kernel)
        for s in range(0, len(self.ids), BLOCK):
            some = slice(s, s + BLOCK)
            row, col, score = cell.nearest(self.q[some], self.ids[some], self.k, np.maximum(self.floor[some], self.score[some, -1]), self.exclude_self)
            if len(row):
                at, n = np.unique(row, return_inverse=True)
                self._merge(at + s, n, score, ids[col], grp[col], known[col])

    def _merge(self, at: np.ndarray, n: np.ndarray, *new: np.ndarray) -> None:
        held = self.score, self.id, self.grp, self.known
        every = [np.concatenate([h[at].ravel(), x]) for h, x in zip(held, new)]
        n = np.concatenate([np.repeat(np.arange(len(at)), self.k), n])
        order = np.lexsort((every[1], -every[0], n))
        order = order[_place(n[order]) < self.k]
        for h, x in zip(held, every):
            h[at] = x[order].reshape(len(at), self.k)

    def found(self) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(self.ids), BLOCK):
            row, place = np.nonzero(np.isfinite(self.score[s : s + BLOCK]))
            row += s
            columns = self.ids[row], self.groups.take(pa.array(row)), self.id[row, place], pa.array(self.grp[row, place], mask=~self.known[row, place]), self.score[row, place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SCHEMA)


_FOUND = "query_id long, query_grp long, id long, grp long, score double"
_SCHEMA = pa.schema([("query_id", pa.int64()), ("query_grp", pa.int64()), ("id", pa.int64()), ("grp", pa.int64()), ("score", pa.float64())])
_SENT = ["_g", "_c", "_kind", "id", "grp", "v", "floor"]


def gather(rows: DataFrame, asked: DataFrame, k: int, kernel: Kernel, exclude_self: bool, tasks: int) -> DataFrame:
    """Like `meet`, but the queries of (_g, _c) are held, and its rows go past them, a cell of WIDE rows or less at a time."""
    most = max(SHARD, WIDE // kernel.views)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asking, parts, lists, n = None, [], [], None, 0
        for (g, c, kind), batch in runs(batches, 3):
            if (g, c) != now:
                if parts:
                    lists.meet(parts)
                if lists is not None:
                    yield from lists.found()
                now, asking, parts, lists, n = (g, c), [], [], None, 0
            if not kind:
                asking.append(batch)
            elif asking or lists is not None:
                if lists is None:
                    lists = Lists(asking, k, kernel, exclude_self)
                parts.append(batch)
                n += batch.num_rows
                if n >= most:
                    lists.meet(parts)
                    parts, n = [], 0
        if parts:
            lists.meet(parts)
        if lists is not None:
            yield from lists.found()

    if "floor" not in asked.columns:
        asked = asked.withColumn("floor", F.lit(None).cast("double"))
    rows = rows.withColumns({"_kind": F.lit(1).cast("long"), "floor": F.lit(None).cast("double")}).select(_SENT)
    both = rows.unionByName(asked.withColumn("_kind", F.lit(0).cast("long")).select(_SENT))
    return both.repartition(4 * tasks, "_g", "_c").sortWithinPartitions("_g", "_c", "_kind").mapInArrow(run, _FOUND)  # more than tasks, so that few share one


def meet(rows: DataFrame, asked: DataFrame, k: int, kernel: Kernel, exclude_self: bool, per_group: bool = False) -> DataFrame:
    """The k best rows of every query in every cell (_g, _c) that it was sent to; with a column `floor`, those that reach it.

    per_group: the best row of each grp alone counts, null groups as one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, cell, x = None, [], None, None
        for (g, c, kind), batch in runs(batches, 3):
            if (g, c) != now:
                now, parts, cell, x = (g, c), [], None, None
            if not kind:
                parts.append(batch)
                continue
            if cell is None:
                if not parts:
                    continue
                keys = pa.Table.from_batches([b.select(["id", "grp"]) for b in parts]).combine_chunks()
                order = np.argsort(keys["id"].to_numpy(), kind="stable")
                ids, groups = keys["id"].to_numpy()[order], keys["grp"].take(pa.array(order)).combine_chunks()
                del keys
                x = stacked(parts)[order]
                cell = Cell(x, ids, kernel)
            codes = groups.dictionary_encode(null_encoding="encode").indices.to_numpy() if per_group else None
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                asking = some["id"].to_numpy()
                q = matrix(some["v"])
                floor = np.nan_to_num(some["floor"].to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                if per_group:
                    score = np.round(kernel.score(q, x), 9)
                    if exclude_self:
                        score[asking[:, None] == ids[None, :]] = -np.inf
                    row, col = best_of_groups(score, codes, k)
                    score = score[row, col]
                else:
                    row, col, score = cell.nearest(q, asking, k, floor, exclude_self)
                yield pa.RecordBatch.from_arrays([pa.array(asking[row]), some["grp"].take(pa.array(row)), pa.array(ids[col]), groups.take(pa.array(col)), pa.array(score)], schema=_SCHEMA)

    if "floor" not in asked.columns:
        asked = asked.withColumn("floor", F.lit(None).cast("double"))
    rows = rows.withColumns({"_kind": F.lit(0).cast("long"), "floor": F.lit(None).cast("double")}).select(_SENT)
    both = rows.unionByName(asked.withColumn("_kind", F.lit(1).cast("long")).select(_SENT))
    return both.repartition("_g", "_c").sortWithinPartitions("_g", "_c", "_kind").mapInArrow(run, _FOUND)


def _plain(t: DataFrame) -> DataFrame:
    return t.select(F.col("id").cast("long").alias("id"), F.col("grp").cast("long").alias("grp"), F.col("v").cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")


def split(rows: DataFrame, asked: DataFrame, counts: DataFrame, shard: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with _c: parts of _g in which counts (_g, n) has more than SHARD rows (or `shard`); queries go to every part."""
    shard = shard or SHARD
    large = counts.where(F.col("n") > shard).select(F.col("_g").alias("_large"), F.ceil(F.col("n") / shard).cast("long").alias("_parts"))
    n = large.count()
    if not n:
        return rows.withColumn("_c", F.lit(0).cast("long")), asked.withColumn("_c", F.lit(0).cast("long"))
    large = F.broadcast(large) if n <= FEW else large
    rows = rows.join(large, F.col("_g") == F.col("_large"), "left").withColumn("_c", F.coalesce(F.pmod(F.xxhash64("id", "v"), F.col("_parts")), F.lit(0).cast("long")))
    asked = asked.join(large, F.col("_g") == F.col("_large"), "left").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts") - 1, F.lit(0).cast("long")))))
    return rows.drop("_large", "_parts"), asked.drop("_large", "_parts")


def _shape(n: int, total: int, m: int, k: int, dims: int) -> tuple[int, int]:
    """Pieces of a group of n rows, of `total` in all groups, and parts of its m queries, for `gather`.

    A query is sent to every piece and has a list from each, a row is sent to every part; so few bytes are sent for as
    many tasks. Neither number grows with the rows until parts are full.
    """
    tasks = max(1, -(-TASKS * n // max(1, total)))
    cells = max(1, round((tasks * dims / (dims + 3 * k)) ** 0.5))
    return cells, max(1, -(-tasks // cells), -(-m * (8 * dims + 25 * k) // HELD))


def grid(rows: DataFrame, asked: DataFrame, sizes: list[tuple[int, int, int]]) -> tuple[DataFrame, DataFrame]:
    """Both sides with _c, cell * parts + part: rows of a cell go to all parts, queries of a part to all cells.

    sizes: (_g, cells, parts) of the groups that are dealt; the others are one cell each.
    """
    zero = F.lit(0).cast("long")
    if not sizes:
        return rows.withColumn("_c", zero), asked.withColumn("_c", zero)
    large = F.broadcast(rows.sparkSession.createDataFrame(sizes, "_large long, _cells long, _parts long"))
    rows, asked = (t.join(large, F.col("_g") == F.col("_large"), "left").fillna(1, ["_cells", "_parts"]) for t in (rows, asked))
    part = F.explode(F.sequence(zero, F.col("_parts") - 1))
    rows = rows.withColumn("_n", part).withColumn("_c", F.pmod(F.xxhash64("id", "v"), F.col("_cells")) * F.col("_parts") + F.col("_n"))
    cell = F.explode(F.sequence(zero, F.col("_cells") - 1))
    asked = asked.withColumn("_n", cell).withColumn("_c", F.col("_n") * F.col("_parts") + F.pmod(F.xxhash64("id"), F.col("_parts")))
    return rows.drop("_large", "_cells", "_parts", "_n"), asked.drop("_large", "_cells", "_parts", "_n")


def _dealt(rows: DataFrame, asked: DataFrame, sizes: list[tuple[int, int]], alone: bool, k: int, kernel: Kernel, exclude_self: bool) -> DataFrame:
    """The best rows of each query, of one task or more. sizes: (_g, n) of groups of more than SHARD rows; alone: there are no others."""
    total, most = sum(n for _, n in sizes), max(SHARD, WIDE // kernel.views)
    wide = [(g, n) for g, n in sizes if n > most]
    few = [(g, 1, max(1, min(-(-n // SHARD), -(-TASKS * n // max(1, total))))) for g, n in sizes if n <= most]
    if not wide:
        return meet(*grid(rows, asked, few), k, kernel, exclude_self)
    apart = F.broadcast(rows.sparkSession.createDataFrame([(g,) for g, _ in wide], "_wide long"))
    same = F.col("_g") == F.col("_wide")
    far, asking = (t.join(apart, same, "left_semi") for t in (rows, asked))
    counts = dict(tuple(r) for r in asking.groupBy("_g").agg(F.count("*")).collect())  # FEW at most
    dims = (far.select(F.size("v")).first() or [1])[0]
    shapes = [(g, *_shape(n, total, counts.get(g, 0), k, dims)) for g, n in wide]
    found = gather(*grid(far, asking, shapes), k, kernel, exclude_self, sum(c * p for _, c, p in shapes))
    if alone and not few:
        return found
    rows, asked = (t.join(apart, same, "left_anti") for t in (rows, asked))
    return found.unionByName(meet(*grid(rows, asked, few), k, kernel, exclude_self))


def topk(corpus: DataFrame, queries: DataFrame, k: int, kernel: Kernel = COSINE, same_group: bool = False, exclude_self: bool = True) -> DataFrame:
    """query_id, query_grp, id, grp, score, rank (bigint, from 1). Raises ValueError if k < 1.

    With same_group, queries meet the rows of their own group only, and null groups meet nothing. Ids are keys: rows of
    the same id and vector land in one cell. Rows without an id or a vector take no part.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows, asked = _plain(corpus), _plain(queries)
    if same_group:
        rows, asked = (t.where("grp IS NOT NULL").withColumn("_g", F.col("grp")) for t in (rows, asked))
        counts = rows.groupBy("_g").agg(F.count("*").alias("n"))
        large = counts.where(F.col("n") > SHARD).limit(FEW + 1).toArrow()
        if large.num_rows > FEW:
            return ranked(meet(*split(rows, asked, counts), k, kernel, exclude_self), k)
        sizes = list(zip(large["_g"].to_pylist(), large["n"].to_pylist()))
        return ranked(_dealt(rows, asked, sizes, False, k, kernel, exclude_self), k)
    n = rows.count()
    if n <= SHARD or kernel.embed is None:
        rows, asked = (t.withColumn("_g", F.lit(0).cast("long")) for t in (rows, asked))
        return ranked(_dealt(rows, asked, [(0, n)] if n > SHARD else [], True, k, kernel, exclude_self), k)
    return _pruned(rows, asked, n, k, kernel, exclude_self)


def _whole(x: np.ndarray) -> np.ndarray:
    """Which rows have length 1; angles say nothing of others."""
    return np.abs(np.linalg.norm(x, axis=1) - 1) < 1e-9


def distinct_groups(corpus: DataFrame, queries: DataFrame, k: int, kernel: Kernel = COSINE, pool: int = 80, exclude_self: bool = True) -> DataFrame:
    """query_id, query_grp, id, grp, score, rank: the best row of each of the k best groups (samples).

    A first search takes the `pool` best rows, or 4 k if that is more. Queries whose pool has k groups, or all rows there
    are, are done. The others, whose nearest rows belong to few groups, meet all cells once more, and each cell gives its
    best row a group; so a group may hold any number of the first places, and no pool is grown to get past it.
    """
    pool = max(pool, 4 * k)
    n = corpus.where("id IS NOT NULL AND v IS NOT NULL").count()
    found = written(topk(corpus, queries, pool, kernel, exclude_self=exclude_self))
    same = Window.partitionBy("query_id", "grp").orderBy(F.desc("score"), F.asc("id"))
    first = found.drop("rank").withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    if pool >= n:
        return ranked(first, k)
    full = found.groupBy("query_id").agg((F.count_distinct("grp") + F.max(F.col("grp").isNull().cast("int"))).alias("groups")).where(F.col("groups") >= k).select("query_id")
    rest = queries.join(full, F.col("id") == F.col("query_id"), "left_anti")
    rows, asked = (_plain(t).withColumn("_g", F.lit(0).cast("long")) for t in (corpus, rest))
    rows, asked = split(rows, asked, corpus.sparkSession.range(1).select(F.lit(0).cast("long").alias("_g"), F.lit(n).alias("n")))
    again = meet(rows, asked, k, kernel, exclude_self, per_group=True)
    again = again.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return ranked(first.join(full, "query_id", "left_semi").unionByName(again), k)


def near_centres(rows: DataFrame, centres: np.ndarray, embed: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """rows with _g, the centre of the largest product, and its angle; rows that aren't of length 1 have the angle pi, so no bound excludes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = embed(matrix(batch["v"]))
            product = np.nan_to_num(x @ centres.T)
            at = product.argmax(axis=1)
            angle = np.where(_whole(x), np.arccos(np.clip(product[np.arange(len(x)), at], -1, 1)), np.pi)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(angle)], names=[*batch.schema.names, "_g", "angle"])

    return rows.mapInArrow(run, rows.select("*", F.lit(0).cast("long").alias("_g"), F.lit(0.0).alias("angle")).schema)


def _wanted(batch: pa.RecordBatch, centres: np.ndarray, reach: np.ndarray, embed: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Which other centres' bounds reach the floor of each row of a batch."""
    x = embed(matrix(batch["v"]))
    angle = np.arccos(np.clip(np.nan_to_num(x @ centres.T), -1, 1))
    angle[~_whole(x)] = 0
    bound = np.cos(np.clip(angle - reach, 0, np.pi))
    floor = batch["floor"].to_numpy(zero_copy_only=False)
    wanted = ~(bound < np.nan_to_num(floor, nan=-2.0)[:, None] - SLACK) & ~np.isnan(reach)
    wanted[np.arange(len(x)), batch["_g"].to_numpy()] = False
    return wanted


def copies(asked: DataFrame, centres: np.ndarray, reach: np.ndarray, embed: Callable[[np.ndarray], np.ndarray], cells: np.ndarray) -> int:
    """How many rows `sent_on` has, and each goes to all cells of its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int((_wanted(batch, centres, reach, embed) @ cells).sum())])], names=["n"])

    return asked.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def sent_on(asked: DataFrame, centres: np.ndarray, reach: np.ndarray, embed: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A row (_g, id, grp, v, floor) for every other centre whose bound reaches a query's floor.

    reach: each centre's largest angle, NaN without rows. A row within angle r of the centre has at most the cosine of
    (the query's angle to the centre - r) with the query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_g", pa.int64()), ("id", pa.int64()), ("grp", pa.int64()), ("v", pa.list_(pa.float64())), ("floor", pa.float64())])
        for batch in batches:
            row, at = np.nonzero(_wanted(batch, centres, reach, embed))
            for s in range(0, len(row), BLOCK):
                some = batch.take(pa.array(row[s : s + BLOCK]))
                yield pa.RecordBatch.from_arrays([pa.array(at[s : s + BLOCK]), *(some[c] for c in ("id", "grp", "v", "floor"))], schema=schema)

    return asked.mapInArrow(run, "_g long, id long, grp long, v array<double>, floor double")


def _pruned(rows: DataFrame, asked: DataFrame, n: int, k: int, kernel: Kernel, exclude_self: bool) -> DataFrame:
    most = min(CENTRES, -(-n // SHARD))
    seeds = rows.select("id", "v").distinct().orderBy(F.xxhash64("id"), "id").limit(most).select("v").toArrow()  # CENTRES rows at most
    centres = vectors.units(kernel.embed(matrix(seeds["v"].combine_chunks())))
    placed = written(near_centres(rows, centres, kernel.embed))
    known = placed.groupBy("_g").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).toArrow()  # a row a centre at most
    reach = np.full(len(centres), np.nan)
    reach[known["_g"].to_numpy()] = known["angle"].to_numpy()
    shards = np.zeros(len(centres), np.int64)
    shards[known["_g"].to_numpy()] = -(-known["n"].to_numpy() // SHARD)
    counts = rows.sparkSession.createDataFrame(known.select(["_g", "n"]).to_pandas()) if known.num_rows else placed.select("_g", F.lit(0).alias("n"))
    m = asked.count()
    dims = centres.shape[1]
    cells, parts = _shape(n, n, m, k, dims)

    def first_cells(asked: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """What queries find near their own centre, they themselves with the floor that this is, and whether bounds spare less than the grid."""
        mine = near_centres(asked, centres, kernel.embed).drop("angle")
        found = written(meet(*split(placed.drop("angle"), mine, counts), k, kernel, exclude_self))
        floors = ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("floor"))
        waiting = written(mine.join(floors, F.col("id") == F.col("_q"), "left").select("id", "grp", "v", "_g", "floor"))
        some = waiting.count()
        sent = copies(waiting, centres, reach, kernel.embed, shards) * (dims + k)  # a third of a list comes back from each
        return found, waiting, sent * m > (cells * m * (dims + 3 * k) + parts * n * dims) * some

    def on_grid(asked: DataFrame) -> DataFrame:
        return ranked(_dealt(*(t.withColumn("_g", F.lit(0).cast("long")) for t in (rows, asked)), [(0, n)], True, k, kernel, exclude_self), k)

    if m > 2 * PROBE and first_cells(asked.orderBy(F.xxhash64("id"), "id").limit(PROBE))[2]:  # says which way is shorter, no more
        return on_grid(asked)
    found, waiting, dense = first_cells(asked)
    if dense:
        return on_grid(waiting)
    here, then = split(placed.drop("angle"), sent_on(waiting, centres, reach, kernel.embed), counts)
    return ranked(found.unionByName(meet(here, then, k, kernel, exclude_self)), k)


def ranked(rows: DataFrame, k: int | None = None, by: str = "score", per: str = "query_id") -> DataFrame:
    """rank within each query by score, ties to the smaller id; the k first."""
    order = Window.partitionBy(per).orderBy(F.desc(by), F.asc("id"))
    out = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def counted_above(corpus: DataFrame, marks: DataFrame, kernel: Kernel = COSINE, exclude_self: bool = True) -> DataFrame:
    """query_id, above: how many rows stand before a mark in each query's full ranking, without the ranking.

    marks: (id, grp, v, mark, mark_id), a query with the score and the id of the row in question. Rows count that score
    more, or the same with a smaller id. Each cell gives one number a query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, cell = None, [], None
        for (g, c, kind), batch in runs(batches, 3):
            if (g, c) != now:
                now, parts, cell = (g, c), [], None
            if not kind:
                parts.append(batch)
                continue
            if not parts:
                continue
            if cell is None:
                whole = pa.Table.from_batches(parts)
                cell = matrix(whole["v"].combine_chunks()), whole["id"].to_numpy()
            x, ids = cell
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                asking, mark, mark_id = (some[c].to_numpy() for c in ("id", "mark", "mark_id"))
                score = np.round(kernel.score(matrix(some["v"]), x), 9)
                before = (score > mark[:, None]) | (score == mark[:, None]) & (ids[None, :] < mark_id[:, None])
                if exclude_self:
                    before &= asking[:, None] != ids[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(asking), pa.array(before.sum(axis=1))], names=["query_id", "above"])

    rows = _plain(corpus).withColumn("_g", F.lit(0).cast("long"))
    asked = marks.select("id", "grp", F.col("v").cast("array<double>").alias("v"), "mark", "mark_id").withColumn("_g", F.lit(0).cast("long"))
    rows, asked = split(rows, asked, rows.groupBy("_g").agg(F.count("*").alias("n")))
    columns = ["_g", "_c", "_kind", "id", "v", "mark", "mark_id"]
    rows = rows.withColumns({"_kind": F.lit(0).cast("long"), "mark": F.lit(None).cast("double"), "mark_id": F.lit(None).cast("long")}).select(columns)
    both = rows.unionByName(asked.withColumn("_kind", F.lit(1).cast("long")).select(columns))
    met = both.repartition("_g", "_c").sortWithinPartitions("_g", "_c", "_kind").mapInArrow(run, "query_id long, above long")
    return met.groupBy("query_id").agg(F.sum("above").alias("above"))
