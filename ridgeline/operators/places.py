"""The best compatible rows of every row, and how many stand before a marked one, in one pass over the pairs that fit.

Rows are (id, code, name, v). Rows of two codes fit if one of them is 0 (blank). A task holds queries by code, and rows go
past them by code, so that a block of queries meets the blank rows and those of its own codes alone. What may be among the
k best, or is too near the mark to tell, is scored exactly; the rest is counted in single precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.vectors import units
from ridgeline.operators import nearest

_SENT = ["_c", "_kind", "id", "code", "name", "v", "mark", "mark_id", "floor"]
_FOUND = "query_id long, above long, best array<struct<below double, id long, good boolean>>"


def _columns(batches: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    t = pa.Table.from_batches([b.select(list(names)) for b in batches])
    return [t[n].to_numpy() for n in names]


class Held:
    """Queries in the order of their codes; the k best rows of each and how many stood before its mark so far."""

    def __init__(self, asked: list[pa.RecordBatch], k: int):
        """asked: emptied, as rows are in `meet`."""
        codes = _columns(asked, "code")[0]
        order = np.argsort(codes, kind="stable")
        self.codes, self.k = codes[order], k
        self.ids, self.names, mark, mark_id, floor = (c[order] for c in _columns(asked, "id", "name", "mark", "mark_id", "floor"))
        self.mark, self.floor = mark.astype(float), np.nan_to_num(floor.astype(float), nan=-np.inf)
        self.mark_id = np.nan_to_num(mark_id.astype(float)).astype(np.int64) if mark_id.dtype.kind == "f" else mark_id
        self.q = units(nearest.stacked(asked))[order]
        self.slack = (self.q.shape[1] + 8) * 2.0**-22
        shape = len(self.ids), k
        self.score, self.id, self.good, self.above = np.full(shape, -np.inf), np.zeros(shape, np.int64), np.zeros(shape, bool), np.zeros(len(self.ids), np.int64)
        blank = int(np.searchsorted(self.codes, 0, "right"))
        self.blocks = [(s, min(s + nearest.BLOCK, e)) for b, e in ((0, blank), (blank, len(codes))) for s in range(b, e, nearest.BLOCK)]

    def meet(self, rows: list[pa.RecordBatch]) -> None:
        ids, codes, names = _columns(rows, "id", "code", "name")
        order = np.lexsort((ids, codes))
        self.row_ids, self.row_codes, names = ids[order], codes[order], names[order]
        self.x = units(nearest.stacked(rows))[order]
        self.single = np.ascontiguousarray(self.x, np.float32)
        by_id = np.argsort(self.row_ids, kind="stable")
        sorted_ids, blank = self.row_ids[by_id], int(np.searchsorted(self.row_codes, 0, "right"))
        for s, e in self.blocks:
            low, high = self.codes[s], self.codes[e - 1]
            first, last = np.searchsorted(self.row_codes, low, "left"), np.searchsorted(self.row_codes, high, "right")
            spans = [(0, len(ids), False)] if not high else [(0, blank, False), (int(first), int(last), low != high)]
            at, n = (np.searchsorted(sorted_ids, self.ids[s:e], side) for side in ("left", "right"))
            n -= at
            own = np.repeat(np.arange(e - s), n), by_id[np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())]
            row, col, score = self._block(s, e, spans, own)
            if len(row):
                good = (names[col] != 0) & (names[col] == self.names[s + row])
                self._merge(s, row, score, self.row_ids[col], good)

    def _block(self, s: int, e: int, spans: list[tuple[int, int, bool]], own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and score of what may be among the k best of the queries from s to e; counts what stands before their marks."""
        mark, slack, k = self.mark[s:e], self.slack, self.k
        over, under = np.nan_to_num(mark, nan=np.inf) + slack, np.nan_to_num(mark, nan=np.inf) - slack
        held = np.maximum(self.floor[s:e], self.score[s:e, -1])
        least, asked, done, hits = held - slack, np.ascontiguousarray(self.q[s:e], np.float32), [], []
        for a, b in ((c, min(c + nearest.SHARD, end)) for start, end, _ in spans for c in range(start, end, nearest.SHARD)):
            near = asked @ self.single[a:b].T
            if any(mixed and start <= a < end for start, end, mixed in spans):
                near[self.codes[s:e, None] != self.row_codes[None, a:b]] = -np.inf
            here = (own[1] >= a) & (own[1] < b)
            near[own[0][here], own[1][here] - a] = -np.inf
            unknown = np.flatnonzero(least == -np.inf)
            if len(unknown) and b - a >= k:
                some = np.nan_to_num(near[unknown], nan=-np.inf, neginf=-np.inf)
                least[unknown] = np.partition(some, b - a - k, axis=1)[:, b - a - k] - slack
            reach = np.nextafter(np.minimum(least, under).astype(np.float32), np.float32(-np.inf))
            hit = near >= reach[:, None]
            if not np.isfinite(reach).all():
                hit &= near > -np.inf
            flat = nearest.hits_of(hit)
            row, col = np.divmod(flat, b - a)
            value = near.ravel()[flat].astype(float)
            sure = value > over[row]
            want = (value >= least[row]) | ~sure & (value >= under[row])
            if np.count_nonzero(want) > max(4 * k, 64) * (e - s):
                done.append(self._dense(s, e, a, b, near, held))
                continue
            self.above[s:e] += np.bincount(row[sure], minlength=e - s)
            hits.append((row[want], col[want] + a, value[want], sure[want]))
        if hits:
            row, col, value, sure = (np.concatenate(c) for c in zip(*hits))
            order = np.lexsort((-value, row))
            row, col, value, sure = row[order], col[order], value[order], sure[order]
            kth = nearest._place(row) == k - 1
            least[row[kth]] = np.maximum(least[row[kth]], value[kth] - slack)
            keep = (value >= least[row]) | ~sure & (value >= under[row])
            row, col, sure = row[keep], col[keep], sure[keep]
            score = np.concatenate([np.zeros(0), *[np.round(np.clip(np.einsum("ij,ij->i", self.q[s + row[i : i + nearest.SHARD]], self.x[col[i : i + nearest.SHARD]]), -1.0, 1.0), 9) for i in range(0, len(row), nearest.SHARD)]])
            before = ~sure & self._before(score, mark[row], self.row_ids[col], self.mark_id[s + row])
            self.above[s:e] += np.bincount(row[before], minlength=e - s)
            fit = np.isfinite(score) & (score >= held[row])
            done.append((row[fit], col[fit], score[fit]))
        return tuple(np.concatenate(c) for c in zip(*done)) if done else (np.zeros(0, np.int64),) * 3

    def _dense(self, s: int, e: int, a: int, b: int, near: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like `_block` for rows of which too many come near: all are scored."""
        order = np.argsort(self.row_ids[a:b], kind="stable")
        score = np.round(np.clip(self.q[s:e] @ self.x[a:b].T, -1.0, 1.0), 9)
        score[near == -np.inf] = -np.inf
        score = score[:, order]
        self.above[s:e] += self._before(score, self.mark[s:e, None], self.row_ids[a:b][order][None, :], self.mark_id[s:e, None]).sum(axis=1)
        score[score < held[:, None]] = -np.inf
        row, col = nearest.best(score, self.k)
        return row, order[col] + a, score[row, col]

    @staticmethod
    def _before(score: np.ndarray, mark: np.ndarray, ids: np.ndarray, mark_id: np.ndarray) -> np.ndarray:
        return (score > mark) & (ids != mark_id) | (score == mark) & (ids < mark_id)

    def _merge(self, s: int, row: np.ndarray, *new: np.ndarray) -> None:
        at, n = np.unique(row, return_inverse=True)
        held = self.score, self.id, self.good
        every = [np.concatenate([h[at + s].ravel(), x]) for h, x in zip(held, new)]
        n = np.concatenate([np.repeat(np.arange(len(at)), self.k), n])
        order = np.lexsort((every[1], -every[0], n))
        order = order[nearest._place(n[order]) < self.k]
        for h, x in zip(held, every):
            h[at + s] = x[order].reshape(len(at), self.k)

    def found(self) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(self.ids), 8 * nearest.BLOCK):
            some = slice(s, s + 8 * nearest.BLOCK)
            there = np.isfinite(self.score[some])
            offsets = np.r_[0, np.cumsum(there.sum(axis=1))].astype(np.int32)
            best = pa.StructArray.from_arrays([pa.array(0.0 - self.score[some][there]), pa.array(self.id[some][there]), pa.array(self.good[some][there])], ["below", "id", "good"])
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[some]), pa.array(self.above[some], mask=np.isnan(self.mark[some])), pa.ListArray.from_arrays(pa.array(offsets), best)], names=["query_id", "above", "best"])


def places(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, above (null without a mark) and best: below (the score, negative), id and good (the same name, not 0), from the best on.

    rows: (id, code, name, v), longs that aren't null and arrays of doubles; asked: these and mark, mark_id and floor, the
    score and id of the row before which others are counted, and a score that k rows are known to reach. Rows of the
    query's own id don't count. Scores are cosines at nine decimals, ties go to the smaller id.
    """
    n, m = rows.count(), asked.count()
    dims = (rows.select(F.size("v")).first() or [1])[0]
    cells, parts = nearest._shape(n, n, m, k, dims) if n > nearest.SHARD else (1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asking, some, held, size = None, [], [], None, 0
        for (c, kind), batch in nearest.runs(batches, 2):
            if c != now:
                if some:
                    held.meet(some)
                if held is not None:
                    yield from held.found()
                now, asking, some, held, size = c, [], [], None, 0
            if not kind:
                asking.append(batch)
            elif asking or held is not None:
                held = held or Held(asking, k)
                some.append(batch)
                size += batch.num_rows
                if size >= nearest.WIDE:
                    held.meet(some)
                    some, size = [], 0
        if some:
            held.meet(some)
        if held is not None:
            yield from held.found()

    rows, asked = nearest.grid(*(t.withColumn("_g", F.lit(0).cast("long")) for t in (rows, asked)), [(0, cells, parts)])
    rows = rows.withColumns({"_kind": F.lit(1).cast("long"), "mark": F.lit(None).cast("double"), "mark_id": F.lit(None).cast("long"), "floor": F.lit(None).cast("double")}).select(_SENT)
    both = rows.unionByName(asked.withColumn("_kind", F.lit(0).cast("long")).select(_SENT))
    met = both.repartitionById(cells * parts, F.col("_c").cast("int")).sortWithinPartitions("_c", "_kind").mapInArrow(run, _FOUND)
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    return met.groupBy("query_id").agg(F.sum("above").alias("above"), best.alias("best"))
