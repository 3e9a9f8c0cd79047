"""One-to-one choices: a series with a margin to the next best, and greedy matching in order of distance."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import vectors
from ridgeline.operators import hypotheses, nearest
from ridgeline.storage import written

# Least similarity of equal or neighbouring state counts, of 7 against 9, the margin, state counts there are.
SAME_STATES, SEVEN_NINE, MARGIN, STATES = 0.97, 0.95, 0.015, (1, 20)
#: Rows that one task matches at the end, of whichever key has most of them.
ALONE = 1_000_000


def _accepts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least similarity of a submitted and a source's state count; infinite where none will do."""
    near = (a == b) | (np.abs(a - b) <= 1) & (b >= STATES[0]) & (b <= STATES[1])
    swapped = (a == 7) & (b == 9) | (a == 9) & (b == 7)
    return np.where(near, SAME_STATES, np.where(swapped, SEVEN_NINE, np.inf))


def _series_score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The aligned similarity, 4 more where it is accepted. The first component is the state count."""
    score = np.round(vectors.aligned(a[:, 1:], b[:, 1:]), 9)
    return score + 4.0 * (score >= _accepts(a[:, :1], b[None, :, 0]))


def _series_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_series_score of row i of a with row i of b."""
    score = np.round(hypotheses.paired_scores(a[:, 1:], b[:, 1:], 1), 9)
    return score + 4.0 * (score >= _accepts(a[:, 0], b[:, 0]))


SERIES = nearest.Kernel(
    _series_score, left=lambda a: hypotheses.left(a[:, 1:]), right=lambda b: hypotheses.right(b[:, 1:]), views=hypotheses.VIEWS, pairs=_series_pairs, always=min(SAME_STATES, SEVEN_NINE),
)


def match_series(submitted: DataFrame, series: DataFrame, margin: float = MARGIN) -> DataFrame:
    """id, status, series, similarity, runner_up of every submitted curve.

    Both sides are (id, source, states, v); a curve is held against the series of its source. Status: `matched` to the
    best accepted one, `ambiguous` if another accepted one is less than the margin behind, `rejected` if none is accepted
    (similarity is the best there is), `no_series` if the source has none. Two best rows a curve leave each cell of a
    source, and meet in a partial maximum; a source of any size is many cells.
    """
    curves = [t.select("id", F.col("source").cast("long").alias("grp"), F.concat(F.array(F.col("states").cast("double")), F.col("v").cast("array<double>")).alias("v")) for t in (series, submitted)]
    found = nearest.topk(*curves, 2, SERIES, same_group=True, exclude_self=False)
    at = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    two = found.groupBy(F.col("query_id").alias("_id")).agg(at(1, "id").alias("series"), at(1, "score").alias("first"), at(2, "score").alias("second"))
    out = submitted.select("id").join(two, F.col("id") == F.col("_id"), "left")
    plain = lambda c: F.round(F.when(F.col(c) > 2, F.col(c) - 4).otherwise(F.col(c)), 9)
    rival = F.coalesce((F.col("second") > 2) & (F.round(F.col("first") - F.col("second"), 9) < margin), F.lit(False))
    status = F.when(F.col("first").isNull(), "no_series").when(F.col("first") <= 2, "rejected").when(rival, "ambiguous").otherwise("matched")
    return out.select("id", status.alias("status"), F.when(status == "matched", F.col("series")).alias("series"), plain("first").alias("similarity"), plain("second").alias("runner_up"))


def greedy(at: np.ndarray, right: np.ndarray, ids: np.ndarray, gate: float, low: float = -np.inf, high: float = np.inf) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs (left, right) of places in the order of (distance, left id, right id), and which places stay undecided.

    Rows are sorted by (at, right). Rows elsewhere may lie at or beyond low and high: a pair that is no shorter than the
    way to them may lose a row to one of them, so it stays undecided, and so does whatever would depend on it. The closest
    pair that is left is always of neighbours, rows of one side at one place counting as one.
    """
    starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (right[1:] != right[:-1])]).tolist() if len(at) else []
    free = [sorted(range(s, e), key=ids.__getitem__, reverse=True) for s, e in zip(starts, [*starts[1:], len(at)])]  # the smallest id last
    place, side = [float(at[s]) for s in starts], [bool(right[s]) for s in starts]
    before, after = list(range(-1, len(starts) - 1)), [*range(1, len(starts)), -1]
    waiting = [False] * len(starts)
    heap: list[tuple[float, int, int, int, int]] = []

    def look(n: int) -> None:
        """Offers n and the next row of the other side, before and after it; undecided ones of its own side may go, so they don't stand between."""
        for way in (before, after) if free[n] else ():
            m = way[n]
            while m >= 0 and side[m] == side[n] and waiting[m]:
                m = way[m]
            if m >= 0 and side[m] != side[n] and abs(place[m] - place[n]) <= gate and not (waiting[n] and waiting[m]):
                left, r = (m, n) if side[n] else (n, m)
                heapq.heappush(heap, (abs(place[m] - place[n]), int(ids[free[left][-1]]), int(ids[free[r][-1]]), left, r))

    def stir(n: int) -> None:
        """Looks again from n, and from the rows around it up to the first that isn't undecided."""
        look(n)
        for way in (before, after):
            m = way[n]
            while m >= 0 and abs(place[m] - place[n]) <= 2 * gate:
                look(m)
                if not waiting[m]:
                    break
                m = way[m]

    for n in range(len(starts)):
        look(n)
    pairs = []
    while heap:
        d, i, j, left, r = heapq.heappop(heap)
        if not free[left] or not free[r] or ids[free[left][-1]] != i or ids[free[r][-1]] != j or waiting[left] and waiting[r]:
            continue
        if waiting[left] or waiting[r] or d >= min(place[left], place[r]) - low or d >= high - max(place[left], place[r]):
            for n in (left, r):
                if not waiting[n]:
                    waiting[n] = True
                    stir(n)
            continue
        pairs.append((free[left].pop(), free[r].pop()))
        for n in (left, r):
            if not free[n]:
                if before[n] >= 0:
                    after[before[n]] = after[n]
                if after[n] >= 0:
                    before[after[n]] = before[n]
        for n in (left, r):
            stir(n)
    undecided = np.zeros(len(at), bool)
    for n, wait in enumerate(waiting):
        if wait or place[n] - low <= gate or high - place[n] <= gate:  # or alone here, with rows elsewhere in reach
            undecided[free[n]] = True
    return pairs, undecided


_OUT = "who long, left long, right long, distance double, open_at double, open_right boolean, open_id long"


def _match(rows: DataFrame, gate: float, complete: bool) -> DataFrame:
    """Pairs, and undecided rows, of partitions sorted by (who, at, right). complete: every key lies in one partition."""
    schema = pa.schema([("who", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("distance", pa.float64()), ("open_at", pa.float64()), ("open_right", pa.bool_()), ("open_id", pa.int64())])

    def answer(table: pa.Table, first: bool, last: bool) -> pa.RecordBatch:
        who, at, ids = (table[c].to_numpy() for c in ("who", "at", "id"))
        right = table["right"].to_numpy().astype(bool)
        pairs, undecided = greedy(at, right, ids, gate, at[0] if first else -np.inf, at[-1] if last else np.inf)
        x = np.array(pairs, np.int64).reshape(-1, 2)
        o = np.flatnonzero(undecided)
        n, m = len(x), len(o)
        none = lambda count, kind: pa.nulls(count, kind)
        columns = [pa.array(np.repeat(who[:1], n + m))]
        for values in (ids[x[:, 0]], ids[x[:, 1]], np.abs(at[x[:, 0]] - at[x[:, 1]])):
            columns.append(pa.concat_arrays([pa.array(values), none(m, pa.array(values).type)]))
        for values in (at[o], right[o], ids[o]):
            columns.append(pa.concat_arrays([none(n, pa.array(values).type), pa.array(values)]))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, first = None, [], True
        for key, batch in nearest.runs(batches, 1):
            if key != now and parts:
                yield answer(pa.Table.from_batches(parts), first and not complete, False)
                parts, first = [], False
            now = key
            parts.append(batch)
        if parts:
            yield answer(pa.Table.from_batches(parts), first and not complete, not complete)

    dealt = rows.repartition("who") if complete else rows.repartitionByRange("who", "at", "right", "id")
    return dealt.sortWithinPartitions("who", "at", "right", "id").mapInArrow(run, _OUT)


def greedy_matches(rows: DataFrame, gate: float) -> DataFrame:
    """who, left, right, distance: left and right rows of each key one to one, in the order of (distance, left, right).

    rows: (who, at, right, id), with ids that are unique among the left and among the right rows of a key. Pairs further
    apart than the gate don't match. Nulls take no part. Every task matches a range of (who, at), and decides all pairs
    that rows of other ranges can't change; what is left lies near the ends of ranges, and goes through the next round,
    until no key has more than ALONE rows of it, which are matched as a whole. So no key goes to one task as long as ranges
    decide anything; they don't where all rows of a range lie within the gate of its ends.
    """
    left = written(rows.select(F.col("who").cast("long").alias("who"), F.col("at").cast("double").alias("at"), F.col("right").cast("boolean").alias("right"), F.col("id").cast("long").alias("id")).dropna())
    out, n, stuck = None, left.count(), False
    while True:
        largest = left.groupBy("who").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        complete = largest <= ALONE or stuck
        round_ = written(_match(left, gate, complete))
        pairs = round_.where("left IS NOT NULL").select("who", "left", "right", "distance")
        out = pairs if out is None else out.unionByName(pairs)
        if complete:
            return out
        left = written(round_.where("open_id IS NOT NULL").select("who", F.col("open_at").alias("at"), F.col("open_right").alias("right"), F.col("open_id").alias("id")))
        n, had = left.count(), n
        stuck = n == had
