"""Exact top-k search by inner product: ball-tree branch and bound in every shard of the candidates.

Components become integers, floor(1024 x), and scores are integer inner products. Candidates are dealt out once, to shards
of rows near one of CENTRES rows at most; a centre with more than SHARD rows is several shards. Every shard is a ball: no
score of its rows is above q.c + r|q|. A query first goes to the shards of the ball of the largest bound; its kth score
there is shared with all tasks, as it goes on only to balls whose bound reaches it, and takes it along. A task builds a
ball tree over a shard, streams the queries sent to it and visits nodes in the order of their bounds; a query leaves a
subtree whose bound is below its current kth score. What is left of all shards, at most k rows of each for a query, is
ranked. Queries never pass through the driver, which sees counts, centres and radii.

Vectors that are null, empty or hold null, NaN or infinite components take no part, nor do rows without an id. Vectors
are compared with those of their own length only. Ties go to the smaller id, and a bound equal to the kth score is still
searched. Repeated rows of one id: candidates count each, as a query the id counts once (its vector of least order).
Components and scores beyond the range of a long stay at its ends. Fewer than k candidates: all of them. Columns besides id and vector are dropped, so their names can't clash. An empty
table or no query: an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import bounded, written
from ridgeline.operators.nearest import runs, split

#: Rows of a leaf, of a shard; centres, which all tasks hold; queries that visit a tree together.
LEAF, SHARD, CENTRES, BLOCK = 64, 1 << 13, 4096, 4096
#: No score; its negative exists too.
NONE = -(2**63 - 1)


def integers(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: vectors that take part, in integers."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & whole)
    return rows.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * 1024).cast("long")).alias("v"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; beyond the range of a long they stay at its ends."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    if most < 2**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, NONE + 1, 2**63 - 1).astype(np.int64)


class Ball:
    """A node: centre, radius and either two children or the rows of a leaf."""

    __slots__ = ("centre", "radius", "length", "left", "right", "ids", "rows")

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        x = rows.astype(float)
        self.centre = x.mean(axis=0)
        self.radius = float(np.sqrt(((x - self.centre) ** 2).sum(axis=1).max()))
        self.length = float(np.sqrt((self.centre**2).sum()))
        self.left = self.right = self.ids = self.rows = None
        if len(ids) <= LEAF:
            self.ids, self.rows = ids, rows
            return
        far = x[((x - self.centre) ** 2).sum(axis=1).argmax()]
        other = x[((x - far) ** 2).sum(axis=1).argmax()]
        order = np.argsort(x @ (other - far), kind="stable")
        half = len(order) // 2
        self.left, self.right = Ball(ids[order[:half]], rows[order[:half]]), Ball(ids[order[half:]], rows[order[half:]])

    def bound(self, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """At least the score of every row below, for each query; the last term covers rounding."""
        reach = self.radius * norms
        centre = q @ self.centre
        return centre + reach + 1e-9 * (np.abs(centre) + reach) + 1e-12 * norms * self.length + 0.5


class Search:
    """The k best of what it has seen for each query of a block, scores descending and ids ascending."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.real, self.norms = q.astype(float), np.sqrt((q.astype(float) ** 2).sum(axis=1))
        self.scores = np.full((len(ids), k), NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.kth = np.full(len(ids), -np.inf) if least is None else least.copy()

    def visit(self, node: Ball, who: np.ndarray) -> None:
        bounds = node.bound(self.real[who], self.norms[who])
        who = who[bounds >= self.kth[who]]
        if not len(who):
            return
        if node.rows is not None:
            self.add(who, node.ids, products(self.q[who], node.rows))
            return
        left = node.left.bound(self.real[who], self.norms[who])
        first = left >= node.right.bound(self.real[who], self.norms[who])
        self.visit(node.left, who[first])
        self.visit(node.right, who)
        self.visit(node.left, who[~first])

    def add(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        own = self.ids[who][:, None] == ids[None, :]
        hopeful = ((scores >= self.kth[who][:, None]) & ~own).any(axis=1)
        who, scores, own = who[hopeful], scores[hopeful], own[hopeful]
        if not len(who):
            return
        scores = np.where(own, NONE, scores)
        s = np.concatenate([self.scores[who], scores], axis=1)
        i = np.concatenate([self.found[who], np.where(own, np.iinfo(np.int64).max, ids[None, :])], axis=1)
        order = np.lexsort((i, -s), axis=-1)[:, : self.k]
        self.scores[who], self.found[who] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        last = self.scores[who][:, -1]
        self.kth[who] = np.maximum(self.kth[who], np.where(last == NONE, -np.inf, last.astype(float)))


def bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """At least the score of every row of each ball, for each query; the last terms cover rounding."""
    norms = np.linalg.norm(q, axis=1)[:, None]
    centre, reach = q @ centres.T, norms * radii[None, :]
    return centre + reach + 1e-9 * (np.abs(centre) + reach) + 1e-12 * norms * np.linalg.norm(centres, axis=1)[None, :] + 0.5


def lengths(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors v of a batch: the places of its rows, and their matrix."""
    size = batch["v"].value_lengths().to_numpy()
    out = []
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        out.append((at, batch["v"].take(pa.array(at)).flatten().to_numpy().reshape(len(at), n)))
    return out


class Balls:
    """Centres of each length of vectors, with the place of each among all, and radii once these are known."""

    def __init__(self, seeds: list[list[int]]) -> None:
        self.at: dict[int, np.ndarray] = {}
        self.centres: dict[int, np.ndarray] = {}
        for n in {len(s) for s in seeds}:
            self.at[n] = np.array([i for i, s in enumerate(seeds) if len(s) == n])
            self.centres[n] = np.array([seeds[i] for i in self.at[n]], float)
        self.radii = np.full(len(seeds), np.nan)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row and its distance; minus the length, where no centre has it."""
        n = x.shape[1]
        if n not in self.at:
            return np.full(len(x), -n), np.zeros(len(x))
        c = self.centres[n]
        x = x.astype(float)
        at = ((c**2).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)
        return self.at[n][at], np.linalg.norm(x - c[at], axis=1)

    def reached(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The balls of the queries' length that have rows, and the queries' bounds there."""
        n = q.shape[1]
        at = self.at.get(n, np.zeros(0, np.int64))
        known = ~np.isnan(self.radii[at])
        if not known.any():
            return np.array([-n]), np.full((len(q), 1), np.inf)
        return at[known], bounds(q.astype(float), self.centres[n][known], self.radii[at[known]])


def _placed(rows: DataFrame, balls: Balls) -> DataFrame:
    """rows with _g, the ball, and the distance from its centre."""

    def run(batches):
        for batch in batches:
            g, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, x in lengths(batch):
                g[at], far[at] = balls.nearest(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g), pa.array(far)], names=[*batch.schema.names, "_g", "far"])

    return rows.mapInArrow(run, "id long, v array<long>, _g long, far double")


def _sent(asked: DataFrame, balls: Balls, again: bool) -> DataFrame:
    """A row (id, v, floor, _g) for the ball of a query's largest bound; again: for every other one that reaches its floor."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int64())), ("floor", pa.int64()), ("_g", pa.int64())])

    def run(batches):
        for batch in batches:
            for at, q in lengths(batch):
                places, bound = balls.reached(q)
                first = bound.argmax(axis=1)
                row = np.arange(len(q))
                if again:
                    floor = batch["floor"].take(pa.array(at)).to_numpy(zero_copy_only=False).astype(float)
                    wanted = ~(bound < floor[:, None])  # no floor: all
                    wanted[row, first] = False
                    row, first = np.nonzero(wanted)
                for s in range(0, len(row), BLOCK):
                    some = batch.take(pa.array(at[row[s : s + BLOCK]]))
                    yield pa.RecordBatch.from_arrays([some["id"], some["v"], some["floor"], pa.array(places[first[s : s + BLOCK]])], schema=schema)

    return asked.select("id", "v", "floor").mapInArrow(run, "id long, v array<long>, floor long, _g long")


def _met(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each shard (_g, _c) for each query that was sent to it."""

    def run(batches):
        now, parts, ball = None, [], None
        for (g, c, kind), batch in runs(batches, 3):
            if (g, c) != now:
                now, parts, ball = (g, c), [], None
            if not kind:
                parts.append(batch)
                continue
            if not parts:
                continue
            if ball is None:
                ids, v = (pa.chunked_array([p[name] for p in parts]).combine_chunks() for name in ("id", "v"))
                ball = Ball(ids.to_numpy(), v.flatten().to_numpy().reshape(len(ids), -1))
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                q = some["v"].flatten().to_numpy().reshape(some.num_rows, -1)
                floor = some["floor"].to_numpy(zero_copy_only=False).astype(float)
                floor[np.isnan(floor)] = -np.inf
                s = Search(some["id"].to_numpy(), q, k, floor)
                s.visit(ball, np.arange(len(q)))
                real = (s.scores != NONE) & (s.scores >= floor[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s.ids, real.sum(axis=1))), pa.array(s.found[real]), pa.array(s.scores[real])], names=["query_id", "vec_id", "score"])

    columns = ["_g", "_c", "_kind", "id", "v", "floor"]
    rows = rows.withColumns({"_kind": F.lit(0).cast("long"), "floor": F.lit(None).cast("long")}).select(columns)
    both = rows.unionByName(asked.withColumn("_kind", F.lit(1).cast("long")).select(columns))
    return both.repartition("_g", "_c").sortWithinPartitions("_g", "_c", "_kind").mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query row. is_query: a condition on the column id."""
    bounded(df.sparkSession)
    rows = integers(df, key, vector)
    n = rows.count()
    seeds = rows.orderBy(F.xxhash64("id", "v"), "id").limit(min(CENTRES, -(-n // SHARD)) or 1).select("v").toArrow()  # CENTRES rows at most
    balls = Balls(seeds["v"].to_pylist())
    placed = written(_placed(rows, balls))
    counts = written(placed.groupBy("_g").agg(F.count("*").alias("n"), F.max("far").alias("far")))
    known = counts.where("_g >= 0").toArrow()  # a row a centre at most
    balls.radii[known["_g"].to_numpy()] = known["far"].to_numpy()
    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn("floor", F.lit(None).cast("long"))
    here, first = split(placed.drop("far"), _sent(asked, balls, False), counts, SHARD)
    found = _met(here, first, k)
    if known.num_rows > 1:
        found = written(found)
        floors = _ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        here, then = split(placed.drop("far"), _sent(asked.drop("floor").join(floors, "id", "left"), balls, True), counts, SHARD)
        found = found.unionByName(_met(here, then, k))
    return _ranked(found, k).select("query_id", "rank", "vec_id", "score")
