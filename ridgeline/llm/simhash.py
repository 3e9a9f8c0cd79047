"""SimHash near-duplicates: links at a small Hamming distance, found with tables of distances to reference fingerprints.

A reference's distance to a fingerprint is the sum of its distances over segments of the 64 bits, which small tables hold
for every value of a segment. Both uses of the triangle inequality rest on these tables:

* Keys. Two fingerprints that differ in `most` bits agree in at least m - most of m segments, so there all partial
  distances to all references are equal. The partial distances over every choice of m - most segments are keys, and only
  fingerprints of one key meet. m follows from the number of fingerprints (5 up to 16 million), so that a key has a few
  thousand chance members at most; any m gives the same links.
* Pruning. Of those that meet, a pair goes if its distances to any reference differ by more than `most`; what is left is
  verified by its bits.

Equal fingerprints are one row from the start, so copies meet in partial minima only. Members of a key are compared in
runs of sorted rows, a few thousand at a time; keys of more than CELL members, known from counts, are dealt to pairs of
blocks. What leaves a key is one row for each member that joins another's component, not its pairs.

Null or empty text, or text without words: fingerprint zero, linked like any other. Fewer words than `words`: the whole
sequence is the only shingle. Very long texts: whole. Rows without an id: their fingerprint, a null component. Repeated
rows: each returned; rows of one id with different texts are one node, linked by any of them. Ties: a bit is set by more
than half of the shingles, so exactly half leaves it 0. Columns besides id and text are dropped, so their names can't
clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Rows, arrow_schema, bounded, map_rows, mix64, written
from ridgeline.llm.components import components

WORDS, SEED, MOST = 4, 42, 4
#: Reference fingerprints; members of a key that meet in one task at once; pairs compared in one step.
REFERENCES, CELL, STEP = 24, 16_384, 1 << 20
#: Chance members of a key, on average, up to which fewer segments do.
CROWD = 2048
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16

_PIVOTS = mix64(np.arange(101, 101 + REFERENCES, dtype=np.uint64))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits, each 1 if it is set in more than half of the hashes of the text's word shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANKS).split(b" ")
    found = [w for w in found if w]
    n = min(words, len(found))
    if not n:
        return 0
    joined = memoryview(b" ".join(found))
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - n + 1].tolist()
    ends = ends[n - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), AT_ONCE):
        part = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE])], ">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


#: White space to a blank.
_BLANKS = bytes(32 if b in (32, 9, 10, 11, 12, 13) else b for b in range(256))


def fingerprints(docs: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """id, f: the fingerprint as a signed long."""

    def make():
        def step(batch: pa.RecordBatch, rows: Rows) -> None:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                f = fingerprint(t.as_py(), words)
                rows.add(k, f - (1 << 64) if f >> 63 else f, size=16)

        return step

    return map_rows(docs.select(F.col(key).cast("long"), text), "id long,f long", make)


def segments(m: int) -> list[tuple[int, int]]:
    """(first bit, size) of m segments of nearly equal size."""
    edges = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def partial_distances(m: int) -> list[np.ndarray]:
    """For each segment, the distances of every value (row) to every reference (column) within it."""
    out = []
    for first, size in segments(m):
        values = np.arange(1 << size, dtype=np.uint64)
        own = _PIVOTS >> np.uint64(first) & np.uint64((1 << size) - 1)
        out.append(np.bitwise_count(values[:, None] ^ own[None, :]).astype(np.uint8))
    return out


class Table:
    """Distances of fingerprints to the references, complete and by segment."""

    def __init__(self, m: int, most: int) -> None:
        self.parts, self.cuts = partial_distances(m), segments(m)
        # a number for each row of partial distances: what is equal in all references is one key
        self.names = [np.unique(p, axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint64) for p in self.parts]
        self.choices = list(combinations(range(m), m - most))

    def _values(self, f: np.ndarray) -> list[np.ndarray]:
        return [(f >> np.uint64(first) & np.uint64((1 << size) - 1)).astype(np.int64) for first, size in self.cuts]

    def complete(self, f: np.ndarray) -> np.ndarray:
        """One row for each reference."""
        return sum(p[v] for p, v in zip(self.parts, self._values(f))).T.astype(np.int8)

    def keys(self, f: np.ndarray) -> np.ndarray:
        """One column for each choice of segments."""
        names = [n[v] for n, v in zip(self.names, self._values(f))]
        out = np.empty((len(f), len(self.choices)), np.uint64)
        for j, choice in enumerate(self.choices):
            key = np.full(len(f), j + 1, np.uint64)
            for i in choice:
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + names[i])
            out[:, j] = key
        return out


def count_of_segments(fingerprints: int, most: int = MOST) -> int:
    """The fewest segments with which a key has CROWD chance members at most; never more than twice `most`."""
    m = most + 1
    while m < 2 * most and fingerprints >> (64 * (m - most) // m) > CROWD:
        m += 1
    return m


def joined(f: np.ndarray, table: Table, most: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each fingerprint the place of the first one of its component, by links among those given.

    side: only pairs of different sides are compared. Rows are sorted by their first coordinate, so that a row meets
    those within `most` of it there; the other coordinates discard what is left, and bits verify.
    """
    if not len(f):
        return np.zeros(0, np.int64)
    far = table.complete(f)
    order = np.argsort(far[0], kind="stable")
    far, g = far[:, order], f[order]
    sides = None if side is None else side[order]
    n = len(f)
    root = np.arange(n)
    reach = np.searchsorted(far[0], far[0] + most, "right")
    at = 0
    while at < n:
        end = at + max(1, STEP // n)
        low, high = np.arange(at, min(end, n)), reach[at:end]
        at = end
        sizes = high - low - 1
        i = np.repeat(low, sizes)
        j = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + i + 1
        for d in (None, *far[1:]):
            if not len(i):
                break
            keep = sides[i] != sides[j] if d is None and sides is not None else np.abs(d[i] - d[j]) <= most if d is not None else None
            if keep is not None:
                i, j = i[keep], j[keep]
        near = np.bitwise_count(g[i] ^ g[j]) <= most
        i, j = i[near], j[near]
        while len(i):  # each round hangs the larger of two roots under a smaller one
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def _keyed(reps: DataFrame, m: int, most: int) -> DataFrame:
    """A row (key, f, id) for every key of every fingerprint."""

    schema = arrow_schema("key long,f long,id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(m, most)
        for batch in batches:
            f, ids = (batch.column(i).to_numpy() for i in (0, 1))
            keys = table.keys(f.view(np.uint64)).view(np.int64)
            c = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), np.repeat(f, c), np.repeat(ids, c))], schema=schema)

    bounded(reps.sparkSession)
    return reps.select("f", "id").mapInArrow(run, "key long, f long, id long")


def _cells(keyed: DataFrame) -> DataFrame:
    """(key, x, y, mine, f, id): members of one cell have key, x and y in common.

    Most keys are one cell. A key of more than CELL members is split into blocks by hash, and every pair of blocks, or
    a block alone, is a cell.
    """
    large = keyed.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks")).where("blocks > 1")
    with_blocks = keyed.join(large, "key", "left").withColumn("mine", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int")))
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = with_blocks.withColumn("other", F.explode(other))
    return spread.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "f", "id")


def _linked(cells: DataFrame, m: int, most: int) -> DataFrame:
    """(a, b): ids of representatives of one component, from all cells."""
    schema = arrow_schema("a long,b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(m, most)

        def compare(rows: pa.Table) -> pa.RecordBatch:
            key, x, y, mine, f, ids = (rows[c].to_numpy() for c in ("key", "x", "y", "mine", "f", "id"))
            edges = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            a, b = [], []
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(key)]):
                if e - s > 1:
                    first = joined(f[s:e].view(np.uint64), table, most, mine[s:e] if x[s] != y[s] else None)
                    moved = np.flatnonzero(first != np.arange(e - s))
                    a.append(ids[s:e][first[moved]])
                    b.append(ids[s:e][moved])
            none = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *c])) for c in (a, b)], schema=schema)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CELL:
                rows = pa.Table.from_batches(held)
                key, x, y = (rows[c].to_numpy() for c in ("key", "x", "y"))
                cut = int(np.argmax((key == key[-1]) & (x == x[-1]) & (y == y[-1])))  # the last cell may go on
                if cut:
                    yield compare(rows.slice(0, cut))
                held, size = rows.slice(cut).to_batches(), rows.num_rows - cut
        if size:
            yield compare(pa.Table.from_batches(held))

    bounded(cells.sparkSession)
    dealt = cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return dealt.mapInArrow(run, "a long, b long")


def join(docs: DataFrame, key: str, text: str, words: int = WORDS, most: int = MOST, m: int | None = None) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id of every row. m: the number of segments, more than `most`."""
    marked = written(fingerprints(docs, key, text, words))
    with_id = marked.where("id IS NOT NULL")
    reps = written(with_id.groupBy("f").agg(F.min("id").alias("id")))
    m = m or count_of_segments(reps.count(), most)
    near = _linked(_cells(written(_keyed(reps, m, most))), m, most)
    several = with_id.groupBy("id").agg(F.min("f").alias("f"), F.max("f").alias("g")).where("f <> g").select("id")  # ids with different texts
    named = reps.select("f", F.col("id").alias("a"))
    same = with_id.join(several, "id", "left_semi").join(named, "f").select("a", F.col("id").alias("b"))
    groups = components(near.unionByName(same).where("a <> b"))
    classes = named.join(groups.withColumnRenamed("v", "a"), "a", "left").select("f", F.coalesce("c", "a").alias("c"))
    back = marked.join(classes, "f", "left")  # a fingerprint that many rows share is one row here; AQE splits the rows' side
    return back.select(F.col("id").alias(key), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("c")).alias("component_id"))
