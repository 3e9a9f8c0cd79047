"""Line dedup by content-defined chunks of lines.

A text is words, and lines of words: a line ends with a line end or a sentence. A rolling hash runs over the hashed words
and line ends of every stretch of CHUNK words. Where it is the least of NEAR neighbouring places, line starts before all
others, a chunk begins: that depends on the stretch and its neighbours only, so shifted text has the same chunks, and any
passage of CHUNK + NEAR - 1 words holds a whole one. Chunks whose hash occurs again anywhere, in other documents or
their own, are compared byte by byte with the first of them (smallest id, then text hash, then place). Equal ones are
removed but for that first, together with the words before and after that equal those around the first one, up to the
next chunk that doesn't repeat. So a repeated passage goes as a whole, whichever its lines are; what surrounds it stays,
and so do line ends. Every word that goes stays at an earlier place.

Null, empty and wordless texts, and texts of fewer than CHUNK words, stay as they are. Very long texts: whole. Rows
without an id stay as they are and count for nothing. Repeated rows are one document; different texts of one id are
different ones. Ties: places are distinct; of equal hashes in a repetitive text the first begins a chunk. Other columns
pass through; they may have any names but n_removed and left_share. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import Marks, bounded, free_name, hash_words, mix64, small_batches, utf8, written

CHUNK, NEAR = 20, 24
#: Hashes with more copies than SOME, and one in HOT places besides, are hot: fewer than HOT are, and their first chunks are broadcast.
HOT, SOME = 1 << 16, 10_000
FACTOR, BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
TOP, NONE = np.uint64(1 << 63), np.uint64((1 << 64) - 1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
BLANK = b"\t\n\v\f\r "


@lru_cache(8)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, from 0 to size - 1, by 64 bits."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (BASE, pow(BASE, -1, 1 << 64)))


def sliding(x: np.ndarray, pick) -> np.ndarray:
    """The least (or greatest) of each NEAR neighbours."""
    width = 1
    while 2 * width <= NEAR:
        x, width = pick(x[:-width], x[width:]), 2 * width
    rest = NEAR - width
    return pick(x[:-rest], x[rest:]) if rest else x


class Cut:
    """Words and chunks of several texts, the UTF-8 bytes between offsets. Words have numbers, chunks the one of their first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        solid = ~SPACE[data]
        new = np.zeros(len(data) + 1, bool)
        new[offsets] = True
        start, end = solid.copy(), solid.copy()
        start[1:] &= ~solid[:-1] | new[1:-1]
        end[:-1] &= ~solid[1:] | new[1:-1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        n = len(self.starts)
        self.first = np.searchsorted(self.starts, offsets[:-1])  # of each text
        self.last = np.searchsorted(self.starts, offsets[1:])
        counts = self.last - self.first
        self.text = np.repeat(np.arange(len(counts)), counts)
        line = np.zeros(n + 1, bool)
        line[np.searchsorted(self.starts, np.flatnonzero(data == 10))] = True
        line[1:] |= STOP[data[self.ends - 1]]
        line[self.first] = True
        self.line = line[:n]
        self.chunks, self.x = self._boundaries(hash_words(data[solid], self.ends - self.starts))

    def _boundaries(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(np.arange(len(words)) + CHUNK <= self.last[self.text])
        if not len(at):
            return at, np.zeros(0, np.uint64)
        up, down = powers(1 << max(12, len(words).bit_length()))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(words + self.line * FACTOR) * up[: len(words)])))
        x = mix64((sums[at + CHUNK] - sums[at + 1]) * down[at] + mix64(words[at]))
        value = x >> np.uint64(1) | np.where(self.line[at], np.uint64(0), TOP)
        # Texts lie apart by NEAR places that are never the least; a window counts if it lies in its text, or begins a short one.
        text = self.text[at]
        begins = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        sizes = np.diff(np.r_[begins, len(at)])
        shift = np.repeat(np.arange(1, len(begins) + 1) * NEAR, sizes)
        place = np.arange(len(at)) + shift
        spread = np.full(len(at) + (len(begins) + 2) * NEAR, NONE)
        spread[place] = value
        least = sliding(spread, np.minimum)
        counts = np.zeros(len(least), bool)
        counts[place[np.arange(len(at)) - np.repeat(begins, sizes) <= np.repeat(np.maximum(0, sizes - NEAR), sizes)]] = True
        least[~counts] = 0
        chosen = np.flatnonzero(sliding(least, np.maximum)[place - NEAR + 1] == value)
        again = np.r_[False, (value[chosen[1:]] == value[chosen[:-1]]) & (np.diff(chosen) < NEAR) & (text[chosen[1:]] == text[chosen[:-1]])]
        chosen = chosen[~again]
        return at[chosen], x[chosen]

    def range_of(self, text: int) -> tuple[int, int]:
        """The chunks of a text: their numbers are ordinals from the first."""
        return tuple(np.searchsorted(self.chunks, [self.first[text], self.last[text]]).tolist())

    def around(self, chunk: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that repeats of chunks may reach: first and behind the last. before, after: the chunks there that repeat next to the same first ones, else -1.

        In a passage that repeats, any NEAR places in a row hold a chunk that repeats, so no more of it lies on a side
        without one. Between two that repeat, only what neither covers is looked at.
        """
        text = self.text[chunk]
        lo, hi = chunk - NEAR + 1, chunk + CHUNK + NEAR - 1
        lo = np.where(before < 0, lo, np.minimum(chunk, np.maximum(before + CHUNK, lo)))
        hi = np.where(after < 0, hi, np.maximum(chunk + CHUNK, np.minimum(after, hi)))
        return np.maximum(lo, self.first[text]), np.minimum(hi, self.last[text])


def cut(texts: list[str | None]) -> Cut:
    data, offsets = utf8(pa.array(texts, pa.string()))
    return Cut(data, offsets)


def equal_ends(a: bytes, b: bytes) -> int:
    """How many bytes at their ends two strings share, back to where a word begins in both."""
    n = min(len(a), len(b))
    if n == 0:
        return 0
    if a[-n:] == b[-n:]:
        same = n
    else:
        same = bisect_left(range(1, n + 1), True, key=lambda k: a[-k:] != b[-k:])
    while same and not (_cut_before(a, len(a) - same) and _cut_before(b, len(b) - same)):
        same -= 1
    return same


def _cut_before(raw: bytes, at: int) -> bool:
    return raw[at] not in BLANK and (at == 0 or raw[at - 1] in BLANK)


def equal_starts(a: bytes, b: bytes) -> int:
    """How many bytes at their starts two strings share, up to where a word ends in both."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        same = n
    else:
        same = bisect_left(range(1, n + 1), True, key=lambda k: a[:k] != b[:k])
    while same and not (_cut_after(a, same) and _cut_after(b, same)):
        same -= 1
    return same


def _cut_after(raw: bytes, at: int) -> bool:
    return raw[at - 1] not in BLANK and (at == len(raw) or raw[at] in BLANK)


def repeat(first: tuple, row: tuple) -> tuple[int, int] | None:
    """What of a row's text repeats the first chunk of its hash. A row: id, hash, place, words of its text, lead, size, raw."""
    (*_, lead, size, raw), (*_, at, _, mine, long, text) = first, row
    if raw[lead : lead + size] != text[mine : mine + long]:
        return None
    return at - equal_ends(raw[:lead], text[:mine]), at + long + equal_starts(raw[lead + size :], text[mine + long :])


def merged(spans: list[tuple[int, int]], raw: bytes) -> list[tuple[int, int]]:
    """The spans, each with the white space behind it, in order and without overlaps."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        while b < len(raw) and raw[b] in BLANK:
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    """The text without the spans; a removed line end is made up for where text would run together."""
    parts, at = [], 0
    for a, b in gone:
        parts.append(raw[at:a])
        if b"\n" in raw[len(raw[a:b].rstrip(BLANK)) + a : b]:
            kept = next((p for p in reversed(parts) if p), b"")
            if kept and not kept.endswith(b"\n"):
                parts.append(b"\n")
        at = b
    return b"".join([*parts, raw[at:]])


def near_copy(spans: list[dict], raw: bytes, share: float) -> bool:
    """Whether the words shared with one single document are at least that share of the words of both."""
    words = len(raw.split())
    firsts: dict[tuple, tuple[list, int]] = {}
    for s in spans:
        firsts.setdefault((s["fid"], s["fh"]), ([], s["fn"]))[0].append((s["a"], s["b"]))
    for some, n in firsts.values():
        common = sum(len(raw[a:b].split()) for a, b in merged(some, raw))
        if common >= share * (words + n - common):
            return True
    return False


_ROW = T.StructType([T.StructField(n, T.LongType()) for n in ("x", "id", "h", "at", "n", "lead", "size")] + [T.StructField("raw", T.BinaryType())])
_SPAN = "id long, h long, a long, b long, fid long, fh long, fn long"
_SPANS = pa.schema([(n, pa.int64()) for n in ("id", "h", "a", "b", "fid", "fh", "fn")])


def _listing(batches):
    """id, text and its hash to the hashes of all chunks."""
    for batch in small_batches(batches, 64):
        c = Cut(*utf8(batch.column(1)))
        bounds = np.searchsorted(c.chunks, np.r_[c.first, len(c.starts)]).astype(np.int32)
        some = np.flatnonzero(np.diff(bounds))
        xs = pa.ListArray.from_arrays(pa.array(np.r_[bounds[some], bounds[-1]].astype(np.int32)), pa.array(c.x.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), batch.column(2).take(pa.array(some)), xs], names=["id", "h", "xs"])


def _found(shared):
    """id, h, ordinal and x of the chunks whose hash may repeat."""

    def run(batches):
        marks = shared.value
        for batch in batches:
            xs = batch.column(2)
            values = xs.flatten().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(xs).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            ordinal = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(marks.has(values))
            of = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(ordinal[at].astype(np.int32)), pa.array(values[at])], names=["id", "h", "ordinal", "x"])

    return run


def _reading(batches):
    """id, text, h and the chunks that repeat, with their first places, to one row for each of them, with the text around it.

    A first chunk comes with all that a repeat may reach, another with what its neighbours in the same repeat don't cover.
    """
    schema = pa.schema([(f.name, pa.binary() if f.name == "raw" else pa.int64()) for f in _ROW])
    for batch in small_batches(batches, 64):
        c = Cut(*utf8(batch.column(1)))
        lists = batch.column(3)
        sizes, flat = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
        row = np.repeat(np.arange(len(sizes)), sizes)
        k, fid, fh, ford = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("ordinal", "fid", "fh", "ford"))
        order = np.lexsort((k, row))
        row, k, fid, fh, ford = (v[order] for v in (row, k, fid, fh, ford))
        key, h = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 2))
        at = np.searchsorted(c.chunks, c.first)[row] + k
        chunk = c.chunks[at]
        # Whether a chunk and the next one repeat two that are neighbours, too.
        run = (row[1:] == row[:-1]) & (np.diff(k) == 1) & (fid[1:] == fid[:-1]) & (fh[1:] == fh[:-1]) & (np.diff(ford) == 1)
        own = (fid == key) & (fh == h) & (ford == k)
        before = np.where(np.r_[False, run] & ~own, np.r_[-1, chunk[:-1]], -1)
        after = np.where(np.r_[run, False] & ~own, np.r_[chunk[1:], -1], -1)
        a, b = c.around(chunk, before, after)
        start, stop, left, right = c.starts[chunk], c.ends[chunk + CHUNK - 1], c.starts[a], c.ends[b - 1]
        long = right - left
        ends = np.cumsum(long)
        raw = c.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(left - (ends - long), long)]
        raws = pa.BinaryArray.from_buffers(pa.binary(), len(long), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
        columns = [c.x[at].view(np.int64), key, h, start - c.offsets[row], (c.last - c.first)[row], start - left, stop - start]
        yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int64()) for v in columns], raws], schema=schema)


def _spans(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found)] if found else [pa.nulls(0, pa.int64())] * 7, schema=_SPANS)


def _comparing(batches):
    """Rows in order of x, id, h and place to the spans that repeat the first one of their x; only that one is held."""
    x = first = None
    for batch in batches:
        found = []
        for x_, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if x_ != x:
                x, first = x_, row
            elif row[:3] != first[:3] and (span := repeat(first, row)):
                found.append((row[0], row[1], *span, first[0], first[1], first[3]))
        yield _spans(found)


def _comparing_hot(shared):
    def run(batches):
        for batch in batches:
            found = []
            for x, *row in zip(*(c.to_pylist() for c in batch.columns)):
                first = shared.value.get(x)
                if first and row[:3] != first[:3] and (span := repeat(first, row)):
                    found.append((row[0], row[1], *span, first[0], first[1], first[3]))
            yield _spans(found)

    return run


def repeats(docs: DataFrame) -> DataFrame:
    """id, h, a, b, fid, fh, fn of docs (id, t, h): spans in bytes that repeat an earlier place; id, hash and words of the document there."""
    spark = docs.sparkSession
    places = written(docs.select("id", "t", "h").mapInArrow(_listing, "id long, h long, xs array<long>"))
    again = written(places.select(F.explode("xs").alias("x")).groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select("x"))
    marks = spark.sparkContext.broadcast(Marks(again, F.col("x")))
    places = places.mapInArrow(_found(marks), "id long, h long, ordinal int, x long")  # what only seems to repeat goes next
    firsts = places.groupBy("x").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "ordinal")).alias("f")).where("n > 1")
    firsts = written(firsts.select("x", "n", F.col("f.id").alias("fid"), F.col("f.h").alias("fh"), F.col("f.ordinal").alias("ford")))
    total = firsts.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") - SOME > total / HOT
    hot, cold = firsts.where(is_hot), firsts.where(~is_hot)
    many = F.broadcast(hot.select(F.col("x").alias("y")))
    flags = places.join(cold.drop("n"), "x")
    some_hot = bool(hot.limit(1).count())
    if some_hot:  # hashes of very many places meet their first ones where they are
        flags = places.join(many, F.col("x") == F.col("y"), "left_anti").join(cold.drop("n"), "x").unionByName(places.join(F.broadcast(hot.drop("n")), "x"))
    flags = written(flags.groupBy("id", "h").agg(F.collect_set(F.struct("ordinal", "fid", "fh", "ford")).alias("chunks")))
    known = spark.sparkContext.broadcast(Marks(flags, F.xxhash64("id", "h")))
    rows = having(docs, F.xxhash64("id", "h"), known, True).join(flags, ["id", "h"]).select("id", "t", "h", "chunks").mapInArrow(_reading, _ROW)
    order = ["x", "id", "h", "at", "n", "lead", "size", "raw"]
    rows = written(rows.select(order)) if some_hot else rows.select(order)
    rest = rows.join(many, F.col("x") == F.col("y"), "left_anti") if some_hot else rows
    spans = rest.repartition("x").sortWithinPartitions("x", "id", "h", "at").mapInArrow(_comparing, _SPAN)
    if not some_hot:
        return spans
    dear = rows.join(many, F.col("x") == F.col("y"), "left_semi").groupBy("x").agg(F.min(F.struct(*order[1:])).alias("f")).toArrow().to_pylist()
    shared = spark.sparkContext.broadcast({r["x"]: [*r["f"].values()] for r in dear})  # fewer than HOT chunks with what is around them
    return spans.unionByName(rows.mapInArrow(_comparing_hot(shared), _SPAN))


def having(df: DataFrame, hashed: Column, shared, yes: bool) -> DataFrame:
    """The rows whose hash may be (or isn't) in the broadcast set. Both halves make up the table, and all columns stay."""
    width = len(df.columns)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.has(batch.column(width).to_numpy(zero_copy_only=False)) == yes)).select(range(width))

    return df.select(*[df[c] for c in df.columns], hashed.alias(free_name(df.columns, "_dedup_k"))).mapInArrow(run, df.schema)


def dedup(df: DataFrame, key: str, text: str, copies: float | None = None) -> DataFrame:
    """All rows and columns, the text deduplicated, with n_removed (long) and left_share (double, of its words).

    copies: documents that share at least that part of the words of both with one single earlier document are left whole,
    so that a dedup of documents can judge them; None: such repeats go like any other.
    """
    bounded(df.sparkSession)
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    spans = written(repeats(docs).groupBy("id", "h").agg(F.collect_set(F.struct("a", "b", "fid", "fh", "fn")).alias("gone")))
    names = {c: free_name(df.columns, f"_dedup_{c}") for c in ("id", "h", "gone")}
    schema = T.StructType([*df.schema.fields, T.StructField("n_removed", T.LongType()), T.StructField("left_share", T.DoubleType())])
    at, width = df.columns.index(text), len(df.columns)
    shared = df.sparkSession.sparkContext.broadcast(Marks(spans, F.xxhash64("id", "h")))
    hashed = F.xxhash64(F.col(key).cast("long"), F.xxhash64(text))

    def removing(batches):
        for batch in batches:
            raws = batch.column(at).cast(pa.binary())
            texts, removed, left = [], [], []
            for i, gone in enumerate(batch.column(width).to_pylist()):
                raw = raws[i].as_py()
                spans = merged([(s["a"], s["b"]) for s in gone], raw) if gone and (copies is None or not near_copy(gone, raw, copies)) else []
                new = without(raw, spans) if spans else raw
                texts.append(new)
                removed.append(len(spans))
                left.append(len(new.split()) / len(raw.split()) if spans else 1.0)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64()), pa.array(left, pa.float64())], names=schema.names)

    touched = having(df, hashed, shared, True)
    joined = touched.join(spans.withColumnsRenamed(names), (touched[key].cast("long") == F.col(names["id"])) & (F.xxhash64(touched[text]) == F.col(names["h"])), "left")
    new = joined.select(*[touched[c] for c in df.columns], names["gone"]).mapInArrow(removing, schema)
    same = having(df, hashed, shared, False)
    return new.unionByName(same.select("*", F.lit(0).cast("long").alias("n_removed"), F.lit(1.0).alias("left_share")))
