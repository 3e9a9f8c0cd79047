"""Exact n-gram Jaccard self-join, given as connected components of the links between documents.

A document's set holds the hashes of its distinct word n-grams. All links of at least the threshold count, but not all
are listed: what is known of one set is carried over to sets related to it.

1. Equal sets: copies share one representative, found by partial minima, and only that goes on.
2. Highly similar sets: under each of several min-hash keys every set is compared with the smallest and the largest id
   of its key. A verified link puts both into one component, so whatever either is linked with is settled for both.
3. The rest, exactly: both sets of a pair are cut into the same parts by hash, as many as follow from the smaller one's
   size. If the whole sets reach the threshold, so do the two halves of at least one part (else no sum of them could).
   The halves of such a part, in a global order (n-grams that are frequent anywhere last, then by hash), share one of
   the first n-grams that are its prefix, and n-grams of prefixes make the index lists. Lists are sorted by size: those
   of one component are skipped as a whole, blocks of a list whose sizes can't reach the threshold are skipped, and so
   is a pair whose positions leave too little to share, or whose 64-bit sketches of odd and even counts differ more than
   the halves of such a part may. So texts that share a passage and little else are no candidates. Only pairs across
   components are. Lists of more than CELL entries, whether known beforehand or found so, are dealt to pairs of blocks.

A candidate pair is first held against histograms of both sets, whose common part bounds the intersection from above;
what is left is compared by whole sets. Scrambled 64-bit hashes stand for words and n-grams throughout.

Null or empty text, or text without words: an empty set, linked with nothing. Texts of fewer words than n: their whole
word sequence is their only element. Very long texts: whole. Rows without an id: their n_shingles, a null component.
Repeated rows: each returned. Rows of one id with different texts: one node, linked by any of its texts. Ties: none, a
component is named by its smallest id. Columns besides id and text are dropped, so their names can't clash. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import Marks, bounded, hash_words, map_rows, mix64, written
from ridgeline.llm.components import components

WORDS, PERCENT = 5, 75
BANDS = 8
#: Sets of up to WHOLE elements are one part; the parts of larger ones have PART elements on average, at most.
WHOLE, PART = 256, 64
#: 64-bit sketches of a whole set, of a part.
WIDE, NARROW = 4, 1
#: Entries of an index list beyond which it is dealt to pairs of blocks.
CELL = 2048
#: n-grams that at least so many sets of one task's buffer share count as frequent; the order keeps the most frequent
#: HOT of them. Any order gives the same links, so this bounds memory, not results.
OFTEN, BUFFER, HOT = 4, 1 << 21, 1 << 17

_NONE = np.uint64((1 << 64) - 1)
_FACTORS = mix64(np.arange(1, 65, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
SEGMENT = 1 << 20


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word, in segments of bounded size."""
    out, at = [], 0
    while at < len(raw):
        end = at + SEGMENT
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        b = np.frombuffer(raw, np.uint8, min(end, len(raw)) - at, at)
        at = end
        solid = np.zeros(len(b) + 2, bool)
        np.logical_not(_SPACE[b], out=solid[1:-1])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        if not len(starts):
            continue
        out.append(hash_words(b[solid[1:-1]], sizes))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    n = min(words, len(w))
    if not n:
        return w
    total = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        total += w[i : len(w) - n + 1 + i] * _FACTORS[i]
    return np.unique(mix64(total ^ np.uint64(n)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def bands(x: np.ndarray, count: int = BANDS) -> list[int]:
    """Keys of two min-hashes each: the least element in each of 2 * count classes, for an empty class the least rehashed one."""
    bins = 2 * count
    least = np.full(bins, _NONE)
    least[(x[::-1] % np.uint64(bins)).astype(np.int64)] = x[::-1]  # sorted, so the least is written last
    for i in np.flatnonzero(least == _NONE).tolist():
        least[i] = mix64(x ^ _FACTORS[20 + i]).min()
    keys = mix64(least[::2] * np.uint64(3) + mix64(least[1::2]) + np.arange(count, dtype=np.uint64)) >> np.uint64(1)
    return keys.tolist()


def histogram(x: np.ndarray) -> bytes:
    """How many elements fall into each of 2^k classes by their top bits, two on average; empty if a count is above 255."""
    bits = max(6, (max(1, len(x) // 2) - 1).bit_length())
    count = np.bincount((x >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else b""


def most_common(a: bytes, b: bytes) -> int:
    """At least as much as two sets with these histograms share."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if not len(x) or not len(y):
        return 1 << 62
    if len(x) < len(y):
        x, y = y, x
    return int(np.minimum(x.reshape(len(y), -1).sum(axis=1), y).sum())


def summaries(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """One row per document (kind 0: id, n, digests x and y, keys, histogram) and per frequent n-gram of a buffer (kind 1: id its hash, n its count)."""

    def run(batches):
        schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("keys", pa.list_(pa.int64())), ("h", pa.binary())])
        kept, size = [], 0

        def frequent():
            value, count = np.unique(np.concatenate(kept), return_counts=True)
            value, count = value[count >= OFTEN], count[count >= OFTEN]
            kept.clear()
            m = len(value)
            if m:
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(signed(value)), pa.array(count.astype(np.int64)), none, none, pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.binary())], schema=schema)

        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(t, words)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                rows.append((0, k, len(s), (h & (1 << 63) - 1), h >> 65, bands(s) if len(s) else [], histogram(s)))
                kept.append(s)
                size += len(s)
                if size >= BUFFER:
                    yield from frequent()
                    size = 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if kept:
            yield from frequent()

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "kind int, id long, n long, x long, y long, keys array<long>, h binary")


def enough(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether so much overlap of sets of sizes a and b reaches the threshold."""
    return 100 * overlap >= percent * (a + b - overlap)


def hopeful(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose histograms leave room for enough overlap."""
    side = sets.groupBy("rep").agg(F.collect_list(F.struct("n", "h")).alias("v"))  # one, or one for each text of an id
    full = pairs.join(side.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b").join(side.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a")

    def compare():
        def step(batch, rows) -> None:
            for a, b, va, vb in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if any(100 * min(x["n"], y["n"], common) >= percent * (x["n"] + y["n"] - min(x["n"], y["n"], common)) for x in va for y in vb for common in (most_common(x["h"], y["h"]),)):
                    rows.add(a, b, size=16)

        return step

    return map_rows(full.select("a", "b", "va", "vb"), "a long,b long", compare)


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of ids whose sets are linked.

    A bitmap tells which texts may be asked for, so that texts stay where they are and only sets travel; the many pairs
    of one id stay apart.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(Marks(ids, F.xxhash64("id")))

    def make():
        marks = shared.value

        def step(batch, rows) -> None:
            asked = np.flatnonzero(marks.has(batch.column(2).to_numpy(zero_copy_only=False)))
            for i in asked.tolist():
                s = shingles(batch.column(1)[i].as_py(), words)
                rows.add(batch.column(0)[i].as_py(), s.tobytes(), size=8 * len(s) + 16)

        return step

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where("id IS NOT NULL")
    sets = written(map_rows(texts.select("id", "t", F.xxhash64("id").alias("h")), "id long,s binary", make))
    full = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")

    def compare():
        def step(batch, rows) -> None:
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if len(x) and 100 * common >= percent * (len(x) + len(y) - common):
                    rows.add(a, b, size=16)

        return step

    return map_rows(full.select("a", "b", "sa", "sb"), "a long,b long", compare).distinct()


def least_partner(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The size of the smallest set that a set of n elements may be linked with."""
    return -(-percent * n // 100)


def level(n: int) -> int:
    """0 for sets that are one part, else k for those of 4^(k + 1) parts."""
    out = 0
    while n > WHOLE << 2 * out:
        out += 1
    return out


def parted(s: np.ndarray, count: np.ndarray | None, k: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of a sorted set at a level: their sizes and sketches, and their prefixes, one after the other, with counts.

    A sketch has a bit for each of 64 classes: whether the part has an odd number of elements in it. That of a whole set
    has WIDE such words.
    """
    bits = 2 * k + 2 if k else 0
    part = (s >> np.uint64(64 - bits)).astype(np.int64) if k else np.zeros(len(s), np.int64)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    sizes = np.diff(np.r_[starts, len(s)])
    bit = np.uint64(1) << (s >> np.uint64(7) & np.uint64(63))
    if k:
        sketches = np.bitwise_xor.reduceat(bit, starts)
    else:
        word = s >> np.uint64(13) & np.uint64(WIDE - 1)
        sketches = np.array([np.bitwise_xor.reduce(bit[word == w], initial=np.uint64(0)) for w in range(WIDE)], np.uint64)
    if count is not None:
        order = np.lexsort((count, part))  # within a part by count, then by hash
        s, count = s[order], count[order]
    place = np.arange(len(s)) - np.repeat(starts, sizes)
    first = place < np.repeat(prefix(sizes, percent), sizes)
    return sizes, sketches, s[first], count[first] if count is not None else np.zeros(0, np.int64)


def prefix(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Any two sets that reach the threshold share one of so many of their first elements."""
    return sizes - least_partner(sizes, percent) + 1


def prefixes(docs: DataFrame, key: str, text: str, shared, words: int, percent: int) -> DataFrame:
    """id, n, level, whether that is the level of its own size, and the packed parts of each text's set."""

    def make():
        tokens, counts = shared.value

        def step(batch, rows) -> None:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(t, words)
                n = len(s)
                if not n:
                    continue
                count = None
                if len(tokens):
                    place = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    hot = tokens[place] == s
                    count = np.where(hot, counts[place], 0) if hot.any() else None
                for k in range(level(int(least_partner(n, percent))), level(n) + 1):
                    sizes, sketches, some, often = parted(s, count, k, percent)
                    rows.add(key, n, k, k == level(n), some.tobytes(), often.astype(np.uint32).tobytes(), sizes.astype(np.uint16).tobytes(), sketches.tobytes(), size=12 * len(some) + 32)

        return step

    return map_rows(docs.select(F.col(key).cast("long").alias("id"), text).where("id IS NOT NULL"), "id long,n long,level int,own boolean,tokens binary,counts binary,sizes binary,sketches binary", make)


#: What an entry's pairs are: any two, those of one block, or those of two blocks, one of each.
PLAIN, FIRST, SECOND, BLOCK = 0, 1, 2, 3


def cells(tokens: np.ndarray, ids: np.ndarray, lengths: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of long lists, dealt to each pair of blocks that the block of their id is one of: which entry, its token there, its side."""
    blocks = -(-lengths // cell)
    mine = (mix64(ids.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
    which = np.repeat(np.arange(len(ids)), blocks)
    other = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own, many = mine[which], blocks[which]
    pair = np.minimum(own, other) * many + np.maximum(own, other) + 1
    side = np.where(own == other, BLOCK, np.where(own < other, FIRST, SECOND))
    return which, mix64(tokens[which] ^ pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), side.astype(np.uint8)


def dealt(entries: list[np.ndarray], parts: int):
    """Batches of (part, packed entries): the first 64 bits of an entry choose its part, its packed token is the last 48 of them."""
    part = (entries[0] >> np.uint64(20)) % np.uint64(parts) * np.uint64(2) + np.uint64(len(entries) == 7 + WIDE)
    entries = [entries[0].astype(np.uint32), (entries[0] >> np.uint64(32)).astype(np.uint16), *entries[1:]]
    order = np.argsort(part, kind="stable")
    part, entries = part[order], [c[order] for c in entries]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    for at in range(0, len(cuts) - 1, 16):
        some = list(zip(cuts[at : at + 16], cuts[at + 1 : at + 17]))
        yield [int(part[a]) for a, _ in some], [b"".join(_bytes(c[a:b]) for c in entries) for a, b in some]


def _deal(parts: int, percent: int, cell: int):
    """Packed parts with components to rows of (part, packed entries).

    An entry: token, id, component less id, size of its set, size of its part, position there, side and whether at its own
    level, sketch. Those of whole sets have longer sketches and go to odd parts, the others to even ones.
    """

    def run(batches):
        kept, size = {WIDE: [], NARROW: []}, 0

        def emit():
            for some in kept.values():
                columns = [np.concatenate(x) for x in zip(*some)]
                some.clear()
                for part, packed in dealt(columns, parts) if columns else ():
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(packed, pa.binary())], names=["part", "entries"])

        for batch in batches:
            for key, c, n, k, own, tokens, counts, sizes, sketches in zip(*(batch.column(i).to_pylist() for i in range(9))):
                s, sizes = np.frombuffer(tokens, np.uint64), np.frombuffer(sizes, np.uint16)
                long = prefix(sizes.astype(np.int64), percent)
                of = np.repeat(np.arange(len(sizes)), long)
                position = (np.arange(len(s)) - np.repeat(np.cumsum(long) - long, long)).astype(np.uint16)
                s = mix64(s + np.uint64(k))
                side = np.full(len(s), PLAIN, np.uint8)
                count = np.frombuffer(counts, np.uint32).astype(np.int64)
                if len(count) and (big := count > cell).any():
                    which, token, more = cells(s[big], np.full(int(big.sum()), key, np.int64), count[big], cell)
                    which = np.flatnonzero(big)[which]
                    s, side = np.concatenate([s[~big], token]), np.concatenate([side[~big], more])
                    of, position = (np.concatenate([x[~big], x[which]]) for x in (of, position))
                m = len(s)
                sketch = np.frombuffer(sketches, np.uint64)
                sketch = [sketch[of]] if k else [np.full(m, x) for x in sketch]
                kept[len(sketch)].append((s, np.full(m, key, np.int64), np.full(m, c - key, np.int64), np.full(m, n, np.int32), sizes[of], position, side | np.uint8(4 * own), *sketch))
                size += m
                if size >= BUFFER // 2:
                    yield from emit()
                    size = 0
        yield from emit()

    return run


def _bytes(x: np.ndarray) -> bytes:
    """Byte planes rather than values, so that high bytes, mostly alike, compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


_ENTRY = (np.uint32, np.uint16, np.int64, np.int64, np.int32, np.uint16, np.uint16, np.uint8, np.uint64)


def unpack(chunks: list[bytes], words: int) -> list[np.ndarray]:
    kinds = [*_ENTRY[:-1], *_ENTRY[-1:] * words]
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    width = sum(np.dtype(t).itemsize for t in kinds)
    for raw in chunks:
        n, at = len(raw) // width, 0
        for column, kind in zip(columns, kinds):
            size = np.dtype(kind).itemsize
            column.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
            at += n * size
    low, high, *rest = [np.concatenate(c) for c in columns]
    return [low + (high.astype(np.uint64) << np.uint64(32)), *rest]


def candidates(entries: list[np.ndarray], percent: int, cell: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct pairs of ids in different components that share a list and may reach the threshold in its part.

    Third, the entries of lists that are too long to be compared here, dealt to pairs of blocks.
    """
    order = np.lexsort((entries[3], entries[0]))
    entries = [c[order] for c in entries]
    token, ids, comps, sizes, parts, positions, flags, *sketches = entries
    comps, sides, own = comps + ids, flags & 3, flags >= 4
    sizes, parts, positions = (x.astype(np.int64) for x in (sizes, parts, positions))
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
    ends = np.r_[starts[1:], len(token)][: len(starts)]
    if len(token):  # a list of one component is skipped, and so is one of guests only
        useful = (np.minimum.reduceat(comps, starts) != np.maximum.reduceat(comps, starts)) & np.maximum.reduceat(own, starts)
        starts, ends = starts[useful], ends[useful]
    long = (ends - starts > 4 * cell) & (sides[starts] == PLAIN)
    later = [c[:0] for c in entries]
    if long.any():
        at = np.concatenate([np.arange(a, b) for a, b in zip(starts[long], ends[long])])
        which, keys, more = cells(token[at], ids[at], np.repeat(ends[long] - starts[long], ends[long] - starts[long]), cell)
        later = [c[at][which] for c in entries]
        later[0], later[6] = keys, more | later[6] & np.uint8(4)
    starts, ends = starts[~long], ends[~long]
    found: list[np.ndarray] = []

    def test(i: np.ndarray, j: np.ndarray) -> None:
        both = sides[i] + sides[j]
        ok = (comps[i] != comps[j]) & (own[i] | own[j]) & ((both == 2 * PLAIN) | (both == 2 * BLOCK) | (both == FIRST + SECOND) & (sides[i] != sides[j]))
        i, j = i[ok], j[ok]
        most = np.minimum(parts[i] - positions[i], parts[j] - positions[j])
        ok = enough(most, parts[i], parts[j], percent) & enough(np.minimum(sizes[i], sizes[j]), sizes[i], sizes[j], percent)
        i, j = i[ok], j[ok]
        apart = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in sketches)  # at most as many as are in one of both parts
        ok = (100 + percent) * apart <= (100 - percent) * (parts[i] + parts[j])
        if ok.any():
            x, y = ids[i[ok]], ids[j[ok]]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            if len(found) >= 1024:
                found[:] = [np.unique(np.concatenate(found), axis=0)]

    pairs = ends - starts == 2
    test(starts[pairs], starts[pairs] + 1)
    least = least_partner(sizes, percent)
    for a, b in zip(starts[~pairs].tolist(), ends[~pairs].tolist()):
        first = a + np.searchsorted(sizes[a:b], least[a:b])  # smaller sets can't reach the threshold
        for at in range(a + 1, b, 256):
            to = min(at + 256, b)
            width = np.arange(at, to) - first[at - a : to - a]
            i = np.repeat(np.arange(at, to), width)
            if len(i):
                test(i, np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[at - a : to - a], width))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), later
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 0], both[:, 1], later


def _lists(percent: int, parts: int, cell: int):
    """Packed entries to rows of pairs (a, b), and of packed entries (part, entries) of lists that were too long."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int64()), ("entries", pa.binary())])

    def run(batches):
        chunks: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("entries").to_pylist()):
                chunks.setdefault(part, []).append(raw)
        for part in list(chunks):
            a, b, later = candidates(unpack(chunks.pop(part), WIDE if part % 2 else NARROW), percent, cell)
            for at in range(0, len(a), 100_000):
                some = a[at : at + 100_000], b[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([*map(pa.array, some), pa.nulls(len(some[0]), pa.int64()), pa.nulls(len(some[0]), pa.binary())], schema=schema)
            for at in range(0, len(later[0]), BUFFER // 2):
                for where, packed in dealt([c[at : at + BUFFER // 2] for c in later], parts):
                    none = pa.nulls(len(where), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(where, pa.int64()), pa.array(packed, pa.binary())], schema=schema)

    return run


def join(docs: DataFrame, key: str, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id for each row."""
    bounded(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(key, text)
    table = written(summaries(docs, key, text, words))
    rows = table.where("kind = 0").select("id", "n", "x", "y", "keys", "h")
    # 1. Equal sets.
    sets = written(rows.where("n > 0 AND id IS NOT NULL").groupBy("x", "y", "n").agg(F.min(F.struct("id", "keys", "h")).alias("m")).select("x", "y", "n", F.col("m.id").alias("rep"), F.col("m.keys").alias("keys"), F.col("m.h").alias("h")))
    # 2. Highly similar sets, each against the ends of its keys; of those the two that share most keys with it.
    keyed = sets.select(F.col("rep").alias("id"), "n", F.posexplode("keys").alias("band", "value"))
    ends = keyed.groupBy("band", "value").agg(F.min(F.struct("id", "n")).alias("lo"), F.max(F.struct("id", "n")).alias("hi")).where("lo.id < hi.id")
    stars = keyed.join(ends, ["band", "value"]).select("id", "n", F.explode(F.array("lo", "hi")).alias("o"))
    fits = 100 * F.least("n", "o.n") >= percent * F.greatest("n", "o.n")
    shares = stars.where((F.col("id") != F.col("o.id")) & fits).groupBy("id", F.col("o.id").alias("other")).agg(F.count("*").alias("k"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("k"), "other"))
    close = shares.withColumn("place", best).where("place <= 2").select(F.col("id").alias("a"), F.col("other").alias("b"))
    near = components(verified(written(hopeful(close, sets, percent)), docs, key, text, words, percent))
    # 3. The rest by prefixes.
    often = table.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(HOT).toPandas()
    hot_tokens = often["id"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(hot_tokens)
    shared = spark.sparkContext.broadcast((hot_tokens[by], often["n"].to_numpy(np.int64)[by]))  # at most HOT entries, 2 MB
    nodes = sets.select(F.col("rep").alias("v")).distinct().join(near, "v", "left").select("v", F.coalesce("c", "v").alias("c"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labelled = prefixes(docs, key, text, shared, words, percent).join(nodes, F.col("id") == F.col("v")).select("id", "c", "n", "level", "own", "tokens", "counts", "sizes", "sketches")
    packed = labelled.mapInArrow(_deal(2 * tasks, percent, CELL), "part long, entries binary")
    listed = "a long, b long, part long, entries binary"
    once = written(packed.repartition(tasks, "part").mapInArrow(_lists(percent, 2 * tasks, CELL), listed))
    again = once.where("part IS NOT NULL").select("part", "entries").repartition(tasks, "part").mapInArrow(_lists(percent, 2 * tasks, CELL), listed)
    across = once.where("part IS NULL").select("a", "b").unionByName(again.select("a", "b")).distinct()
    links = verified(written(hopeful(across, sets, percent)), docs, key, text, words, percent)
    # Texts of one id hang together, whichever representatives they have.
    full = rows.where("n > 0 AND id IS NOT NULL").select("id", "x", "y", "n")
    several = full.groupBy("id").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi").select("id")
    reps = full.join(several, "id", "left_semi").join(sets.select("x", "y", "n", "rep"), ["x", "y", "n"])
    ties = reps.withColumn("a", F.min("rep").over(Window.partitionBy("id"))).select("a", F.col("rep").alias("b")).where("a < b").distinct()
    named = links.unionByName(ties).join(nodes.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(nodes.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
    merged = components(named.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    final = nodes.join(merged.select(F.col("v").alias("c"), F.col("c").alias("d")), "c", "left").select(F.col("v").alias("rep"), F.coalesce("d", "c").alias("component"))
    known = sets.select("x", "y", F.col("n").alias("m"), "rep").join(final, "rep").drop("rep")
    out = rows.join(known, (rows["x"] == known["x"]) & (rows["y"] == known["y"]) & (rows["n"] == known["m"]), "left")
    component = F.when(rows["id"].isNotNull(), F.coalesce(known["component"], rows["id"]))
    return out.select(rows["id"].alias(key), rows["n"].alias("n_shingles"), component.alias("component_id"))
