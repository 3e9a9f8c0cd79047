"""Byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash resolves whole pre-tokens that are in the vocabulary; for the others a heap over
linked bytes merges the pair of least rank, leftmost first. Both give the ids that the tiktoken library gives.

Texts are split into chunks that end where white space begins. No match of the pre-token pattern crosses such a place,
so a chunk's ids don't depend on its neighbours, and a bounded memo of chunks saves most of the work.

Null text: encoded as empty (no ids). Empty text: no ids, decoded to empty bytes. Texts of any length are encoded
whole; a pre-token of n bytes costs n log n. Repeated rows are encoded each; columns besides the key and the text are
dropped, so their names can't clash. An empty table gives an empty result. A null key stays null.
"""

from __future__ import annotations

import base64
import re
from heapq import heapify, heappop, heappush

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import map_rows

#: The characters that the pattern's \s matches (fixed values of Unicode's White_Space).
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: Entries of a memo; at the limit it starts afresh, which costs time but changes no result.
MEMO = 300_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by id. Raises ValueError if the ids have gaps or a single byte is missing."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    tokens = [ranks[i] for i in range(len(ranks)) if i in ranks]
    if len(tokens) != len(ranks) or not {bytes([i]) for i in range(256)} <= set(tokens):
        raise ValueError("ranks must be gapless and hold all single bytes")
    return tokens


class PerfectHash:
    """A minimal perfect hash of distinct keys: as many slots as keys, one probe a lookup.

    Keys fall into buckets by one part of their hash. Buckets, largest first, get the first displacement that puts all
    their keys on free slots; a bucket of one key stores its slot itself.
    """

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 2)
        members: dict[int, list[tuple[int, int, int]]] = {}
        for i, key in enumerate(keys):
            b, first, step = self._parts(key)
            members.setdefault(b, []).append((first, step, i))
        self.shift = [0] * self.buckets
        self.ids = [-1] * n
        free_from = 0
        for b, items in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(items) == 1:
                while self.ids[free_from] >= 0:
                    free_from += 1
                self.shift[b] = -free_from - 1
                self.ids[free_from] = items[0][2]
                continue
            d = 0
            while True:
                slots = [self._slot(first, step, d) for first, step, _ in items]
                if len({*slots}) == len(slots) and all(self.ids[s] < 0 for s in slots):
                    break
                d += 1
                if d > 1000 * n:
                    raise ValueError("two keys have the same hash")
            self.shift[b] = d
            for s, (_, _, i) in zip(slots, items):
                self.ids[s] = i

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.buckets, h >> 32 & 0xFFFFFFFF, h >> 64 & 0xFFFFFFFF | 1

    def _slot(self, first: int, step: int, d: int) -> int:
        return (first + d * step & 0xFFFFFFFF) * self.n >> 32

    def candidate(self, key: bytes) -> int:
        """The id of the only key that can equal this one."""
        b, first, step = self._parts(key)
        d = self.shift[b]
        return self.ids[-d - 1 if d < 0 else self._slot(first, step, d)]


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash | None = None) -> None:
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.table = table or PerfectHash(tokens)
        self.pattern = regex.compile(pattern)
        self.packed = [i.to_bytes(4, "little") for i in range(len(tokens))]
        #: All tokens one after the other: where each starts, and its size.
        self.bytes, self.sizes = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: By two bytes: their heap entry at place 0, or 0 if they don't merge.
        self.pairs = [0 if (r := self.ranks.get(bytes(divmod(x, 256)))) is None else r << 46 | 2 for x in range(65536)]
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of bytes by merges alone."""
        n, rank = len(piece), self.ranks.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n
        pairs = self.pairs
        heap = [r | i << 16 for i, (a, b) in enumerate(zip(piece, piece[1:])) if (r := pairs[a << 8 | b])]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, size = top >> 16 & 0x3FFFFFFF, top & 0xFFFF
            j = after[i]
            if not alive[i] or j >= n or after[j] != i + size:
                continue  # one of the parts has been merged meanwhile
            alive[j] = 0
            end = after[i] = i + size
            if end < n:
                before[end] = i
                if (size := after[end] - i) < 65536 and (r := rank(piece[i : i + size])) is not None:
                    heappush(heap, r << 46 | i << 16 | size)
            if (p := before[i]) >= 0 and (size := end - p) < 65536 and (r := rank(piece[p:end])) is not None:
                heappush(heap, r << 46 | p << 16 | size)
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : (i := after[i])]))
        return out

    def piece(self, text: str) -> bytes:
        raw = text.encode("utf-8", "surrogatepass")
        i = self.table.candidate(raw)
        if self.tokens[i] == raw:
            return self.packed[i]
        return b"".join(map(self.packed.__getitem__, self.merge(raw)))

    def chunk(self, text: str) -> bytes:
        pieces, out = self.pieces, []
        for x in self.pattern.findall(text):
            ids = pieces.get(x)
            if ids is None:
                ids = self.piece(x)
                if len(x) <= 64:
                    if len(pieces) >= MEMO:
                        pieces.clear()
                    pieces[x] = ids
            out.append(ids)
        ids = b"".join(out)
        if len(text) <= 64:
            if len(self.chunks) >= MEMO:
                self.chunks.clear()
            self.chunks[text] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, new = self.chunks.get, self.chunk
        return b"".join([get(x) or new(x) for x in CHUNK.findall(text or "")])

    def decode(self, ids: bytes) -> bytes:
        which = np.frombuffer(ids, "<u4")
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        return self.bytes[np.arange(len(ids) and ends[-1]) + np.repeat(self.starts[which] - (ends - sizes), sizes)].tobytes()


def _codec(df: DataFrame, tokens: list[bytes], pattern: str):
    """A function for tasks that makes the codec. The vocabulary's size is fixed, so it is broadcast (about 2 MB)."""
    shared = df.sparkSession.sparkContext.broadcast((tokens, PerfectHash(tokens)))

    def make() -> Codec:
        return Codec(shared.value[0], pattern, shared.value[1])

    return make


def encode(df: DataFrame, key: str, text: str, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """Returns key, ids (binary: little-endian unsigned 32-bit) and, on request, the ids' decoded bytes. path: a rank file on the driver."""
    codec_of = _codec(df, read_ranks(path), pattern)

    def make():
        codec = codec_of()

        def step(batch, rows) -> None:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = codec.encode(t)
                if decoded:
                    raw = codec.decode(ids)
                    rows.add(k, ids, raw, size=len(ids) + len(raw) + 16)
                else:
                    rows.add(k, ids, size=len(ids) + 16)

        return step

    return map_rows(df.select(F.col(key).cast("long"), text), f"{key} long,ids binary" + ",decoded binary" * decoded, make)


def decode(df: DataFrame, key: str, ids: str, path: str, pattern: str) -> DataFrame:
    """Returns key and decoded (binary) of ids packed as encode() packs them; null ids decode to empty bytes. Ids beyond the vocabulary raise IndexError."""
    codec_of = _codec(df, read_ranks(path), pattern)

    def make():
        codec = codec_of()

        def step(batch, rows) -> None:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = codec.decode(x or b"")
                rows.add(k, raw, size=len(raw) + 16)

        return step

    return map_rows(df.select(F.col(key).cast("long"), ids), f"{key} long,decoded binary", make)


def n_ids(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
