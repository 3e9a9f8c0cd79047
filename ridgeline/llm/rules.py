"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Every byte n-gram of a text falls into one of BUCKETS classes. Two multinomials over these, one of the whole corpus and
one of its trusted part, smoothed towards the corpus, give each class a log-likelihood ratio. A text's score is the mean
over its n-grams, so that length has no say, and it is kept if the score reaches a fixed threshold. The corpus counts
cover all texts; the trusted ones cover the whole texts of a bounded sample of labelled rows.

Null text: no words, which fails the base rules. Empty text likewise. Very long texts: counted whole. Repeated rows:
each counted in the multinomials and each judged. Ties: a score at the threshold is kept. Columns besides those named
are dropped, so their names can't clash. Empty table: empty result. No trusted text: all ratios are 0, and the base
rules alone decide. Rows without a key: counted in the corpus and judged, never trusted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import map_rows

ORDER, BUCKETS = 4, 1 << 16
#: Bound of the sample of labelled rows: documents that the trusted multinomial counts. The corpus's counts all.
TRUSTED = 20_000
#: Weight of the corpus in the trusted multinomial, as a count of n-grams.
PRIOR = 20_000.0
#: Least mean ratio of a text that is kept.
THRESHOLD = -0.5
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"


def hashed(raw: bytes) -> np.ndarray:
    """The class of each n-gram of the bytes."""
    if len(raw) < ORDER:
        return np.zeros(0, np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    n = len(b) - ORDER + 1
    x = b[:n].copy()
    for i in range(1, ORDER):
        x |= b[i : n + i] << np.uint32(8 * i)
    return (x * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def base(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 bytes."""
    words = raw.split()
    codes: dict[bytes, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    chars = len(raw.translate(None, SPACE + bytes(range(0x80, 0xC0))))  # a code point has one byte that isn't a continuation
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(ids) > 3:
        n = len(ids) - 2
        _, pair = np.unique(ids[:-1] * (len(codes) + 1) + ids[1:], return_inverse=True)
        _, place, count = np.unique(pair[:n] * (len(codes) + 1) + ids[2:], return_inverse=True, return_counts=True)
        twice = count[place] > 1
        covered = np.zeros(len(ids), bool)
        for i in range(3):
            covered[i : n + i] |= twice
        repeated = int(covered.sum())
    return len(words), chars, symbols, len(lines) - len({*lines}), repeated


def trusted_ids(labels: DataFrame, key: str, good: Column, bound: int = TRUSTED) -> np.ndarray:
    """The sorted ids of at most `bound` trusted documents, those of least hash, so that any input gives as many."""
    known = labels.where(good & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct()
    return np.sort(known.orderBy(F.xxhash64("id"), "id").limit(bound).toPandas()["id"].to_numpy(np.int64))


def count(df: DataFrame, key: str, text: str, trusted: np.ndarray) -> DataFrame:
    """bucket, n, t: how many n-grams of all texts, and of trusted ones, fall into each class.

    One reading of the texts, which stay where they are: ids of trusted documents are broadcast (8 bytes each, TRUSTED at
    most), and a task sums its own counts before they are shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(trusted)

    def run(batches):
        raw, some = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.bincount(hashed((t or "").encode("utf-8", "surrogatepass")), minlength=BUCKETS)
                raw += n
                if k is not None and (at := np.searchsorted(shared.value, k)) < len(shared.value) and shared.value[at] == k:
                    some += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(some[at])], names=["bucket", "n", "t"])

    parts = df.select(F.col(key).cast("long"), text).mapInArrow(run, "bucket long, n long, t long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def ratios(df: DataFrame, key: str, text: str, trusted: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of each class. The counts that come to the driver are BUCKETS rows at most."""
    rows = count(df, key, text, trusted).toPandas()
    q, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    q[rows["bucket"]], t[rows["bucket"]] = rows["n"], rows["t"]
    if not t.sum():
        return np.zeros(BUCKETS)
    q = (q + 0.5) / (q + 0.5).sum()
    return np.log((t + PRIOR * q) / (t.sum() + PRIOR)) - np.log(q)


def judge(df: DataFrame, key: str, text: str, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """key, the base counts, base_failed, kept, score. The ratios have a fixed size (half a MB), so they are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(ratio)

    def make():
        ratio = shared.value

        def step(batch, rows) -> None:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                words, chars, symbols, lines, repeated = base(raw)
                failed = words < 50 or 100 * repeated > 50 * words
                classes = hashed(raw)
                score = float(ratio[classes].mean()) if len(classes) else 0.0
                rows.add(k, words, chars, symbols, lines, repeated, failed, not failed and score >= threshold, score, size=96)

        return step

    ddl = f"{key} long,n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,base_failed boolean,kept boolean,score double"
    return map_rows(df.select(F.col(key).cast("long"), text), ddl, make)
