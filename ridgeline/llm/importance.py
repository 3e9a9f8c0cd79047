"""Importance resampling towards a target distribution, over hashed word n-grams.

Equal texts are collapsed first, by grouping whole texts; their features are cut and weighed once, and count as often as
their text occurs. Weights go back to documents by the text's SHA-256, and only then does each document get its own noise,
so copies have one weight and different scores.

1. Texts are grouped (Spark combines copies before the shuffle, so a text that a third of all rows share is one row a
   task). Of each, the buckets of its features are written: the only reading of texts besides the one that hashes them.
2. Counts a bucket, times copies, are summed in every task; at most `buckets` rows a task meet, and as many come to the
   driver, from raw and target texts alike. The gains of all buckets go back to tasks with their code (8 bytes each).
3. Weights, noise, scores. Scores are whole numbers within 110,000 values, as gains lie within 1000 * ln(2^63) and noise
   between -3,200 and 22,900; so counts a score, which find the lowest score drawn, have that bound in the driver too.
   Only rows that reach it are put in order, over ranges.

Null or empty text, or text without words: no features, weight 0, never drawn unless `least` is 0. Very long texts: whole.
Null ids: noise of the seed and a colon alone; ties in score go to the smaller id, null ids first, then rows that equal
each other in both in an unstated order. Repeated rows: each is drawn for itself. Columns besides id and text are dropped,
so their names can't clash. An empty table gives an empty result, an empty target gains from the raw counts alone.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Rows, arrow_schema, bounded, map_rows, written
from ridgeline.operators.tables import numbered

BUCKETS, ORDER, LEAST, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of words to themselves, A-Z to lower case, all others to a blank.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def features(text: str, order: int = ORDER, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every run of 1 to `order` words."""
    found = words(text)
    hashed = [np.fromiter(map(zlib.crc32, found), np.uint32, len(found))]
    for n in range(2, order + 1):
        runs = max(0, len(found) - n + 1)
        hashed.append(np.fromiter((zlib.crc32(b" ".join(found[i : i + n])) for i in range(runs)), np.uint32, runs))
    return len(found), np.concatenate(hashed) % np.uint32(buckets)


def collapsed(rows: DataFrame, text: str, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """One row for each different text: k (its SHA-256), copies, n_words, n_features, ids (its buckets)."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def make():
        def step(batch: pa.RecordBatch, out: Rows) -> None:
            for t, m in zip(batch.column(0), batch.column(1).to_pylist()):
                t = t.as_py()
                n, ids = features(t, order, buckets)
                ids = ids.astype(kind).tobytes()
                out.add(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest(), m, n, len(ids) // kind.itemsize, ids, size=len(ids) + 96)

        return step

    bounded(rows.sparkSession)  # before the grouping, whose output is cut into batches
    texts = rows.select(F.coalesce(F.col(text), F.lit("")).alias("t")).groupBy("t").agg(F.count("*").alias("m"))
    return written(map_rows(texts, "k binary,copies long,n_words long,n_features long,ids binary", make))


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column after one another, and how many each row has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).astype(np.int64), np.fromiter(map(len, values), np.int64, len(values)) // kind.itemsize


def counted(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket, copies included."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            ids, sizes = _flat(batch.column(1), kind)
            total += np.bincount(ids, np.repeat(batch.column(0).to_numpy(), sizes), buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=arrow_schema("b long,n long"))

    sums = texts.select("copies", "ids").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket at most
    out = np.zeros(buckets, np.int64)
    out[sums["b"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of both smoothed shares) of each bucket."""
    buckets, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    each = [math.floor(1000 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets)))) for s, t in zip(raw.tolist(), target.tolist())]
    return np.array(each, np.int64)


def weighed(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """k, n_words, n_features and weight of each different text: the floored mean gain of its features, 0 without any."""
    kind = np.dtype("<u2" if len(gain) <= 1 << 16 else "<u4")
    schema = arrow_schema("k binary,n_words long,n_features long,weight long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = _flat(batch.column(3), kind)
            ends = np.concatenate([[0], np.cumsum(gain[ids])])
            at = np.cumsum(sizes)
            weight = (ends[at] - ends[at - sizes]) // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], schema=schema)

    return texts.select("k", "n_words", "n_features", "ids").mapInArrow(run, "k binary, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """floor(-1000 * ln(-ln u)), where u follows from a hash of the seed and the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    rows: DataFrame, key: str, text: str, target: DataFrame, target_text: str, order: int = ORDER, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """key, n_features, weight, score and rank of every row; rank is null for rows that aren't drawn."""
    texts = collapsed(rows, text, order, buckets)
    gain = gains(counted(texts, buckets), counted(collapsed(target, target_text, order, buckets), buckets))
    keyed = rows.select(F.col(key).cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("k"))
    back = keyed.join(weighed(texts, gain), "k")  # a text that many rows share is one row here; AQE splits the rows' side
    scored = written(back.select("id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score")))
    able = scored.where(F.col("n_words") >= least)
    per_score = sorted(((r["score"], r["n"]) for r in able.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in per_score) // 100
    lowest, above = None, 0
    for score, n in per_score:
        if above >= draw:
            break
        lowest, above = score, above + n
    hope = (F.col("n_words") >= least) & (F.col("score") >= F.lit(lowest).cast("long"))
    hope = F.coalesce(hope, F.lit(False))
    best = numbered(scored.where(hope), [], [F.desc("score"), F.asc_nulls_first("id")], "_place")
    columns = [F.col("id").alias(key), "n_features", "weight", "score"]
    placed = best.select(*columns, F.when(F.col("_place") <= draw, F.col("_place")).alias("rank"))
    return placed.unionByName(scored.where(~hope).select(*columns, F.lit(None).cast("long").alias("rank")))
