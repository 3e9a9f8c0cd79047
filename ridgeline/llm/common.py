"""What the operators of this subpackage share: tables, written intermediate results, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.storage import shared_dir, written  # noqa: F401

#: Rows are handed back to Spark once a batch holds about so many bytes.
EMIT_BYTES = 4 << 20


#: Most rows and bytes of an Arrow batch between Spark and Python; Spark's own bounds are 10,000 rows and 64 MB.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def bounded(spark: SparkSession) -> None:
    """Keeps Arrow batches of this session small from now on, as every Python worker and its executor hold some; smaller bounds stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:  # a bound with a unit was set by hand
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def free_name(columns: list[str], name: str) -> str:
    """A name like the given one that no column has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Marks:
    """A set of hashes as a bitmap that every task can hold: what was put in is found, little else is.

    Its size follows the count of hashes, 32 bits for each, up to MOST bits (16 MB); beyond that more of what was not put
    in is found too, which costs work and changes no result.
    """

    LEAST, MOST = 1 << 16, 1 << 27

    def __init__(self, rows: DataFrame, hashed: Column) -> None:
        wanted = 32 * max(1, rows.count())
        self.bits = min(self.MOST, max(self.LEAST, 1 << (wanted - 1).bit_length()))
        place = F.pmod(hashed, F.lit(self.bits)).cast("long")
        words = rows.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("m")).toArrow()
        self.words = np.zeros(self.bits // 64, np.uint64)
        self.words[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the signed 64-bit hashes may be in the set."""
        at = hashes.view(np.uint64) & np.uint64(self.bits - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Rows:
    """Collects rows and yields them as Arrow batches of a bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.columns, self.size = schema, [[] for _ in schema], 0

    def add(self, *values: object, size: int = 64) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)
        self.size += size

    def full(self) -> bool:
        return self.size >= EMIT_BYTES

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
        self.columns, self.size = [[] for _ in self.schema], 0
        return batch

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield self.take()


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a comma-separated "name type" list."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([pa.field(n, kinds[t]) for n, t in (x.split() for x in ddl.split(","))])


def map_rows(df: DataFrame, ddl: str, make: Callable[[], Callable[[pa.RecordBatch, Rows], None]]) -> DataFrame:
    """mapInArrow with bounded batches. make: called once in each task; what it returns gets every batch and adds rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, rows = make(), Rows(arrow_schema(ddl))
        for batch in small_batches(batches, 64):
            step(batch, rows)
            if rows.full():
                yield rows.take()
        last = getattr(step, "last", None)
        if last is not None:
            last(rows)
        yield from rows.flush()

    bounded(df.sparkSession)
    return df.mapInArrow(run, ddl)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: One scrambled number for each byte at each of the first places of a word.
_PLACES = 64
_TABLE = mix64(np.arange(1, 256 * _PLACES + 1, dtype=np.uint64))


def hash_words(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word from the bytes of all words and their sizes: the scrambled sum of a scrambled number for each byte and its place, and the size."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    place *= 256
    place += letters
    values = _TABLE[place] if sizes.max() <= _PLACES else mix64((place + 1).view(np.uint64))
    return mix64(np.add.reduceat(values, ends - sizes) ^ sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of a column, null as empty, and the offsets where each starts and the last ends."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]
