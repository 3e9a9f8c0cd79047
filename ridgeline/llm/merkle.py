"""A Merkle manifest of a table: a leaf a row, a tree a source, a tree over sources, and a proof for every row.

Leaves of a source are numbered in order over ranges, so a source of any share of the rows is spread out. Every 16^3
consecutive nodes of a source are a bucket: 16 never divides across two of them, so three levels of a bucket need no other
rows. Executors hold whole buckets as Arrow tables and run level queries on them in DuckDB (ordered string_agg, then
sha256). Spark takes the buckets' roots as the next round's nodes, until each source has one; the same rounds then run over
the sources. On the way down, every bucket is joined with the siblings outside of it, and its queries prove each leaf: the
siblings are hashed, and the root is folded again from the leaf, or from what tampering makes of it.

Nodes are 64 hex digits; a bucket has 4,096 rows at most, and a task holds a few buckets at a time. Rounds go by the
logarithm of the largest source to base 4,096; each round's table is written to the shared folder.

Nulls in any column: a dash in the leaf; null sources are one group, the first; null ids come first in their source, and
are never tampered with. Repeated rows: leaves of their own, next to one another; equal ids with different leaves are
ordered by leaf. Empty and very long texts: whole, by their size in bytes. Columns besides those of the leaf are dropped.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import bounded, written
from ridgeline.operators.tables import numbered

FAN, LEVELS = 16, 3
BUCKET = FAN**LEVELS
#: Rows of whole buckets that one set of level queries takes, at most, unless a bucket alone has more.
AT_ONCE = 2 * BUCKET

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(values: list[Column]) -> Column:
    """The hash of the values, each with its size in bytes, or a dash for a null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _steps(n: Column) -> Column:
    """Levels that a bucket of a source of n nodes takes in one round."""
    out = F.lit(0)
    for level in range(LEVELS):
        out = out + (n > FAN**level).cast("int")
    return out


def _level(of: int) -> str:
    """The nodes of one level, from those of the level below."""
    return f"l{of + 1} AS (SELECT g, b, p // {FAN} AS p, steps, sha256(string_agg(h, '' ORDER BY p)) AS h FROM l{of} WHERE steps > {of} GROUP BY g, b, p // {FAN}, steps)"


_LEVELS = "WITH l0 AS (SELECT g, b, p, steps, h FROM nodes), " + ", ".join(map(_level, range(LEVELS)))
ROOTS = f"{_LEVELS} " + " UNION ALL ".join(f"SELECT g, b, h FROM l{i} WHERE steps = {i}" for i in range(LEVELS + 1))


def _siblings(level: int) -> str:
    """What stands before and after each node among the children of its parent."""
    run = f"(PARTITION BY g, b, p // {FAN} ORDER BY p ROWS BETWEEN"
    return (
        f"s{level} AS (SELECT g, b, p, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' || "
        f"coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS s FROM l{level} WHERE steps > {level})"
    )


#: Of each node, the siblings ("before|after") of every level up to the top.
PATHS = (
    f"{_LEVELS}, " + ", ".join(map(_siblings, range(LEVELS))) + ", paths AS (SELECT n.* EXCLUDE (path, subroot), o.subroot, list_concat(list_filter([" + ", ".join(f"s{i}.s" for i in range(LEVELS)) + "], lambda x: x IS NOT NULL), o.path) AS path "
    "FROM nodes n JOIN outer_paths o ON n.g = o.g AND n.b = o.b " + " ".join(f"LEFT JOIN s{i} ON n.g = s{i}.g AND n.b = s{i}.b AND n.p // {FAN**i} = s{i}.p" for i in range(LEVELS)) + ")"
)
INNER = f"{PATHS} SELECT g, p AS b, path, subroot FROM paths"
#: The hash of all siblings, and the root folded from the leaf or what it was changed to.
PROOFS = (
    f"{PATHS} SELECT id, h AS leaf, subroot, sha256(array_to_string(list_transform(path, lambda x: replace(x, '|', '')), '')) AS proof_sha256, "
    "list_reduce(list_prepend(coalesce(changed, h), path), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root FROM paths"
)


def _engine(sql: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs a query over whole buckets; rows come sorted by bucket (g, b). Rows of kind 0 are a bucket's outer path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": "", "autoinstall_known_extensions": False})

        def answer(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            kinds = rows["kind"].combine_chunks()
            con.register("nodes", rows.filter(pa.compute.equal(kinds, 1)))
            con.register("outer_paths", rows.filter(pa.compute.equal(kinds, 0)))
            yield from con.sql(sql).to_arrow_table().select(schema.names).cast(schema).to_batches(2048)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if size + batch.num_rows > AT_ONCE:
                rows = pa.Table.from_batches([*held, batch])
                g, b = rows["g"].combine_chunks(), rows["b"].combine_chunks()
                same = pa.compute.and_(pa.compute.equal(g, g[-1]), pa.compute.equal(b, b[-1]))
                cut = pa.compute.index(same, True).as_py()  # the last bucket may go on
                if cut:
                    yield from answer(rows.slice(0, cut))
                    held, size = rows.slice(cut).to_batches(), rows.num_rows - cut
                    continue
            held.append(batch)
            size += batch.num_rows
        if size:
            yield from answer(pa.Table.from_batches(held))

    return run


_KINDS = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}


def _in_buckets(rows: DataFrame, sql: str, ddl: str) -> DataFrame:
    schema = pa.schema([pa.field(n, _KINDS[t]) for n, t in (x.split() for x in ddl.split(","))])
    bounded(rows.sparkSession)
    dealt = rows.repartition("g", "b").sortWithinPartitions("g", "b", "kind")
    return dealt.mapInArrow(_engine(sql, schema), ddl)


def _nodes(level: DataFrame) -> DataFrame:
    """(g, b, p, steps, h) of a round's (g, pos, n, h), pos from 0."""
    extra = [c for c in level.columns if c not in ("g", "pos", "n", "h")]
    return level.select(F.lit(1).alias("kind"), "g", F.floor(F.col("pos") / BUCKET).cast("long").alias("b"), F.col("pos").alias("p"), _steps(F.col("n")).alias("steps"), "h", *extra)


def rounds(leaves: DataFrame) -> list[DataFrame]:
    """The written tables (g, pos, n, h) of all rounds, until every group has one node."""
    out = [leaves]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        sizes = out[-1].select("g", F.floor(F.col("pos") / BUCKET).cast("long").alias("b"), F.ceil(F.col("n") / BUCKET).alias("n")).groupBy("g", "b").agg(F.max("n").alias("n"))
        roots = _in_buckets(_nodes(out[-1].select("g", "pos", "n", "h")), ROOTS, "g string,b long,h string")
        out.append(written(roots.join(sizes, ["g", "b"]).select("g", F.col("b").alias("pos"), "n", "h")))
    return out


def _down(levels: list[DataFrame], top: DataFrame, last: str, ddl: str) -> DataFrame:
    """Paths from the top (g, b, path, subroot of each group's single node) down to the leaves, where the query `last` runs."""
    outer = top
    for k in range(len(levels) - 1, -1, -1):
        if k == len(levels) - 1 and k:
            continue  # the single nodes, whose paths are the given ones
        rows = _nodes(levels[k]).unionByName(outer.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        outer = _in_buckets(rows, last, ddl) if not k else written(_in_buckets(rows, INNER, "g string,b long,path array<string>,subroot string"))
    return outer


def manifest(rows: DataFrame, key: str, source: str, columns: list[str], text: str, tampered: Callable[[Column], Column]) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    columns: those of the leaf, in its order, key, source and text among them. tampered: says of which keys the text is
    lower-cased before the root is folded from it.
    """
    values = {c: F.col(c) for c in columns}
    lower = [F.translate(v, _UP, _LOW) if c == text else v for c, v in values.items()]
    made = rows.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("g"),
        leaf(list(values.values())).alias("h"), F.when(F.coalesce(tampered(F.col(key)), F.lit(False)), leaf(lower)).alias("changed"),
    )
    leaves = written(numbered(made, ["g"], [F.asc_nulls_first("id"), F.asc("h")], "_place").select("id", "g", "h", "changed", (F.col("_place") - 1).alias("pos"), F.col("_place_of").alias("n")))
    own = rounds(leaves)
    subroots = own[-1].select(F.col("g").alias("of"), "h")
    tops = written(numbered(subroots, [], ["of"], "_place").select(F.lit("").alias("g"), "of", "h", (F.col("_place") - 1).alias("pos"), F.col("_place_of").alias("n")))
    over = rounds(tops)
    root = over[-1].first()
    session = rows.sparkSession
    start = session.createDataFrame([("", 0, [], None)], "g string, b long, path array<string>, subroot string")
    paths = written(_down(over, start, INNER, "g string,b long,path array<string>,subroot string")).withColumnRenamed("b", "pos").drop("g", "subroot")
    outer = tops.join(paths, "pos").select(F.col("of").alias("g"), F.lit(0).cast("long").alias("b"), "path", F.col("h").alias("subroot"))
    proofs = _down(own, outer, PROOFS, "id long,leaf string,subroot string,proof_sha256 string,folded_root string")
    found = F.lit(root["h"] if root else None).cast("string")
    return proofs.select(F.col("id").alias(key), "leaf", "subroot", found.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == found).alias("verified"))
