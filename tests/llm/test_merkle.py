"""Merkle manifests against a plain version."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    out = []
    for c, v in zip(COLUMNS, row):
        if v is not None:
            v = str(v)
            if lower and c == "text":
                v = "".join(x.lower() if "A" <= x <= "Z" else x for x in v)
        out.append("-" if v is None else f"{len(v.encode())}:{v}")
    return H(*out)


def up(nodes):
    """All levels, from the nodes to the one that remains."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def way(levels, pos):
    for nodes in levels[:-1]:
        at = pos // 16 * 16
        yield nodes[at:pos], nodes[pos + 1 : at + 16]
        pos //= 16


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = up([leaf(r) for r in groups[s]])
    top = up([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for pos, r in enumerate(groups[s]):
            path = [*way(trees[s], pos), *way(top, i)]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r, changed)
            for a, b in path:
                node = H(*a, node, *b)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, H(*[x for a, b in path for x in a + b]), node, node == root))
    return sorted(out, key=str)


def made(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, pos int").repartition(5)
    out = merkle.manifest(docs, "doc_id", "source", COLUMNS, "text", lambda k: F.crc32(k.cast("string").cast("binary")) % 5 == 0)
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17, None: 3}, {"hot": 4097, "": 257, "ä": 1, "Z": 256, None: 1}, {f"s{i}": 1 + i % 3 for i in range(300)}])
def test_equals_plain(spark, sizes):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, None if i % 7 == 0 else "en", i % 11 or None, None if i % 13 == 0 else "" if i % 17 == 0 else f"Text Ä {i}"))
            i += 1
    assert made(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "a", None, None, "X"), (5, "a", "l", 1, "Y" * 300_000), (5, "a", "l", 1, "B"), (5, "a", "l", 1, "B"), (-3, "a", "l", 2, "C|D")]
    assert made(spark, rows) == plain(rows)


def test_rounds_over_many_buckets(spark, monkeypatch):
    """Small buckets, so that there are several rounds and buckets on the way up and down."""
    monkeypatch.setattr(merkle, "AT_ONCE", 40)
    rows = [(i, "a" if i % 3 else "b", "l", i, f"T{i}") for i in range(9000)]
    assert made(spark, rows) == plain(rows)


def test_empty(spark):
    assert made(spark, []) == []


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    names = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    want = con.sql(f"SELECT {names} FROM ({queries.ORACLE_SQL['op12_merkle']})").fetchall()
    rows = queries.op12_merkle(spark, at).select(*names.split(", ")).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)
    assert any(r["verified"] for r in rows) and not all(r["verified"] for r in rows)
