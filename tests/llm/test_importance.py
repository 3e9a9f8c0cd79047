"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from ridgeline.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, order=1, buckets=10_000, least=20, percent=10, seed=2024):
    def feats(text):
        found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(found), [zlib.crc32(" ".join(found[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(found) - n + 1)]

    raw, want = Counter(), Counter()
    for _, text in docs:
        raw.update(feats(text)[1])
    for text in target:
        want.update(feats(text)[1])
    s, t = sum(raw.values()), sum(want.values())
    rows = []
    for key, text in docs:
        n, ids = feats(text)
        gain = sum(math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in ids)
        weight = gain // len(ids) if ids else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, n, len(ids), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0]))
    ranks = {r: i for i, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted((r[0] or -1, *r[2:], ranks.get(r, 0)) for r in rows)


def got(rows):
    return sorted((r[0] or -1, *r[1:4], r["rank"] or 0) for r in rows.select("id", "n_features", "weight", "score", "rank").collect())


TEXTS = ["", None, "one two Three", "Ünï-code straße 東京 x9", "a " * 30, "the quick Brown fox jumps over the lazy dog " * 4, "AB_cd" * 5 + " z" * 40, "w" * 70_000 + " tail" * 25, "\x00\x7f|{}~ ", "same words here " * 9]


@pytest.mark.parametrize("order", [1, 2])
def test_equals_plain(spark, order):
    docs = [(i, TEXTS[i % len(TEXTS)] if i % 3 else TEXTS[9]) for i in range(90)] + [(None, TEXTS[4])]
    target = ["the lazy fox", "same words", None, "", "東京 one"]
    rows = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in docs], "id long, text string, copies int, k string, score int").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    kept = importance.resample(rows, "id", "text", aim, "text", order=order, percent=37)
    assert got(kept) == plain(docs, target, order, percent=37)


def test_ties_and_wide_buckets(spark):
    docs = [(7, TEXTS[5])] * 40 + [(8, TEXTS[5])] * 20
    rows = spark.createDataFrame(docs, "id long, text string")
    kept = importance.resample(rows, "id", "text", rows.limit(1), "text", buckets=100_000, percent=50).collect()
    assert sorted(r["rank"] for r in kept if r["rank"]) == list(range(1, 31))
    assert len({(r["id"], r["weight"], r["score"]) for r in kept}) == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string")
    one = spark.createDataFrame([(1, TEXTS[5])], "id long, text string")
    assert importance.resample(none, "id", "text", one, "text").collect() == []
    assert got(importance.resample(one, "id", "text", none, "text", percent=100)) == plain([(1, TEXTS[5])], [], percent=100)


def test_query_equals_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    want = con.sql(f"SELECT doc_id, n_features, weight, score, rank FROM ({queries.ORACLE_SQL['op11_importance']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in queries.op11_importance(spark, at).select("doc_id", "n_features", "weight", "score", "rank").collect())
