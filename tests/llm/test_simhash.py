"""SimHash components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ridgeline.llm import queries, simhash


def plain_fingerprint(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    n = min(words, len(found))
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + n]), 42) for i in range(len(found) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(prints, most=4):
    """(id, fingerprint) rows: the least id that each reaches."""
    known = [(k, f) for k, f in prints if k is not None]
    label = {k: k for k, _ in known}
    f = np.array([f for _, f in known], np.uint64)
    near = [np.flatnonzero(np.bitwise_count(f ^ x) <= most) for x in f]
    while True:
        before = dict(label)
        for i, (k, _) in enumerate(known):
            label[k] = min(label[k], *(label[known[j][0]] for j in near[i]))
        if label == before:
            return sorted(((k, f"{f:016x}", label.get(k)) for k, f in prints), key=str)


def found(rows):
    return sorted((tuple(r) for r in rows.collect()), key=str)


TEXTS = [None, "", " \t\n", "one", "One two THREE", "a b c d", "a b c d e", "Ünï CÖDE straße 東京 \x1f x\x0by", "w" * 70_000, "the quick brown fox jumps over the lazy dog " * 5000]


def test_fingerprints(spark):
    for t in TEXTS:
        assert simhash.fingerprint(t) == plain_fingerprint(t), (t or "")[:40]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, text string")
    got = {r["id"]: r["f"] % (1 << 64) for r in simhash.fingerprints(docs, "id", "text").collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(TEXTS)}


def test_hash_is_sparks(spark):
    r = spark.range(1).select(F.xxhash64(F.lit("ä b c d")).alias("h")).first()
    assert r["h"] % (1 << 64) == xxhash.xxh64_intdigest("ä b c d", 42)


def test_documents(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(40)) for _ in range(90)) for _ in range(25)]
    docs = [(i, base[i % 25] if i % 4 else base[i % 25].replace(" ", " x ", i % 3)) for i in range(200)] + [(500 + i, t) for i, t in enumerate(TEXTS)] + [(None, "one"), (None, None), (3, "quite another text of this id"), (3, base[3])]
    rows = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "id long, text string, f int, c int").repartition(4)
    assert found(simhash.join(rows, "id", "text")) == plain([(k, plain_fingerprint(t)) for k, t in docs])


def planted(rng, n):
    """Random fingerprints, and chains of neighbours at distances up to six."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        f = rng.choice(out[-n:])
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            f ^= 1 << b
        out.append(f)
    return out


@pytest.mark.parametrize("m", [5, 6, 7, 8])
def test_every_link_shares_a_key(m):
    rng = random.Random(m)
    table = simhash.Table(m, 4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << bit
        keys = table.keys(np.array([a, b], np.uint64))
        far = table.complete(np.array([a, b], np.uint64))
        assert (keys[0] == keys[1]).any()
        assert (np.abs(far[:, 0] - far[:, 1]) <= 4).all()
        assert [bin(a ^ int(p)).count("1") for p in simhash._PIVOTS] == far[:, 0].tolist()


@pytest.mark.parametrize("m, cell", [(5, 16_384), (6, 16_384), (8, 16_384), (5, 7)])
def test_links(spark, monkeypatch, m, cell):
    """Also with cells so small that most keys are split into pairs of blocks."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "STEP", 50)
    prints = [(i, f) for i, f in enumerate(planted(random.Random(m), 250))]
    known = dict((str(i), f) for i, f in prints)

    def given(docs, key, text, words):
        return docs.select(F.col(key).alias("id"), F.col("f"))

    monkeypatch.setattr(simhash, "fingerprints", given)
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in prints], "id long, f long")
    assert len(known) == 500
    assert found(simhash.join(rows, "id", "f", m=m)) == plain(prints)


def test_dense_group():
    """Thousands around one fingerprint are one component, in bounded steps."""
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    f = np.array([centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)], np.uint64)
    assert len(set(simhash.joined(f, simhash.Table(5, 4), 4).tolist())) == 1


def test_segments_grow_with_the_input():
    assert [simhash.count_of_segments(n) for n in (0, 10**6, 10**8, 10**10, 10**12, 10**15)] == [5, 5, 6, 7, 8, 8]


def test_empty(spark):
    assert simhash.join(spark.createDataFrame([], "id long, text string"), "id", "text").collect() == []


def test_query_equals_all_pairs(spark):
    at = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op13_simhash(spark, at)) == plain([(k, plain_fingerprint(t)) for k, t in docs])
