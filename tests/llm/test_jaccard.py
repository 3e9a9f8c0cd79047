import random
import re

import numpy as np

from ridgeline.llm import jaccard


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_set(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, percent=75):
    sets = [(k, shingle_set(t)) for k, t in rows]
    parent = {k: k for k, _ in sets if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i, (k, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    for i, (k, s) in enumerate(sets):
        common = {}
        for g in s:
            for j in index[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if None not in (k, sets[j][0]) and 100 * c >= percent * (len(s) + len(sets[j][1]) - c):
                a, b = sorted((find(k), find(sets[j][0])))
                parent[b] = a
    return sorted(((k, len(s), find(k) if k is not None else None) for k, s in sets), key=str)


def got(spark, rows, parts=4):
    df = spark.createDataFrame([(k, t, 1, "c") for k, t in rows], "doc_id long, text string, n int, c string").repartition(parts)
    return sorted(map(tuple, jaccard.join(df, "doc_id", "text").collect()), key=str)


def make(rnd, groups, words):
    vocabulary = [f"w{i}" for i in range(words)]
    passage = rnd.choices(vocabulary, k=30)
    rows, k = [], 0
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=rnd.randint(1, 60))
        if rnd.random() < 0.3:
            base += passage
        for _ in range(rnd.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            if rnd.random() < 0.2:
                w = w[: rnd.randint(1, len(w))]
            rows.append((k, " ".join(w)))
            k += 1
    rnd.shuffle(rows)
    return rows


def test_shingles():
    r = random.Random(0)
    for _ in range(300):
        t = "".join(r.choice("aAbÉé \n\t\x85") for _ in range(r.randint(0, 40)))
        assert len(jaccard.shingles(t)) == len(shingle_set(t))
    assert (jaccard.shingles("A b  C\nd e f") == jaccard.shingles("a B c d E F")).all()
    assert not (jaccard.shingles("É a b c d")[0] == jaccard.shingles("é a b c d")[0])


def test_segments_change_nothing(monkeypatch):
    t = " ".join(f"word{i % 97}" for i in range(4000))
    want = jaccard.shingles(t)
    monkeypatch.setattr(jaccard, "SEGMENT", 50)
    assert (jaccard.shingles(t) == want).all()


def test_equals_brute_force(spark):
    rows = make(random.Random(7), 150, 400)
    assert got(spark, rows) == brute(rows)


def test_small_cells_and_frequent_order(spark, monkeypatch):
    for name, value in (("CELL", 3), ("OFTEN", 2), ("BUFFER", 500), ("HOT", 200), ("BANDS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    rows = make(random.Random(8), 120, 300)
    assert got(spark, rows) == brute(rows)


def test_long_lists_that_no_count_foretold(spark, monkeypatch):
    """Lists found too long where they are gathered are dealt again: no n-gram counts as frequent here."""
    for name, value in (("CELL", 2), ("OFTEN", 10**9), ("BANDS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "bands", lambda x, count=0: [int(x[0]) >> 1])
    rows = make(random.Random(9), 100, 200)
    assert got(spark, rows) == brute(rows)


def test_words_and_counts_of_long_texts(spark):
    """Sets of several levels, whose parts differ in number, and words of more than 64 bytes."""
    rnd = random.Random(4)
    rows = []
    for k, size in enumerate([60, 66, 68, 72, 250, 260, 300, 1020, 1100, 1300, 4200, 5200]):
        w = [f"{'x' * rnd.randint(1, 100)}{rnd.randint(0, 10**6)}" for _ in range(size)]
        for j, share in enumerate([0, 0.005, 0.02, 0.04, 0.06, 0.1]):
            v = list(w)
            for _ in range(int(share * size)):
                v[rnd.randrange(size)] = f"new{rnd.random()}"
            rows.append((100 * k + j, " ".join(v[: int(size * rnd.choice([1, 1, 0.97, 0.8]))])))
    assert got(spark, rows) == brute(rows)


def test_parts_keep_every_link():
    """Whenever whole sets reach the threshold, some part does, and its sketches and prefixes say so."""
    rnd = np.random.default_rng(5)
    for n in (3, 200, 256, 300, 1000, 1025, 5000):
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        b = np.unique(np.r_[a[rnd.random(len(a)) < 0.9], rnd.integers(0, 2**63, n // 20).astype(np.uint64)])
        common = len(np.intersect1d(a, b))
        if 100 * common < 75 * (len(a) + len(b) - common):
            continue
        k = jaccard.level(min(len(a), len(b)))
        assert jaccard.level(int(jaccard.least_partner(max(len(a), len(b)), 75))) <= k
        of = [(x >> np.uint64(64 - 2 * k - 2)).astype(int) if k else np.zeros(len(x), int) for x in (a, b)]
        (m, sa, fa, _), (o, sb, fb, _) = (jaccard.parted(x, None, k, 75) for x in (a, b))
        assert m.sum() == len(a) and len(fa) == jaccard.prefix(m, 75).sum() and len(sa) == (len(m) if k else jaccard.WIDE)
        good = 0
        for p, q in [(p, np.flatnonzero(np.unique(of[1]) == part)) for p, part in enumerate(np.unique(of[0]).tolist())]:
            if not len(q):
                continue
            q = int(q[0])
            apart = np.bitwise_count(sa[p] ^ sb[q]) if k else np.bitwise_count(sa ^ sb).sum()
            u, v = (x[np.repeat(np.arange(len(z)), z) == w] for x, z, w in ((a, m, p), (b, o, q)))
            shared = len(np.intersect1d(u, v))
            if 100 * shared >= 75 * (len(u) + len(v) - shared):
                good += 1
                assert 175 * int(apart) <= 25 * (len(u) + len(v)) and np.isin(fa, v).any()
        assert good


def test_chain_that_min_hash_misses(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "bands", lambda x, count=0: [int(x[0]) >> 1])
    words = [f"u{i}" for i in range(90)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 40])) for i in range(20)]
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one two"), (3, "One  TWO"), (9, "one two three"), (None, "one two"), (8, "one two"), (4, "x " * 5000), (10, "x " * 5001)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    twice = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"), (0, "a b c d e f")]
    assert {r[2] for r in got(spark, twice)} == {0}


def test_query_equals_brute_force(spark):
    from ridgeline.llm.queries import op7_jaccard

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    result = sorted(map(tuple, op7_jaccard(spark, sf).collect()), key=str)
    assert result == brute(rows)
    assert len({r[2] for r in result}) < len(result)
    assert np.mean([r[0] == r[2] for r in result]) > 0.5
