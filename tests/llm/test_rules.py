import random
import re
from collections import Counter

import numpy as np

from ridgeline.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_equals_brute_force():
    rnd = random.Random(3)
    for _ in range(400):
        text = "".join(rnd.choice(["a", "b", "é", "🎉", " ", " ", "\n", "\t", "#", "|", "\x85", "\x1c", "　"]) for _ in range(rnd.randint(0, 80)))
        assert rules.base(text.encode()) == brute(text)
    assert rules.base(b"x " * 50_000)[4] == 50_000


def test_classes_equal_brute_force():
    raw = "Hällo wörld ##".encode()
    want = [(int.from_bytes(raw[i : i + 4], "little") * 2654435761 % 2**32) >> 16 for i in range(len(raw) - 3)]
    assert rules.hashed(raw).tolist() == want
    assert len(rules.hashed(b"abc")) == 0


def test_ratios_and_verdicts(spark):
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choices("aeinrst", k=rnd.randint(2, 7))) for _ in range(300)]
    clean = [" ".join(rnd.choices(vocabulary, k=80)) for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in rnd.choices(vocabulary, k=80)) for _ in range(20)]
    rows = [(i, t, "x") for i, t in enumerate(clean + junk)] + [(900, None, "y"), (901, "", "y"), (0, clean[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    ratio = rules.ratios(df, "doc_id", "text", np.arange(30))
    q, t = np.full(rules.BUCKETS, 0.5), np.zeros(rules.BUCKETS)
    for k, x, _ in rows:
        h = np.bincount(rules.hashed((x or "").encode()), minlength=rules.BUCKETS)
        q, t = q + h, t + h * (k < 30)
    q = q / q.sum()
    assert np.allclose(ratio, np.log((t + rules.PRIOR * q) / (t.sum() + rules.PRIOR) / q))
    got = {r.doc_id: r for r in rules.judge(df, "doc_id", "text", ratio, threshold=-0.2).collect()}
    assert len(got) == 82 and all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 80))
    assert got[900].base_failed and got[901].base_failed and got[900].n_words == 0
    assert rules.judge(df, "doc_id", "text", ratio).count() == len(rows)
    none = np.zeros(0, np.int64)
    assert not rules.ratios(df, "doc_id", "text", none).any()
    assert rules.judge(df.limit(0), "doc_id", "text", rules.ratios(df.limit(0), "doc_id", "text", none)).count() == 0
    nulls = df.selectExpr("CAST(NULL AS LONG) AS doc_id", "text")
    assert np.allclose(rules.ratios(nulls, "doc_id", "text", np.arange(30)), 0)  # counted, but none of them trusted


def test_trusted_ids(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] * 2 + [(None, 1), (200, None)], "doc_id long, quality int")
    every = rules.trusted_ids(labels, "doc_id", labels["quality"] == 1, bound=1000)
    assert every.tolist() == list(range(1, 100, 2))
    some = rules.trusted_ids(labels, "doc_id", labels["quality"] == 1, bound=7)
    assert len(some) == 7 and set(some) < set(every) and (np.diff(some) > 0).all()
    assert some.tolist() == rules.trusted_ids(labels.repartition(5), "doc_id", labels["quality"] == 1, bound=7).tolist()


def test_verdicts_of_documents_that_did_not_train(spark):
    """Half of the labelled documents train; the verdicts on the others agree with their labels."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL")
    held = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    trusted = rules.trusted_ids(labels.where(~held), "doc_id", F.col("quality") == 1)
    got = rules.judge(docs.join(labels.where(held).select("doc_id"), "doc_id", "left_semi"), "doc_id", "text", rules.ratios(docs, "doc_id", "text", trusted))
    rows = got.join(labels.select("doc_id", "quality"), "doc_id").where("NOT base_failed").select("quality", "kept").toPandas()
    good, bad = rows[rows["quality"] == 1], rows[rows["quality"] == 0]
    assert len(good) > 100 and good["kept"].mean() >= 0.98 and (not len(bad) or bad["kept"].mean() <= 0.05)


def test_query_equals_brute_force(spark):
    from ridgeline.llm.queries import op5_rules

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_rules(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, dup, repeat = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)
    q, t = np.full(rules.BUCKETS, 0.5), np.zeros(rules.BUCKETS)
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}  # fewer than the bound
    bags = {k: np.bincount(rules.hashed((x or "").encode()), minlength=rules.BUCKETS) for k, x in texts.items()}
    for k, h in bags.items():
        q, t = q + h, t + h * (k in trusted)
    ratio = np.log((t + rules.PRIOR * q / q.sum()) / (t.sum() + rules.PRIOR) / (q / q.sum()))
    for r in got:
        score = float(bags[r.doc_id] @ ratio / max(1, bags[r.doc_id].sum()))
        assert abs(r.score - score) < 1e-9 and r.kept == (not r.base_failed and score >= rules.THRESHOLD)
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert all(r.kept for r in got if r.doc_id in good and not r.base_failed)
