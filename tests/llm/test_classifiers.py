import random

import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import quality, toxicity


def test_toxicity_generalises_to_misspellings():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("aeilmnorst", k=rnd.randint(2, 9))) for _ in range(800)]
    bad = ["blorgface", "snizzwit", "grumpfool"]
    texts, labels = [], []
    for i in range(400):
        ws = rnd.choices(vocabulary, k=rnd.randint(20, 120))
        if i % 4 == 0:
            for _ in range(3):
                ws.insert(rnd.randrange(len(ws)), rnd.choice(bad))
        texts.append(ws)
        labels.append(int(i % 4 == 0))
    scorer = toxicity.Scorer(toxicity.Model().fit(texts[:300], labels[:300]))
    got = [scorer.score(" ".join(t)) >= 0.7 for t in texts[300:]]
    assert np.mean([g == bool(y) for g, y in zip(got, labels[300:])]) > 0.93
    assert scorer.score(" ".join(texts[1]) + " Blorgfacce!!") > 0.7
    assert 0 <= scorer.score(None) == scorer.score("") <= 1
    monkey = toxicity.Scorer(scorer.model)
    monkey.MEMO = 5
    assert [monkey.score(" ".join(t)) for t in texts[:20]] == [scorer.score(" ".join(t)) for t in texts[:20]]


def test_toxic_words_within_long_ones():
    assert set(toxicity.grams("a" * 40 + "badword" + "b" * 40)) != set(toxicity.grams("a" * 40 + "goodwrd" + "b" * 40))
    assert len(toxicity.grams("x" * 1000)) == 3 * 1002 - 9 + 1


def test_softmax_is_the_score():
    """The score is class 1 of the trained softmax over a span's averaged vectors."""
    rnd = random.Random(6)
    texts = [[rnd.choice("abcdefgh") * 4 for _ in range(20)] + ["blorgface"] * (i % 2) for i in range(80)]
    model = toxicity.Model().fit(texts, [i % 2 for i in range(80)])
    for ws in (["aaaa", "blorgface"], ["bbbb"], ["cccc", "dddd", "eeee"]):
        hidden = np.mean([model.vectors[toxicity.grams(w)].mean(axis=0) for w in ws], axis=0)
        assert abs(toxicity.Scorer(model).score(" ".join(ws)) - model.softmax((hidden @ model.weights + model.bias)[None])[0, 1]) < 1e-9


def test_quality_gradients_and_attention():
    m = quality.Model(3)
    r = np.random.default_rng(0)
    m.p["W"][:50] = r.normal(0, 0.3, (50, quality.HIDDEN))
    x, starts, y, w = r.random((7, quality.N_FEATURES)), np.array([0, 2, 3]), np.array([1, 0, 1]), np.ones(3)
    counts = np.array([3, 0, 5, 1, 2, 0, 4])
    bag = (x, r.integers(0, 50, counts.sum()), counts)

    def loss():
        z, _ = m.forward(bag, starts)
        return float(np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))))

    grads = m._grads(bag, starts, y, w)
    met = grads.pop("met")
    for k, g in grads.items():
        for i in (0, g.size // 2):
            at = np.unravel_index(i, g.shape)
            place = (met[at[0]], *at[1:]) if k == "W" else at
            kept = m.p[k][place]
            m.p[k][place] = kept + 1e-5
            up = loss()
            m.p[k][place] = kept - 1e-5
            down = loss()
            m.p[k][place] = kept
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6
    assert np.allclose(np.add.reduceat(m.forward(bag, starts)[1]["a"], starts), 1)


def test_features():
    for t in (None, "", "   "):
        x, classes, counts = quality.features(t)
        assert x.tolist() == [[0] * quality.N_FEATURES] and len(classes) == 0 and counts.tolist() == [0]
    x, classes, counts = quality.features("Word " * 130)
    assert x.shape == (3, quality.N_FEATURES) and np.isfinite(x).all() and x[0, 9] == 1 / 64 and counts.tolist() == [127, 127, 3]
    assert quality.features("THE!! CAT!!")[0][0, 0] == 1


def test_features_equal_brute_force():
    rnd = random.Random(8)
    for _ in range(50):
        ws = [rnd.choice(["a", "bb", "Ccc", "é", "x1!"]) * rnd.randint(1, 2) for _ in range(rnd.randint(1, 200))]
        x, classes, counts = quality.features(" ".join(ws))
        for i in range(len(x)):
            part = ws[64 * i : 64 * i + 64]
            raw, m = [w.encode() for w in part], len(part)
            pairs = list(zip(part, part[1:]))
            want = [m / 64, len({*part}) / m, sum(a == b for a, b in pairs) / m, max(map(part.count, part)) / m, sum(map(len, raw)) / m / 16, len({*pairs}) / max(1, m - 1)]
            assert np.allclose(x[i, 8:], want) and counts[i] == 2 * m - 1
        assert counts.sum() == len(classes)


def test_words_decide_quality():
    """Two kinds of documents that look alike: only what they say differs."""
    rnd = random.Random(9)
    good, bad = (["".join(rnd.choices("aeiourst", k=5)) for _ in range(60)] for _ in range(2))
    texts = [" ".join(rnd.choices(good if i % 2 else bad, k=150)) for i in range(120)]
    model = quality.Model().fit([quality.features(t) for t in texts[:80]], np.arange(80) % 2)
    assert all((model.score(t) > 0.5) == bool(i % 2) for i, t in enumerate(texts[80:]))


def held_out_accuracy(spark, query, label, parts, part):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = query(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    good = (rows.predicted == rows.y)
    return good[rows.y == 1].mean(), good[rows.y == 0].mean()


def test_quality_held_out(spark):
    from ridgeline.llm.queries import op2_quality

    assert min(held_out_accuracy(spark, op2_quality, "quality", 5, 0)) > 0.97


def test_toxicity_held_out(spark):
    from ridgeline.llm.queries import op10_toxicity

    toxic, clean = held_out_accuracy(spark, op10_toxicity, "toxic", 3, 1)
    assert toxic > 0.8 and clean > 0.93


def test_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, None, None), (None, "", "t")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(None, 1, 1), (7, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    held = toxicity.held_out(F.col("doc_id"), 5, 9)
    for module, label, value in ((quality, "quality", 0.5), (toxicity, "toxic", 0.0)):
        model = module.fit(docs, none, "doc_id", "text", label, held)
        assert model is None
        assert sorted(map(str, module.score(docs, "doc_id", "text", model).collect())) == sorted(f"Row(doc_id={k}, score={value})" for k in (1, 1, 2, None))
        assert module.score(docs.limit(0), "doc_id", "text", model).count() == 0


def test_sample_is_bounded_and_repeats_bring_no_more(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i}") for i in range(100)] + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, "doc_id", "text", "toxic", F.lit(False), 3).collect()
    assert len(rows) == 6 and {r._y for r in rows} == {0, 1} and len({r._id for r in rows}) == 6
    assert all(r._text == "" or int(r._text.split()[1]) % 10 == r._id for r in rows)


def test_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000), (2, "x" * 1_000_000)], "doc_id long, text string")
    model = quality.Model().fit([quality.features("a b"), quality.features("C! D!")], np.array([1, 0]))
    tox = toxicity.Model().fit([["aaa"] * 9, ["bbb"] * 9] * 4, [0, 1] * 4)
    for module, m in ((quality, model), (toxicity, tox)):
        assert all(0 <= r.score <= 1 for r in module.score(docs, "doc_id", "text", m).collect())
