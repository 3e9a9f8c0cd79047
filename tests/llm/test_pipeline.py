import corpus_pipeline
from ridgeline.llm import pii
from ridgeline.llm.common import written
from tests.llm.test_jaccard import brute
from tests.llm.test_lines import brute as lines_brute
from tests.llm.test_packing import verify

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    """Each stage on what the one before it wrote, against brute force on that input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard_join", "pii", "packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    before, clean, dedup, single, redacted, packed = ({r.doc_id: r for r in d.collect()} if i < 5 else d.collect() for i, d in enumerate(seen))
    assert set(clean) < set(before) and all(clean[k] == before[k] for k in clean)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic IS NOT NULL").collect()}
    toxic, harmless = ({k for k, y in labels.items() if y == z and k in before} for z in (1, 0))
    assert len(toxic - set(clean)) > 0.5 * len(toxic) and len(harmless & set(clean)) >= 0.97 * len(harmless)
    assert set(dedup) <= set(clean) and all(r.n_chars == len(r.text) for r in dedup.values())
    want = {k: t for k, t, _ in lines_brute([(k, r.text) for k, r in clean.items()], corpus_pipeline.COPIES)}
    assert {k: r.text for k, r in dedup.items()} == {k: t for k, t in want.items() if t == clean[k].text or t.split()}
    groups = {k: c for k, _, c in brute([(k, r.text) for k, r in dedup.items()])}
    assert set(single) == {k for k, c in groups.items() if c == k}
    linked = {k for k, _, c in brute([(k, r.text) for k, r in clean.items()]) if c != k}
    assert len(linked & set(single)) <= 0.1 * len(linked)  # near copies of the documents as they came in
    assert all(redacted[k].text == pii.redact(r.text, pii.find(r.text)[1]) for k, r in single.items()) and len(redacted) == len(single)
    assert verify(packed, {k: r.text for k, r in redacted.items()}, 2048) > 0.95


def test_edges(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and an empty table go through all stages."""
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "plain words", "en", "s", 11), (3, "same text here now", "en", "s", 18), (4, "same text here now", "en", "s", 18), (4, "same text here now", "en", None, None), (5, "same text here now " * 25_000, None, "s", 475_000), (6, "now" * 100_000, "en", "s", 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n, (df, left) in enumerate(((docs, [1, 2, 3, 5, 6, None]), (docs.limit(0), []))):
        for name, stage in corpus_pipeline.STAGES[:4]:
            stage(spark, df, SF).write.parquet(str(tmp_path / f"{n}{name}"))
            df = spark.read.parquet(str(tmp_path / f"{n}{name}"))
        assert sorted((r.doc_id for r in df.collect()), key=str) == sorted(left, key=str)
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        packed = corpus_pipeline.pack(spark, df, SF).collect()
        assert {r.doc_id for r in packed} == set(texts)


def test_run(spark):
    """The whole pipeline gives what its stages give one after the other, and leaves no more tables than its last stage reads."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "/root/testdata/sf0.001"))
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(got.select(columns).collect(), key=str) == sorted(docs.select(columns).collect(), key=str)
    assert corpus_pipeline.ORACLE_SQL is None


def test_documents_without_repeats_pass_line_dedup(spark):
    texts = ["Seven swans swim over the cold lake. Nobody at the shore looks up.", *(" ".join(f"Sentence {j} of text {i} says word{i}x{j} to all of us." for j in range(i)) for i in range(2, 12))]
    shared = "\n".join(f"This is line {j} of a passage that two documents have." for j in range(20))
    own = [" ".join(f"own{k}x{j}" for j in range(300)) for k in range(2)]
    texts += [f"Only here we begin with {shared}\nOnly here we end.", f"{own[0]}\n{shared}\n{own[1]}", shared]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert all(left[i].text == t and left[i].n_chars == len(t) for i, t in enumerate(texts[:-2]))
    assert left[12].text == "\n".join(own) and left[12].n_chars == len(left[12].text)
    assert left[13].text == shared  # a copy of a document, which the next stage drops
    assert 13 not in {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
