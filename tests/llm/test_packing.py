import random
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from ridgeline.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
DEFINITION = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def verify(rows, texts, capacity):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for k, text in texts.items():
        ids, at = ids_of(text), 0
        for r in sorted(docs[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(packed(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows) / (capacity * len(sequences))


def test_cuts():
    for capacity in (1, 7, 64, 2048):
        for n in (1, 2, 5, 31, 63, 64, 65, 1000, 2047, 2048, 2049, 9999):
            parts = packing.cut(n, capacity)
            assert sum(x for x, _ in parts) == n
            assert all(capacity // (k + 1) < x * 1.02 + 1 and x * k <= capacity for x, k in parts)


def test_tokens_equal_library():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(" \t\n\x85\xa0　\x1cabcé'st!12🎉") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    texts += ["a <|endoftext|> b  <|endoftext|>", "", "x" * 5000]
    tokens = packing.Tokens(DEFINITION)
    assert tokens.fast is not None
    want = [packed(ids_of(t)[:-1]) for t in texts]
    assert [tokens.encode(t) for t in texts] == want
    tokens.fast = None
    tokens.memo.clear()
    assert [tokens.encode(t) for t in texts] == want


def test_other_definitions_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = packing.Tokens(open(path, encoding="utf-8").read())
    assert tokens.fast is None
    assert tokens.encode("Hello") == packed(Tokenizer.from_file(path).encode("Hello", add_special_tokens=False).ids)


def test_pack(spark):
    rnd = random.Random(9)
    texts = {i: " ".join(rnd.choices(["alpha", "beta", "gamma", "delta"], k=rnd.randint(0, 300))) for i in range(300)} | {500: None, 501: "", 502: "word " * 9000}
    df = spark.createDataFrame([(k, t, 1, "z") for k, t in texts.items()], "doc_id long, text string, length int, kind string").repartition(5)
    rows = packing.pack(df, "doc_id", "text", DEFINITION, 1, 256, with_ids=True).collect()
    assert verify(rows, texts, 256) > 0.97
    assert all(bytes(r.ids) == packed(ids_of(texts[r.doc_id])[r.start : r.start + r.length]) for r in rows)
    assert packing.pack(df.limit(0), "doc_id", "text", DEFINITION, 1, 256).count() == 0


def test_repeated_rows_and_null_keys(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text")], "doc_id long, text string")
    rows = packing.pack(df, "doc_id", "text", DEFINITION, 1).collect()
    assert sum(r.length for r in rows) == 3 * len(ids_of("same text"))
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_query(spark):
    from ridgeline.llm.queries import op3_packing

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert verify(op3_packing(spark, sf).collect(), texts, 2048) > 0.97
