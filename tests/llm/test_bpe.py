import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENS = bpe.read_ranks(PATH)
CODEC = bpe.Codec(TOKENS, public_tokenizers.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = " \t\n\r\x0b\x85\xa0 　\x1c\x1fabcdefghé'sßtll12٣!?<|>🎉́﻿"


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(ODD, max_size=40)))
def test_equals_library(text):
    ids = CODEC.encode(text)
    assert ids == packed(LIBRARY.encode_ordinary(text))
    assert CODEC.decode(ids) == text.encode()


def test_hash_is_minimal_and_perfect():
    assert sorted(CODEC.table.ids) == list(range(len(TOKENS)))
    assert all(CODEC.table.candidate(t) == i for i, t in enumerate(TOKENS))
    assert TOKENS[CODEC.table.candidate(b"\xff\xfe no such token")] != b"\xff\xfe no such token"


def test_memo_limit_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    codec = bpe.Codec(TOKENS, public_tokenizers.PATTERN, CODEC.table)
    text = "".join(random.Random(5).choices(ODD, k=3000))
    assert codec.encode(text) == CODEC.encode(text)


def test_rows(spark):
    rows = [(1, "Hello, world", "x"), (1, "Hello, world", "x"), (2, None, None), (3, "", "y"), (None, "a" * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode(df, "doc_id", "text", PATH, public_tokenizers.PATTERN, decoded=True)
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = sorted((str(k), packed(LIBRARY.encode_ordinary(t or "")), (t or "").encode()) for k, t, _ in rows)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got.collect()) == want
    back = bpe.decode(got.select("doc_id", "ids"), "doc_id", "ids", PATH, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back.collect()) == [(k, t) for k, _, t in want]
    assert bpe.encode(df.limit(0), "doc_id", "text", PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark):
    from ridgeline.llm.queries import op1_bpe

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op1_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
