"""The queries of this subpackage, each a thin layer over one operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import bpe, html, importance, jaccard, lines, merkle, packing, pii, quality, rules, simhash, sql, topk, toxicity
from ridgeline.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return docs.select("doc_id", bpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", held)
    scored = quality.score(docs, "doc_id", "text", model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", definition, end_id=1, capacity=2048)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_removed", "left_share", "text")


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trusted = rules.trusted_ids(table(spark, sf_dir, "labels"), "doc_id", F.col("quality") == 1)
    ratio = rules.ratios(docs, "doc_id", "text", trusted)
    return rules.judge(docs, "doc_id", "text", ratio)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0, k=10)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), "doc_id", "text", words=5, percent=75)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages"), "page_id", "html", keep=("url",))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", held)
    scored = toxicity.score(docs, "doc_id", "text", model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], "text", lambda k: F.crc32(k.cast("string").cast("binary")) % 5 == 0)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.join(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"op1_bpe": op1_bpe, "op2_quality": op2_quality, "op3_packing": op3_packing, "op4_lines": op4_lines, "op5_rules": op5_rules, "op6_topk": op6_topk, "op7_jaccard": op7_jaccard, "op8_pii": op8_pii, "op9_html": op9_html, "op10_toxicity": op10_toxicity, "op11_importance": op11_importance, "op12_merkle": op12_merkle, "op13_simhash": op13_simhash}
ORACLE_SQL: dict[str, str] = {"op11_importance": sql.importance(), "op12_merkle": sql.merkle()}
