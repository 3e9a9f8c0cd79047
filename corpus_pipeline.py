"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Toxic documents go; repeated passages go, with documents that consist of passages of several others and nothing else;
of each group of near copies the document of the smallest id stays; personal data is replaced by its kind; what is left
is packed into sequences. Every stage but the last returns the columns of documents, with n_chars set to the length of
the text it leaves.

Removing lines first would tear copies of documents apart, and the third stage would no longer know the rest of them as
near copies. So the second stage leaves a document whole that shares COPIES of its words and those of one single earlier
document: whether it stays is for the third stage to say.

Null or empty texts pass all filters (their toxicity is that of no words) and are packed as an end id alone. Rows
without an id are kept by every filter that their text doesn't fail. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import jaccard, lines, packing, pii, toxicity
from ridgeline.llm.common import table, written
from ridgeline.storage import scratch

TOXIC_FROM, COPIES = 0.7, 0.5
ORACLE_SQL = None


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, n_chars in step with the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(like.columns) if "n_chars" in like.columns else df.select(like.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is trained on labels of the original documents that aren't held out."""
    held = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", held)
    return toxicity.keep(docs, "text", model, TOXIC_FROM)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, but not out of copies of whole documents; documents without a word left go."""
    out = lines.dedup(docs, "doc_id", "text", copies=COPIES)
    return _columns(out.where("left_share > 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by links of 0.75 the smallest id stays, with all its rows; rows without an id stay."""
    groups = jaccard.join(docs, "doc_id", "text", words=5, percent=75)
    lost = groups.where("component_id < doc_id").select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, docs["doc_id"] == lost["_lost"], "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data, disguised or not, becomes its kind in brackets; no row goes."""
    return _columns(pii.redacted(docs, "text"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document, with its sequence and offset there."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return packing.pack(docs, "doc_id", "text", definition, end_id=1, capacity=2048)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_jaccard_join", drop_near_copies), ("pii", redact_personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each other stage's table is written and read again; what it wrote on its way is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as outside:
            docs = written(stage(spark, docs, sf_dir), outside)
    return STAGES[-1][1](spark, docs, sf_dir)
