"""The dual encoder and the pair model, trained on `embeddings`, and the audit of a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgeline.operators import encoder, learn, retrieval, search
from ridgeline.plans.retrieval import described
from ridgeline.plans.search import corpus
from ridgeline.sources import parquet
from ridgeline.storage import written


def dual_encoder_blends(spark, sf_dir):
    """Queries see a vector with its first half dimmed; the learned score of the codes re-ranks their first ten."""
    c = written(corpus(spark, sf_dir))
    seen = c.select("id", "grp", F.transform("v", lambda x, i: F.when(i < 32, 0.25 * x).otherwise(x)).alias("v"))
    pairs = seen.withColumnRenamed("v", "q").join(c.select("id", F.col("v").alias("t")), "id")
    model = encoder.train(pairs.where(F.pmod(F.xxhash64("id"), F.lit(5)) > 0), "q", "t", dims=16)
    rows = search.topk(c, seen, 10, exclude_self=False)
    codes = encoder.encoded(c, "v", model, False).select("id", F.col("code").alias("theirs"))
    asked = encoder.encoded(seen, "v", model, True).select(F.col("id").alias("query_id"), F.col("code").alias("mine"))
    scored = rows.join(asked, "query_id").join(codes, "id")
    scored = scored.select("query_id", "id", "rank", "score", encoder.similarity(F.col("mine"), F.col("theirs")).alias("learned"), (F.col("id") == F.col("query_id")).alias("relevant"))
    ranks = encoder.blended_ranks(scored, list(learn.BLENDS), 10)
    return learn.choose_blend(ranks).select("weight", "queries", *[F.round(c, 6).alias(c) for c in ("top_1", "recall_at_5", "recall_at_10", "mrr")])


def blend_ranks(spark, sf_dir):
    """Customers' orders, ranked by price; those of status F are relevant, the share of the key's last digits is the learned score."""
    o = parquet(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 1e6, 9).cast("double").alias("score"), (F.col("o_orderkey") * 37 % 100 / 100.0).cast("double").alias("learned"), (F.col("o_orderstatus") == "F").alias("relevant"))
    ranks = encoder.blended_ranks(search.ranked(o), [0.0, 0.1, 0.5], 4)
    return ranks.select("weight", "queries", *[F.round(c, 6).alias(c) for c in ("top_1", "recall_at_5", "recall_at_10", "mrr")])


def pairwise_reranker(spark, sf_dir):
    """Weights of the pair model, learned from neighbours of the same and of other samples."""
    d = written(described(spark, sf_dir))
    near = search.topk(d.select("id", F.col("sample").alias("grp"), "v"), d.select("id", F.col("sample").alias("grp"), "v"), 10, search.two_views())
    rows = retrieval.pair_features(near.select("query_id", "id", "score", (F.col("grp") == F.col("query_grp")).cast("int").alias("label")), d, d)
    weights, intercept = learn.monotone_logistic(written(rows.select("label", *retrieval.FEATURES)), list(retrieval.FEATURES), "label")
    return spark.createDataFrame([*((n, round(w, 4)) for n, w in weights.items()), ("intercept", round(intercept, 4))], "feature string, weight double")


def _reports(spark, sf_dir):
    """Suppliers' nations as suites, their line items as groups of fixtures."""
    li = parquet(spark, sf_dir, "lineitem")
    suite = F.concat(F.lit("suite-"), F.col("l_suppkey") % 9)
    named = F.when(F.col("l_suppkey") % 9 == 0, encoder.STRICT_SUITE).otherwise(suite)
    share = lambda c, n, least: (least + F.col(c) % n / (n / (1 - least))).cast("double")
    groups = li.where("l_orderkey % 1500 = l_suppkey % 9").select(
        named.alias("suite"), (F.col("l_linenumber") < 8).alias("states"), (F.col("l_partkey") % 9 > 0).alias("top"), (F.col("l_partkey") % 5 > 0).alias("top_two"),
        share("l_orderkey", 40, 0.955).alias("profile"), share("l_partkey", 20, 0.78).alias("top_five"), share("l_quantity", 25, 0.68).alias("top_ten"),
    )
    s = parquet(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 9 == 0, encoder.STRICT_SUITE).otherwise(F.concat(F.lit("suite-"), F.col("s_suppkey") % 9)).alias("suite"), "s_suppkey")
    n = F.count("*")
    reports = s.groupBy("suite").agg(n.alias("fixtures"), n.alias("preprocessing"), F.count_if(F.col("s_suppkey") != 12).alias("states"), n.alias("search"), n.alias("end_to_end"))
    return reports, groups


def encoder_audit(spark, sf_dir):
    return encoder.audit(*_reports(spark, sf_dir))


def encoder_promotion(spark, sf_dir):
    return encoder.promoted(encoder.audit(*_reports(spark, sf_dir)), True, 0.05)


QUERIES = {f.__name__: f for f in (dual_encoder_blends, blend_ranks, pairwise_reranker, encoder_audit, encoder_promotion)}

_AUDIT = (
    "WITH g AS (SELECT CASE WHEN l_suppkey % 9 = 0 THEN 'user-peak-valley' ELSE 'suite-' || l_suppkey % 9 END AS suite, l_linenumber < 8 AS states, l_partkey % 9 > 0 AS top, l_partkey % 5 > 0 AS two, 0.955::DOUBLE + l_orderkey % 40 / (40 / (1 - 0.955::DOUBLE)) AS profile, 0.78::DOUBLE + l_partkey % 20 / (20 / (1 - 0.78::DOUBLE)) AS five, 0.68::DOUBLE + l_quantity % 25 / (25 / (1 - 0.68::DOUBLE)) AS ten FROM lineitem WHERE l_orderkey % 1500 = l_suppkey % 9), "
    "p AS (SELECT suite, bool_and(CASE WHEN suite = 'user-peak-valley' THEN states AND top AND profile >= 0.92 AND five >= 1 AND ten >= 0.8 ELSE states AND profile >= 0.95 AND ((five >= 0.8 AND (top OR five >= 1)) OR (profile >= 0.98 AND top AND five >= 0.6 AND ten >= 0.8) OR (profile >= 0.98 AND five >= 0.6 AND ten >= 0.9 AND two) OR (profile >= 0.96 AND ten >= 0.7)) END) AS ok FROM g GROUP BY suite), "
    "r AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'user-peak-valley' ELSE 'suite-' || s_suppkey % 9 END AS suite, count(*) FILTER (s_suppkey <> 12) = count(*) AS counts FROM supplier GROUP BY 1), a AS (SELECT suite, counts AS counts_passed, coalesce(ok, false) AS groups_passed, counts AND coalesce(ok, false) AS passed FROM r LEFT JOIN p USING (suite))"
)
ORACLE_SQL = {
    "blend_ranks": "WITH o AS (SELECT o_custkey AS q, o_orderkey AS id, round((o_totalprice / 1e6)::DOUBLE, 9) AS score, (o_orderkey * 37 % 100 / 100.0)::DOUBLE AS learned, o_orderstatus = 'F' AS good FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM o), w AS (SELECT *, unnest([0.0, 0.1, 0.5]::DOUBLE[]) AS weight FROM r), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY weight, q ORDER BY CASE WHEN rank <= 4 THEN 0 ELSE 1 END, CASE WHEN rank <= 4 THEN round((1 - weight) * score + weight * learned, 9) END DESC, rank) AS place FROM w), f AS (SELECT weight, q, min(place) FILTER (good) AS first FROM b GROUP BY ALL) "
    "SELECT weight, count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS top_1, round(avg(CASE WHEN first <= 5 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / first, 0.0)), 6) AS mrr FROM f GROUP BY weight",
    "encoder_audit": f"{_AUDIT} SELECT suite, counts_passed, groups_passed, passed FROM a",
    "encoder_promotion": f"{_AUDIT} SELECT bool_and(passed) AND count(*) FILTER (suite IN ('public', 'measured-multisource', 'user-peak-valley')) = 3 AS promoted, 'public,measured-multisource' AS missing, coalesce(string_agg(suite, ',' ORDER BY suite) FILTER (NOT passed), '') AS failed FROM a",
}
