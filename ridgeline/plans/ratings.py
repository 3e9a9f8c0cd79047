"""Ratings, consensus and classifier metrics: raters of `events` (a day rated per event type), labels of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.operators import feedback, learn, metrics, tables
from ridgeline.sources import parquet

PAIR, KEY = ["query", "candidate"], ["query", "candidate", "rater"]


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parquet(spark, sf_dir, "events")
    return e.select(F.date_trunc("day", "ts").alias("query"), F.col("event_type").alias("candidate"), (F.col("user_id") % 7).alias("rater"), F.col("ts").alias("created_at"), F.col("event_id").alias("arrived"), (F.col("value") >= 50).cast("long").alias("label"), "value")


def retained(spark, sf_dir) -> DataFrame:
    return feedback.latest(ratings(spark, sf_dir), KEY, ["created_at", "arrived"])


def pairs(spark, sf_dir) -> DataFrame:
    return feedback.consensus(retained(spark, sf_dir), PAIR, "rater", "label", ["value"])


def ratings_latest_wins(spark, sf_dir):
    return retained(spark, sf_dir).select(*KEY, "created_at", "arrived", "label")


def rating_duplicates(spark, sf_dir):
    return feedback.encounters(ratings(spark, sf_dir), KEY, "created_at", "arrived", "label")


def consensus_majority(spark, sf_dir):
    return pairs(spark, sf_dir).where("label IS NOT NULL").select(*PAIR, "positives", "negatives", F.col("label").cast("long").alias("label"), F.round("agreement", 6).alias("agreement"))


def agreement_rate(spark, sf_dir):
    return feedback.agreement(pairs(spark, sf_dir)).select(F.round("agreement", 6).alias("agreement"))


def pair_class_counts(spark, sf_dir):
    return feedback.classes(pairs(spark, sf_dir))


def consensus_feature_means(spark, sf_dir):
    return pairs(spark, sf_dir).select(*PAIR, F.round("mean_value", 4).alias("mean_value"), "raters")


def consensus_ready_having(spark, sf_dir):
    ready = retained(spark, sf_dir).groupBy("query").agg(F.count_distinct("rater").alias("n")).where("n >= 2")
    return ready.agg(F.count("*").alias("ready_queries"))


def report_totals_distinct(spark, sf_dir):
    r = ratings(spark, sf_dir).where("label = 1")
    return r.agg(F.count("*").alias("reports"), F.coalesce(F.sum("label"), F.lit(0)).alias("judgments"), F.count_distinct("query").alias("queries"))


def label_counters(spark, sf_dir):
    return retained(spark, sf_dir).groupBy("candidate", F.col("label").cast("string").alias("label_key")).agg(F.count("*").alias("n"))


def rater_lists(spark, sf_dir):
    rows = retained(spark, sf_dir).groupBy(*PAIR).agg(F.sort_array(F.collect_set("rater")).alias("r"))
    return rows.select(*PAIR, F.array_join(F.transform("r", lambda x: x.cast("string")), ",").alias("raters"))


def scored(spark, sf_dir) -> DataFrame:
    d = parquet(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    p = lambda n: F.col("n_chars") / (F.col("n_chars") + n)
    return parquet(spark, sf_dir, "labels").join(d, "doc_id").withColumns({"p": p(1000), "p2": p(500)})


def roc_auc(spark, sf_dir):
    return metrics.auc(scored(spark, sf_dir), "quality", "n_chars").select(F.round("auc", 6).alias("auc"))


def roc_auc_by_lang(spark, sf_dir):
    return metrics.auc(scored(spark, sf_dir), "quality", "n_chars", ["lang"]).select("lang", F.round("auc", 6).alias("auc"))


def log_loss_brier(spark, sf_dir):
    y, p = F.col("quality"), F.col("p")
    return scored(spark, sf_dir).agg(F.count("*").alias("n"), F.round(metrics.share((p >= 0.5) == (y == 1)), 6).alias("accuracy"), F.round(metrics.log_loss(y, p), 6).alias("log_loss"), F.round(metrics.brier(y, p), 6).alias("brier"))


def query_macro_accuracy(spark, sf_dir):
    by = scored(spark, sf_dir).groupBy("source").agg(metrics.share((F.col("p") >= 0.5) == (F.col("quality") == 1)).alias("a"))
    return by.agg(F.count("*").alias("groups"), F.round(F.avg("a"), 6).alias("macro_accuracy"))


def model_delta_gates(spark, sf_dir):
    s = scored(spark, sf_dir)
    y = F.col("quality")
    hit = lambda p: metrics.share((F.col(p) >= 0.5) == (y == 1))
    every = s.agg(*[x.alias(f"{n}_{p}") for p in ("p", "p2") for n, x in (("acc", hit(p)), ("ll", metrics.log_loss(y, F.col(p))))], F.count("*").alias("n"), F.count_distinct("quality").alias("classes"))
    macro = s.groupBy("source").agg(hit("p").alias("a"), hit("p2").alias("b")).agg((F.avg("b") - F.avg("a")).alias("macro_accuracy"), F.count("*").alias("groups"))
    auc = metrics.auc(s, "quality", "p").withColumnRenamed("auc", "auc1").join(metrics.auc(s, "quality", "p2").withColumnRenamed("auc", "auc2"), how="cross")  # one row each
    d = every.join(macro, how="cross").join(auc, how="cross").withColumns({"auc": F.col("auc2") - F.col("auc1"), "accuracy": F.col("acc_p2") - F.col("acc_p"), "log_loss": F.col("ll_p2") - F.col("ll_p")})
    names = ("auc", "accuracy", "log_loss", "macro_accuracy")
    evidence = (F.col("n") >= metrics.EVIDENCE["pairs"]) & (F.col("groups") >= metrics.EVIDENCE["groups"]) & (F.col("classes") == 2)
    return d.select(*[F.round(n, 6).alias(f"{n}_delta") for n in names], metrics.promotion({n: F.col(n) for n in names}, evidence).alias("recommendation"))


def pairwise_logistic_scores(spark, sf_dir):
    d = parquet(spark, sf_dir, "documents")
    z = 0.6 * F.least(F.col("n_chars") / 5000, F.lit(1.0)) + 1.2 * (F.col("lang") == "en").cast("double") - 0.9
    return d.select("doc_id", F.round(metrics.sigmoid(z), 6).alias("score"), F.round(metrics.softplus(z), 6).alias("softplus"))


def monotone_lr_fit(spark, sf_dir):
    s = scored(spark, sf_dir).select(F.col("p").alias("length_share"), (F.col("lang") == "en").cast("double").alias("english"), "quality")
    weights, intercept = learn.monotone_logistic(s, ["length_share", "english"], "quality")
    return spark.createDataFrame([(k, round(v, 4)) for k, v in [*weights.items(), ("intercept", intercept)]], "parameter string, value double")


def hash_group_split(spark, sf_dir):
    users = parquet(spark, sf_dir, "events").select("user_id").distinct()
    return tables.group_split(users, "user_id", 20260727, 1 / 3).select("user_id", "held_out")


def stratified_split_counts(spark, sf_dir):
    parts = parquet(spark, sf_dir, "part").select("p_partkey", "p_brand").distinct()
    return tables.group_split(parts, "p_partkey", 7, 0.2, by="p_brand").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if("held_out").alias("held_out"))


QUERIES = {f.__name__: f for f in (
    ratings_latest_wins, rating_duplicates, consensus_majority, agreement_rate, pair_class_counts, consensus_feature_means, consensus_ready_having, report_totals_distinct,
    label_counters, rater_lists, roc_auc, roc_auc_by_lang, log_loss_brier, query_macro_accuracy, model_delta_gates, pairwise_logistic_scores, monotone_lr_fit, hash_group_split, stratified_split_counts,
)}

_R = "WITH r AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS query, event_type AS candidate, user_id % 7 AS rater, ts AS created_at, event_id AS arrived, CAST(value >= 50 AS BIGINT) AS label, value FROM events)"
_L = f"{_R}, l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query, candidate, rater ORDER BY created_at DESC, arrived DESC) = 1)"
_P = f"{_L}, p AS (SELECT query, candidate, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, count(DISTINCT rater) AS raters, avg(value) AS mean_value FROM l GROUP BY ALL)"
_S = "WITH s AS (SELECT l.*, d.lang, d.source, d.n_chars, CAST(n_chars AS DOUBLE) / (n_chars + 1000) AS p, CAST(n_chars AS DOUBLE) / (n_chars + 500) AS p2 FROM labels l JOIN documents d USING (doc_id))"


def _auc(score: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"SELECT {by + ',' if by else ''} (sum(CASE WHEN quality = 1 THEN k END) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / nullif(count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0), 0) AS auc FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by + ',' if by else ''} {score}) - 1) / 2.0 AS k FROM s) {'GROUP BY ' + by if by else ''}"


def _hit(p: str) -> str:
    return f"avg(CASE WHEN ({p} >= 0.5) = (quality = 1) THEN 1.0 ELSE 0.0 END)"


def _ll(p: str) -> str:
    q = f"greatest(1e-7, least(1 - 1e-7, {p}))"
    return f"avg(-(quality * ln({q}) + (1 - quality) * ln(1 - {q})))"


ORACLE_SQL = {
    "ratings_latest_wins": f"{_L} SELECT query, candidate, rater, created_at, arrived, label FROM l",
    "rating_duplicates": f"{_R}, k AS (SELECT label, arg_max(label, (created_at, arrived)) OVER (PARTITION BY query, candidate, rater ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM r) SELECT count(kept) AS duplicates, count(*) FILTER (kept <> label) AS conflicts FROM k",
    "consensus_majority": f"{_P} SELECT query, candidate, positives, negatives, CAST(positives > negatives AS BIGINT) AS label, round(greatest(positives, negatives) / (positives + negatives), 6) AS agreement FROM p WHERE positives <> negatives",
    "agreement_rate": f"{_P} SELECT round(sum(positives * (positives - 1) / 2 + negatives * (negatives - 1) / 2) / nullif(sum((positives + negatives) * (positives + negatives - 1) / 2), 0), 6) AS agreement FROM p",
    "pair_class_counts": f"{_P} SELECT count(*) AS pairs, count(*) FILTER (positives + negatives >= 2) AS multi, count(*) FILTER (positives + negatives >= 2 AND (positives = 0 OR negatives = 0)) AS unanimous, count(*) FILTER (positives > 0 AND negatives > 0) AS conflict, count(*) FILTER (positives > 0 AND negatives > 0 AND positives <> negatives) AS majority, count(*) FILTER (positives = negatives) AS tie FROM p",
    "consensus_feature_means": f"{_P} SELECT query, candidate, round(mean_value, 4) AS mean_value, raters FROM p",
    "consensus_ready_having": f"{_L} SELECT count(*) AS ready_queries FROM (SELECT query FROM l GROUP BY query HAVING count(DISTINCT rater) >= 2)",
    "report_totals_distinct": f"{_R} SELECT count(*) AS reports, CAST(coalesce(sum(label), 0) AS BIGINT) AS judgments, count(DISTINCT query) AS queries FROM r WHERE label = 1",
    "label_counters": f"{_L} SELECT candidate, CAST(label AS VARCHAR) AS label_key, count(*) AS n FROM l GROUP BY ALL",
    "rater_lists": f"{_L} SELECT query, candidate, array_to_string(list_sort(list(DISTINCT rater)), ',') AS raters FROM l GROUP BY ALL",
    "roc_auc": f"{_S} SELECT round(auc, 6) AS auc FROM ({_auc('n_chars')})",
    "roc_auc_by_lang": f"{_S} SELECT lang, round(auc, 6) AS auc FROM ({_auc('n_chars', 'lang')})",
    "log_loss_brier": f"{_S} SELECT count(*) AS n, round({_hit('p')}, 6) AS accuracy, round({_ll('p')}, 6) AS log_loss, round(avg(pow(p - quality, 2)), 6) AS brier FROM s",
    "query_macro_accuracy": f"{_S} SELECT count(*) AS groups, round(avg(a), 6) AS macro_accuracy FROM (SELECT source, {_hit('p')} AS a FROM s GROUP BY source)",
    "model_delta_gates": f"{_S}, d AS (SELECT (SELECT auc FROM ({_auc('p2')})) - (SELECT auc FROM ({_auc('p')})) AS auc, (SELECT {_hit('p2')} - {_hit('p')} FROM s) AS accuracy, (SELECT {_ll('p2')} - {_ll('p')} FROM s) AS log_loss, (SELECT avg(b) - avg(a) FROM (SELECT {_hit('p')} AS a, {_hit('p2')} AS b FROM s GROUP BY source)) AS macro_accuracy, (SELECT count(*) >= 20 AND count(DISTINCT source) >= 3 AND count(DISTINCT quality) = 2 FROM s) AS evidence) SELECT round(auc, 6) AS auc_delta, round(accuracy, 6) AS accuracy_delta, round(log_loss, 6) AS log_loss_delta, round(macro_accuracy, 6) AS macro_accuracy_delta, CASE WHEN NOT evidence THEN 'insufficient-evidence' WHEN coalesce(auc >= -0.01, false) AND accuracy >= -0.02 AND log_loss <= 0.02 AND macro_accuracy >= -0.02 AND (coalesce(auc >= 0.005, false) OR log_loss <= -0.01 OR macro_accuracy >= 0.02) THEN 'promote-candidate' ELSE 'keep-baseline' END AS recommendation FROM d",
    "pairwise_logistic_scores": "WITH z AS (SELECT doc_id, 0.6::DOUBLE * least(CAST(n_chars AS DOUBLE) / 5000, 1.0::DOUBLE) + 1.2::DOUBLE * CAST(lang = 'en' AS DOUBLE) - 0.9::DOUBLE AS z FROM documents) SELECT doc_id, round(1 / (1 + exp(-z)), 6) AS score, round(greatest(z, 0::DOUBLE) + ln(1 + exp(-abs(z))), 6) AS softplus FROM z",
    "hash_group_split": "WITH u AS (SELECT DISTINCT user_id FROM events), k AS (SELECT user_id, row_number() OVER (ORDER BY sha256('20260727:' || user_id), user_id) AS place, count(*) OVER () AS n FROM u) SELECT user_id, n >= 2 AND place <= greatest(1, least(n - 1, CAST(round_even(n * CAST(0.3333333333333333 AS DOUBLE), 0) AS BIGINT))) AS held_out FROM k",
    "stratified_split_counts": "WITH u AS (SELECT DISTINCT p_partkey, p_brand FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('7:' || p_partkey), p_partkey) AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM u) SELECT p_brand, count(*) AS n, count(*) FILTER (n >= 2 AND place <= greatest(1, least(n - 1, CAST(round_even(n * CAST(0.2 AS DOUBLE), 0) AS BIGINT)))) AS held_out FROM k GROUP BY p_brand",
}
