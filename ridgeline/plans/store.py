"""Keyed tables, intake, text cleaning, JSON and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions import text
from ridgeline.operators import feedback, intake, tables
from ridgeline.sources import parquet


def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parquet(spark, sf_dir, "embeddings")
    return e.agg(F.count("*").alias("total"), F.count_if(F.col("label") < 5).alias("ready"), F.count_if(F.col("label") >= 5).alias("pending"), F.max("vec_id").alias("last_id"))


def fingerprint_dedup(spark, sf_dir):
    return tables.fingerprint_dedup(parquet(spark, sf_dir, "documents"), F.col("text"), "doc_id")


def shape_fingerprints(spark, sf_dir):
    e = parquet(spark, sf_dir, "embeddings")
    bits = F.transform("embedding", lambda x: F.when(x >= 0, "1").otherwise("0"))
    return e.select("vec_id", F.sha2(F.concat(F.col("label").cast("string"), F.lit(":"), F.array_join(bits, ",")), 256).alias("fingerprint"))


def keyset_page(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return tables.keyset_page(o, "o_orderdate", "o_orderkey", 50)


def _calls(spark, sf_dir) -> DataFrame:
    return parquet(spark, sf_dir, "events").select("event_id", "user_id", "ts")


def rolling_24h_count(spark, sf_dir):
    return tables.rolling_count(_calls(spark, sf_dir), "user_id", "ts").select("event_id", "user_id", "in_window")


def rate_limited_rows(spark, sf_dir):
    return tables.rolling_count(_calls(spark, sf_dir), "user_id", "ts").where("in_window > 4").select("event_id", "user_id", "in_window")


def _accounts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The customers, and their orders as later versions of the same keys."""
    c = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("amount"))
    o = parquet(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("name"), F.round("o_totalprice", 2).alias("amount"), "o_orderdate", "o_orderkey")
    return c, o


def upsert_latest(spark, sf_dir):
    target, source = _accounts(spark, sf_dir)
    return tables.upsert(target, source, "key", ["o_orderdate", "o_orderkey"])


def prune_except(spark, sf_dir):
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "source")
    keep = parquet(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return tables.prune(docs, F.col("source") == "src3", keep, "doc_id")


def soft_delete(spark, sf_dir):
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("active").alias("status"))
    return tables.soft_delete(docs, F.col("lang") == "de").groupBy("status", "lang").agg(F.count("*").alias("n"))


def source_semi_join(spark, sf_dir):
    ids = parquet(spark, sf_dir, "labels").where("toxic = 0").select("doc_id")
    return parquet(spark, sf_dir, "documents").join(ids, "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


def candidate_set_merge(spark, sf_dir):
    c = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 0).alias("can_delete"), F.col("c_name").alias("label"), F.col("c_nationkey").alias("state"))
    s = parquet(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") < 0).alias("can_delete"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("label"), F.col("s_nationkey").alias("state"))
    return tables.merge_sets([c, s], "id", "can_delete").select("id", F.col("first_set").cast("long").alias("first_set"), "can_delete", "label", "state")


def _rows_as_text(spark, sf_dir) -> DataFrame:
    """A manifest in text, with blanks, bad numbers and repeats, one row per document."""
    d = parquet(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        k.alias("position"), "lang",
        F.when(k % 11 == 0, " ").when(k % 13 == 0, F.concat(F.lit("img/"), (k % 50).cast("string"), F.lit(".gif"))).otherwise(F.concat(F.lit("img/"), k.cast("string"), F.lit(".PNG"))).alias("image_path"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("id-"), (k - F.when(k % 17 == 0, 1).otherwise(0)).cast("string"))).alias("image_id"),
        F.when(k % 7 == 0, "8.0").when(k % 19 == 0, "x").otherwise(" 4 ").alias("state_count"),
        F.when(k % 3 == 0, "").when(k % 23 == 0, "9").otherwise("4").alias("observed_state_count"),
        F.when(k % 29 == 0, "linear").when(k % 2 == 0, "LOG").otherwise("log10").alias("y_scale"),
        F.when(k % 31 == 0, "maybe").when(k % 2 == 0, "Yes").otherwise("illustrative").alias("is_measured"),
    )


def manifest_validation(spark, sf_dir):
    out = intake.manifest(_rows_as_text(spark, sf_dir))
    return out.select("row_number", "image_id", F.col("state_count").cast("long").alias("state_count"), F.col("observed_state_count").cast("long").alias("observed_state_count"), "coverage", "y_scale", "is_measured", "valid", F.array_join("errors", "; ").alias("errors"))


def manifest_summary_gates(spark, sf_dir):
    rows = _rows_as_text(spark, sf_dir)
    checked = intake.manifest(rows).join(rows.select("position", "lang"), "position")
    return intake.manifest_summary(checked, "lang")


def registry_orphans(spark, sf_dir):
    r = parquet(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey") * 3 + 1).alias("duplicate_of"))
    return intake.orphans(r, "s_suppkey", "duplicate_of")


def status_counts_zero_filled(spark, sf_dir):
    d = parquet(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "calibration").when(F.col("lang") == "de", "stress-only").otherwise("rejected").alias("status"))
    return intake.counts_with_zeros(d, "status", intake.STATUSES)


def json_extract_props(spark, sf_dir):
    e = parquet(spark, sf_dir, "events").select("event_type", F.from_json("props", "k INT").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k_total"), F.count_if(F.col("p.k") >= 50).alias("k_high"))


def explode_judgments(spark, sf_dir):
    nested = parquet(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("chars")))).alias("judgments"))
    return nested.select("conv_id", F.posexplode("judgments").alias("place", "j")).select("conv_id", F.col("place").cast("long").alias("place"), "j.turn", "j.role", F.col("j.chars").cast("long").alias("chars"))


def normalize_code(spark, sf_dir):
    return parquet(spark, sf_dir, "pages").select("page_id", text.code(F.col("url")).alias("code"), text.code(F.col("url"), 96, "none").alias("safe_id"))


def label_clean(spark, sf_dir):
    return parquet(spark, sf_dir, "documents").select("doc_id", text.label(F.col("text")).alias("label"))


def id_format(spark, sf_dir):
    return parquet(spark, sf_dir, "part").select("p_partkey", F.format_string("%02ds-s%04d-%05d", (F.col("p_size") % 16).cast("int"), F.lit(42), F.col("p_partkey")).alias("sample_id"), F.substring_index("p_name", " ", -1).alias("family"))


def page_cursors(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders")
    return o.select("o_orderkey", text.cursor(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.col("o_orderkey")).alias("cursor"))


def anti_known_ids(spark, sf_dir):
    known = parquet(spark, sf_dir, "labels").select("doc_id")
    return parquet(spark, sf_dir, "documents").select("doc_id").join(known, "doc_id", "left_anti")


def round_robin_take(spark, sf_dir):
    p = parquet(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return tables.round_robin(p, "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 40).select("p_partkey", "p_brand", "depth")


def equi_self_pairs(spark, sf_dir):
    """Directed pairs of each group, own pairs included, as counts: n squared without making them."""
    by = parquet(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("grp")).agg(F.count("*").alias("n"))
    return by.select("grp", (F.col("n") * F.col("n")).alias("pairs"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("unordered"))


def intersect_except_ids(spark, sf_dir):
    a, b = parquet(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), parquet(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    both, only = a.intersect(b), a.exceptAll(b.distinct())
    return both.select("id", F.lit("both").alias("side")).unionByName(only.select("id", F.lit("only").alias("side")))


def first_representative(spark, sf_dir):
    """The base variant of each sample if it has one, else its first."""
    li = parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy((F.col("l_returnflag") != "N").cast("int"), "l_linenumber", "l_returnflag")
    return li.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def latest_rows(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return feedback.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


def chunk_numbers(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    numbers = tables.numbered(o, ["o_orderstatus"], ["o_orderkey"], "n")
    return numbers.withColumn("chunk", F.floor((F.col("n") - 1) / 1000)).groupBy("o_orderstatus", "chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def variant_rollup(spark, sf_dir):
    li = parquet(spark, sf_dir, "lineitem")
    out = li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.min("l_quantity").alias("min_quantity"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))
    return out.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("l_returnflag", "l_linestatus")})


def group_consistency(spark, sf_dir):
    li = parquet(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg((F.count_distinct("l_returnflag") == 1).alias("same_flag"), F.count_distinct("l_suppkey").alias("suppliers"))


QUERIES = {f.__name__: f for f in (
    store_counts, fingerprint_dedup, shape_fingerprints, keyset_page, rolling_24h_count, rate_limited_rows, upsert_latest, prune_except, soft_delete, source_semi_join, candidate_set_merge,
    manifest_validation, manifest_summary_gates, registry_orphans, status_counts_zero_filled, json_extract_props, explode_judgments, normalize_code, label_clean, id_format, page_cursors,
    anti_known_ids, round_robin_take, equi_self_pairs, intersect_except_ids, first_representative, latest_rows, chunk_numbers, variant_rollup, group_consistency,
)}

_ROLL = "WITH r AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS in_window FROM events)"
_M = """WITH d AS (SELECT doc_id AS k, lang,
  nullif(trim(CASE WHEN k % 11 = 0 THEN ' ' WHEN k % 13 = 0 THEN 'img/' || (k % 50) || '.gif' ELSE 'img/' || k || '.PNG' END), '') AS path,
  nullif(CASE WHEN k % 5 = 0 THEN '' ELSE 'id-' || (k - CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END) END, '') AS rid,
  nullif(trim(CASE WHEN k % 7 = 0 THEN '8.0' WHEN k % 19 = 0 THEN 'x' ELSE ' 4 ' END), '') AS rs,
  nullif(CASE WHEN k % 3 = 0 THEN '' WHEN k % 23 = 0 THEN '9' ELSE '4' END, '') AS ro,
  lower(CASE WHEN k % 29 = 0 THEN 'linear' WHEN k % 2 = 0 THEN 'LOG' ELSE 'log10' END) AS ys,
  CASE WHEN k % 31 = 0 THEN NULL WHEN k % 2 = 0 THEN true ELSE false END AS m FROM documents),
t AS (SELECT *, coalesce(rid, printf('image-%04d', k + 1)) AS image_id, CAST(try_cast(rs AS DOUBLE) AS BIGINT) AS s, CAST(try_cast(ro AS DOUBLE) AS BIGINT) AS o, CASE WHEN ys IN ('log', 'log10') THEN 'log10' ELSE ys END AS y_scale FROM d),
u AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k) > 1 AS again, path IS NOT NULL AND row_number() OVER (PARTITION BY path ORDER BY k) > 1 AS path_again FROM t),
v AS (SELECT *, list_filter([CASE WHEN path IS NULL THEN 'image_path is required' END, CASE WHEN lower(string_split(path, '.')[-1]) NOT IN ('png', 'jpg', 'jpeg', 'webp', 'bmp', 'tif', 'tiff') THEN 'image_path has an unsupported suffix' END,
  CASE WHEN path_again THEN 'image_path repeats an earlier row' END, CASE WHEN again THEN 'image_id repeats an earlier row' END, CASE WHEN rs IS NOT NULL AND s IS NULL THEN 'state_count must be a positive integer' END,
  CASE WHEN o > s THEN 'observed_state_count exceeds state_count' END, CASE WHEN y_scale <> 'log10' THEN 'y_scale must be log10' END, CASE WHEN m IS NULL THEN 'is_measured must be a truth value' END], lambda x: x IS NOT NULL) AS e FROM u)"""

ORACLE_SQL = {
    "store_counts": "SELECT count(*) AS total, count(*) FILTER (label < 5) AS ready, count(*) FILTER (label >= 5) AS pending, max(vec_id) AS last_id FROM embeddings",
    "fingerprint_dedup": "SELECT sha256(text) AS fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "shape_fingerprints": "SELECT vec_id, sha256(label || ':' || array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), ',')) AS fingerprint FROM embeddings",
    "keyset_page": "SELECT o_orderkey, o_orderdate, o_totalprice, (SELECT count(*) FROM orders) > 50 AS has_more FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
    "rolling_24h_count": f"{_ROLL} SELECT event_id, user_id, in_window FROM r",
    "rate_limited_rows": f"{_ROLL} SELECT event_id, user_id, in_window FROM r WHERE in_window > 4",
    "upsert_latest": "WITH l AS (SELECT o_custkey AS key, o_orderpriority AS name, round(o_totalprice, 2) AS amount FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) SELECT * FROM l UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 2) FROM customer WHERE c_custkey NOT IN (SELECT key FROM l)",
    "prune_except": "SELECT doc_id, source FROM documents WHERE source <> 'src3' OR doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "soft_delete": "SELECT CASE WHEN lang = 'de' THEN 'deleted' ELSE 'active' END AS status, lang, count(*) AS n FROM documents GROUP BY ALL",
    "source_semi_join": "SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) GROUP BY source",
    "candidate_set_merge": "SELECT id, CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END::BIGINT AS first_set, coalesce(c_acctbal < 0, false) OR coalesce(s_acctbal < 0, false) AS can_delete, coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN s_name END, c_name) AS label, coalesce(s_nationkey, c_nationkey) AS state FROM (SELECT coalesce(c_custkey, s_suppkey) AS id, * FROM customer FULL JOIN supplier ON c_custkey = s_suppkey)",
    "manifest_validation": f"{_M} SELECT k + 2 AS row_number, image_id, s AS state_count, CASE WHEN ro IS NULL THEN s ELSE o END AS observed_state_count, CASE WHEN ro IS NULL AND s IS NOT NULL OR s = o THEN 'full' WHEN s <> o THEN 'partial' ELSE 'unknown' END AS coverage, y_scale, m AS is_measured, len(e) = 0 AS valid, array_to_string(e, '; ') AS errors FROM v",
    "manifest_summary_gates": f"{_M}, g AS (SELECT lang, count(*) AS r, count(*) FILTER (len(e) = 0) AS n, sum(len(e)) AS x FROM v GROUP BY lang) SELECT CAST(sum(r) AS BIGINT) AS rows, CAST(sum(n) AS BIGINT) AS valid_rows, CAST(sum(x) AS BIGINT) AS errors, count(*) FILTER (n > 0) AS groups, count(*) FILTER (n >= 2) AS evaluable_groups, count(*) FILTER (n = 1) AS singleton_groups, CAST(sum(n * (n - 1)) AS BIGINT) AS positive_pairs, sum(x) = 0 AND count(*) FILTER (n >= 2) >= 3 AS ready FROM g",
    "registry_orphans": "WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey * 3 + 1 END AS duplicate_of FROM supplier) SELECT * FROM r WHERE duplicate_of IS NOT NULL AND duplicate_of NOT IN (SELECT s_suppkey FROM supplier)",
    "status_counts_zero_filled": "SELECT s.status, count(d.doc_id) AS n FROM (VALUES ('calibration'), ('stress-only'), ('rejected'), ('pending')) s(status) LEFT JOIN documents d ON s.status = CASE WHEN lang = 'en' THEN 'calibration' WHEN lang = 'de' THEN 'stress-only' ELSE 'rejected' END GROUP BY s.status",
    "json_extract_props": "SELECT event_type, CAST(sum(CAST(props::JSON->>'k' AS INT)) AS BIGINT) AS k_total, count(*) FILTER (CAST(props::JSON->>'k' AS INT) >= 50) AS k_high FROM events GROUP BY event_type",
    "explode_judgments": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) - 1 AS place, turn, role, length(text) AS chars FROM conversations",
    "normalize_code": "WITH c AS (SELECT page_id, regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '-', 'g') AS x FROM pages) SELECT page_id, coalesce(nullif(substr(regexp_replace(x, '^-+|-+$', '', 'g'), 1, 64), ''), 'anonymous') AS code, coalesce(nullif(substr(regexp_replace(x, '^-+|-+$', '', 'g'), 1, 96), ''), 'none') AS safe_id FROM c",
    "label_clean": "SELECT doc_id, coalesce(nullif(substr(trim(regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g')), 1, 80), ''), 'untitled') AS label FROM documents",
    "id_format": "SELECT p_partkey, printf('%02ds-s%04d-%05d', p_size % 16, 42, p_partkey) AS sample_id, string_split(p_name, ' ')[-1] AS family FROM part",
    "page_cursors": "SELECT o_orderkey, replace(replace(replace(to_base64(encode('[\"v1\",\"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '\",\"' || o_orderkey || '\"]')), '+', '-'), '/', '_'), '=', '') AS cursor FROM orders",
    "anti_known_ids": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "round_robin_take": "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS depth FROM part ORDER BY depth, p_brand LIMIT 40",
    "equi_self_pairs": "SELECT CAST(a.label AS BIGINT) AS grp, count(*) AS pairs, count(*) FILTER (a.vec_id < b.vec_id) AS unordered FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY a.label",
    "intersect_except_ids": "SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'both' ELSE 'only' END AS side FROM customer",
    "first_representative": "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END, l_linenumber, l_returnflag) = 1",
    "latest_rows": "SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "chunk_numbers": "SELECT o_orderstatus, (n - 1) // 1000 AS chunk, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders) GROUP BY ALL",
    "variant_rollup": "SELECT coalesce(l_returnflag, 'all') AS l_returnflag, coalesce(l_linestatus, 'all') AS l_linestatus, count(*) AS n, min(l_quantity) AS min_quantity, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "group_consistency": "SELECT l_orderkey, count(DISTINCT l_returnflag) = 1 AS same_flag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_orderkey",
}
