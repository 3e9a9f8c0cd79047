"""Selection, files, hypotheses, states, checks and smoothing over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ridgeline.functions import vectors
from ridgeline.operators import search, selection, tables
from ridgeline.plans import curves
from ridgeline.plans.search import _E, _FIRST, _WHOLE, _top, corpus
from ridgeline.sources import parquet

K = (1, 5, 10, 50)


def _files(spark, sf_dir):
    d = parquet(spark, sf_dir, "documents")
    end = F.element_at(F.array(*[F.lit(x) for x in (".png", ".JPG", ".webp", ".gif", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("image/png"), F.lit(""), F.lit("text/plain")), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select("doc_id", F.concat(F.lit("f"), "doc_id", end).alias("name"), kind.alias("mime"), (F.col("n_chars") * 3000).alias("size"))


def batch_file_selection(spark, sf_dir):
    return selection.batch_files(_files(spark, sf_dir), "name", "mime", "size", "doc_id", 100).groupBy("fate").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def candidate_pool_sizes(spark, sf_dir):
    totals = parquet(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("total"))
    rows = totals.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in K])))
    return rows.select("label", "k", *[c.cast("long").alias(n) for n, c in selection.candidate_counts(F.col("k"), F.col("total")).items()])


def topk_arguments(spark, sf_dir):
    p = parquet(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.lit(None)).when(F.col("p_partkey") % 7 == 1, "").when(F.col("p_partkey") % 7 == 2, F.col("p_name")).otherwise((F.col("p_partkey") % 14).cast("string")).alias("given"))
    return p.select("p_partkey", selection.top_k_argument(F.col("given")).cast("long").alias("k"))


def hypothesis_best_match(spark, sf_dir):
    c = corpus(spark, sf_dir).select("id", F.array(F.slice("v", 1, 32), F.slice("v", 33, 32)).alias("h"))
    pairs = c.join(c.select((F.col("id") - 1).alias("id"), F.col("id").alias("candidate"), F.col("h").alias("g")), "id")
    best = selection.best_hypotheses(pairs, "id", "candidate", "h", "g")
    return best.select("id", "candidate", F.col("left_at").cast("long").alias("left_at"), F.col("right_at").cast("long").alias("right_at"), F.round("score", 6).alias("score"))


def product_group_pairs(spark, sf_dir):
    d = parquet(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")).alias("g"))
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("g").alias("h"))
    return d.join(other, "doc_id").groupBy(selection.compatible(F.col("g"), F.col("h")).alias("compatible")).agg(F.count("*").alias("n"))


def graded_negatives(spark, sf_dir):
    rows = search.topk(corpus(spark, sf_dir, "a"), corpus(spark, sf_dir, "a"), 20, same_group=True)
    oracle = search.topk(corpus(spark, sf_dir), corpus(spark, sf_dir), 5, same_group=True)
    return selection.graded_negatives(rows, oracle).groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("hardest"), F.round(F.max("score"), 6).alias("score"))


def prototype_means(spark, sf_dir):
    return selection.prototypes(corpus(spark, sf_dir), "grp", "v").select("grp", "at", F.round("value", 6).alias("value"))


def best_state_score(spark, sf_dir):
    best = selection.best_state(search.topk(corpus(spark, sf_dir), corpus(spark, sf_dir), 20))
    return best.select("query_id", "state", F.round("score", 6).alias("score"))


def tile_round_robin(spark, sf_dir):
    e = parquet(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4 * 4 + F.col("user_id") % 4).alias("tile"), "value")
    return tables.round_robin(e, "tile", [F.desc("value"), F.asc("event_id")], 512).select("event_id", "tile", "depth")


def running_extremes(spark, sf_dir):
    """The running maximum, and the running minimum outward from the highest bin."""
    p = curves.log_profile(spark, sf_dir)
    top = p.groupBy("event_type").agg(F.min(F.struct((-F.col("value")).alias("v"), "bin")).alias("m")).select("event_type", F.col("m.bin").alias("top"))
    w = Window.partitionBy("event_type").orderBy("bin")
    side = Window.partitionBy("event_type", F.col("bin") < F.col("top")).orderBy(F.abs(F.col("bin") - F.col("top")))
    return p.join(top, "event_type").select("event_type", "bin", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("highest"), F.min("value").over(side.rowsBetween(Window.unboundedPreceding, 0)).alias("outward"))


def profile_range(spark, sf_dir):
    return curves.long(curves.profiles(spark, sf_dir).withColumn("n", selection.normalised(F.col("p"))), "n", "value")


def supplier_variation(spark, sf_dir):
    return parquet(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(selection.variation("l_quantity"), 6).alias("variation"))


def data_url_decode(spark, sf_dir):
    d = parquet(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(F.concat_ws("/", "lang", "source", "doc_id").cast("binary")), r"\s", ""), F.when(F.col("doc_id") % 5 == 0, "?").otherwise("")).alias("u"))
    kind, raw = selection.data_url(F.col("u"))
    return d.select("doc_id", kind.alias("kind"), F.decode(raw, "utf-8").alias("content"), F.octet_length(raw).cast("long").alias("n_bytes"))


def content_sniff(spark, sf_dir):
    p = parquet(spark, sf_dir, "part")
    marks = [F.lit(x) for x in ("89504E470D0A1A0A0000000D49484452", "FFD8FFE000104A464946000100000000", "52494646000000005745425056503820", "47494638396100000000000000000000")]
    size = lambda c: F.lpad(F.hex(c), 8, "0")
    raw = F.unhex(F.concat(F.element_at(F.array(*marks), (F.col("p_partkey") % 4 + 1).cast("int")), size(F.col("p_partkey")), size(F.col("p_size").cast("long"))))
    w, h = selection.png_size(raw)
    header = F.concat(F.lit(" Image/PNG ;charset="), F.col("p_brand"))
    return p.select("p_partkey", selection.sniffed(raw).alias("kind"), w.alias("width"), h.alias("height"), selection.content_type(header).alias("declared"))


def diagnostic_codes(spark, sf_dir):
    n = F.col("n_chars")
    found = {"no_foreground": n < 40, "table": n % 11 == 0, "ambiguous": n % 7 == 0, "low_resolution": n < 300, "rejected": n % 5 == 0, "no_waveform": n > 4000}
    d = parquet(spark, sf_dir, "documents").select(F.coalesce(selection.diagnosis(found), F.lit("fine")).alias("code"))
    return d.groupBy("code").agg(F.count("*").alias("n"))


def descriptor_checks(spark, sf_dir):
    """Descriptors of suppliers' first ship days; every third has its peaks turned around, every fifth one depth too many."""
    li = parquet(spark, sf_dir, "lineitem").select("l_suppkey", (F.dayofyear("l_shipdate") / 400.0).alias("x"))
    s = li.groupBy("l_suppkey").agg(F.slice(F.sort_array(F.collect_set("x")), 1, 4).alias("up"))
    peaks = F.when(F.col("l_suppkey") % 3 == 0, F.reverse("up")).otherwise(F.col("up"))
    s = s.withColumn("peaks", peaks).withColumn("valleys", F.transform(F.slice("up", 2, 3), lambda v: v - 0.0005)).withColumn("depths", F.when(F.col("l_suppkey") % 5 == 0, F.array(F.lit(1.5))).otherwise(F.array(F.lit(0.5))))
    wrong = selection.descriptor_errors(F.when(F.col("l_suppkey") % 7 == 0, 21).otherwise(4), F.col("peaks"), F.col("valleys"), F.col("depths"))
    return s.select("l_suppkey", F.size(wrong).cast("long").alias("n_errors"), F.coalesce(F.get(wrong, F.lit(0)), F.lit("none")).alias("first_error"))


def pending_to_ready(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    out = selection.promoted(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0"), "o_orderkey", F.col("o_orderstatus") == "F")
    return out.groupBy("status", "o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def demo_choice(spark, sf_dir):
    c = parquet(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("previous"))
    return selection.one_of(c.join(first, "c_nationkey"), "c_nationkey", "c_custkey", "previous", 0.37).select(F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_custkey")


def text_search_page(spark, sf_dir):
    return selection.text_page(parquet(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "p_type", "A", ["p_name", "p_partkey"], 10, 20)


def export_slice(spark, sf_dir):
    return parquet(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey").orderBy("o_orderdate", "o_orderkey").limit(500)


def required_types(spark, sf_dir):
    """Whether each user has events of all required types."""
    wanted = F.array(F.lit("click"), F.lit("purchase"))
    seen = parquet(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("s"))
    return seen.select("user_id", (F.size(F.array_except(wanted, "s")) == 0).alias("complete"))


def weighted_union(spark, sf_dir):
    l = parquet(spark, sf_dir, "labels").select("doc_id", "quality")
    both = selection.weighted_union([(l.where("quality = 1"), 1.0), (l.where("toxic = 1"), 0.25)])
    return both.groupBy("quality", "weight").agg(F.count("*").alias("n"), F.sum("weight").alias("total"))


def manifest_raw_join(spark, sf_dir):
    """Each line with what is computed once for its order."""
    li = parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    once = li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"))
    return li.join(once, "l_orderkey").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / F.col("total"), 6).alias("share"))


def source_lookup(spark, sf_dir):
    """The best neighbour of each vector with the group and first component of the row that it came from."""
    best = search.topk(corpus(spark, sf_dir), corpus(spark, sf_dir), 1).select("query_id", "id")
    rows = corpus(spark, sf_dir).select("id", "grp", F.round(F.get("v", F.lit(0)), 6).alias("head"))
    return best.join(rows, "id").select("query_id", "id", "grp", "head")


def deletable_ids(spark, sf_dir):
    """Of the chosen orders, those that were learned, may be deleted and have an id."""
    o = parquet(spark, sf_dir, "orders")
    chosen = parquet(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return o.join(chosen, "o_orderkey", "left_semi").where("o_orderstatus = 'F' AND o_totalprice < 300000 AND o_orderkey IS NOT NULL").select("o_orderkey")


def origin_checks(spark, sf_dir):
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    p = parquet(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.concat(F.md5("url"), F.when(F.col("page_id") % 4 == 0, "!").otherwise("")).alias("token"))
    return p.select("page_id", F.col("host").rlike(r"(^|\.)example\.com$").alias("allowed"), F.col("token").rlike(selection.TOKEN).alias("token_valid"))


def savgol_profile(spark, sf_dir):
    return curves.long(selection.smooth(curves.profiles(spark, sf_dir), "p", curves.BINS), "smooth", "value")


def top_hypothesis_vectors(spark, sf_dir):
    """The unit vectors of the groups' means meet every row of their group: its closeness to the prototype."""
    m = selection.prototypes(corpus(spark, sf_dir), "grp", "v").groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda s: s["value"]).alias("m"))
    return corpus(spark, sf_dir).join(m, "grp").select("id", F.round(vectors.cosine(F.col("v"), F.col("m")), 6).alias("closeness"))


QUERIES = {f.__name__: f for f in (
    batch_file_selection, candidate_pool_sizes, topk_arguments, hypothesis_best_match, product_group_pairs, graded_negatives, prototype_means, best_state_score, tile_round_robin,
    running_extremes, profile_range, supplier_variation, data_url_decode, content_sniff, diagnostic_codes, descriptor_checks, pending_to_ready, demo_choice, text_search_page, export_slice,
    required_types, weighted_union, manifest_raw_join, source_lookup, deletable_ids, origin_checks, savgol_profile, top_hypothesis_vectors,
)}

_M = "m AS (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) r(i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM m GROUP BY label)"
_MATRIX = ", ".join(f"({i}, {j}, {float(x)!r}::DOUBLE)" for i, row in enumerate(selection.smoothing(curves.BINS)) for j, x in enumerate(row) if x)

ORACLE_SQL = {
    "batch_file_selection": "WITH f AS (SELECT doc_id, 'f' || doc_id || ['.png', '.JPG', '.webp', '.gif', ''][doc_id % 5 + 1] AS name, ['image/png', '', 'text/plain'][doc_id % 3 + 1] AS mime, n_chars * 3000 AS size FROM documents), j AS (SELECT *, CASE WHEN mime NOT IN ('image/png', 'image/jpeg', 'image/webp') AND NOT regexp_matches(lower(name), '\\.(png|jpe?g|webp)$') THEN 'unsupported' WHEN NOT (size > 0 AND size <= 12582912) THEN 'oversized' END AS f FROM f), k AS (SELECT *, sum(CASE WHEN f IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY doc_id) AS n FROM j) SELECT coalesce(f, CASE WHEN n <= 100 THEN 'accepted' ELSE 'over_limit' END) AS fate, count(*) AS n, min(doc_id) AS first FROM k GROUP BY ALL",
    "candidate_pool_sizes": "WITH t AS (SELECT CAST(label AS BIGINT) AS label, count(*) AS total FROM embeddings GROUP BY ALL), c AS (SELECT label, k, total, least(greatest(80, 4 * k), total) AS candidates FROM t, (SELECT unnest([1, 5, 10, 50]::BIGINT[]) AS k)) SELECT label, k, candidates, greatest(3 * k, k) AS unique_cap, least(total, greatest(2 * candidates, 16 * k, 160)) AS expansion FROM c",
    "topk_arguments": "SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 1) THEN 8 WHEN p_partkey % 7 = 2 THEN NULL WHEN p_partkey % 14 BETWEEN 1 AND 10 THEN p_partkey % 14 END AS k FROM part",
    "hypothesis_best_match": f"{_E}, h AS (SELECT vec_id, 0 AS at, a AS w FROM e UNION ALL SELECT vec_id, 1, b FROM e), s AS (SELECT x.vec_id AS id, y.vec_id AS candidate, x.at AS left_at, y.at AS right_at, round(greatest(-1.0, least(1.0, list_cosine_similarity(x.w, y.w))), 9) AS score FROM h x JOIN h y ON y.vec_id = x.vec_id + 1), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, left_at, right_at) AS n FROM s) SELECT id, candidate, CAST(left_at AS BIGINT) AS left_at, CAST(right_at AS BIGINT) AS right_at, round(score, 6) AS score FROM t WHERE n = 1",
    "product_group_pairs": "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS g FROM documents) SELECT a.g = '' OR b.g = '' OR a.g = b.g AS compatible, count(*) AS n FROM d a JOIN d b ON b.doc_id = a.doc_id + 1 GROUP BY ALL",
    "graded_negatives": f"{_E}, {_top('t', 20, _FIRST, True)}, {_top('o', 5, _WHOLE, True)} SELECT t.query_id, count(*) AS n, min(t.rank) AS hardest, round(max(t.score), 6) AS score FROM t ANTI JOIN o ON o.query_id = t.query_id AND o.id = t.id GROUP BY t.query_id",
    "prototype_means": f"{_E}, {_M} SELECT m.label AS grp, i - 1 AS at, round(m / n, 6) AS value FROM m JOIN n USING (label)",
    "best_state_score": f"{_E}, {_top('t', 20, _WHOLE, False)}, s AS (SELECT query_id, grp AS state, round(max(score + CASE WHEN grp = query_grp THEN 0.03 ELSE 0.0 END), 9) AS score FROM t GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, state) AS n FROM s) SELECT query_id, state, round(score, 6) AS score FROM b WHERE n = 1",
    "tile_round_robin": "WITH e AS (SELECT event_id, event_id % 4 * 4 + user_id % 4 AS tile, value FROM events), d AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY value DESC, event_id) AS depth FROM e) SELECT event_id, tile, depth FROM d ORDER BY depth, tile LIMIT 512",
    "running_extremes": f"{curves._P}, t AS (SELECT event_type, arg_min(bin, (-value, bin)) AS top FROM p GROUP BY event_type) SELECT p.event_type, p.bin, max(value) OVER (PARTITION BY p.event_type ORDER BY p.bin ROWS UNBOUNDED PRECEDING) AS highest, min(value) OVER (PARTITION BY p.event_type, p.bin < top ORDER BY abs(p.bin - top) ROWS UNBOUNDED PRECEDING) AS outward FROM p JOIN t ON t.event_type = p.event_type",
    "profile_range": f"{curves._P}, r AS (SELECT *, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM p) SELECT event_type, bin, round((value - lo) / (hi - lo), 6) AS value FROM r WHERE hi - lo >= 0.035",
    "supplier_variation": "SELECT l_suppkey, round(coalesce(stddev_pop(l_quantity) / nullif(abs(avg(l_quantity)), 0.0), 0.0), 6) AS variation FROM lineitem GROUP BY l_suppkey",
    "data_url_decode": "WITH d AS (SELECT doc_id, doc_id % 5 = 0 AS broken, concat_ws('/', lang, source, doc_id) AS c FROM documents) SELECT doc_id, CASE WHEN NOT broken THEN 'image/png' END AS kind, CASE WHEN NOT broken THEN c END AS content, CASE WHEN NOT broken THEN CAST(octet_length(encode(c)) AS BIGINT) END AS n_bytes FROM d",
    "content_sniff": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN p_partkey END AS width, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS BIGINT) END AS height, 'image/png' AS declared FROM part",
    "diagnostic_codes": "SELECT CASE WHEN n_chars < 40 THEN 'no_foreground' WHEN n_chars % 11 = 0 THEN 'table' WHEN n_chars % 7 = 0 THEN 'ambiguous' WHEN n_chars < 300 THEN 'low_resolution' WHEN n_chars % 5 = 0 THEN 'rejected' WHEN n_chars > 4000 THEN 'no_waveform' ELSE 'fine' END AS code, count(*) AS n FROM documents GROUP BY ALL",
    "descriptor_checks": "WITH s AS (SELECT l_suppkey, list_sort(list(DISTINCT dayofyear(l_shipdate) / 400.0::DOUBLE))[1:4] AS up FROM lineitem GROUP BY l_suppkey), c AS (SELECT l_suppkey, up, CASE WHEN l_suppkey % 3 = 0 THEN list_reverse(up) ELSE up END AS p, l_suppkey % 7 = 0 AS many, l_suppkey % 5 = 0 AS deep FROM s), e AS (SELECT l_suppkey, list_filter([CASE WHEN many THEN 'state count is outside 1 to 20' END, CASE WHEN many OR len(p) <> 4 THEN 'peaks don''t match the state count' END, CASE WHEN len(p) > 1 AND p[1] > p[2] THEN 'peaks aren''t in order' END, CASE WHEN len(p) > 1 AND (up[2] - 0.0005 < p[1] OR up[2] - 0.0005 > p[2] OR (len(p) > 2 AND (up[3] - 0.0005 < p[2] OR up[3] - 0.0005 > p[3])) OR (len(p) > 3 AND (up[4] - 0.0005 < p[3] OR up[4] - 0.0005 > p[4]))) THEN 'a valley isn''t between its peaks' END, CASE WHEN deep THEN 'a depth is outside [0, 1]' END], lambda x: x IS NOT NULL) AS e FROM c) SELECT l_suppkey, len(e) AS n_errors, coalesce(e[1], 'none') AS first_error FROM e",
    "pending_to_ready": "WITH r AS (SELECT o_orderkey, o_orderstatus, 'ready' AS status FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'pending' END FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0) SELECT status, o_orderstatus, count(*) AS n, min(o_orderkey) AS first FROM r GROUP BY ALL",
    "demo_choice": "WITH c AS (SELECT c_nationkey, c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n, min(c_custkey) OVER (PARTITION BY c_nationkey) AS first FROM customer), l AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, count(*) OVER (PARTITION BY c_nationkey) AS m FROM c WHERE n = 1 OR c_custkey <> first) SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey FROM l WHERE place = least(floor(0.37::DOUBLE * m), m - 1)",
    "text_search_page": "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_type), 'a') ORDER BY p_name, p_partkey LIMIT 20 OFFSET 10",
    "export_slice": "SELECT o_orderdate, o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500",
    "required_types": "SELECT user_id, bool_or(event_type = 'click') AND bool_or(event_type = 'purchase') AS complete FROM events GROUP BY user_id",
    "weighted_union": "WITH u AS (SELECT quality, 1.0::DOUBLE AS weight FROM labels WHERE quality = 1 UNION ALL SELECT quality, 0.25::DOUBLE FROM labels WHERE toxic = 1) SELECT quality, weight, count(*) AS n, sum(weight) AS total FROM u GROUP BY ALL",
    "manifest_raw_join": "SELECT l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem",
    "source_lookup": f"{_E}, {_top('t', 1, _WHOLE, False)} SELECT t.query_id, t.id, e.label AS grp, round(e.v[1], 6) AS head FROM t JOIN e ON e.vec_id = t.id",
    "deletable_ids": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 300000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "origin_checks": "SELECT page_id, regexp_matches(regexp_extract(url, '^https?://([^/]+)', 1), '(^|\\.)example\\.com$') AS allowed, page_id % 4 <> 0 AS token_valid FROM pages",
    "savgol_profile": f"{curves._P}, w(i, j, x) AS (VALUES {_MATRIX}), s AS (SELECT p.event_type, w.i, greatest(0.0, sum(w.x * p.value)) AS y FROM p JOIN w ON w.j = p.bin GROUP BY ALL) SELECT event_type, CAST(i AS BIGINT) AS bin, round(y / max(y) OVER (PARTITION BY event_type), 6) AS value FROM s",
    "top_hypothesis_vectors": f"{_E}, {_M}, p AS (SELECT label, list(m ORDER BY i) AS m FROM m GROUP BY label) SELECT e.vec_id AS id, round(greatest(-1.0, least(1.0, list_cosine_similarity(e.v, p.m))), 6) AS closeness FROM e JOIN p USING (label)",
}
