"""Queries of the exchange, review, memory, state and file operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.operators import exchange, memory, review, state
from marginalia.plans.registry import Catalog
from marginalia.plans.views import MEMORY, REVIEW, STATE, view
from marginalia.sources import files
from marginalia.sources.scratch import scratch_path
from marginalia.streaming import jobs

catalog = Catalog()
query = catalog.query


def _scratch(t, name: str) -> str:
    return scratch_path(t.spark, name)


def _requested(t):
    return t("orders").where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("item_id"))


def _returned(t):
    return t("lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("item_id")).distinct()


_REQ = "SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey % 10 <> 3"
_RET = "SELECT DISTINCT l_orderkey AS item_id FROM lineitem WHERE l_linenumber <= 2"


@query("u1_set_equality", f"WITH a AS ({_REQ}), b AS ({_RET}) SELECT item_id, 'left' AS side FROM a WHERE item_id NOT IN (SELECT item_id FROM b) UNION ALL SELECT item_id, 'right' FROM b WHERE item_id NOT IN (SELECT item_id FROM a)")
def _u1(t):
    return exchange.set_difference(_requested(t), _returned(t), "item_id")


@query("u2_missing_items", f"SELECT item_id FROM ({_REQ}) WHERE item_id NOT IN (SELECT item_id FROM ({_RET}))")
def _u2(t):
    return exchange.missing_items(_requested(t), _returned(t))


@query("u2_missing_items_none", f"SELECT item_id FROM ({_REQ})")
def _u2n(t):
    return exchange.missing_items(_requested(t), t("orders").select(F.col("o_orderkey").alias("item_id")))


@query("u3_failed_trusted", f"SELECT item_id FROM ({_REQ}) WHERE item_id IN (SELECT item_id FROM ({_RET}))")
def _u3(t):
    return exchange.failed_trusted(_returned(t), _requested(t))


@query("u4_colour_groups", "SELECT n_regionkey, len(list_filter(list_distinct(list_sort(array_agg(lower(substr(n_name, 1, 1))))), lambda x: x NOT IN ('a', 'c', 'i')))::INTEGER AS extra FROM nation GROUP BY n_regionkey")
def _u4(t):
    g = t("nation").groupBy("n_regionkey").agg(F.collect_set(F.lower(F.substring("n_name", 1, 1))).alias("g"))
    return g.select("n_regionkey", F.size(F.array_except("g", F.array(F.lit("a"), F.lit("c"), F.lit("i")))).alias("extra"))


@query("u5_append_with_offset", "SELECT s_suppkey AS ord, s_name AS name FROM supplier UNION ALL SELECT 1000000 + n_nationkey, n_name FROM nation")
def _u5(t):
    return t("supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name")).unionByName(t("nation").select((F.col("n_nationkey") + 1000000).cast("long").alias("ord"), F.col("n_name").alias("name")))


@query("u6_ordered_distinct", "SELECT o_custkey, string_agg(p, ',' ORDER BY k) AS priorities FROM (SELECT o_custkey, substr(o_orderpriority, 1, 1) AS p, min(o_orderkey) AS k FROM orders GROUP BY o_custkey, 2) GROUP BY o_custkey")
def _u6(t):
    o = t("orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p")))), lambda x: x["p"]).alias("a"))
    return o.select("o_custkey", F.array_join(exchange.ordered_distinct(F.col("a")), ",").alias("priorities"))


@query("a10_duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _a10(t):
    return exchange.duplicates(t("lineitem"), "l_orderkey", "l_linenumber")


@query("a11_multiset_equality", "SELECT coalesce(a.k, b.k) AS k, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM (SELECT l_suppkey % 50 AS k, count(*) AS n_left FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) a FULL JOIN (SELECT l_suppkey % 50 AS k, count(*) AS n_right FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) b ON a.k = b.k WHERE coalesce(n_left, 0) <> coalesce(n_right, 0)")
def _a11(t):
    side = lambda n: t("lineitem").where(f"l_linenumber = {n}").select((F.col("l_suppkey") % 50).alias("k"))
    return exchange.multiset_mismatch(side(1), side(2), "k")


@query("j21_three_way_equality", f"WITH a AS ({_REQ}), b AS ({_RET}) SELECT coalesce(a.item_id, b.item_id) AS item_id, (a.item_id IS NOT NULL)::BIGINT AS n_left, (b.item_id IS NOT NULL)::BIGINT AS n_right FROM a FULL JOIN b ON a.item_id = b.item_id WHERE a.item_id IS NULL OR b.item_id IS NULL")
def _j21(t):
    return exchange.multiset_mismatch(_requested(t), _returned(t), "item_id")


@query("a12_next_item_number", "SELECT o_custkey AS page, max(o_orderkey)::INTEGER + 1 AS next_number FROM orders GROUP BY o_custkey")
def _a12(t):
    return exchange.next_item_number(t("orders").select(F.col("o_custkey").alias("page"), F.concat(F.lit("p001-i"), F.col("o_orderkey").cast("string")).alias("item_id")))


def _candidates(t):
    c = t("orders").select(
        F.col("o_orderkey").alias("item_id"), (F.col("o_orderstatus") != "P").alias("should_translate"), F.col("o_orderpriority").alias("text"),
        F.when(F.col("o_custkey") % 2 == 0, "sample_review").otherwise("bom").alias("page_type"), F.col("o_custkey").cast("string").alias("ck"),
    )
    hit = lambda s, x: F.struct(s.alias("source_term"), x.alias("target_term"))
    return c.withColumn("hits", F.array(hit(F.col("text"), F.lit("x")), hit(F.col("ck"), F.lit("y")), hit(F.col("text"), F.lit("x"))))


_MODE = "CASE WHEN o_custkey % 2 = 0 THEN 'faithful_digest' ELSE 'direct' END"


@query("x1_request_items", f"SELECT o_orderkey AS item_id, {_MODE} AS mode, o_orderpriority || '>x|' || o_custkey || '>y' AS terms FROM orders WHERE o_orderstatus <> 'P'")
def _x1(t):
    show = F.array_join(F.transform("glossary_terms", lambda g: F.concat_ws(">", g["source_term"], g["target_term"])), "|")
    return exchange.request_items(_candidates(t)).select("item_id", "mode", show.alias("terms"))


@query("x2_request_hash", "SELECT s_suppkey, sha256('{\"s_name\":\"' || s_name || '\",\"s_nationkey\":' || s_nationkey || ',\"s_suppkey\":' || s_suppkey || ',\"x\":null}') AS request_sha256 FROM supplier")
def _x2(t):
    return t("supplier").withColumn("x", F.lit(None).cast("string")).select("s_suppkey", exchange.request_hash("x", "s_suppkey", "s_name", "s_nationkey").alias("request_sha256"))


@query("x3_cache_key", "SELECT s_suppkey, sha256(s_name || chr(31) || 'b' || chr(30) || CASE WHEN s_suppkey % 2 = 0 THEN 'unknown' ELSE 'm1' END || chr(30) || CASE WHEN s_suppkey % 2 = 0 THEN 'j' || s_nationkey ELSE '' END || chr(30)) AS cache_key FROM supplier")
def _x3(t):
    model = exchange.model_identifier(F.when(F.col("s_suppkey") % 2 == 0, " Unknown ").otherwise("m1"))
    return t("supplier").select("s_suppkey", exchange.cache_key(F.array("s_name", F.lit("b")), model, F.concat(F.lit("j"), F.col("s_nationkey").cast("string")), F.lit(None).cast("string")).alias("cache_key"))


@query("p29_model_identifier", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN p_brand END AS model FROM part")
def _p29(t):
    raw = F.when(F.col("p_partkey") % 3 == 0, " UnKnown").when(F.col("p_partkey") % 3 == 1, F.concat("p_brand", F.lit(" "))).otherwise("  ")
    return t("part").select("p_partkey", exchange.model_identifier(raw).alias("model"))


@query("x4_response_outcome", "SELECT c_custkey AS job_id, CASE WHEN c_custkey % 3 = 0 THEN 'schema' WHEN c_custkey % 5 = 0 THEN 'binding' WHEN c_custkey % 7 = 0 THEN 'id_set' WHEN c_custkey % 2 = 0 THEN 'item' ELSE 'ok' END AS code FROM customer")
def _x4(t):
    k = F.col("c_custkey")
    checks = t("customer").select(k.alias("job_id"), (k % 3 != 0).alias("schema_ok"), F.lit(True).alias("attempt_ok"), (k % 5 != 0).alias("binding_ok"), F.lit(True).alias("duplicate_ok"), (k % 7 != 0).alias("id_set_ok"), (k % 2 != 0).alias("item_ok"))
    return exchange.response_outcome(checks)


@query("x5_item_codes", "SELECT p_partkey AS item_id, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'glossary_target_missing' END, CASE WHEN p_partkey % 3 = 0 THEN 'glossary_terms_used_mismatch' END, CASE WHEN p_partkey % 5 = 0 THEN 'locked_token_mismatch' END, CASE WHEN p_partkey % 7 = 0 THEN 'mode_mismatch' END) AS codes FROM part")
def _x5(t):
    k = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    pairs = t("part").select(
        k.alias("item_id"), F.lit("direct").alias("mode"), F.when(k % 7 == 0, "digest").otherwise("direct").alias("r_mode"), F.array(size).alias("locked"),
        F.array(F.when(k % 5 == 0, F.concat(size, F.lit("0"))).otherwise(size)).alias("preserved"),
        F.concat(F.when(k % 2 == 0, "rad ").otherwise("Bolzen  lang "), F.col("p_size").cast("string"), F.lit(" - ende")).alias("translated_text"), F.array(F.struct(F.lit("bolt").alias("source"), F.lit("bolzen lang").alias("target"))).alias("terms"),
        F.array(F.when(k % 3 == 0, "nut").otherwise("bolt")).alias("used"),
    )
    return exchange.item_codes(pairs).withColumn("codes", F.array_join("codes", ","))


@query("x6_correction_envelope", "SELECT o_custkey AS job_id, (o_custkey % 2)::INTEGER AS attempt, string_agg(DISTINCT o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR) AS item_ids, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS codes, CASE WHEN o_custkey % 2 = 0 THEN 'host_correction' ELSE 'human_review_required' END AS next_state FROM orders GROUP BY o_custkey")
def _x6(t):
    f = t("orders").select(F.col("o_custkey").alias("job_id"), (F.col("o_custkey") % 2).cast("int").alias("attempt"), F.col("o_orderkey").cast("string").alias("item_id"), F.col("o_orderstatus").alias("code"))
    return exchange.correction_envelope(f).withColumns({"item_ids": F.array_join("item_ids", ","), "codes": F.array_join("codes", ",")})


@query("x7_schema_code", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'empty_translation' WHEN 1 THEN 'model_missing' WHEN 2 THEN 'translator_missing' ELSE 'response_schema_invalid' END AS code FROM customer")
def _x7(t):
    k = F.col("c_custkey") % 4
    return t("customer").select("c_custkey", exchange.schema_code(F.when(k == 0, "items.translated_text").when(k == 1, "items.translator.model").when(k == 2, "items.translator.host").otherwise("items.mode")).alias("code"))


@query("v1_strict_keys", "SELECT event_id AS id, '' AS extra, 'k2' AS missing FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'zz', '' FROM events WHERE event_id % 2 = 1 AND event_id % 3 = 0")
def _v1(t):
    k = F.col("event_id")
    e = t("events").select(k.alias("id"), F.when(k % 2 == 0, F.col("props")).when(k % 3 == 0, '{"k": 1, "k2": 2, "zz": 3}').otherwise('{"k": 1, "k2": null}').alias("json"))
    return exchange.key_errors(e, ["k", "k2"]).withColumns({"extra": F.array_join("extra", ","), "missing": F.array_join("missing", ",")})


def _translations(t):
    return t("lineitem").where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.min("l_returnflag").alias("translated_text"))


_TRUST = "SELECT o_orderkey AS item_id, t.x AS translated_text, t.x IS NULL AS missing FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS x FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) t ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'"


@query("j1_trusted_items", _TRUST)
def _j1(t):
    return exchange.trusted_items(_candidates(t), _translations(t)).select("item_id", "translated_text", "missing")


@query("j2_translated_items", f"SELECT item_id, translated_text FROM ({_TRUST}) WHERE NOT missing")
def _j2(t):
    return exchange.trusted_items(_candidates(t), _translations(t)).where("NOT missing").select("item_id", "translated_text")


@query("j3_classification_answers", "SELECT c_custkey AS page_id, CASE WHEN c_custkey % 4 = 0 AND c_nationkey < 10 THEN 'bom' WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE 'measurement' END AS page_type, CASE WHEN c_custkey % 4 = 0 AND c_nationkey < 10 THEN 0.85 ELSE 0.5 END::DOUBLE AS confidence FROM customer")
def _j3(t):
    p = t("customer").select(F.col("c_custkey").alias("page_id"), F.when(F.col("c_custkey") % 4 == 0, "unknown").otherwise("measurement").alias("page_type"), F.lit(0.5).alias("confidence"))
    a = t("customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("page_id"), F.lit("bom").alias("page_type"), F.lit(0.85).alias("confidence"))
    return exchange.with_answers(p, a)


@query("j4_coverage_defaults", "SELECT c_custkey, coalesce(o.n > 0, false) AS should_translate FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def _j4(t):
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count(F.lit(1)) > 0).alias("s"))
    return t("customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("s", F.lit(False)).alias("should_translate"))


@query("j5_bijection", "SELECT coalesce(a.k, b.k) AS page, CASE WHEN a.k IS NULL THEN 'unexpected' WHEN b.k IS NULL THEN 'missing' ELSE 'duplicate' END AS error FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 9 <> 4) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR n > 1")
def _j5(t):
    return exchange.bijection_errors(t("customer").where("c_custkey % 9 <> 4").select(F.col("c_custkey").alias("page")), t("orders").select(F.col("o_custkey").alias("page")), "page")


@query("v6_page_set", "SELECT p_partkey % 50 AS page, 'duplicate' AS error FROM part WHERE p_partkey % 50 < 49 GROUP BY 1 UNION ALL SELECT 49, 'missing'")
def _v6(t):
    pages = t("part").select((F.col("p_partkey") % 50).alias("page"))
    return exchange.bijection_errors(pages.distinct(), pages.where("page < 49"), "page")


@query("v8_stable_identity", "SELECT o_custkey, bool_and(o_orderkey % 100 <> 7) AS same FROM orders GROUP BY o_custkey")
def _v8(t):
    a = t("orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("v"))
    return exchange.ordered_equal(a, a.withColumn("v", F.when(F.col("o_orderkey") % 100 == 7, "x").otherwise(F.col("v"))), "o_custkey", "o_orderkey", "v")


@query("v14_input_drift", "SELECT s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'missing' ELSE 'changed' END AS state FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 = 0")
def _v14(t):
    s = t("supplier").select(F.col("s_name").alias("name"), F.sha2("s_name", 256).alias("digest"), "s_suppkey")
    now = s.where("s_suppkey % 5 <> 0").withColumn("digest", F.when(F.col("s_suppkey") % 3 == 0, "x").otherwise(F.col("digest")))
    return exchange.drifted(s.select("name", "digest"), now)


@query("j24_artifact_digests", "SELECT s_name AS name, 'changed' AS state FROM supplier WHERE s_suppkey % 4 = 1")
def _j24(t):
    s = t("supplier").select(F.col("s_name").alias("name"), F.sha2("s_name", 256).alias("digest"), "s_suppkey")
    return exchange.drifted(s.select("name", "digest"), s.withColumn("digest", F.when(F.col("s_suppkey") % 4 == 1, F.upper("digest")).otherwise(F.col("digest"))))


@query("j22_protected_subset", "SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)")
def _j22(t):
    return t("lineitem").select(F.col("l_suppkey").alias("id")).distinct().join(t("supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("id")), "id", "left_anti")


def _items(t):
    return view(t, REVIEW).withColumn("ord", F.col("item_id"))


_R = f"r AS ({REVIEW}), k AS (SELECT *, CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS rk FROM r)"


@query("a3_review_navigation", f"WITH {_R}, m AS (SELECT *, min(rk) OVER (PARTITION BY page) AS top FROM k) SELECT page, string_agg(item_id::VARCHAR, ',' ORDER BY NOT open, rk, item_id) AS item_ids, count(*) FILTER (open) AS unreviewed, count(*) FILTER (risk = 'high') AS n_high, count(*) FILTER (risk = 'medium') AS n_medium, count(*) FILTER (risk = 'low') AS n_low, CASE min(rk) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS highest_risk FROM m GROUP BY page")
def _a3(t):
    return review.navigation(_items(t)).drop("open_at_top").withColumn("item_ids", F.array_join("item_ids", ","))


@query("a4_open_highest_risk", f"WITH {_R}, m AS (SELECT *, min(rk) OVER (PARTITION BY page) AS top FROM k) SELECT page, bool_or(open AND rk = top) AS open_at_top FROM m GROUP BY page")
def _a4(t):
    return review.navigation(_items(t)).select("page", "open_at_top")


@query("a5_status_counts", f"WITH {_R} SELECT status, count(*) AS n FROM r GROUP BY status")
def _a5(t):
    return review.status_counts(_items(t))


@query("a6_provenance", f"WITH {_R} SELECT page, CASE WHEN count(DISTINCT status) = 1 THEN min(status) ELSE 'mixed' END AS status, CASE WHEN count(DISTINCT risk) = 1 THEN min(risk) ELSE 'mixed' END AS risk FROM r GROUP BY page")
def _a6(t):
    return _items(t).groupBy("page").agg(*review.single_or_mixed("status", "risk"))


@query("v4_pipeline_provenance", f"WITH {_R} SELECT page FROM r GROUP BY page HAVING count(DISTINCT status) > 1")
def _v4(t):
    return _items(t).groupBy("page").agg(*review.single_or_mixed("status")).where("status = 'mixed'").select("page")


@query("a19_model_switch", f"WITH {_R} SELECT page, count(DISTINCT status) > 1 AS status_switch, count(DISTINCT risk) > 1 AS risk_switch FROM r GROUP BY page")
def _a19(t):
    return _items(t).groupBy("page").agg((F.count_distinct("status") > 1).alias("status_switch"), (F.count_distinct("risk") > 1).alias("risk_switch"))


@query("a13_all_any", f"WITH {_R} SELECT page, bool_and(open) AS all_open, bool_or(open) AS any_open FROM r GROUP BY page")
def _a13(t):
    return _items(t).groupBy("page").agg(F.bool_and("open").alias("all_open"), F.bool_or("open").alias("any_open"))


@query("a17_grouped_issues", f"WITH {_R} SELECT page, risk, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM r GROUP BY page, risk")
def _a17(t):
    return _items(t).groupBy("page", "risk").agg(F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))


@query("a18_extents", f"WITH {_R} SELECT page, max(item_id + 2) AS row_count, max(price) AS top FROM r GROUP BY page")
def _a18(t):
    return _items(t).groupBy("page").agg(F.max(F.col("item_id") + 2).alias("row_count"), F.max("price").alias("top"))


@query("k4_items_by_id", f"WITH {_R} SELECT page, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM r GROUP BY page")
def _k4(t):
    return _items(t).groupBy("page").agg(F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids"))


@query("k5_navigation_order", f"WITH {_R} SELECT page, row_number() OVER (ORDER BY min(rk), page) AS place FROM k GROUP BY page")
def _k5(t):
    from pyspark.sql import Window

    nav = review.navigation(_items(t)).select("page", review.risk_rank(F.col("highest_risk")).alias("r"))
    # One row per page, three ranks: counted per rank, so no window holds all pages.
    before = nav.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    offset = before.alias("a").join(F.broadcast(before.alias("b")), F.col("b.r") < F.col("a.r"), "left").groupBy(F.col("a.r").alias("r")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("off"))
    place = F.row_number().over(Window.partitionBy("r").orderBy("page"))
    return nav.withColumn("p", place).join(F.broadcast(offset), "r").select("page", (F.col("p") + F.col("off")).cast("long").alias("place"))


@query("k6_next_unreviewed", f"WITH {_R} SELECT item_id, page, risk FROM k WHERE open ORDER BY rk, page, item_id LIMIT 1")
def _k6(t):
    return review.queue(_items(t)).limit(1).select("item_id", "page", "risk")


@query("k10_top_of_group", f"WITH {_R} SELECT page, item_id FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY price DESC, item_id) AS n FROM r) WHERE n = 1")
def _k10(t):
    return _items(t).groupBy("page").agg(F.min_by("item_id", F.struct(-F.col("price"), F.col("item_id"))).alias("item_id"))


@query("p20_quality_warnings", f"WITH {_R} SELECT item_id, concat_ws(',', CASE WHEN page % 3 = 0 THEN 'native_only_degradation' END, CASE WHEN risk <> 'high' THEN 'coordinate_confidence' END, CASE WHEN page % 2 = 0 THEN 'manual_placement_required' END) AS warnings, CASE WHEN page % 3 = 0 OR risk <> 'high' OR page % 2 = 0 OR NOT open THEN 'high' ELSE 'low' END AS risk_level FROM r")
def _p20(t):
    w = review.warnings(F.col("page") % 3 == 0, F.col("risk"), F.lit("m"), F.col("page") % 2 != 0)
    return _items(t).withColumn("w", w).select("item_id", F.array_join("w", ",").alias("warnings"), review.risk_level(F.col("w"), F.col("open")).alias("risk_level"))


@query("p21_visible_items", f"WITH {_R} SELECT item_id FROM r WHERE risk = 'high' AND status = 'approved' AND contains(lower(reviewed), '1')")
def _p21(t):
    return review.visible(_items(t), status="approved", risk="high", search="1").select("item_id")


@query("p22_final_text", f"WITH {_R} SELECT item_id, coalesce(CASE WHEN status = 'approved_edited' THEN reviewed ELSE suggested END, '') AS final_text FROM r")
def _p22(t):
    return _items(t).select("item_id", review.final_text(F.col("status"), F.col("reviewed"), F.col("suggested")).alias("final_text"))


@query("p23_frozen_fields", f"WITH {_R} SELECT item_id, CASE WHEN status <> 'skipped' THEN coalesce(CASE WHEN open THEN price END, price * 2) END AS reviewed_font FROM (SELECT *, CASE WHEN status = 'skipped' THEN NULL END AS z FROM r) WHERE status <> 'skipped'")
def _p23(t):
    i = _items(t).withColumns({"font": F.col("price") * 2, "reviewed_font": F.when(F.col("open"), F.col("price"))})
    return review.frozen(i, "font").where("status <> 'skipped'").select("item_id", "reviewed_font")


@query("p24_set_status", f"WITH {_R} SELECT item_id, CASE WHEN status = 'approved' AND reviewed <> suggested THEN 'approved_edited' ELSE status END AS status FROM r")
def _p24(t):
    return _items(t).select("item_id", review.set_status(F.col("status"), F.col("reviewed"), F.col("suggested")).alias("status"))


@query("p25_redacted_details", "SELECT s_suppkey, 'name=' || s_name AS kept FROM supplier")
def _p25(t):
    m = F.create_map(F.lit("name"), F.col("s_name"), F.lit("token"), F.lit("t"), F.lit("path"), F.lit("p"))
    kept = review.redacted(m, ("name", "token"), ("token",))
    return t("supplier").select("s_suppkey", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("kept"))


@query("p26_exit_code", f"WITH s AS ({STATE}) SELECT event_id, CASE state WHEN 'failed' THEN 3 WHEN 'translation_requested' THEN 4 ELSE 5 END AS code FROM s")
def _p26(t):
    return view(t, STATE).select("event_id", state.exit_code(F.col("state")).alias("code"))


@query("p28_explanations", f"WITH {_R} SELECT item_id, CASE risk WHEN 'high' THEN 'check carefully' WHEN 'low' THEN 'usually fine' ELSE 'confirm' END AS explanation FROM r")
def _p28(t):
    return review.explanations(_items(t).withColumn("reason", F.col("risk")), {"high": "check carefully", "low": "usually fine"})


@query("j6_immutable_fields", f"WITH {_R} SELECT item_id, CASE WHEN item_id % 11 = 0 THEN 'missing' ELSE 'changed' END AS error FROM r WHERE item_id % 11 = 0 OR item_id % 13 = 0")
def _j6(t):
    i = _items(t)
    changed = i.where("item_id % 11 <> 0").withColumn("page", F.when(F.col("item_id") % 13 == 0, -1).otherwise(F.col("page")))
    return review.changed_items(changed, i, ["page", "suggested"])


@query("v2_review_checks", f"WITH {_R} SELECT item_id, CASE WHEN page % 10 = 0 THEN 0 WHEN reviewed <> suggested AND status = 'approved' THEN 1 ELSE 2 END AS check_ord, CASE WHEN page % 10 = 0 THEN 'page' WHEN reviewed <> suggested AND status = 'approved' THEN 'edited' ELSE 'status' END AS code FROM r WHERE page % 10 = 0 OR (reviewed <> suggested AND status = 'approved') OR status = 'skipped'")
def _v2(t):
    edited = (F.col("reviewed") != F.col("suggested")) & (F.col("status") == "approved")
    return review.first_violation(_items(t), [("page", F.col("page") % 10 != 0), ("edited", ~edited), ("status", F.col("status") != "skipped")])


@query("v3_translation_checks", "SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN 'do_not_translate_changed' WHEN p_partkey % 5 = 0 THEN 'locked_token_changed' ELSE 'glossary_target_missing' END AS code FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0")
def _v3(t):
    k = F.col("p_partkey")
    final = F.concat(F.when(k % 3 == 0, "GIZMO GIZMO ").otherwise("GIZMO "), F.when(k % 5 == 0, "5").otherwise("42"), F.lit(" "), F.when(k % 7 == 0, "Teil").otherwise("Klein–Teil"))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    return review.translation_errors(t("part").select(k.alias("item_id"), F.lit("GIZMO 42 part").alias("source"), final.alias("final"), words("GIZMO").alias("dnt"), words("42").alias("locked"), words("klein-teil").alias("targets")))


@query("v9_approved_geometry", f"WITH {_R} SELECT item_id, CASE WHEN price > 300000 THEN 1 WHEN page % 5 = 0 THEN 2 ELSE 3 END AS check_ord, CASE WHEN price > 300000 THEN 'outside_page' WHEN page % 5 = 0 THEN 'font' ELSE 'leader' END AS code FROM r WHERE status <> 'skipped' AND (price > 300000 OR page % 5 = 0 OR page % 7 = 0)")
def _v9(t):
    i = _items(t).select("item_id", "status", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.when(F.col("price") > 300000, 9e9).otherwise(50.0).alias("x1"), F.lit(9.0).alias("y1"), F.when(F.col("page") % 5 == 0, 30.0).otherwise(7.0).alias("font"), F.when(F.col("page") % 7 == 0, F.array(F.lit(1.0))).alias("leader"))
    return review.geometry_errors(i, 600.0, 800.0)


@query("v12_page_completeness", "SELECT o_custkey % 40 AS job_id, count(*) = 1 AND min(o_orderkey // 40) = 0 AS complete FROM orders GROUP BY 1")
def _v12(t):
    return files.complete_pages(t("orders").select((F.col("o_custkey") % 40).alias("job_id"), F.floor(F.col("o_orderkey") / 40).alias("page")))


@query("src15_page_completeness", "SELECT p_partkey % 10 AS job_id, p_partkey % 10 <> 3 AS complete FROM part GROUP BY 1, 2")
def _src15(t):
    k = F.col("p_partkey")
    return files.complete_pages(t("part").where("p_partkey <> 3").select((k % 10).alias("job_id"), (F.floor(k / 10) - F.when(k % 10 == 3, 0).otherwise(F.lit(0))).alias("page")))


@query("src12_degrade", "SELECT c_nationkey AS job_id, CASE WHEN c_nationkey % 2 = 0 THEN 'parsed' WHEN c_nationkey % 3 = 0 THEN 'native_only' ELSE 'error' END AS mode, CASE WHEN c_nationkey % 2 = 1 AND c_nationkey % 3 <> 0 THEN min(c_custkey) END AS first_incomplete FROM customer GROUP BY c_nationkey")
def _src12(t):
    n = F.col("c_nationkey")
    return files.parse_or_degrade(t("customer").select(n.alias("job_id"), F.col("c_custkey").alias("page"), F.when(n % 3 == 0, 0).otherwise(2).alias("n_missing"), (n % 2 == 1).alias("parser_failed")))


@query("src13_native_title", "SELECT p_size AS page, p_name AS title FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY (p_partkey % 100 <= 30) DESC, p_retailprice DESC, p_partkey % 100, p_partkey, p_name) AS n FROM part) WHERE n = 1")
def _src13(t):
    k = F.col("p_partkey")
    return files.native_titles(t("part").select(F.col("p_size").alias("page"), F.col("p_name").alias("text"), F.col("p_retailprice").alias("font"), (k % 100).cast("double").alias("y0"), k.cast("double").alias("x0"), F.lit(100.0).alias("height")))


@query("src14_native_headers", "WITH w AS (SELECT p_size AS page, p_partkey, i, string_split(lower(p_name), ' ')[i] AS word FROM (SELECT *, unnest(range(1, 4)) AS i FROM part)), f AS (SELECT page, word, min(p_partkey * 10 + i) AS spot FROM w WHERE word IN ('anvil', 'bolt', 'red') GROUP BY ALL) SELECT page, string_agg(word, ',' ORDER BY spot) AS headers FROM f GROUP BY page")
def _src14(t):
    s = t("part").select(F.col("p_size").alias("page"), F.col("p_partkey").alias("idx"), F.col("p_name").alias("text"))
    return files.native_headers(s, ["anvil", "bolt", "red"]).withColumn("headers", F.array_join("headers", ","))


@query("src8_flat_spans", "SELECT p_partkey AS page, 0 AS block, i - 1 AS line, 0 AS span, string_split(p_name, ' ')[i] AS text FROM (SELECT *, unnest(range(1, len(string_split(p_name, ' ')) + 1))::INTEGER AS i FROM part)")
def _src8(t):
    lines = F.transform(F.split("p_name", " "), lambda w: F.array(w, F.lit("  ")))
    return files.flat_spans(t("part").select(F.col("p_partkey").alias("page"), F.array(lines).alias("blocks")))


@query("src11_nested_tables", "SELECT n_nationkey AS id, n_name AS html FROM nation UNION ALL SELECT n_nationkey, 'deep' FROM nation WHERE n_nationkey % 2 = 0")
def _src11(t):
    inner = F.when(F.col("n_nationkey") % 2 == 0, '{"a":[{"b":{"type":"table","html":"deep"}}]}').otherwise('{"type":"text"}')
    j = F.concat(F.lit('{"blocks":[{"type":"table","html":"'), "n_name", F.lit('"},'), inner, F.lit("]}"))
    return files.nested_tables(t("nation").select(F.col("n_nationkey").alias("id"), j.alias("json"))).select("id", "html")


@query("src10_parser_response", "SELECT c_custkey, (c_custkey % 3)::INTEGER AS page, c_name AS text FROM customer")
def _src10(t):
    inner = F.to_json(F.struct(F.array(F.struct((F.col("c_custkey") % 3).cast("int").alias("page_idx"), F.col("c_name").alias("text"))).alias("content_list")))
    payload = t("customer").select("c_custkey", F.to_json(F.struct(F.struct(inner.alias("doc")).alias("result"))).alias("body"))
    unwrapped = payload.select("c_custkey", F.from_json(F.get_json_object("body", "$.result.doc"), "content_list array<struct<page_idx:int,text:string>>").alias("r"))
    return unwrapped.select("c_custkey", F.inline("r.content_list").alias("page", "text"))


@query("src16_node_shape", "SELECT event_id FROM events WHERE event_id % 4 = 0")
def _src16(t):
    k = F.col("event_id")
    nodes = t("events").select("event_id", F.when(k % 4 == 0, F.array(F.lit(1.0))).otherwise(F.array(*[F.lit(float(i)) for i in range(4)])).alias("bbox"))
    return nodes.where(F.size("bbox") != 4).select("event_id")


def _memory(t):
    return view(t, MEMORY)


_K = r"trim(regexp_replace(source_text, '\s+', ' ', 'g'))"


@query("j8_memory_merge", f"WITH m AS ({MEMORY}), a AS (SELECT * FROM m WHERE seq % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY {_K}, page_type, context, corrected ORDER BY seq) AS n FROM m WHERE seq % 2 = 1 OR seq % 3 = 0) SELECT seq FROM a UNION ALL SELECT seq FROM b WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE trim(regexp_replace(a.source_text, '\\s+', ' ', 'g')) = trim(regexp_replace(b.source_text, '\\s+', ' ', 'g')) AND a.page_type = b.page_type AND a.context = b.context AND a.corrected = b.corrected)")
def _j8(t):
    m = _memory(t)
    return memory.merge(m.where("seq % 2 = 0"), m.where("seq % 2 = 1 OR seq % 3 = 0")).select("seq")


@query("j8_memory_idempotent", "SELECT 0::BIGINT AS added")
def _j8i(t):
    m = _memory(t)
    return memory.additions(memory.merge(m.limit(0), m), m).agg(F.count(F.lit(1)).alias("added"))


@query("a9_competing_corrections", f"WITH m AS ({MEMORY}) SELECT {_K} AS key, page_type, context, count(DISTINCT corrected) AS n_texts FROM m GROUP BY ALL HAVING count(DISTINCT corrected) > 1")
def _a9(t):
    return memory.competing(_memory(t))


@query("j7_memory_recall", f"WITH m AS (SELECT *, {_K} AS key FROM ({MEMORY})), c AS (SELECT key, page_type, context, count(DISTINCT corrected) > 1 AS many FROM m GROUP BY ALL) SELECT q.seq AS item_id, m.seq, concat_ws(',', CASE WHEN many THEN 'conflicting_corrections' END, CASE WHEN NOT contains(lower(m.corrected), 'the') THEN 'glossary_conflict' END) AS warnings, many OR NOT contains(lower(m.corrected), 'the') AS requires_confirmation FROM m q JOIN m USING (key, page_type, context) JOIN c USING (key, page_type, context)")
def _j7(t):
    m = _memory(t)
    q = m.select(F.col("seq").alias("item_id"), F.concat(F.lit("  "), F.col("source_text"), F.lit("\n")).alias("source_text"), "page_type", "context", F.array(F.lit("The")).alias("targets"))
    return memory.recall(q, m).select("item_id", "seq", F.array_join("warnings", ",").alias("warnings"), "requires_confirmation")


@query("c8_recall_confirmation", f"WITH m AS (SELECT *, {_K} AS key FROM ({MEMORY})), c AS (SELECT key, page_type, context, count(DISTINCT corrected) > 1 AS many FROM m GROUP BY ALL) SELECT many AS requires_confirmation, count(*) AS n FROM m q JOIN m USING (key, page_type, context) JOIN c USING (key, page_type, context) GROUP BY 1")
def _c8(t):
    m = _memory(t)
    q = m.select(F.col("seq").alias("item_id"), "source_text", "page_type", "context", F.array().cast("array<string>").alias("targets"))
    return memory.recall(q, m).groupBy("requires_confirmation").agg(F.count(F.lit(1)).alias("n"))


@query("c7_learnable", f"WITH {_R} SELECT item_id FROM r WHERE status = 'approved_edited' AND reviewed <> suggested")
def _c7(t):
    return memory.learnable(_items(t)).select("item_id")


@query("v13_memory_rows", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def _v13(t):
    k = F.col("event_id") % 3
    stamp = F.when(k == 0, "2024-05-01T10:00:00").when(k == 1, "2024-05-01T10:00:00Z").otherwise("2024-05-01T10:00:00+02:00")
    return t("events").where(text.zoned_timestamp(stamp).isNotNull()).select("event_id")


@query("src17_memory_table", f"SELECT seq::VARCHAR AS seq, source_text, corrected FROM ({MEMORY})")
def _src17(t):
    rows = _memory(t).select(F.col("seq").cast("string").alias("seq"), "source_text", "corrected")
    columns = ("seq", "source_text", "corrected")
    return files.parse_memory_lines(files.memory_lines(rows, *columns), *columns)


@query("snk1_memory_round_trip", f"SELECT count(*) AS n, count(DISTINCT seq) AS ids FROM ({MEMORY})")
def _snk1(t):
    columns = ("seq", "source_text", "corrected")
    path = _scratch(t, "memory")
    files.write_memory(_memory(t), path, *columns)
    return files.read_memory(t.spark, path, *columns).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("ids"))


@query("snk2_canonical_json", "SELECT '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS value FROM nation")
def _snk2(t):
    path = _scratch(t, "json")
    files.write_canonical_json(t("nation"), path)
    return t.spark.read.text(path)


@query("src3_job_id", "SELECT s_suppkey, substr(sha256(s_name), 1, 12) || '-20240501T100000Z' AS job_id FROM supplier")
def _src3(t):
    at = F.lit("2024-05-01 10:00:00").cast("timestamp")
    return t("supplier").select("s_suppkey", state.job_id(F.sha2("s_name", 256), at).alias("job_id"))


@query("snk6_bounded_read", f"SELECT doc_id FROM documents WHERE strlen(text) <= {files.ARTIFACT_BYTES}")
def _snk6(t):
    return files.bounded(t("documents").select("doc_id", F.octet_length("text").alias("length"))).select("doc_id")


_S = f"s AS ({STATE})"


@query("w8_legal_steps", f"WITH {_S}, l AS (SELECT *, coalesce(lag(state) OVER w, '') AS b FROM s WINDOW w AS (PARTITION BY job_id ORDER BY revision)) SELECT job_id, revision, state, (b = '' AND state = 'initialized') OR (b = 'initialized' AND state IN ('parsed', 'failed')) OR (b = 'parsed' AND state IN ('translation_requested', 'failed')) OR (b = 'translation_requested' AND state IN ('translation_requested', 'translation_validated', 'failed')) OR (b = 'translation_validated' AND state = 'failed') AS legal FROM l")
def _w8(t):
    return state.steps(view(t, STATE).select("job_id", "revision", "state"))


@query("v7_state_invariants", f"WITH {_S} SELECT job_id, revision, CASE WHEN state IN ('translation_requested', 'translation_validated') THEN 'artifact_missing' WHEN state IN ('parsed', 'initialized', 'failed') AND job_id % 2 = 0 THEN 'wait_reason' WHEN state = 'initialized' AND revision <> 0 THEN 'revision' ELSE 'revision' END AS code FROM s WHERE state IN ('translation_requested', 'translation_validated') OR job_id % 2 = 0 OR (state = 'initialized' AND revision <> 0) OR (state = 'parsed' AND revision < 1)")
def _v7(t):
    s = view(t, STATE).select("job_id", "revision", "state", F.lit(0).alias("attempt"), F.when(F.col("job_id") % 2 == 0, "odd").otherwise("").alias("wait_reason"), F.create_map(F.lit("analysis"), F.lit("x")).alias("artifacts"))
    return state.invariant_errors(s)


@query("a14_batch_exit", f"WITH {_S}, c AS (SELECT job_id, CASE state WHEN 'failed' THEN 3 WHEN 'translation_requested' THEN 4 ELSE 5 END AS code FROM s) SELECT job_id, arg_min(code, CASE code WHEN 3 THEN 1 WHEN 5 THEN 3 ELSE 4 END) AS exit_code FROM c GROUP BY job_id")
def _a14(t):
    return state.batch_exit(view(t, STATE).select("job_id", state.exit_code(F.col("state")).alias("code")), "job_id")


@query("w9_unchanged_rounds", f"WITH {_S}, l AS (SELECT *, (lag(state) OVER (PARTITION BY job_id ORDER BY revision) IS DISTINCT FROM state)::INTEGER AS c FROM s), g AS (SELECT *, sum(c) OVER (PARTITION BY job_id ORDER BY revision) AS run FROM l) SELECT job_id, revision AS round, (row_number() OVER (PARTITION BY job_id, run ORDER BY revision) - 1)::INTEGER AS streak FROM g")
def _w9(t):
    s = view(t, STATE).select("job_id", F.col("revision").alias("round"), F.col("state").alias("signature"))
    return state.unchanged_rounds(s).select("job_id", "round", "streak")


@query("p27_problem_tree", "SELECT n_nationkey AS id, 2 AS depth FROM nation UNION ALL SELECT 1000 + r_regionkey, 1 FROM region UNION ALL SELECT 9999, 0")
def _p27(t):
    root = t.spark.createDataFrame([(9999, None)], "id int, parent_id int")
    regions = t("region").select((F.col("r_regionkey") + 1000).alias("id"), F.lit(9999).alias("parent_id"))
    nations = t("nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") + 1000).alias("parent_id"))
    return state.problem_paths(root.unionByName(regions).unionByName(nations)).select("id", "depth")


@query("j20_unsafe_items", f"WITH {_R}, u AS (SELECT DISTINCT page FROM r WHERE risk = 'high') SELECT item_id, u.page IS NOT NULL AS unsafe FROM r LEFT JOIN u ON r.page = u.page")
def _j20(t):
    i = _items(t)
    unsafe = i.where("risk = 'high'").select("page").distinct().withColumn("u", F.lit(True))
    return i.join(unsafe, "page", "left").select("item_id", F.coalesce("u", F.lit(False)).alias("unsafe"))


@query("p15_scanned_pages", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_tax < 0.01 AND l_quantity / 50 >= 0.5 GROUP BY 1, 2")
def _p15(t):
    scanned = (F.col("l_tax") < 0.01) & (F.col("l_quantity") / 50 >= 0.5)
    return t("lineitem").where(scanned).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("w3_previous_text", "SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE text <> ''")
def _w3(t):
    from pyspark.sql import Window

    return t("conversations").where("text <> ''").select("conv_id", "turn", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous"))


@query("t1_job_stream", f"WITH {_S} SELECT count(*) AS n, count(DISTINCT job_id) AS jobs FROM s")
def _t1(t):
    """Runs the stream over the event log to completion and reads what it emitted."""
    source, out, mark = (_scratch(t, n) for n in ("log", "states", "mark"))
    view(t, STATE).select("job_id", "revision", "state").write.parquet(source)
    stream = jobs.track_jobs(t.spark.readStream.schema("job_id long, revision long, state string").parquet(source))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("jobs"))
