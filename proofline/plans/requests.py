"""Queries of requests and commands, derived from all orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import requests as Q
from proofline.plans.common import Registry, carried, plain

query = Registry()

_STATE = "CASE {0} % 5 WHEN 0 THEN 'resolving_entity' WHEN 1 THEN 'awaiting_entity_confirmation' WHEN 2 THEN 'preliminary_research' WHEN 3 THEN 'draft' ELSE 'failed_no_charge' END"
_REQ = f"SELECT c_custkey AS k, 'r' || c_custkey AS request_id, 'u' || (c_custkey % 40) AS user_id, {_STATE.format('c_custkey')} AS state, 'https://x' || c_custkey AS input_url, c_name AS input_legal_name, CASE WHEN c_custkey % 2 = 0 THEN 'hint' || c_custkey END AS legal_name_hint, 'cin' AS input_cin, CASE WHEN c_custkey % 3 = 0 THEN 'c2' END AS cin_hint, NULL AS state_hint, 'e' || (c_custkey % 70) AS confirmed_entity_id FROM {{customer}}"
_CAND = "SELECT 'r' || o_custkey AS request_id, 'k' || o_orderkey AS candidate_id, 'e' || (o_orderkey % 9) AS entity_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, CASE WHEN o_orderkey % 4 = 0 THEN 'parent' WHEN o_orderkey % 4 = 1 THEN ' ' END AS related_reason, o_orderkey % 3 = 0 AS is_selected, o_orderkey AS k FROM {orders}"


@query("WITH r AS (" + plain(_REQ) + ") SELECT 'resolve' AS kind, request_id, coalesce(legal_name_hint, input_legal_name) AS legal_name, coalesce(cin_hint, input_cin) AS cin FROM r WHERE state = 'resolving_entity' UNION ALL SELECT 'research', request_id, 'n' || s_suppkey, NULL FROM r JOIN supplier ON confirmed_entity_id = 'e' || s_suppkey WHERE state = 'preliminary_research'")
def request_loads(spark, d):
    rows = carried(spark, d, _REQ)
    entities = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("e"), "s_suppkey").alias("entity_id"), F.concat(F.lit("n"), "s_suppkey").alias("legal_name"))
    one = Q.resolution_requests(rows).select(F.lit("resolve").alias("kind"), "request_id", "legal_name", "cin")
    return one.unionByName(Q.research_requests(rows, entities).select(F.lit("research").alias("kind"), "request_id", "legal_name", F.lit(None).cast("string").alias("cin")))


@query("WITH r AS (" + plain(_REQ) + "), c AS (" + plain(_CAND) + ") SELECT candidate_id, rank, related_reason IS NOT NULL AND trim(related_reason) <> '' AND NOT is_selected AS suggested FROM c WHERE rank <= 4 AND request_id IN (SELECT request_id FROM r WHERE state IN ('awaiting_entity_confirmation', 'preliminary_research', 'failed_no_charge'))")
def shown_candidates(spark, d):
    shown = Q.candidate_lists(carried(spark, d, _CAND), carried(spark, d, _REQ), 4)
    hints = Q.related_suggestions(shown).select("candidate_id", F.lit(True).alias("suggested"))
    return shown.join(hints, "candidate_id", "left").select("candidate_id", F.col("rank").cast("long").alias("rank"), F.coalesce("suggested", F.lit(False)).alias("suggested"))


_CMD = """SELECT 'm' || k AS command_id, 'r' || (k % 160) AS request_id, 'u' || (k % 160 % 40 + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END) AS user_id, CASE k % 4 WHEN 0 THEN 'none_of_these' WHEN 1 THEN 'refine' ELSE 'confirm' END AS action, CASE WHEN k % 4 > 1 THEN 'k' || k END AS candidate_id, CASE WHEN k % 4 = 1 THEN 'Acme' END AS legal_name,
  CAST(NULL AS STRING) AS cin, CAST(NULL AS STRING) AS state_hint, k, cust FROM (SELECT o_orderkey AS k, o_custkey AS cust FROM {orders})"""
_CMD = _CMD.replace("'r' || (k % 160) AS", "'r' || cust AS").replace("k % 160 % 40", "cust % 40")


@query("WITH r AS (" + plain(_REQ) + "), c AS (" + plain(_CAND) + "), m AS (SELECT *, CASE WHEN action = 'confirm' THEN CASE k % 3 WHEN 0 THEN [] WHEN 1 THEN ['e' || (k * 5 % 9)] ELSE ['e1', 'e2'] END ELSE [] END AS related FROM (" + plain(_CMD) + """)),
j AS (SELECT m.*, r.state AS s, c.entity_id AS entity, len(list_filter(related, lambda x: NOT list_contains(coalesce(g.es, []), x))) > 0 AS stray FROM m LEFT JOIN r ON r.request_id = m.request_id AND r.user_id = m.user_id LEFT JOIN c ON c.request_id = m.request_id AND c.candidate_id = m.candidate_id
 LEFT JOIN (SELECT request_id, list(DISTINCT entity_id) AS es FROM c WHERE coalesce(related_reason, '') <> '' GROUP BY 1) g ON g.request_id = m.request_id),
e AS (SELECT *, CASE WHEN s IS NULL THEN 'REPORT_REQUEST_NOT_FOUND' WHEN action IN ('confirm', 'none_of_these') AND s <> 'awaiting_entity_confirmation' OR action = 'refine' AND s NOT IN ('draft', 'awaiting_entity_confirmation', 'failed_no_charge') THEN 'CONFIRMATION_STATE_CONFLICT' WHEN action = 'confirm' AND (list_contains(related, entity) OR stray) THEN 'INVALID_RELATED_ENTITY_SCOPE' END AS code FROM j)
SELECT command_id, code, CASE WHEN code IS NULL THEN CASE action WHEN 'confirm' THEN 'preliminary_research' WHEN 'none_of_these' THEN 'draft' ELSE 'resolving_entity' END END AS state, CASE WHEN code IS NULL AND action = 'confirm' THEN entity END AS confirmed_entity_id, CASE WHEN code IS NULL THEN 200 WHEN code LIKE 'INVALID%' THEN 400 WHEN code LIKE '%NOT_FOUND' THEN 404 ELSE 409 END AS status FROM e""")
def confirmation_commands(spark, d):
    k = F.col("k")
    none = F.array().cast("array<string>")
    related = F.when((F.col("action") != "confirm") | (k % 3 == 0), none).when(k % 3 == 1, F.array(F.concat(F.lit("e"), k * 5 % 9))).otherwise(F.array(F.lit("e1"), F.lit("e2")))
    out = Q.confirmed(carried(spark, d, _CMD).withColumn("related_ids", related), carried(spark, d, _REQ), carried(spark, d, _CAND))
    return out.withColumn("status", Q.http_status(F.col("code")))


_FAIL = "SELECT 'm' || o_orderkey AS command_id, 't' || (o_orderkey % 300) AS task_id, 'r' || (o_orderkey % 300 % 170) AS request_id, CASE o_orderkey % 7 WHEN 0 THEN 'Bad code' WHEN 1 THEN NULL ELSE 'provider_down' END AS error_code FROM {orders}"


@query("WITH r AS (" + plain(_REQ) + "), f AS (" + plain(_FAIL) + """), j AS (SELECT f.*, r.state AS s, substr(task_id, 2)::INT % 4 <> 0 AND substr(task_id, 2)::INT % 9 <> 0 AS task FROM f LEFT JOIN r USING (request_id)),
e AS (SELECT *, CASE WHEN coalesce(error_code, 'Bad code') = 'Bad code' THEN 'INVALID_RESOLUTION_ERROR_CODE' WHEN NOT task THEN 'RESOLUTION_TASK_NOT_FOUND' WHEN s IS NULL THEN 'REPORT_REQUEST_NOT_FOUND' WHEN s NOT IN ('resolving_entity', 'failed_no_charge', 'awaiting_entity_confirmation') THEN 'RESOLUTION_STATE_CONFLICT' END AS code FROM j)
SELECT command_id, code, CASE WHEN code IS NULL THEN CASE s WHEN 'resolving_entity' THEN 'failed_no_charge' ELSE s END END AS state FROM e""")
def failure_commands(spark, d):
    i = F.col("id")
    kind = F.when(i % 4 == 0, "render_pdf").otherwise("resolve_entity")
    request = F.when(i % 9 == 0, "other").otherwise(F.concat(F.lit("r"), i % 170))
    outbox = spark.range(300).select(F.concat(F.lit("t"), i).alias("id"), F.to_json(F.struct(kind.alias("taskType"), request.alias("reportRequestId"))).alias("payload"))
    return Q.failed(carried(spark, d, _FAIL), carried(spark, d, _REQ), outbox)


@query("SELECT o_orderkey AS completion_id, i + 1 AS rank, 'a' || i AS candidate, 'b' || i AS audit FROM orders, (SELECT unnest(range(0, 5))::INT AS i) WHERE i < o_orderkey % 6 AND o_orderkey % 6 = o_orderkey % 5")
def zipped_completions(spark, d):
    k = F.col("o_orderkey")
    items = lambda lead, n: F.to_json(F.transform(F.slice(F.sequence(F.lit(0), F.lit(5)), F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(lead), i.cast("string"))))
    rows = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("completion_id"), items("a", k % 6).alias("candidates"), items("b", k % 5).alias("audits"))
    return Q.zipped(rows)


@query("SELECT event_id, i::INT AS ordinality, CASE i WHEN 1 THEN event_type WHEN 2 THEN event_id::VARCHAR ELSE NULL END AS value FROM events, (SELECT unnest([1, 2, 3]) AS i)")
def json_entries(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.lit('["'), "event_type", F.lit('",'), "event_id", F.lit(",null]")).alias("j"))
    return Q.entries(rows, "event_id", "j")


@query("WITH c AS (" + plain(_CAND) + ") SELECT request_id, candidate_id, is_selected FROM (SELECT request_id, candidate_id, CASE WHEN ch.chosen IS NULL THEN is_selected ELSE candidate_id = ch.chosen END AS is_selected FROM c LEFT JOIN (SELECT request_id, max(candidate_id) AS chosen FROM c WHERE substr(request_id, 2)::INT % 2 = 0 GROUP BY 1) ch USING (request_id)) WHERE substr(request_id, 2)::INT % 5 <> 0 UNION ALL SELECT 'r' || c_custkey, 'new', true FROM customer WHERE c_custkey % 5 = 0")
def replaced_candidates(spark, d):
    rows = carried(spark, d, _CAND)
    even = rows.filter("cast(substr(request_id, 2) as int) % 2 = 0").groupBy("request_id").agg(F.max("candidate_id").alias("chosen"))
    new = spark.read.parquet(f"{d}/customer.parquet").filter("c_custkey % 5 = 0").select(F.concat(F.lit("r"), "c_custkey").alias("request_id"), F.lit("new").alias("candidate_id"), F.lit(True).alias("is_selected"))
    return Q.replaced(Q.selected(rows, even).select("request_id", "candidate_id", "is_selected"), new, "request_id")


_BOX = "SELECT o_orderkey AS id, o_orderkey % 3 AS attempts, CASE WHEN o_orderkey % 4 = 0 THEN 5 END AS dispatched_at, CASE WHEN o_orderkey % 6 = 0 THEN 'old' END AS last_error, o_custkey AS created_at FROM {orders}"


@query("WITH b AS (" + plain(_BOX) + ") SELECT id, attempts + CASE WHEN id % 5 < 2 THEN 1 ELSE 0 END AS attempts, CASE WHEN id % 5 = 0 THEN 9 ELSE dispatched_at END AS dispatched_at, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 5 = 1 THEN 'queue_dispatch_failed' ELSE last_error END AS last_error, id IN (SELECT id FROM b WHERE dispatched_at IS NULL ORDER BY created_at, id LIMIT 7) AS next_up, CASE WHEN id % 5 < 2 THEN 9 ELSE 1 END AS updated_at FROM b")
def outbox_dispatch(spark, d):
    box = carried(spark, d, _BOX)
    sent = box.filter("id % 5 < 2").select("id", (F.col("id") % 5 == 0).alias("sent"))
    after = Q.dispatched(box, sent, F.lit(9)).withColumn("updated_at", F.lit(1))
    due = Q.oldest_pending(box, 7).select("id", F.lit(True).alias("next_up"))
    return Q.touched(after, box.withColumn("updated_at", F.lit(1)), "id", F.lit(9)).join(due, "id", "left").select("id", "attempts", "dispatched_at", "last_error", F.coalesce("next_up", F.lit(False)).alias("next_up"), "updated_at")


@query("""WITH r AS (SELECT c_custkey AS k, c_custkey % 2 = 0 AS a, c_custkey % 3 <> 0 AS b FROM customer), q AS (SELECT k, 1 AS place, 'client_role' AS code FROM r UNION ALL SELECT k, 2, 'transaction_category' FROM r WHERE a UNION ALL SELECT k, CASE WHEN a THEN 3 ELSE 2 END, 'cross_border' FROM r WHERE b)
SELECT 'r' || k AS request_id, place, code, code = 'client_role' AS mandatory, CASE code WHEN 'client_role' THEN 'single_select' ELSE 'optional_select' END AS kind, CASE code WHEN 'client_role' THEN 'company_promoter,investor_acquirer,seller_transferor,other' WHEN 'cross_border' THEN 'yes,no,unknown' ELSE 'investment,acquisition,sale_or_transfer,other' END AS options, k % 4 < 2 AS sparse FROM q""")
def clarification_questions(spark, d):
    k = F.col("c_custkey")
    related = F.when(k % 2 == 0, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("r"), k).alias("request_id"), Q.material_signals(F.when(k % 3 == 0, "IN").when(k % 3 == 1, "US"), related).alias("signals"))
    few = Q.sparse(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (F.substring("request_id", 2, 20).cast("int") % 4).cast("int")))
    return Q.questions(rows).withColumn("sparse", few)
