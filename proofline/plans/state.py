"""Queries of ledgers, limits, queues, payloads and model calls, over all orders, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import payloads as P
from proofline.operators import models as M
from proofline.operators import sequential as Q
from proofline.plans.common import Registry, carried, plain

query = Registry()

_STAGES = list(Q.STAGE_SEARCHES_PAGES)
_ENTRIES = """SELECT o_custkey % 200 AS job_id, o_orderkey AS ord, CASE o_orderkey % 5 WHEN 0 THEN 'start_stage' WHEN 1 THEN 'searches' WHEN 2 THEN 'searches' ELSE 'tokens' END AS kind, o_orderkey % 7 AS s,
  CASE o_orderkey % 5 WHEN 1 THEN o_orderkey % 4 WHEN 2 THEN CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_orderkey % 3 END ELSE (o_orderkey * 37) % 9000 END AS amount, (o_orderkey * 11) % 1500 AS second FROM {orders}"""
_LEDGER = "WITH RECURSIVE e AS (" + plain(_ENTRIES) + f"""), n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS i FROM e),
caps AS (SELECT {[a for a, _ in Q.STAGE_SEARCHES_PAGES.values()]} AS cs),
z AS (SELECT job_id, 0::BIGINT AS i, NULL::BIGINT AS ord, NULL::BIGINT AS stage, 0::BIGINT AS a, 0::BIGINT AS b, 0::BIGINT AS o, [0, 0, 0, 0, 0, 0]::BIGINT[] AS sa, [0, 0, 0, 0, 0, 0]::BIGINT[] AS sb, [0, 0, 0, 0, 0, 0]::BIGINT[] AS so, NULL::VARCHAR AS code FROM (SELECT DISTINCT job_id FROM n)
 UNION ALL SELECT job_id, i, ord, CASE WHEN kind = 'start_stage' AND code IS NULL THEN s + 1 ELSE stage END, a + CASE WHEN kind = 'searches' AND code IS NULL THEN amount ELSE 0 END, b + CASE WHEN kind = 'tokens' AND code IS NULL THEN amount ELSE 0 END, o + CASE WHEN kind = 'tokens' AND code IS NULL THEN second ELSE 0 END,
   CASE WHEN kind = 'searches' AND code IS NULL THEN list_transform(sa, lambda v, k: CASE WHEN k = stage THEN v + amount ELSE v END) ELSE sa END, CASE WHEN kind = 'tokens' AND code IS NULL THEN list_transform(sb, lambda v, k: CASE WHEN k = stage THEN v + amount ELSE v END) ELSE sb END,
   CASE WHEN kind = 'tokens' AND code IS NULL THEN list_transform(so, lambda v, k: CASE WHEN k = stage THEN v + second ELSE v END) ELSE so END, code FROM (
   SELECT z.job_id, n.i, n.ord, n.kind, n.s, n.amount, n.second, z.stage, z.a, z.b, z.o, z.sa, z.sb, z.so, CASE WHEN kind = 'start_stage' THEN CASE WHEN n.s = 6 THEN 'budget_stage_unconfigured' END WHEN n.amount < 0 THEN 'budget_increment_invalid' WHEN stage IS NULL THEN 'budget_stage_not_started'
     WHEN kind = 'searches' THEN CASE WHEN a + amount > 45 THEN 'budget_searches_exhausted' WHEN sa[stage] + amount > cs[stage] THEN 'budget_stage_searches_exhausted' END
     WHEN b + amount > 350000 THEN 'budget_input_tokens_exhausted' WHEN sb[stage] + amount > 50000 THEN 'budget_stage_input_tokens_exhausted' WHEN o + second > 60000 THEN 'budget_output_tokens_exhausted' WHEN so[stage] + second > 8000 THEN 'budget_stage_output_tokens_exhausted' END AS code
   FROM z JOIN n ON n.job_id = z.job_id AND n.i = z.i + 1, caps))
"""


def _ledger(spark, d):
    rows = carried(spark, d, _ENTRIES)
    stage = F.try_element_at(F.array(*map(F.lit, _STAGES)), (F.col("s") + 1).cast("int"))
    return Q.budget_ledger(rows.select("job_id", "ord", "kind", stage.alias("stage"), "amount", "second", F.lit(False).alias("frontier")))


@query(_LEDGER + "SELECT job_id, ord, code, a::DOUBLE AS searches_used, b::DOUBLE AS input_tokens_used, o::DOUBLE AS output_tokens_used FROM z WHERE i > 0")
def budget_bookings(spark, d):
    return _ledger(spark, d).select("job_id", "ord", "code", "searches_used", "input_tokens_used", "output_tokens_used")


@query(_LEDGER + ", x AS (SELECT job_id, a >= 9 OR b >= 350000 OR o >= 60000 AS done FROM z WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1) SELECT job_id, done, CASE WHEN NOT done THEN 'continue' WHEN job_id % 3 = 0 THEN 'stop_to_questions' WHEN job_id % 2 = 0 THEN 'retry_wait' ELSE 'failed_restored' END AS decision FROM x")
def budget_stops(spark, d):
    last = _ledger(spark, d).withColumn("done", Q.exhausted(Q.JOB_CAPS | {"searches": 9})).groupBy("job_id").agg(F.max_by("done", "ord").alias("done"))
    return last.select("job_id", "done", Q.stopping(F.col("done"), F.col("job_id") % 3 == 0, F.col("job_id") % 2 == 0).alias("decision"))


_SLICES = "SELECT o_custkey AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 's' || o_orderkey END AS stage, o_orderkey % 9 AS searches, o_orderkey % 30 AS pages, (o_orderkey * 7) % 60000 AS input_tokens, o_orderkey % 9000 AS output_tokens, o_orderkey % 25 AS cost_inr, o_orderkey % 300 AS wall_clock_seconds FROM {orders}"


@query("WITH s AS (" + plain(_SLICES) + """), g AS (SELECT name, count(*) <> count(DISTINCT stage) AS again, sum(searches) AS a, sum(pages) AS b, sum(input_tokens) AS c, sum(output_tokens) AS d, sum(cost_inr) AS e, sum(wall_clock_seconds) AS f FROM s GROUP BY 1)
SELECT name, unnest(list_filter([CASE WHEN again THEN 'stages_not_unique' END, CASE WHEN a > 45 THEN 'searches_exceed_job' END, CASE WHEN b > 100 THEN 'pages_exceed_job' END, CASE WHEN c > 350000 THEN 'input_tokens_exceed_job' END, CASE WHEN d > 60000 THEN 'output_tokens_exceed_job' END,
 CASE WHEN e > 120 THEN 'cost_inr_exceed_job' END, CASE WHEN f > 1200 THEN 'wall_clock_seconds_exceed_job' END], lambda x: x IS NOT NULL)) AS rule FROM g""")
def budget_profiles(spark, d):
    slices = carried(spark, d, _SLICES)
    caps = {k: F.lit(v) for k, v in Q.JOB_CAPS.items() if k != "frontier_model_calls"}
    return Q.profile_errors(slices.select("name").distinct().withColumns(caps), slices)


_COMMANDS = "SELECT user_id, event_id AS ord, event_id * 400 AS at, CASE WHEN event_id % 4 = 0 THEN 'k' || (event_id % 40) END AS idempotency_key, event_type AS payload FROM {events}"


@query("WITH RECURSIVE c AS (" + plain(_COMMANDS) + """), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS i FROM c),
z AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS ord, []::BIGINT[] AS times, []::VARCHAR[] AS ks, []::VARCHAR[] AS ps, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT user_id FROM n)
 UNION ALL SELECT user_id, i, ord, CASE WHEN outcome = 'accepted' THEN list_append(times, "at") ELSE times END, CASE WHEN outcome = 'accepted' AND k IS NOT NULL THEN list_append(ks, k) ELSE ks END, CASE WHEN outcome = 'accepted' AND k IS NOT NULL THEN list_append(ps, payload) ELSE ps END, outcome FROM (
  SELECT z.user_id, n.i, n.ord, n."at", z.times, z.ks, z.ps, n.idempotency_key AS k, n.payload, CASE WHEN n.idempotency_key IS NOT NULL AND list_contains(z.ks, n.idempotency_key) THEN CASE WHEN z.ps[list_position(z.ks, n.idempotency_key)] = n.payload THEN 'replayed' ELSE 'conflict' END
   WHEN len(list_filter(z.times, lambda t: t >= n."at" - 172800)) >= 4 THEN 'limited' ELSE 'accepted' END AS outcome FROM z JOIN n ON n.user_id = z.user_id AND n.i = z.i + 1))
SELECT user_id, ord, outcome FROM z WHERE i > 0""")
def limited_commands(spark, d):
    return Q.limited(carried(spark, d, _COMMANDS), "user_id", 4, 172_800).select("user_id", "ord", "outcome")


_QUEUE = """SELECT 'q' || (user_id % 25) AS queue, event_id AS ord, CAST(event_id * 10 AS DOUBLE) AS at, CASE event_type WHEN 'view' THEN 'send' WHEN 'click' THEN 'lease' WHEN 'signup' THEN 'extend' WHEN 'purchase' THEN 'archive' ELSE 'dead_letter' END AS op,
  event_id % 30 + 1 AS message_id, CAST(CASE WHEN event_id % 9 = 0 THEN -1 ELSE event_id % 50 * 30 END AS DOUBLE) AS seconds FROM {events}"""
_REPLAY = "WITH RECURSIVE c AS (" + plain(_QUEUE) + """), n AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ord) AS i FROM c),
z AS (SELECT queue, 0::BIGINT AS i, NULL::BIGINT AS ord, 1::BIGINT AS next_id, []::STRUCT(id BIGINT, v DOUBLE, r BIGINT)[] AS m, NULL::VARCHAR AS outcome, NULL::BIGINT AS subject, NULL::BIGINT AS reads FROM (SELECT DISTINCT queue FROM n)
 UNION ALL SELECT queue, i, ord, CASE WHEN outcome = 'sent' THEN next_id + 1 ELSE next_id END,
  CASE WHEN outcome = 'sent' THEN list_append(m, {'id': next_id, 'v': "at" + seconds, 'r': 0::BIGINT}) WHEN outcome IN ('archived', 'dead_lettered') THEN list_filter(m, lambda x: x.id <> subject)
    WHEN outcome = 'leased' THEN list_transform(m, lambda x: CASE WHEN x.id = subject THEN {'id': x.id, 'v': "at" + seconds, 'r': x.r + 1} ELSE x END) WHEN outcome = 'extended' THEN list_transform(m, lambda x: CASE WHEN x.id = subject THEN {'id': x.id, 'v': "at" + seconds, 'r': x.r} ELSE x END) ELSE m END,
  outcome, CASE WHEN outcome = 'sent' THEN next_id ELSE subject END, CASE WHEN outcome = 'sent' THEN 0 WHEN outcome = 'leased' THEN held + 1 WHEN outcome IN ('archived', 'dead_lettered', 'extended') THEN held END FROM (
   SELECT *, list_filter(m, lambda x: x.id = subject)[1].r AS held FROM (SELECT *, CASE WHEN op = 'send' THEN CASE WHEN seconds < 0 THEN 'invalid_delay' ELSE 'sent' END WHEN op IN ('lease', 'extend') AND seconds <= 0 THEN 'invalid_timeout' WHEN op = 'lease' THEN CASE WHEN found IS NULL THEN 'empty' ELSE 'leased' END
      WHEN NOT list_contains(list_transform(m, lambda x: x.id), message_id) THEN 'not_found' WHEN op = 'extend' THEN 'extended' WHEN op = 'archive' THEN 'archived' ELSE 'dead_lettered' END AS outcome,
     CASE WHEN op = 'lease' THEN CASE WHEN seconds > 0 THEN found END WHEN op = 'send' OR op = 'extend' AND seconds <= 0 THEN NULL ELSE message_id END AS subject FROM (
      SELECT z.queue, n.i, n.ord, n.op, n."at", n.message_id, n.seconds, z.next_id, z.m, list_min(list_transform(list_filter(z.m, lambda x: x.v <= n."at"), lambda x: x.id)) AS found FROM z JOIN n ON n.queue = z.queue AND n.i = z.i + 1))))
"""


@query(_REPLAY + "SELECT queue, ord, outcome, subject, reads FROM z WHERE i > 0")
def queue_outcomes(spark, d):
    return Q.queue_replay(carried(spark, d, _QUEUE)).select("queue", "ord", "outcome", "subject", "reads")


@query(_REPLAY + "SELECT queue, x.id AS message_id, x.r AS reads, x.v AS visible_at FROM (SELECT queue, unnest(held) AS x FROM (SELECT queue, arg_max(m, i) AS held FROM z GROUP BY 1))")
def queue_left(spark, d):
    return Q.queue_snapshot(Q.queue_replay(carried(spark, d, _QUEUE)))


_DELIVERED = "SELECT event_id, event_id % 7 AS read_count, event_id % 11 <> 0 AS valid, CASE event_id % 5 WHEN 0 THEN 'timeout' WHEN 1 THEN 'error' ELSE 'ok' END AS result, event_id % 3 <> 0 AS kept FROM {events}"


@query("WITH c AS (" + plain(_DELIVERED) + """) SELECT event_id, CASE WHEN NOT valid OR read_count > 4 THEN 'dead_letter' WHEN result = 'ok' THEN 'archive' ELSE 'redeliver' END AS job, CASE WHEN NOT valid THEN 'invalid_job_message' WHEN read_count > 4 THEN 'max_deliveries_exceeded' WHEN result = 'timeout' THEN 'job_timeout' WHEN result = 'error' THEN 'handler_error' END AS job_code,
CASE WHEN valid AND read_count > 4 AND NOT kept THEN 'redeliver' WHEN NOT valid OR read_count > 4 THEN 'dead_letter' WHEN result = 'ok' THEN 'archive' ELSE 'redeliver' END AS light,
CASE WHEN NOT valid THEN 'invalid_light_task_message' WHEN read_count > 4 AND NOT kept THEN 'failure_persistence_failed' WHEN read_count > 4 THEN 'max_light_task_deliveries_exceeded' WHEN result = 'timeout' THEN 'light_task_timeout' WHEN result = 'error' THEN 'handler_error' END AS light_code FROM c""")
def delivery_policies(spark, d):
    c = F.col
    job, light = Q.job_delivery(c("read_count"), c("valid"), c("result")), Q.light_delivery(c("read_count"), c("valid"), c("result"), c("kept"))
    return carried(spark, d, _DELIVERED).select("event_id", job["action"].alias("job"), job["code"].alias("job_code"), light["action"].alias("light"), light["code"].alias("light_code"))


def _payload(k):
    """Payloads of several shapes by number."""
    shapes = {
        0: '{"b": 1, "a": "é \\"secret\\": x", "c": [1, {"z": null, "y": 2.5}]}', 1: '{"outer": [{"API_Key": "x"}], "a": 1}', 2: "not json", 3: '{"msg": "say \\"password\\": no", "n": 3}', 4: '{"url": "https://a.example.com/x", "ok": true}',
        5: '{"url": "https://evil.org/x", "k": [1, 2]}', 6: '{"raw-Body": 1, "url": "see https://x.org"}', 7: '[1, "two"]',
    }
    out = F.lit("{}")
    for n, text in shapes.items():
        out = F.when(k % 9 == n, F.lit(text)).otherwise(out)
    return out


_CANON = {
    0: '{"a":"\\u00e9 \\"secret\\": x","b":1,"c":[1,{"y":2.5,"z":null}]}', 1: '{"a":1,"outer":[{"API_Key":"x"}]}', 3: '{"msg":"say \\"password\\": no","n":3}', 4: '{"ok":true,"url":"https://a.example.com/x"}', 5: '{"k":[1,2],"url":"https://evil.org/x"}',
    6: '{"raw-Body":1,"url":"see https://x.org"}', 7: '[1,"two"]', 8: "{}",
}


@query("SELECT event_id, CASE WHEN event_id % 9 = 2 THEN NULL ELSE sha256(CASE event_id % 9 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _CANON.items()) + """ END) END AS digest, CASE event_id % 9 WHEN 1 THEN 'payload_contains_forbidden_field' WHEN 2 THEN 'payload_not_serializable' END AS code,
CASE event_id % 9 WHEN 1 THEN 'forbidden_field' WHEN 6 THEN 'forbidden_field' WHEN 5 THEN 'url_not_reserved' END AS golden, CASE event_id % 9 WHEN 2 THEN NULL WHEN 7 THEN 'array' ELSE 'object' END AS kind FROM events""")
def payload_digests(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", _payload(F.col("event_id")).alias("p"))
    p = F.col("p")
    return rows.select("event_id", P.payload_sha256(p).alias("digest"), P.checkpoint_digest(p)["code"].alias("code"), P.unsafe_case(p, ("api_key", "raw_body")).alias("golden"), P.json_kind(p).alias("kind"))


@query("""SELECT event_id, '{"event":"' || event_type || '","user_email":"[x]","details":"[REDACTED]","Auth-Token":"[REDACTED]","nested":[{"promptVersion":1,"prompt_text":"[REDACTED]","billingId":"[REDACTED]"}],"n":' || event_id || '}' AS safe, CASE WHEN event_id % 3 = 0 THEN 'trace.' || (event_id + 100000) ELSE 'minted' END AS trace FROM events""")
def log_redaction(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    event = F.concat(F.lit('{"event":"'), "event_type", F.lit('","user_email":"[x]","details":{"a":1},"Auth-Token":"t","nested":[{"promptVersion":1,"prompt_text":"p","billingId":7}],"n":'), "event_id", F.lit("}"))
    given = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("trace."), F.col("event_id") + 100000)).when(F.col("event_id") % 3 == 1, "bad id")
    return rows.select("event_id", P.redacted(event).alias("safe"), P.trace_id(given, F.lit("minted")).alias("trace"))


@query("SELECT event_id, 1 AS version, 'jobs' AS queue, event_id AS message, CASE WHEN event_id % 2 = 0 THEN 'job_timeout' ELSE 'queue_error' END AS code, sha256(props.replace(' ', '')) AS digest, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS observed FROM events")
def dead_letters(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    record = P.dead_letter(F.lit("jobs"), F.col("event_id"), F.lit(5), F.when(F.col("event_id") % 2 == 0, "job_timeout").otherwise("Bad Code!"), F.col("props"), F.col("ts"))
    return rows.select("event_id", record.alias("r")).select("event_id", F.col("r.schemaVersion").alias("version"), F.col("r.sourceQueue").alias("queue"), F.col("r.sourceMessageId").alias("message"), F.col("r.errorCode").alias("code"), F.col("r.payloadSha256").alias("digest"), F.col("r.observedAt").alias("observed"))


_CALLS = """SELECT conv_id * 100 + turn AS call_id, conv_id AS job_id, length(text) AS est_in, 500 + turn * 10 AS max_out, length(text) AS in_1, 100 + turn AS out_1, length(text) + 50 AS in_2, 120 AS out_2, length(text) + 60 AS est_in_2, conv_id % 5 AS s, turn % 7 AS u, CASE conv_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'frontier' END AS tier FROM {conversations}"""
_COST = "(({0})::DECIMAL(15,0) * pin * 0.001::DECIMAL(4,3) + ({1})::DECIMAL(15,0) * pout * 0.001::DECIMAL(4,3))"
_RUNS = "WITH c AS (" + plain(_CALLS) + "), p AS (SELECT *, CASE tier WHEN 'low' THEN 0.10 WHEN 'mid' THEN 0.50 ELSE 2.00 END::DECIMAL(10,4) AS pin, CASE tier WHEN 'low' THEN 0.20 WHEN 'mid' THEN 1.00 ELSE 4.00 END::DECIMAL(10,4) AS pout, u <> 1 AND u <> 2 AS ok_1, u <> 2 AS ok_2, CASE WHEN s = 4 THEN 'model_unavailable' END AS fail_1, CASE WHEN s = 3 THEN 'model_rate_limited' END AS fail_2, " + f"""CASE WHEN s = 0 THEN 0.9 ELSE 40 END::DECIMAL(18,7) AS remaining, 3::DECIMAL(18,7) AS per_call FROM c),
q AS (SELECT *, {_COST.format('est_in', 'max_out')} AS worst, {_COST.format('in_1', 'out_1')} AS one, {_COST.format('in_2', 'out_2')} AS two, {_COST.format('est_in_2', 'max_out')} AS worst_2 FROM p),
r AS (SELECT *, CASE WHEN remaining <= 0 OR worst > per_call OR worst > remaining THEN 'refused' WHEN fail_1 IS NOT NULL THEN 'failed_1' WHEN ok_1 THEN CASE WHEN one > per_call OR one > remaining THEN 'over_1' ELSE 'ok' END WHEN one + worst_2 > per_call OR one + worst_2 > remaining THEN 'again'
 WHEN fail_2 IS NOT NULL THEN 'failed_2' WHEN one + two > per_call OR one + two > remaining THEN 'over_2' WHEN ok_2 THEN 'schema_retry_ok' ELSE 'invalid' END AS k FROM q),
v AS (SELECT call_id, job_id, CASE WHEN k IN ('refused', 'ok', 'schema_retry_ok') THEN k ELSE 'error' END AS result, CASE WHEN k IN ('refused', 'over_1', 'over_2', 'again') THEN 'model_cost_cap_exceeded' WHEN k = 'failed_1' THEN fail_1 WHEN k = 'failed_2' THEN fail_2 WHEN k = 'invalid' THEN 'model_schema_invalid_after_repair' END AS error,
 CASE WHEN k IN ('ok', 'over_1', 'again') THEN in_1 WHEN k IN ('over_2', 'schema_retry_ok', 'invalid') THEN in_1 + in_2 ELSE 0 END::BIGINT AS tokens_in, CASE WHEN k IN ('ok', 'over_1', 'again') THEN out_1 WHEN k IN ('over_2', 'schema_retry_ok', 'invalid') THEN out_1 + out_2 ELSE 0 END::BIGINT AS tokens_out,
 CASE WHEN k IN ('ok', 'over_1', 'again') THEN one WHEN k IN ('over_2', 'schema_retry_ok', 'invalid') THEN one + two ELSE 0 END::DECIMAL(28,7) AS cost_inr FROM r)
"""


def _runs(spark, d):
    c = F.col
    rows = carried(spark, d, _CALLS)
    price = lambda k: F.create_map(*[x for t, p in M.PRICES.items() for x in (F.lit(t), F.lit(p[k]))])[c("tier")].cast("decimal(10,4)")
    rows = rows.withColumns({
        "price_in": price(0), "price_out": price(1), "ok_1": (c("u") != 1) & (c("u") != 2), "ok_2": c("u") != 2, "fail_1": F.when(c("s") == 4, "model_unavailable"), "fail_2": F.when(c("s") == 3, "model_rate_limited"),
        "remaining": F.when(c("s") == 0, 0.9).otherwise(40.0).cast("decimal(18,7)"), "per_call": F.lit(3).cast("decimal(18,7)"),
    })
    return M.calls(rows)


@query(_RUNS + "SELECT call_id, result, error, tokens_in, tokens_out, cost_inr FROM v")
def model_runs(spark, d):
    return _runs(spark, d).select("call_id", "result", "error", F.col("tokens_in").cast("long").alias("tokens_in"), F.col("tokens_out").cast("long").alias("tokens_out"), "cost_inr")


@query(_RUNS + "SELECT job_id, count(*) AS calls, count(*) FILTER (result = 'refused') AS refused, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(cost_inr) AS cost_total_inr FROM v GROUP BY 1")
def job_costs(spark, d):
    return M.cost_by_job(_runs(spark, d))


_HTTP = "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 400 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 502 WHEN 5 THEN 302 ELSE 200 END AS status, CASE WHEN event_id % 5 = 0 THEN 'text/html' ELSE ' Application/JSON; charset=utf-8' END AS kind, event_id % 7 AS b FROM {events}"


@query("WITH c AS (" + plain(_HTTP) + """), k AS (SELECT *, CASE WHEN status = 200 AND kind = 'text/html' THEN 'response_invalid' WHEN status = 200 THEN NULL WHEN status = 400 THEN 'invalid_request' WHEN status = 403 THEN 'unauthorized' WHEN status = 429 THEN 'rate_limited' WHEN status = 502 THEN 'unavailable' ELSE 'http_error' END AS code FROM c)
SELECT event_id, CASE WHEN status = 404 OR b < 3 THEN 'no_approved_capacity' WHEN code IS NOT NULL THEN 'model_' || code END AS model, 'search_' || code AS search, 'company_data_' || code AS company, coalesce(status = 404 OR b < 3 OR status IN (429, 502), false) AND (code IS NOT NULL OR b < 3) AS again FROM k""")
def provider_failures(spark, d):
    c = F.col
    said = "No endpoints found matching your data policy (x)"
    body = F.when(c("b") == 0, f'{{"message":"{said}"}}').when(c("b") == 1, f'{{"error":{{"message":"{said}"}}}}').when(c("b") == 2, f'{{"error":"{said}"}}').when(c("b") == 3, f'{{"error":["{said}"]}}').when(c("b") == 4, "not json").otherwise("{}")
    of = lambda kind, b=None: M.http_failure(c("status"), c("kind"), kind, b)
    return carried(spark, d, _HTTP).select("event_id", of("model", body)["code"].alias("model"), of("search")["code"].alias("search"), of("company_data")["code"].alias("company"), F.coalesce(of("model", body)["retryable"], F.lit(False)).alias("again"))


_TRIED = "SELECT o_custkey AS call_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, o_orderkey % 3 = 0 AS ok, o_orderkey % 4 <> 1 AS retryable, 'code' || (o_orderkey % 5) AS code FROM {orders}"


@query("WITH t AS (" + plain(_TRIED) + "), s AS (SELECT call_id, coalesce(min(ord) FILTER (ok OR NOT retryable OR ord >= 2), max(ord)) AS calls FROM t GROUP BY 1) SELECT call_id, calls, ok, CASE WHEN NOT ok THEN code END AS code FROM t JOIN s USING (call_id) WHERE ord = calls")
def bounded_retries(spark, d):
    return M.first_success(carried(spark, d, _TRIED), "call_id").withColumn("calls", F.col("calls").cast("long"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' WHEN 2 THEN 'frontier' END AS tier, CASE c_custkey % 4 WHEN 0 THEN 'm-low' WHEN 1 THEN 'm-mid' END AS model, CASE c_custkey % 4 WHEN 2 THEN 'model_route_missing' WHEN 3 THEN 'model_task_unrouted' END AS code, CASE c_custkey % 4 WHEN 0 THEN least(c_custkey, 50) ELSE c_custkey END AS most FROM customer""")
def model_routes(spark, d):
    tiers = spark.createDataFrame([("t0", "low"), ("t1", "mid"), ("t2", "frontier")], "task string, tier string")
    routes = spark.createDataFrame([("low", "m-low"), ("mid", "m-mid")], "tier string, model string")
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit("t"), F.col("c_custkey") % 4).alias("task"))
    limit = M.most_output(F.col("c_custkey"), F.when(F.col("task") == "t0", F.lit(50).cast("bigint")))
    return M.routed(rows, tiers, routes).select("c_custkey", "tier", "model", "code", limit.alias("most"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'schema_invalid' ELSE array_to_string(list_transform(range(0, least(c_custkey % 4 * 5, 10)), lambda i: CASE WHEN i % 3 = 0 THEN 'root' ELSE 'a.' || i END || ':' || CASE WHEN i % 2 = 0 THEN 'missing' ELSE 'invalid' END), ';') END AS summary FROM customer")
def validation_summaries(spark, d):
    i = F.sequence(F.lit(0), F.lit(30))
    one = lambda k: F.struct(F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), k.cast("string"))).alias("loc"), F.when(k % 2 == 0, "missing").alias("type"))
    errors = F.slice(F.transform(i, one), F.lit(1), (F.col("c_custkey") % 4 * 5).cast("int"))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", M.validation_summary(errors).alias("summary"))
