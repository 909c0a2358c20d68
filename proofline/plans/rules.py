"""Queries of the rules, over rows derived from all customers, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import matching as M
from proofline.operators import rules as R
from proofline.operators.records import STAGES
from proofline.operators.scoring import WEIGHTS
from proofline.plans.common import Registry, carried, plain

query = Registry()


def broken(carrier: str, key: str, rules: dict[str, str]) -> str:
    """SQL of the violations of named conditions; one that is null isn't broken."""
    cases = ", ".join(f"CASE WHEN NOT ({ok}) THEN '{name}' END" for name, ok in rules.items())
    return f"WITH c AS ({plain(carrier)}) SELECT {key}, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS rule FROM c"


_CIN = "regexp_full_match({0}, '[UL][0-9]{{5}}[A-Z]{{2}}[0-9]{{4}}[A-Z]{{3}}[0-9]{{6}}')"
_INTAKE = """SELECT k, CASE k % 3 WHEN 0 THEN 'website' WHEN 1 THEN 'legal_name' ELSE NULL END AS input_kind, CASE WHEN k % 4 < 2 THEN CASE WHEN k % 8 = 0 THEN '' ELSE 'https://x' || k END END AS input_url, CASE WHEN k % 5 < 2 THEN CASE WHEN k % 10 = 0 THEN '' ELSE name END END AS input_legal_name,
  CASE k % 6 WHEN 0 THEN 'U12345MH2001PTC123456' WHEN 1 THEN 'u12345mh2001ptc123456' WHEN 2 THEN 'xU12345MH2001PTC123456' END AS input_cin, CASE WHEN k % 7 = 0 THEN '' WHEN k % 7 = 1 THEN repeat('x', 101) WHEN k % 7 = 2 THEN 'sale' END AS category,
  CASE k % 4 WHEN 0 THEN 'abc!' WHEN 1 THEN 'has space' WHEN 2 THEN '' END AS idempotency_key, name AS full_name, CASE k % 5 WHEN 0 THEN 'in' WHEN 1 THEN 'IND' ELSE 'US' END AS country, CASE k % 4 WHEN 0 THEN 'owner' ELSE 'partner' END AS role,
  CASE k % 6 WHEN 0 THEN '+12345678' WHEN 1 THEN '12345678' WHEN 2 THEN '+02345678' END AS phone, CASE WHEN k % 4 = 1 THEN k END AS phone_verified_at FROM (SELECT c_custkey AS k, c_name AS name FROM {customer})"""


@query(broken(_INTAKE, "k", {
    "exactly_one_input": "coalesce(input_kind = 'website' AND input_url IS NOT NULL AND input_legal_name IS NULL, false) OR coalesce(input_kind = 'legal_name' AND input_url IS NULL AND input_legal_name IS NOT NULL, false)",
    "input_url_bounded": "length(input_url) BETWEEN 1 AND 2048", "input_legal_name_bounded": "length(input_legal_name) BETWEEN 1 AND 300", "input_cin": _CIN.format("input_cin"), "category_bounded": "length(category) BETWEEN 1 AND 100",
    "idempotency_key": "regexp_full_match(idempotency_key, '[!-~]{1,128}')", "full_name_bounded": "length(full_name) BETWEEN 1 AND 200", "country": "regexp_full_match(country, '[A-Z]{2}')", "role": "role IN ('partner', 'associate', 'other')",
    "phone": "regexp_full_match(phone, '\\+[1-9][0-9]{7,14}')", "phone_verified": "phone_verified_at IS NULL OR phone IS NOT NULL",
}))
def intake_violations(spark, d):
    return M.violations(carried(spark, d, _INTAKE), ["k"], R.intake_rules())


_CLAIM = """SELECT k, CASE WHEN k % 9 = 0 THEN '' ELSE 's' END AS subject, CASE WHEN k % 8 = 0 THEN repeat('p', 201) ELSE 'p' END AS predicate, CASE WHEN k % 7 = 0 THEN repeat('o', 2001) ELSE 'o' END AS object, CASE WHEN k % 6 = 0 THEN repeat('t', 201) END AS period,
  CASE k % 5 WHEN 0 THEN '' ELSE 'intro' END AS section, CASE k % 4 WHEN 0 THEN 'v 1' ELSE 'v1.0-b' END AS version, k % 2 = 0 AS is_material, k % 3 AS ids FROM (SELECT o_orderkey AS k FROM {orders})"""


@query(broken(_CLAIM, "k", {
    "subject_bounded": "length(subject) BETWEEN 1 AND 500", "predicate_bounded": "length(predicate) <= 200", "object_bounded": "length(object) <= 2000", "period_bounded": "length(period) <= 200", "sections": "section <> ''",
    "prompt_version": "regexp_full_match(version, '[A-Za-z0-9.-]{1,100}')", "material_evidence": "NOT is_material OR ids > 0", "evidence_ids_unique": "ids <> 2",
}))
def claim_violations(spark, d):
    ids = F.when(F.col("ids") == 0, F.array().cast("array<bigint>")).when(F.col("ids") == 1, F.array("k")).otherwise(F.array("k", "k"))
    rows = carried(spark, d, _CLAIM).withColumns({"evidence_ids": ids, "sections": F.array("section")})
    return M.violations(rows, ["k"], R.claim_rules())


_DRAFT = """SELECT k, CASE k % 4 WHEN 0 THEN 'research_competitors' WHEN 1 THEN 'research_regulatory' WHEN 2 THEN 'research_public_risk' ELSE 'research_business' END AS stage, k % 3 <> 0 AS is_material, CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN 'why' END AS rationale, CASE WHEN k % 2 = 0 THEN 'price' END AS basis,
  CASE WHEN k % 7 < 3 THEN 'ask' END AS question, CASE WHEN k % 11 < 8 THEN 'open' END AS proceeding, CASE k % 6 WHEN 0 THEN 'cin' WHEN 2 THEN 'rumour' WHEN 4 THEN NULL ELSE 'director' END AS base, CASE k % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'recent' ELSE 'stale' END AS freshness,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '2019-20' WHEN 2 THEN '2024-25' ELSE '2023-24' END AS period, CASE WHEN k % 2 = 0 THEN '2020' END AS since FROM (SELECT o_orderkey AS k FROM {orders})"""


@query(broken(_DRAFT, "k", {
    "research_competitor_basis_missing": "NOT (stage = 'research_competitors' AND is_material) OR coalesce(rationale, '') <> '' AND coalesce(basis, '') <> ''",
    "research_regulatory_confirmation_missing": "NOT (stage = 'research_regulatory' AND is_material) OR question IS NOT NULL",
    "research_public_risk_match_basis_missing": "NOT (stage = 'research_public_risk' AND is_material) OR proceeding IS NOT NULL AND base IS NOT NULL",
    "research_public_risk_identifier_match_weak": "NOT (stage = 'research_public_risk' AND is_material AND proceeding IS NOT NULL AND base IS NOT NULL) OR base IN ('cin', 'director')",
    "research_current_claim_period_missing": "period IS NOT NULL OR NOT (is_material AND freshness IN ('current', 'recent'))",
    "research_dynamic_period_outside_window": "period IS NULL OR freshness = 'stale' OR period IN ('2023-24', '2024-25')",
    "research_historical_period_before_incorporation": "period IS NULL OR since IS NULL OR period >= since",
}))
def draft_violations(spark, d):
    base = F.when(F.col("base").isNotNull(), F.array("base")).otherwise(F.array().cast("array<string>"))
    rows = carried(spark, d, _DRAFT).withColumns({"match_basis": base, "periods": F.array(F.lit("2023-24"), F.lit("2024-25"))})
    return M.violations(rows, ["k"], R.draft_rules())


_SCOPE = "SELECT c_custkey AS k, c_custkey % 7 AS entity_id, c_custkey % 5 AS a, c_custkey % 3 AS b, c_custkey % 4 AS n FROM {customer}"


@query(broken(_SCOPE, "k", {
    "related_at_most_two": "n <= 2", "related_unique": "NOT (n = 2 AND a = b OR n = 3 AND (a = b OR a = 9 OR b = 9))", "related_excludes_primary": "NOT (n >= 1 AND a = entity_id OR n >= 2 AND b = entity_id)",
    "signals_unique": "a <> n", "result_within_evidence": "n IN (a, b)",
}))
def scope_violations(spark, d):
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    related = F.slice(F.array(a, b, F.lit(9).cast("bigint")), F.lit(1), n.cast("int"))
    rows = carried(spark, d, _SCOPE).withColumns({"related_ids": related, "signals": F.array(a, n), "result_ids": F.array(n), "evidence_ids": F.array(a, b)})
    return M.violations(rows, ["k"], R.scope_rules())


_STORED = """SELECT k, 'id' || k AS id, 'e' || k AS entity_id, CAST(k % 101 AS INT) AS score, CASE WHEN k % 2 = 0 THEN 'ambiguous' ELSE 'strong_match' END AS label, CAST(k % 23 AS INT) AS rank FROM (SELECT c_custkey AS k FROM {customer})"""


@query(broken(_STORED, "k", {
    "payload_identity": "k % 6 = 0 AND k % 5 = 0", "payload_score": "(k % 4 <> 0 OR score = 7) AND label = 'ambiguous'", "audit_alignment": "k % 3 = 0 AND k % 2 = 0 AND k % 8 <> 0", "rank_bounded": "rank BETWEEN 1 AND 20",
}))
def stored_candidate_violations(spark, d):
    k, text = F.col("k"), lambda lead, c: F.concat(F.lit(lead), c.cast("string"))
    payload = F.to_json(F.struct(
        (k % 6 + 1).alias("schemaVersion"), text("id", k).alias("candidateId"), text("e", k - k % 5).alias("entityId"), F.when(k % 4 == 0, 7).otherwise(k % 101).alias("confidenceScore"),
        F.lit("ambiguous").alias("confidenceLabel"), F.array().cast("array<string>").alias("conflicts"),
    ))
    audit = F.struct(text("id", k - k % 3).alias("candidateId"), text("entity-confidence-v", k % 2 + 1).alias("scoringVersion"), (k % 101).alias("finalScore"), F.when(k % 8 == 0, "x").alias("decisions"))
    audit = F.when(k % 8 == 0, F.to_json(audit)).otherwise(F.to_json(F.struct("candidateId", "scoringVersion", "finalScore", F.array().cast("array<string>").alias("decisions"))))
    rows = carried(spark, d, _STORED).withColumns({"conflicts": F.lit("[]"), "candidateId": text("id", k - k % 3), "scoringVersion": text("entity-confidence-v", k % 2 + 1), "finalScore": k % 101})
    return M.violations(rows.withColumns({"payload": payload, "audit": audit}), ["k"], R.candidate_rules())


_SIGNAL = """SELECT k, CASE k % 3 WHEN 0 THEN 'official_domain_link' WHEN 1 THEN 'credible_corroboration' ELSE 'incompatible_business' END AS kind, k % 7 AS tier, CASE WHEN k % 2 = 0 THEN 'x' END AS cin, CASE WHEN k % 5 = 0 THEN 'n' END AS name, k % 4 AS n, CASE WHEN k % 6 = 0 THEN 'r' END AS reason FROM (SELECT c_custkey AS k FROM {customer})"""


@query(broken(_SIGNAL, "k", {
    "signal_identifies_candidate": "cin IS NOT NULL OR name IS NOT NULL", "official_signal_tier": "kind <> 'official_domain_link' OR tier = 1", "corroboration_tier": "kind <> 'credible_corroboration' OR tier <= 3",
    "tier_bounded": "tier BETWEEN 1 AND 5", "hint_adds_something": "n > 0 OR reason IS NOT NULL",
}))
def signal_violations(spark, d):
    rows = carried(spark, d, _SIGNAL).withColumn("brands", F.when(F.col("n") > 0, F.array("n")))
    return M.violations(rows, ["k"], R.signal_rules())


_FACTORS = "SELECT c_custkey AS k, c_custkey % 12 AS f, c_custkey % 2 = 0 AS applied, CAST(CASE WHEN c_custkey % 5 = 0 THEN 35 WHEN c_custkey % 5 = 1 THEN -15 ELSE 0 END AS INT) AS adjustment FROM {customer}"


@query("WITH c AS (" + plain(_FACTORS) + f") SELECT k, f, applied, adjustment FROM c WHERE f = 11 OR adjustment <> CASE WHEN applied THEN ({list(WEIGHTS.values())})[f::INT + 1] ELSE 0 END")
def adjustment_violations(spark, d):
    name = F.try_element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("f") + 1).cast("int"))
    return R.adjustment_errors(carried(spark, d, _FACTORS).withColumn("factor", name)).select("k", "f", "applied", "adjustment")


_RANKED = "SELECT c_nationkey AS request_id, c_custkey AS rank, 'c' || c_custkey AS candidate_id, c_custkey % 50 AS score FROM {customer} WHERE c_custkey % 9 <> 0"
_AUDITS = "SELECT c_nationkey AS request_id, c_custkey AS rank, 'c' || (c_custkey - CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END) AS candidate_id, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE c_custkey % 50 END AS score FROM {customer} WHERE c_custkey % 8 <> 0"


@query("WITH a AS (" + plain(_RANKED) + "), b AS (" + plain(_AUDITS) + ") SELECT request_id, rank FROM a FULL JOIN b USING (request_id, rank) WHERE NOT (a.candidate_id IS NOT DISTINCT FROM b.candidate_id AND a.score IS NOT DISTINCT FROM b.score)")
def audit_alignment(spark, d):
    return R.misaligned(carried(spark, d, _RANKED), carried(spark, d, _AUDITS))


@query("SELECT 'selected' AS rule, o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'rank', l_orderkey * 10 + l_linenumber, count(*) FROM lineitem GROUP BY 2 HAVING count(*) > 1")
def unique_index_violations(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    selected = R.repeated(t("orders").withColumn("k", F.col("o_custkey")), ["k"], F.col("o_orderstatus") == "F").withColumn("rule", F.lit("selected"))
    lines = R.repeated(t("lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")), ["k"]).withColumn("rule", F.lit("rank"))
    return selected.unionByName(lines)


_DECISION = """SELECT k, CASE k % 5 WHEN 0 THEN 'confirm' WHEN 1 THEN 'none_of_these' WHEN 2 THEN 'refine' WHEN 3 THEN 'confirm' ELSE CASE WHEN k % 10 = 4 THEN 'delete' END END AS action, CASE WHEN k % 3 = 0 THEN 'c' || k END AS candidate, k % 2 AS related,
  CASE WHEN k % 7 = 0 THEN '  ' WHEN k % 7 < 3 THEN 'Acme' END AS name, CASE WHEN k % 11 = 0 THEN 'bad' WHEN k % 11 < 3 THEN ' u12345mh2001ptc123456' END AS cin, CASE WHEN k % 13 = 0 THEN repeat('s', 101) END AS state FROM (SELECT o_orderkey AS k FROM {orders})"""


@query("WITH c AS (" + plain(_DECISION) + """) SELECT k, CASE WHEN action IS NULL OR action = 'delete' THEN 'INVALID_CONFIRMATION_ACTION' WHEN cin = 'bad' THEN 'INVALID_CIN_HINT' WHEN trim(name) = '' THEN 'INVALID_LEGAL_NAME_HINT' WHEN state IS NOT NULL THEN 'INVALID_STATE_HINT'
WHEN action = 'confirm' AND (candidate IS NULL OR name IS NOT NULL OR cin IS NOT NULL) OR action = 'none_of_these' AND (candidate IS NOT NULL OR related = 1 OR name IS NOT NULL OR cin IS NOT NULL) OR action = 'refine' AND (candidate IS NOT NULL OR related = 1 OR name IS NULL AND cin IS NULL) THEN 'INVALID_CONFIRMATION_PAYLOAD' END AS code FROM c""")
def decision_codes(spark, d):
    c = F.col
    related = F.when(c("related") == 1, F.array("k")).otherwise(F.array().cast("array<bigint>"))
    return carried(spark, d, _DECISION).select("k", R.decision_code(c("action"), c("candidate"), related, c("name"), c("cin"), c("state")).alias("code"))


_COMPLETED = "SELECT k, k % 24 AS n, k % 23 AS m, k % 10 AS q, k % 5 = 0 AS other FROM (SELECT o_orderkey AS k FROM {orders})"


@query(broken(_COMPLETED, "k", {"candidates_and_audits": "n = m AND n <= 20", "clarification_set": "q BETWEEN 1 AND 8 AND NOT other", "preliminary_evidence": "n <= 20"}))
def completion_violations(spark, d):
    c = F.col
    items = lambda n: F.to_json(F.slice(F.sequence(F.lit(1), F.lit(30)), F.lit(1), n.cast("int")))
    questions = F.concat(F.lit('{"questions":'), items(c("q")), F.lit(',"reportRequestId":"'), c("k"), F.lit('","entityId":"'), F.when(c("other"), -1).otherwise(c("k")), F.lit('"}'))
    rows = carried(spark, d, _COMPLETED).select("k", c("k").alias("request_id"), c("k").alias("entity_id"), items(c("n")).alias("candidates"), items(c("m")).alias("audits"), questions.alias("clarifications"), items(c("n")).alias("preliminary"))
    return M.violations(rows, ["k"], R.completion_rules())


_FILING = """SELECT k, CASE WHEN k % 5 = 0 THEN 'a b' ELSE 'doc:' || k END AS document_id, CASE WHEN k % 6 = 0 THEN 'Fixture' ELSE 'fixture' END AS provider, CASE WHEN k % 7 = 0 THEN 'x?Token=1' ELSE 'vault/' || k END AS locator, CASE k % 4 WHEN 0 THEN '2023' WHEN 1 THEN NULL ELSE '2023-24' END AS year,
  CASE WHEN k % 9 = 0 THEN 'text/html' ELSE 'application/pdf' END AS media_type, CASE WHEN k % 8 = 0 THEN repeat('A', 64) ELSE repeat('a', 64) END AS sha256, (k % 4) * 13000000 AS size, CASE WHEN k % 2 = 0 THEN 'ready' ELSE 'unavailable' END AS status, k % 3 AS documents,
  CASE WHEN k % 5 < 2 THEN 'no_matching_documents' END AS action, k % 11 AS other, k % 10 AS foreign_ones FROM (SELECT o_orderkey AS k FROM {orders})"""


@query(broken(_FILING, "k", {
    "document_id": "document_id <> 'a b'", "source_provider": "provider = 'fixture'", "locator_credentials": "NOT contains(lower(locator), 'token=')", "financial_year": "year = '2023-24'", "media_type": "media_type = 'application/pdf'", "sha256": "k % 8 <> 0",
    "size_bounded": "size BETWEEN 1 AND 26214400", "ready_shape": "status <> 'ready' OR documents > 0 AND action IS NULL", "other_shape": "status = 'ready' OR documents = 0 AND action IS NOT NULL", "same_company": "foreign_ones <> 0 OR false",
    "years_valid": "other <> 3", "years_unique": "other NOT IN (2, 3)", "types_unique": "other <> 1",
}))
def filing_violations(spark, d):
    o = F.col("other")
    years = F.when(o == 2, F.array(F.lit("2023-24"), F.lit(" 2023-24"))).when(o == 3, F.array(F.lit("2023"), F.lit("2023 "))).otherwise(F.array(F.lit("2022-23"), F.lit("2023-24")))
    types = F.when(o == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    rows = carried(spark, d, _FILING).withColumns({"years": years, "types": types, "foreign": F.when(F.col("foreign_ones") == 0, 1).otherwise(0)})
    return M.violations(rows, ["k"], R.filing_rules())


_SAFETY = """SELECT k, CASE k % 3 WHEN 0 THEN 'infected' ELSE 'clean' END AS verdict, CASE WHEN k % 2 = 0 THEN 'Eicar' END AS threat, 'https://x/' || (k % 4) AS final_url, k % 5 AS hops, CASE WHEN k % 6 = 0 THEN 'http://x/a' ELSE 'https://x/a' END AS canonical, k % 7 = 0 AS admitted, k % 8 AS digest FROM (SELECT o_orderkey AS k FROM {orders})"""


@query(broken(_SAFETY, "k", {
    "verdict_shape": "(verdict = 'infected') = (threat IS NOT NULL)", "redirect_tail": "hops = 0 OR final_url = 'https://x/' || hops", "scheme_preserved": "starts_with(canonical, 'https')", "not_admitted": "NOT admitted", "digests": "digest <> 0", "digests_disjoint": "digest <> 1",
}))
def safety_violations(spark, d):
    c = F.col
    good, other = F.lit("a" * 64), F.lit("b" * 64)
    chain = F.transform(F.slice(F.sequence(F.lit(1), F.lit(5)), F.lit(1), c("hops").cast("int")), lambda i: F.concat(F.lit("https://x/"), i.cast("string")))
    rows = carried(spark, d, _SAFETY).withColumns({"chain": chain, "url": F.lit("HTTPS://x/a"), "clean": F.array(F.when(c("digest") == 0, "zz").otherwise(good)), "infected": F.array(F.when(c("digest") == 1, good).otherwise(other))})
    return M.violations(rows, ["k"], R.safety_rules())


def _task(spark, d):
    k = F.col("event_id")
    id_ = lambda n: F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad((k + n).cast("string"), 12, "0"))
    pairs = [
        ("schemaVersion", F.when(k % 9 == 0, "2").otherwise("1")), ("taskId", F.concat(F.lit('"'), F.when(k % 8 == 0, "x").otherwise(id_(0)), F.lit('"'))), ("taskType", F.when(k % 7 == 0, '"other"').otherwise('"render_pdf"')),
        ("reportRequestId", F.concat(F.lit('"'), id_(1), F.lit('"'))), ("userId", F.concat(F.lit('"'), id_(2), F.lit('"'))), ("attempt", (k % 103).cast("string")), ("traceId", F.when(k % 6 == 0, '"short"').otherwise('"trace-0001"')),
    ]
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), v) for name, v in pairs], F.when(k % 5 == 0, '"extra":1'))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.when(k % 11 == 0, "not json").otherwise(F.concat(F.lit("{"), body, F.lit("}"))).alias("payload"))


@query("SELECT event_id, event_id % 11 <> 0 AND event_id % 9 <> 0 AND event_id % 8 <> 0 AND event_id % 7 <> 0 AND event_id % 6 <> 0 AND event_id % 5 <> 0 AND event_id % 103 BETWEEN 1 AND 100 AS valid FROM events")
def task_payloads(spark, d):
    return _task(spark, d).select("event_id", R.task_payload_valid(F.col("payload")).alias("valid"))


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN false WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS valid FROM events")
def identifier_payloads(spark, d):
    k = F.col("event_id") % 8
    good, cin = '"addresses":["x"],"legalNames":["Acme"]', '"U12345MH2001PTC123456"'
    cases = {0: f'{{{good},"cins":["bad"]}}', 1: f"{{{good}}}", 2: f'{{{good},"cins":[],"more":1}}', 3: f'{{{good},"cins":{cin}}}', 4: '{"addresses":[""],"cins":[],"legalNames":[]}', 5: f'{{{good},"cins":[{cin}]}}', 6: f'{{"cins":[],{good}}}'}
    payload = F.lit('{"legalNames":[],"cins":[],"addresses":[]}')
    for n, text in cases.items():
        payload = F.when(k == n, text).otherwise(payload)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", R.identifiers_valid(payload).alias("valid"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'missing_keys' WHEN 1 THEN 'as_of_not_a_date' WHEN 2 THEN 'entity_hint_not_an_object' WHEN 3 THEN 'focus_topics_empty' WHEN 4 THEN 'as_of_not_a_date' END AS code FROM events")
def golden_inputs(spark, d):
    k = F.col("event_id") % 6
    body = '{"submittedUrl":"u","asOf":"%s","entityHint":%s,"focusTopics":%s}'
    cases = {0: '{"submittedUrl":"u"}', 1: body % ("2024-13-01", "{}", "[1]"), 2: body % ("2024-01-01", "[]", "[1]"), 3: body % ("2024-01-01", "{}", "[]"), 4: body % ("1 Jan", "{}", "[1]")}
    inputs = F.lit(body % ("2024-02-29", "{}", '["a"]'))
    for n, text in cases.items():
        inputs = F.when(k == n, text).otherwise(inputs)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", R.golden_inputs_code(inputs).alias("code"))


_QUESTIONS = "SELECT user_id AS set_id, CASE WHEN event_type = 'view' THEN 'client_role' ELSE 'cross_border' END AS code, event_type = 'view' AND value > 5 AS mandatory, value < 150 AS safe, event_type || ' of ' || CASE WHEN event_id % 97 = 0 THEN 'your PASSWORD' ELSE 'role' END AS prompt, 'why' AS reason FROM {events}"


@query("WITH c AS (" + plain(_QUESTIONS) + """), g AS (SELECT set_id, bool_or(mandatory AND code = 'client_role') AS r, bool_and(safe) AS s, bool_or(contains(lower(prompt), 'password')) AS p FROM c GROUP BY 1)
SELECT set_id, unnest(list_filter([CASE WHEN NOT r THEN 'mandatory_client_role_question_missing' END, CASE WHEN NOT s THEN 'clarification_question_not_confidentiality_safe' END, CASE WHEN p THEN 'clarification_question_contains_sensitive_request' END], lambda x: x IS NOT NULL)) AS rule FROM g""")
def question_safety(spark, d):
    return R.unsafe_questions(carried(spark, d, _QUESTIONS))


_FINDINGS = "SELECT o_orderkey AS finding_id, o_custkey AS job_id, o_custkey % 9 AS entity_id FROM {orders}"
_FOUND = "SELECT l_orderkey AS finding_id, l_linenumber AS claim_id, o_custkey + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS job_id, o_custkey % 9 AS entity_id, l_partkey % 20 AS evidence_id FROM {lineitem} AS l JOIN {orders} AS o ON l_orderkey = o_orderkey"
_NOTES = "SELECT l_orderkey AS finding_id, CAST(l_linenumber + CASE WHEN l_suppkey % 3 = 0 THEN 20 ELSE 0 END AS INT) AS claim_id, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 't' END AS topic, (l_partkey + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END) % 20 AS evidence_id FROM {lineitem}"


@query("WITH f AS (" + plain(_FINDINGS) + "), c AS (" + plain(_FOUND) + "), n AS (" + plain(_NOTES) + """)
SELECT DISTINCT finding_id, 'coverage_evidence_unknown' AS rule FROM n WHERE topic = '' OR NOT EXISTS (SELECT 1 FROM c WHERE c.finding_id = n.finding_id AND c.evidence_id = n.evidence_id)
UNION SELECT c.finding_id, 'claim_scope' FROM c JOIN f USING (finding_id) WHERE c.job_id <> f.job_id OR c.entity_id <> f.entity_id UNION SELECT finding_id, 'claim_ids_not_unique' FROM c GROUP BY finding_id, claim_id HAVING count(*) > 1
UNION SELECT n.finding_id, 'note_claim_unknown' FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.finding_id = n.finding_id AND c.claim_id = n.claim_id) UNION SELECT finding_id, 'note_ids_not_unique' FROM n GROUP BY finding_id, claim_id HAVING count(*) > 1""")
def finding_violations(spark, d):
    claims, notes = carried(spark, d, _FOUND).withColumn("evidence_ids", F.array("evidence_id")), carried(spark, d, _NOTES)
    return R.finding_errors(carried(spark, d, _FINDINGS), claims, notes.select("finding_id", "claim_id"), notes.select("finding_id", "topic", "evidence_id"))


@query("SELECT 'own' AS kind, o_orderkey AS k, false AS is_admin FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'child', l_orderkey, false FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7) UNION ALL SELECT 'admin', o_orderkey, coalesce(c_nationkey < 5 AND c_acctbal >= 0, false) FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 20")
def tenancy(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    orders = t("orders").withColumn("user_id", F.col("o_custkey"))
    profiles = t("customer").select((F.col("c_custkey") - 20).alias("user_id"), (F.col("c_nationkey") < 5).alias("is_admin"), F.when(F.col("c_acctbal") < 0, 1).alias("deleted_at"))
    shown = lambda kind, key, df: df.select(F.lit(kind).alias("kind"), F.col(key).alias("k"), "is_admin")
    own = R.own_rows(orders, F.lit(7)).withColumn("is_admin", F.lit(False))
    child = R.own_rows(t("lineitem").withColumn("o_orderkey", F.col("l_orderkey")), F.lit(7), orders, "o_orderkey").withColumn("is_admin", F.lit(False))
    return shown("own", "o_orderkey", own).unionByName(shown("child", "l_orderkey", child)).unionByName(shown("admin", "o_orderkey", R.with_admins(orders, profiles)))


_PLANS = "SELECT user_id AS plan_id, event_id AS ord, CASE event_type WHEN 'view' THEN 'plan' WHEN 'click' THEN 'verify_contradictions' WHEN 'signup' THEN 'deliver' WHEN 'purchase' THEN 'compose_brief' ELSE 'unknown' END AS stage FROM {events}"


@query("WITH c AS (" + plain(_PLANS) + f"), p AS (SELECT *, coalesce(list_position({list(STAGES)}, stage), 0) AS p FROM c), b AS (SELECT *, lag(p) OVER (PARTITION BY plan_id ORDER BY ord) AS before FROM p) SELECT plan_id, ord, stage, CASE WHEN p = 0 THEN 'stage_unknown' ELSE 'stage_out_of_order' END AS rule FROM b WHERE p = 0 OR before >= p")
def stage_plans(spark, d):
    return R.stage_order_errors(carried(spark, d, _PLANS), STAGES)
