"""Queries of the evidence operators over the driver's tables, each with SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import text, urls
from proofline.operators import claims as C
from proofline.operators import records as R
from proofline.operators import scoring as S
from proofline.plans.common import carried, plain

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


_CLAIMS = """
WITH c AS (
  SELECT o_orderkey % 97 AS job_id, o_orderkey AS claim_id, o_orderkey AS ord, 'Part ' || (o_custkey % 10) AS subject, o_orderstatus AS predicate,
         CASE WHEN o_orderkey % 3 = 0 THEN '2023/24' ELSE '2023-24' END AS period, 'n ' || (floor(o_totalprice)::BIGINT % 5) AS object,
         [o_orderkey % 50, o_custkey % 60] AS evidence_ids, o_orderkey % 2 = 0 AS is_material, CASE WHEN o_custkey % 11 = 0 THEN 'stale' ELSE 'current' END AS freshness
  FROM orders),
e AS (SELECT j.job_id, s.i AS evidence_id, (s.i % 5 + 1)::INT AS source_tier, 20200000 + (s.i * 37 + j.job_id) % 1000 AS published, s.i % 13 = 0 AS suspected
      FROM (SELECT unnest(range(0, 97)) AS job_id) j, (SELECT unnest(range(0, 55)) AS i) s),
x AS (SELECT c.job_id, c.claim_id, count(*) FILTER (u.id IS NOT NULL AND e.evidence_id IS NULL) AS n_unknown, count(e.evidence_id) AS n_known,
        count(*) FILTER (e.suspected) AS n_suspected, count(*) FILTER (e.source_tier >= 4) AS n_weak, coalesce(min(e.source_tier), 5) AS strongest, max(e.published) AS latest
      FROM c, LATERAL (SELECT unnest(c.evidence_ids) AS id) u LEFT JOIN e ON e.job_id = c.job_id AND e.evidence_id = u.id GROUP BY 1, 2),
r AS (SELECT c.*, x.* EXCLUDE (job_id, claim_id), list_filter([
        CASE WHEN n_unknown > 0 THEN 'evidence_reference_unknown' END, CASE WHEN is_material AND len(evidence_ids) = 0 THEN 'material_claim_without_evidence' END,
        CASE WHEN freshness = 'stale' THEN 'claim_stale' END, CASE WHEN n_known > 0 AND n_suspected = n_known THEN 'all_supporting_evidence_prompt_suspected' END,
        CASE WHEN is_material AND n_known > 0 AND n_weak = n_known THEN 'material_claim_source_too_weak' END], lambda v: v IS NOT NULL) AS rs
      FROM c JOIN x USING (job_id, claim_id)),
d AS (SELECT *, replace(period, '/', '-') AS t, row_number() OVER (PARTITION BY job_id, subject, predicate, replace(period, '/', '-'), object ORDER BY ord) > 1 AS again FROM r),
s AS (SELECT *, CASE WHEN again THEN list_append(rs, 'duplicate_claim') ELSE rs END AS rs2,
        CASE WHEN again THEN 'rejected' WHEN len(rs) = 0 THEN 'approved' WHEN rs = ['material_claim_source_too_weak'] THEN 'pending' ELSE 'rejected' END AS st FROM d),
f AS (SELECT *, st <> 'rejected' AS live, st <> 'rejected' AND min(object) OVER w <> max(object) OVER w AS disputed, rank() OVER (w ORDER BY strongest, latest DESC NULLS LAST) AS place,
        min(strongest) OVER w AS best, max(strongest) OVER w AS worst FROM s WINDOW w AS (PARTITION BY job_id, subject, predicate, t, st <> 'rejected')),
g AS (SELECT *, CASE WHEN NOT disputed THEN NULL WHEN count(*) FILTER (place = 1) OVER w > 1 THEN 'disclose_as_conflict' WHEN best >= 5 THEN 'convert_to_question'
        WHEN worst <> best THEN 'prefer_stronger_source' ELSE 'prefer_later' END AS resolution FROM f WINDOW w AS (PARTITION BY job_id, subject, predicate, t, live)),
v AS (SELECT job_id, claim_id, evidence_ids, resolution,
        CASE WHEN resolution LIKE 'prefer%' AND place > 1 THEN 'rejected' WHEN resolution IS NOT NULL AND resolution NOT LIKE 'prefer%' THEN 'conflicted' ELSE st END AS status,
        array_to_string(list_concat(rs2, list_filter([CASE WHEN resolution LIKE 'prefer%' AND place > 1 THEN 'contradicted_by_preferred_claim' END,
          CASE WHEN resolution IS NOT NULL AND resolution NOT LIKE 'prefer%' THEN 'unresolved_contradiction' END,
          CASE WHEN resolution LIKE 'prefer%' AND len(rs2) = 0 THEN 'resolved_contradiction' END], lambda q: q IS NOT NULL)), ',') AS reasons FROM g)
"""


def _claims(spark, d):
    key, party = F.col("o_orderkey"), F.col("o_custkey")
    rows = _t(spark, d, "orders").select(
        (key % 97).alias("job_id"), key.alias("claim_id"), key.alias("ord"), F.concat(F.lit("Part "), party % 10).alias("subject"), F.col("o_orderstatus").alias("predicate"),
        F.when(key % 3 == 0, "2023/24").otherwise("2023-24").alias("period"), F.concat(F.lit("n "), F.floor("o_totalprice") % 5).alias("object"),
        F.array(key % 50, party % 60).alias("evidence_ids"), (key % 2 == 0).alias("is_material"), F.when(party % 11 == 0, "stale").otherwise("current").alias("freshness"),
    )
    jobs = spark.range(97).select(F.col("id").alias("job_id"), F.explode(F.sequence(F.lit(0), F.lit(54)).cast("array<bigint>")).alias("evidence_id"))
    i = F.col("evidence_id")
    evidence = jobs.select("job_id", "evidence_id", (i % 5 + 1).cast("int").alias("source_tier"), (20200000 + (i * 37 + F.col("job_id")) % 1000).alias("published"), (i % 13 == 0).alias("suspected"))
    return rows, evidence


@query(_CLAIMS + "SELECT job_id, claim_id, status, reasons, resolution FROM v")
def verify_claims(spark, d):
    return C.verify(*_claims(spark, d))


@query(_CLAIMS + """, t AS (SELECT job_id, i % 9 AS topic, i AS evidence_id FROM (SELECT unnest(range(0, 97)) AS job_id), (SELECT unnest(range(0, 60)) AS i)),
h AS (SELECT t.job_id, topic, max(CASE WHEN a.id IS NULL THEN 0 ELSE 1 END) AS hit FROM t LEFT JOIN
      (SELECT DISTINCT job_id, unnest(evidence_ids) AS id FROM v WHERE status = 'approved') a ON a.job_id = t.job_id AND a.id = t.evidence_id GROUP BY 1, 2)
SELECT job_id, sum(hit)::BIGINT AS covered, (count(*) - sum(hit))::BIGINT AS missing, round_even(sum(hit) * 100.0 / count(*), 0)::BIGINT AS coverage_percent FROM h GROUP BY 1""")
def topic_coverage(spark, d):
    claims, evidence = _claims(spark, d)
    topics = spark.range(97).select(F.col("id").alias("job_id"), F.explode(F.sequence(F.lit(0), F.lit(59)).cast("array<bigint>")).alias("evidence_id")).withColumn("topic", F.col("evidence_id") % 9)
    return C.coverage(topics, claims, C.verify(claims, evidence))


#: A lineitem is a candidate, with the facts that its values give.
_FACTS = "SELECT l_orderkey AS id, l_linenumber AS line, " + ", ".join(f"{said} AS {name}" for name, said in zip(S.WEIGHTS, (
    "l_quantity >= 25", "l_discount >= 0.05", "l_tax >= 0.04", "l_returnflag = 'A'", "l_linestatus = 'O'", "l_extendedprice >= 50000", "l_partkey % 2 = 0", "l_suppkey % 2 = 0", "l_linenumber % 2 = 1", "l_orderkey % 2 = 0", "l_partkey % 3 = 0"), strict=True)) + " FROM {lineitem}"
_SUM = lambda sign: " + ".join(f"CASE WHEN {n} THEN {w} ELSE 0 END" for n, w in S.WEIGHTS.items() if w * sign > 0)


@query(f"WITH b AS ({plain(_FACTS)}), s AS (SELECT id, line, {_SUM(1)} AS positive_total, {_SUM(-1)} AS negative_total FROM b) SELECT *, least(100, greatest(0, positive_total + negative_total)) AS score, CASE WHEN score >= 75 THEN 'strong_match' WHEN score >= 50 THEN 'probable_match' WHEN score >= 25 THEN 'ambiguous' ELSE 'insufficient_evidence' END AS label FROM s")
def candidate_scores(spark, d):
    return S.score(carried(spark, d, _FACTS)).select("id", "line", "positive_total", "negative_total", "score", "label")


@query("SELECT * FROM (SELECT c_nationkey AS request, c_custkey AS id, c_name AS name, (c_acctbal / 100)::INT AS score, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_acctbal / 100)::INT DESC, lower(c_name), c_custkey) AS rank FROM customer) WHERE rank <= 20")
def candidate_rank(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_nationkey").alias("request"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.bround(F.col("c_acctbal") / 100).cast("int").alias("score"))
    return S.ranked(rows, "request")


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(substr(text, 1, 60) || ' PVT. Ltd.'), '\bpvt\.?\b', 'private', 'g'), '\bltd\.?\b', 'limited', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def legal_name_keys(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.legal_name_key(F.concat(F.substring("text", 1, 60), F.lit(" PVT. Ltd."))).alias("key"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text || ' PVT. Ltd.'), '\bpvt\.?\b', 'private', 'g'), '\bltd\.?\b', 'limited', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def whole_name_keys(spark, d):
    """``legal_name_keys`` sees 60 characters of a document; this sees all."""
    return _t(spark, d, "documents").select("doc_id", text.legal_name_key(F.concat("text", F.lit(" PVT. Ltd."))).alias("key"))


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))), lambda v: v <> ''), chr(10)) AS lines FROM documents")
def normalised_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.normalised_lines(F.col("text")).alias("lines"))


@query("SELECT doc_id, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in text.INJECTION_PATTERNS) + " AS suspected, ceil(length(text) / 4)::BIGINT AS tokens FROM documents")
def injection_flags(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.prompt_injection(F.col("text")).alias("suspected"), text.estimated_tokens(F.col("text")).alias("tokens"))


@query("""SELECT page_id, '<untrusted_source id="' || page_id || '" url="' || replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '" tier="3" company_controlled="false" prompt_injection_suspected="true">' || replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</untrusted_source>' AS envelope FROM pages""")
def source_envelopes(spark, d):
    no, yes = F.lit(False), F.lit(True)
    return _t(spark, d, "pages").select("page_id", text.untrusted_envelope(F.col("page_id").cast("string"), F.col("url"), F.lit(3), no, yes, F.col("html")).alias("envelope"))


@query("WITH p AS (SELECT c_custkey, 'US' || lpad(c_custkey::VARCHAR, 9, '0') || (c_custkey % 10) AS code FROM customer), e AS (SELECT *, array_to_string(list_transform(string_split(code, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), '') AS s FROM p) SELECT c_custkey, code, list_sum(list_transform(range(1, length(s) + 1), lambda k: CASE WHEN k % 2 = 0 THEN (CASE WHEN s[length(s) + 1 - k]::INT > 4 THEN s[length(s) + 1 - k]::INT * 2 - 9 ELSE s[length(s) + 1 - k]::INT * 2 END) ELSE s[length(s) + 1 - k]::INT END)) % 10 = 0 AS valid FROM e")
def security_codes(spark, d):
    code = F.concat(F.lit("US"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.col("c_custkey") % 10)
    return _t(spark, d, "customer").select("c_custkey", code.alias("code"), text.isin_valid(code).alias("valid"))


@query("WITH h AS (SELECT c_custkey, c_name, sha1(unhex('c35295503ee85bc4966d4346ded3fa37') || encode(c_name)) AS s FROM customer) SELECT c_custkey, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || lower(printf('%x', (('0x' || substr(s, 17, 2))::INT & 63) | 128)) || substr(s, 19, 2) || '-' || substr(s, 21, 12) AS evidence_id FROM h")
def evidence_ids(spark, d):
    return _t(spark, d, "customer").select("c_custkey", text.uuid5("c3529550-3ee8-5bc4-966d-4346ded3fa37", F.col("c_name")).alias("evidence_id"))


@query("WITH u AS (SELECT page_id, split_part(url || '&utm_source=a&gclid=1', '#', 1) AS u FROM pages), q AS (SELECT page_id, split_part(u, '?', 1) AS h, list_filter(string_split(substr(u, length(split_part(u, '?', 1)) + 2), '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid') AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_')) AS k FROM u) SELECT page_id, CASE WHEN len(k) > 0 THEN h || '?' || array_to_string(k, '&') ELSE h END AS url FROM q")
def clean_urls(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.without_tracking(F.concat("url", F.lit("&utm_source=a&gclid=1"))).alias("url"))


_SURFACES = ["privacy", "terms", "contact-us", "consumer terms", "cookies", "annual-report", "imprint", "investors", "governance", "jobs", "about us", "nothing"]
_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{k}'" for k, p in urls.LINK_RULES) + " END"


@query(f"WITH p AS (SELECT page_id, replace(url, '/', ' ') || ' ' || {_SURFACES}[page_id % 12 + 1] AS s FROM pages), k AS (SELECT page_id, {_KIND_SQL} AS kind FROM p) SELECT page_id, kind, CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in urls.PRIORITIES.items()) + " END AS priority FROM k")
def link_kinds(spark, d):
    label = F.element_at(F.array(*map(F.lit, _SURFACES)), (F.col("page_id") % 12 + 1).cast("int"))
    kind = urls.link_kind(F.concat(F.replace("url", F.lit("/"), F.lit(" ")), F.lit(" "), label))
    return _t(spark, d, "pages").select("page_id", kind.alias("kind")).withColumn("priority", urls.link_priority(F.col("kind")))


_HOSTS, _KINDS = ["mca.gov.in", "x.gov", "sebi.gov.in", "a.example.com", "www.nic.in", "b.nic.in", "bseindia.com."], [None, "reputable_independent", "commercial_aggregator", "social_user_generated", "authoritative", "company_controlled"]
_KINDS_SQL = "[" + ", ".join("NULL" if k is None else f"'{k}'" for k in _KINDS) + "]"


@query(f"WITH p AS (SELECT page_id, rtrim({_HOSTS}[page_id % 7 + 1], '.') AS h, page_id % 4 = 0 AS c, {_KINDS_SQL}[page_id % 6 + 1] AS k FROM pages), l AS (SELECT *, h IN {tuple(urls.AUTHORITATIVE_HOSTS)} OR h LIKE '%.gov.in' OR h LIKE '%.nic.in' OR h LIKE '%.gov' AS listed FROM p)" + """
SELECT page_id, CASE WHEN listed THEN 1 WHEN c AND k IS NOT NULL AND k <> 'company_controlled' THEN NULL WHEN c THEN 2 WHEN k = 'reputable_independent' THEN 3 WHEN k = 'commercial_aggregator' THEN 4 WHEN k = 'social_user_generated' THEN 5 END AS tier,
CASE WHEN listed THEN 'authoritative_domain_allowlist' WHEN c AND k IS NOT NULL AND k <> 'company_controlled' THEN 'source_company_controlled_kind_conflict' WHEN c THEN 'company_controlled_source' WHEN k IS NULL THEN 'source_tier_unclassified' WHEN k = 'authoritative' THEN 'authoritative_domain_unverified' WHEN k = 'company_controlled' THEN 'company_controlled_source_unverified' ELSE 'adapter_declared_' || k END AS code FROM l""")
def source_tiers(spark, d):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % n + 1).cast("int"))
    tier = urls.source_tier(F.concat(F.lit("https://"), pick(_HOSTS, 7), F.lit("/p")), F.col("page_id") % 4 == 0, pick(_KINDS, 6))
    return _t(spark, d, "pages").select("page_id", tier.alias("t")).select("page_id", "t.tier", "t.code")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def first_events(spark, d):
    return R.keep_first(_t(spark, d, "events"), ["user_id", F.lower("event_type")], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, min(event_id) AS place, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def last_values(spark, d):
    return R.first_place_last_value(_t(spark, d, "events"), "user_id", "event_type", "event_id")


@query("WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders) SELECT o_custkey, arg_min(status, o_orderkey) FILTER (status IS NOT NULL) AS status, arg_min(priority, o_orderkey) FILTER (priority IS NOT NULL) AS priority FROM o GROUP BY 1")
def merged_records(spark, d):
    key = F.col("o_orderkey")
    rows = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(key % 3 != 0, F.col("o_orderstatus")).alias("status"), F.when(key % 2 != 0, F.col("o_orderpriority")).alias("priority"))
    return R.merged(rows, "o_custkey", "o_orderkey", ["status", "priority"])


@query("WITH a AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, upper(c_name) AS name, -c_acctbal AS bal FROM customer WHERE c_custkey % 2 = 0) SELECT 'cin:' || coalesce(b.k, a.k) AS identity_key, CASE WHEN b.k IS NOT NULL THEN b.name ELSE a.name END AS name, CASE WHEN b.k IS NOT NULL THEN b.bal ELSE a.bal END AS bal FROM a FULL OUTER JOIN b ON a.k = b.k")
def entity_upsert(spark, d):
    c = _t(spark, d, "customer").withColumn("identity_key", F.concat(F.lit("cin:"), F.col("c_custkey")))
    old = c.filter("c_custkey % 3 <> 0").select("identity_key", F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.filter("c_custkey % 2 = 0").select("identity_key", F.upper("c_name").alias("name"), (-F.col("c_acctbal")).alias("bal"))
    return R.upsert(old, new, "identity_key")


@query("SELECT 'cin:' || coalesce(c_custkey, s_suppkey) AS identity_key, CASE WHEN c_custkey IS NULL THEN s_name ELSE c_name END AS name FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey")
def whole_upsert(spark, d):
    """All customers upserted into all suppliers; ``entity_upsert`` takes its rows by residues of ids."""
    rows = lambda table, key, name: _t(spark, d, table).select(F.concat(F.lit("cin:"), key).alias("identity_key"), F.col(name).alias("name"))
    return R.upsert(rows("supplier", "s_suppkey", "s_name"), rows("customer", "c_custkey", "c_name"), "identity_key")


@query("SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN first_value(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 'replayed' ELSE 'conflict' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id)")
def replayed_commands(spark, d):
    rows = _t(spark, d, "events").withColumn("slot", F.col("event_id") % 5)
    return R.replay_outcome(rows, ["user_id", "slot"], "event_type", ["ts", "event_id"]).select("event_id", "outcome")


@query("SELECT event_id, count(*) OVER w AS in_hour, count(*) OVER w > 10 AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
def request_rates(spark, d):
    return R.trailing_hour(_t(spark, d, "events"), "user_id", "ts").select("event_id", "in_hour", "limited")


_STATES = list(R.TRANSITIONS)
_LEGAL = ", ".join(f"('{a}', '{b}')" for a, to in R.TRANSITIONS.items() for b in to.split())


@query(f"WITH s AS (SELECT user_id, event_id, ts, {_STATES}[event_id % 12 + 1] AS state FROM events), l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM s) SELECT event_id, from_state, state, (from_state, state) IN ({_LEGAL}) AS legal FROM l WHERE from_state IS NOT NULL")
def state_transitions(spark, d):
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 12 + 1).cast("int"))
    rows = _t(spark, d, "events").withColumn("state", state)
    return R.transitions(rows, "user_id", "state", ["ts", "event_id"]).select("event_id", "from_state", "state", "legal")


@query(f"WITH s AS (SELECT DISTINCT user_id, {list(R.STAGES)}[event_id % 13 + 1] AS stage FROM events), o AS (SELECT unnest({list(R.STAGES)}) AS stage, unnest(range(0, 13)) AS n), u AS (SELECT user_id, count(*) AS completed FROM s GROUP BY 1) SELECT user_id, completed, (SELECT arg_min(o.stage, o.n) FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = u.user_id AND s.stage = o.stage)) AS next_stage FROM u")
def resume_stage(spark, d):
    stage = F.element_at(F.array(*map(F.lit, R.STAGES)), (F.col("event_id") % 13 + 1).cast("int"))
    return R.next_stage(_t(spark, d, "events").select("user_id", stage.alias("stage")), "user_id")


@query("WITH l AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS running FROM lineitem) SELECT *, running > 120 AS would_exceed FROM l")
def budget_ledger(spark, d):
    return R.ledger(_t(spark, d, "lineitem"), "l_orderkey", "l_quantity", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], 120).select("l_orderkey", "l_linenumber", "running", "would_exceed")


@query("SELECT user_id, sum(((event_id % 4000)::DECIMAL(14,6) / 1000 * 1.25 + (event_id % 900)::DECIMAL(14,6) / 1000 * 10)::DECIMAL(14,6))::DOUBLE AS cost, count(*) AS calls FROM events GROUP BY 1")
def model_costs(spark, d):
    part = lambda n, price: (F.col("event_id") % n).cast("decimal(14,6)") / 1000 * F.lit(price)
    return _t(spark, d, "events").groupBy("user_id").agg(F.sum((part(4000, 1.25) + part(900, 10.0)).cast("decimal(14,6)")).cast("double").alias("cost"), F.count("*").alias("calls"))


@query("SELECT event_id, CASE WHEN NOT (event_type <> 'signup') THEN 'dead_letter_invalid' WHEN event_id % 7 > 4 THEN 'dead_letter_exhausted' WHEN event_type = 'error' THEN 'redeliver' ELSE 'archive' END AS action FROM events")
def message_delivery(spark, d):
    kind = F.col("event_type")
    return _t(spark, d, "events").select("event_id", R.delivery(F.col("event_id") % 7, kind != "signup", kind == "error").alias("action"))


@query("SELECT event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS pending FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def outbox_heads(spark, d):
    pending = _t(spark, d, "events").filter("event_id % 2 = 0")
    return pending.groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("pending"))


@query("SELECT o_orderpriority, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, count(*) AS pending FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def open_order_heads(spark, d):
    """The oldest pending row of each queue by a real status; ``outbox_heads`` looks at half of the ids."""
    pending = _t(spark, d, "orders").filter("o_orderstatus = 'O'")
    return pending.groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.count("*").alias("pending"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')")
def unknown_references(spark, d):
    known = _t(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _t(spark, d, "lineitem").join(known, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")
