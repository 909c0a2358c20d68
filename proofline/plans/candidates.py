"""Queries of candidate generation. Requests, sites and register records are derived from all customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import candidates as K
from proofline.operators.steps import Steps
from proofline.plans.common import Registry, carried, plain

query = Registry()

_KEY = "CASE WHEN k % 4 = 0 THEN 'L' ELSE 'U' END || lpad(CAST(k % 100000 AS STRING), 5, '0') || 'MH2001PTC' || lpad(CAST(k AS STRING), 6, '0')"
_RECORDS = f"""SELECT k, {_KEY} AS cin, name || CASE WHEN k % 2 = 0 THEN ' Pvt. Ltd.' ELSE ' PRIVATE LIMITED' END AS legal_name, CASE WHEN k % 5 = 0 THEN 'Old ' || name ELSE NULL END AS former,
  CASE k % 5 WHEN 0 THEN 'Private limited' WHEN 1 THEN 'Public' WHEN 2 THEN 'One Person Company' WHEN 3 THEN '' ELSE 'private' END AS company_type, CASE k % 6 WHEN 0 THEN 'Struck Off' WHEN 1 THEN NULL ELSE 'Active' END AS status,
  CASE k % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS active, CASE k % 9 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS listed, CASE k % 3 WHEN 0 THEN 'Maharashtra' WHEN 1 THEN 'Goa' END AS state,
  CASE WHEN k % 10 <> 9 THEN 'Tower ' || k || ' MG Lane Pune Maharashtra' END AS summary FROM (SELECT c_custkey AS k, c_name AS name FROM {{customer}})"""
_REQUESTS = """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 6 <> 1 THEN '  ' || c_name || '  Private   Limited' END AS legal_name, CASE WHEN c_custkey % 3 = 0 THEN ' u12345mh2001ptc000001 ' WHEN c_custkey % 3 = 1 THEN 'bad' END AS cin,
  CASE WHEN c_custkey % 11 = 0 THEN ' MAHARASHTRA ' END AS state, 'https://WWW.site' || c_custkey || '.example.com/' AS root_url FROM {customer}"""
_SITE = f"""SELECT k AS request_id, i AS page_no, i AS ord, 'https://site' || k || '.example.com/p' || i AS url, 'h' || (k * 10 + i) AS content_hash, k % 8 <> 0 AS controlled, CASE i WHEN 0 THEN 'legal_name' WHEN 1 THEN 'legal_name' WHEN 2 THEN 'cin' ELSE 'registered_office' END AS kind,
  CASE i WHEN 0 THEN CASE WHEN k % 3 = 0 THEN name || ' Pvt Ltd' ELSE 'Another Company Limited' END WHEN 1 THEN 'OLD ' || name WHEN 2 THEN lower({_KEY}) ELSE CASE WHEN k % 2 = 0 THEN 'Registered office: Tower ' || k || ', MG Lane, Pune, Maharashtra' ELSE 'Plot 9 Panaji Goa' END END AS value, 'context ' || i AS context
  FROM (SELECT c_custkey AS k, c_name AS name FROM {{customer}}) AS c CROSS JOIN (SELECT CAST(r_regionkey AS BIGINT) AS i FROM {{region}}) AS r WHERE i < 4 AND (i <> 2 OR k % 4 < 2)"""
_ANSWERS = f"""SELECT r + 1 AS request_id, i AS query_no, i > 0 AS by_name, j AS pos, {_KEY} AS cin FROM (
  SELECT c.r, x.i, y.j, c.r + y.j * CASE WHEN x.i = 1 THEN 1 ELSE 2 END + 1 AS k FROM (SELECT c_custkey - 1 AS r FROM {{customer}}) AS c CROSS JOIN (SELECT CAST(r_regionkey AS BIGINT) AS i FROM {{region}}) AS x
  CROSS JOIN (SELECT CAST(n_nationkey AS BIGINT) AS j FROM {{nation}}) AS y WHERE x.i < 4 AND (x.i > 0 OR y.j = 0 AND c.r % 2 = 0) AND y.j < 12)"""
_SIGNALS = f"""SELECT k AS request_id, CASE WHEN k % 2 = 0 THEN {_KEY} END AS cin, name || ' private limited' AS name, CASE k % 7 WHEN 0 THEN 'official_domain_link' WHEN 1 THEN 'director_promoter_business_match' WHEN 2 THEN 'credible_corroboration' WHEN 3 THEN 'conflicting_registered_office'
  WHEN 4 THEN 'incompatible_business' ELSE 'common_name_adverse_ambiguity' END AS kind, 's' || k AS evidence_id FROM (SELECT c_custkey AS k, c_name AS name FROM {{customer}})"""
_HINTS = f"""SELECT k AS request_id, i AS ord, CASE WHEN k % 3 = 0 THEN {_KEY} END AS cin, CASE WHEN k % 2 = 0 THEN name || ' Pvt Ltd' END AS name, 'Brand' || (k % 4) AS one, CASE WHEN i = 1 THEN 'BRAND' || (k % 4) ELSE 'Extra' END AS two,
  CASE WHEN k % 5 = 0 THEN 'parent' WHEN k % 7 = 0 AND i = 1 THEN 'sister' WHEN k % 7 = 0 THEN 'cousin' END AS reason FROM (SELECT c_custkey AS k, c_name AS name FROM {{customer}}) AS c CROSS JOIN (SELECT CAST(r_regionkey AS BIGINT) AS i FROM {{region}}) AS r WHERE i < 2"""

_NAME = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\bpvt\.?\b', 'private', 'g'), '\bltd\.?\b', 'limited', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-5' || substr({0}, 14, 3) || '-' || lower(printf('%x', (('0x' || substr({0}, 17, 2))::INT & 63) | 128)) || substr({0}, 19, 2) || '-' || substr({0}, 21, 12)"
_WALK = "WITH RECURSIVE a AS (" + plain(_ANSWERS) + """), q AS (SELECT request_id, query_no, by_name, list(cin ORDER BY pos) AS cins, row_number() OVER (PARTITION BY request_id ORDER BY query_no) AS n FROM a GROUP BY 1, 2, 3),
z AS (SELECT request_id, 0::BIGINT AS n, []::VARCHAR[] AS held, NULL::BIGINT AS query_no, NULL::BOOLEAN AS by_name, []::VARCHAR[] AS part FROM (SELECT DISTINCT request_id FROM q)
  UNION ALL SELECT w.request_id, w.n, list_filter(list_concat(w.held, list_filter(w.part, lambda x: NOT list_contains(w.held, x))), lambda x, i: i <= 20), w.query_no, w.by_name, w.part FROM (
    SELECT z.request_id, q.n, z.held, q.query_no, q.by_name, CASE WHEN q.by_name THEN q.cins[1:least(10, greatest(1, 20 - len(z.held)))] ELSE q.cins END AS part FROM z JOIN q ON q.request_id = z.request_id AND q.n = z.n + 1 WHERE len(z.held) < 20) w),
t AS (SELECT request_id, arg_max(held, n) AS held FROM z GROUP BY 1),
f AS (SELECT z.request_id, z.query_no, z.by_name, p.cin, list_position(t.held, p.cin)::INT AS place FROM z JOIN t USING (request_id), LATERAL (SELECT unnest(z.part) AS cin) p WHERE list_contains(t.held, p.cin))
"""


def _found(spark, d):
    return K.ingested(carried(spark, d, _ANSWERS))


def _records(spark, d):
    rows = carried(spark, d, _RECORDS)
    return rows.withColumn("former_names", F.when(F.col("former").isNotNull(), F.array("former")).otherwise(F.array().cast("array<string>"))).drop("k", "former")


def _hints(spark, d):
    return carried(spark, d, _HINTS).withColumn("brands", F.array("one", "two")).drop("one", "two")


@query(_WALK + "SELECT request_id, query_no, by_name, cin, place FROM f")
def candidate_intake(spark, d):
    return _found(spark, d).select("request_id", "query_no", "by_name", "cin", F.col("place").cast("int").alias("place"))


@query("WITH r AS (" + plain(_REQUESTS) + "), s AS (" + plain(_SITE) + f"""), n AS (SELECT request_id, -1 AS page_no, trim(regexp_replace(legal_name, '\\s+', ' ', 'g')) AS v FROM r WHERE legal_name IS NOT NULL UNION ALL SELECT request_id, page_no, value FROM s WHERE kind = 'legal_name'),
k AS (SELECT *, {_NAME.format('v')} AS key FROM n), u AS (SELECT request_id, v, page_no FROM k QUALIFY row_number() OVER (PARTITION BY request_id, key ORDER BY page_no) = 1) SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY page_no)::INT AS place, v AS value FROM u""")
def names_to_ask(spark, d):
    return K.identities(carried(spark, d, _REQUESTS), carried(spark, d, _SITE), "legal_name")


@query("WITH r AS (" + plain(_REQUESTS) + "), s AS (" + plain(_SITE) + """), n AS (SELECT request_id, -1 AS page_no, upper(trim(cin)) AS v FROM r WHERE cin IS NOT NULL UNION ALL SELECT request_id, page_no, upper(value) FROM s WHERE kind = 'cin'),
u AS (SELECT request_id, v, page_no FROM n WHERE regexp_full_match(v, '[UL][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}') QUALIFY row_number() OVER (PARTITION BY request_id, v ORDER BY page_no) = 1) SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY page_no)::INT AS place, v AS value FROM u""")
def numbers_to_ask(spark, d):
    return K.identities(carried(spark, d, _REQUESTS), carried(spark, d, _SITE), "cin")


_FACTS = _WALK + ", rec AS (" + plain(_RECORDS) + "), site AS (" + plain(_SITE) + "), sig AS (" + plain(_SIGNALS) + "), hint AS (" + plain(_HINTS) + "), req AS (" + plain(_REQUESTS) + f"""),
m AS (SELECT DISTINCT request_id, cin FROM f), nm AS (SELECT cin, {_NAME.format('legal_name')} AS key, true AS present FROM rec UNION ALL SELECT cin, {_NAME.format('former')}, false FROM rec WHERE former IS NOT NULL),
said0 AS (SELECT *, sha1(unhex('c35295503ee85bc4966d4346ded3fa37') || encode('site|' || url || '|' || content_hash || '|' || kind || '|' || value || '|' || context)) AS h FROM site WHERE controlled), said AS (SELECT *, {_UUID.format('h')} AS evidence_id FROM said0),
tok AS (SELECT s.request_id, r.cin, s.value, r.state, s.evidence_id, list_distinct(list_filter(regexp_extract_all(lower(s.value), '[a-z0-9]+'), lambda v: length(v) > 1 AND NOT list_contains({K.STOP_WORDS}, v))) AS x,
        list_distinct(list_filter(regexp_extract_all(lower(r.summary), '[a-z0-9]+'), lambda v: length(v) > 1 AND NOT list_contains({K.STOP_WORDS}, v))) AS y FROM said s JOIN m USING (request_id) JOIN rec r ON r.cin = m.cin WHERE s.kind = 'registered_office'),
adr AS (SELECT *, coalesce((state IS NULL OR contains(lower(value), lower(state))) AND len(list_intersect(x, y)) >= 3 AND len(list_intersect(x, y)) * 2 >= least(len(x), len(y)), false) AS hit FROM tok),
said_facts AS (SELECT DISTINCT s.request_id, m.cin, p.fact, s.evidence_id FROM said s JOIN m USING (request_id) JOIN nm ON nm.cin = m.cin AND nm.key = {_NAME.format('s.value')}, LATERAL (SELECT unnest(CASE WHEN nm.present THEN ['name', 'legal_page'] ELSE ['legal_page'] END) AS fact) p WHERE s.kind = 'legal_name'
  UNION SELECT s.request_id, m.cin, 'cin', s.evidence_id FROM said s JOIN m ON m.request_id = s.request_id AND m.cin = upper(s.value) WHERE s.kind = 'cin'
  UNION SELECT request_id, cin, CASE WHEN hit THEN 'address_match' ELSE 'address_conflict' END, evidence_id FROM adr WHERE hit OR CASE WHEN contains(lower(value), 'maharashtra') THEN 'maharashtra' WHEN contains(lower(value), 'goa') THEN 'goa' END <> lower(state)),
told AS (SELECT DISTINCT s.request_id, m.cin, CASE s.kind """ + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.SIGNAL_FACTORS.items()) + f""" END AS fact, s.evidence_id FROM sig s JOIN m USING (request_id) WHERE s.cin = m.cin OR s.cin IS NULL AND EXISTS (SELECT 1 FROM nm WHERE nm.cin = m.cin AND nm.key = {_NAME.format('s.name')}))
"""


@query(_FACTS + "SELECT * FROM said_facts UNION ALL SELECT * FROM told")
def candidate_facts(spark, d):
    mine = _found(spark, d).select("request_id", "cin").distinct().join(_records(spark, d), "cin")
    steps = Steps(spark, "candidate-facts")
    mine = steps.write(mine, "records")
    named = steps.write(K.handles(mine, mine), "handles")
    return K.site_facts(named, mine, carried(spark, d, _SITE)).unionByName(K.signal_facts(named, carried(spark, d, _SIGNALS)))


_HINTED = _FACTS + f""", fit AS (SELECT h.request_id, m.cin, h.ord, h.one, h.two, h.reason FROM hint h JOIN m USING (request_id) WHERE (h.cin IS NOT NULL OR h.name IS NOT NULL) AND (h.cin IS NULL OR h.cin = m.cin) AND (h.name IS NULL OR EXISTS (SELECT 1 FROM nm WHERE nm.cin = m.cin AND nm.key = {_NAME.format('h.name')}))),
br AS (SELECT request_id, cin, brand, ord, pos FROM (SELECT request_id, cin, ord, 0 AS pos, one AS brand FROM fit UNION ALL SELECT request_id, cin, ord, 1, two FROM fit) QUALIFY row_number() OVER (PARTITION BY request_id, cin, lower(brand) ORDER BY ord, pos) = 1),
hinted AS (SELECT request_id, cin, b.brand_names, x.related_reason, CASE WHEN x.n > 1 THEN 'conflicting_entity_relationship_hints' END AS code FROM (SELECT request_id, cin, arg_min(reason, ord) FILTER (reason IS NOT NULL) AS related_reason, count(DISTINCT lower(reason)) AS n FROM fit GROUP BY 1, 2) x
  JOIN (SELECT request_id, cin, list(brand ORDER BY ord, pos) AS brand_names FROM br GROUP BY 1, 2) b USING (request_id, cin))
"""


@query(_HINTED + "SELECT request_id, cin, array_to_string(brand_names, ',') AS brand_names, related_reason, code FROM hinted")
def relationship_hints(spark, d):
    out = K.hinted(_hints(spark, d), K.handles(_found(spark, d), _records(spark, d)))
    return out.withColumn("brand_names", F.array_join("brand_names", ","))


_POSITIVE = "35 * exact::INT + 20 * has_adr::INT + 15 * has_page::INT + 15 * off::INT + 10 * dir::INT + 5 * cor::INT"
_NEGATIVE = "-15 * inact::INT - 10 * confl::INT - 15 * incomp::INT - 20 * only_name::INT - 10 * adverse::INT"


@query(_HINTED + f""", prov0 AS (SELECT DISTINCT f.request_id, f.cin, sha1(unhex('c35295503ee85bc4966d4346ded3fa37') || encode('provider|fixture|' || CASE WHEN by_name THEN 'search_by_name' ELSE 'lookup_by_cin' END || '|' || f.cin || '|Compatible company-data source returned ' || legal_name || ' (' || f.cin || ')' || CASE WHEN status IS NOT NULL THEN ' with status ' || status ELSE '' END || CASE WHEN state IS NOT NULL THEN ' and registered-office state ' || state ELSE '' END || '.')) AS h FROM f JOIN rec USING (cin)),
prov AS (SELECT request_id, cin, 'provider' AS fact, {_UUID.format('h')} AS evidence_id FROM prov0), every AS (SELECT * FROM said_facts UNION ALL SELECT * FROM told UNION ALL SELECT * FROM prov),
g AS (SELECT request_id, cin, list(DISTINCT fact) AS fs, list_sort(list(DISTINCT evidence_id) FILTER (fact = 'provider')) AS pids, list_sort(list(DISTINCT evidence_id) FILTER (fact IN ('address_conflict', 'conflicting_registered_office', 'provider'))) AS cids FROM every GROUP BY 1, 2),
a1 AS (SELECT f.request_id, f.cin, bool_or(by_name) AS bn, bool_or(NOT by_name) AS bc FROM f GROUP BY 1, 2),
b1 AS (SELECT a1.*, rec.* EXCLUDE (cin), g.* EXCLUDE (request_id, cin), list_contains(fs, 'name') AND list_contains(fs, 'cin') AS exact, list_contains(fs, 'address_match') AS has_adr, list_contains(fs, 'legal_page') AS has_page, list_contains(fs, 'official_regulator_exchange_links_domain') AS off,
        list_contains(fs, 'directors_promoters_business_match') AS dir, list_contains(fs, 'credible_corroboration') AS cor, coalesce(NOT active, false) OR coalesce(status = 'Struck Off', false) AS inact, list_contains(fs, 'conflicting_registered_office') OR list_contains(fs, 'address_conflict') AS confl,
        list_contains(fs, 'incompatible_business_description') AS incomp, list_contains(fs, 'common_name_adverse_ambiguity') AS adverse, req.state AS wanted, len(list_intersect(fs, ['name', 'legal_page', 'cin', 'address_match', 'address_conflict'])) > 0 AS on_site FROM a1 JOIN rec USING (cin) JOIN g USING (request_id, cin) JOIN req USING (request_id)),
d1 AS (SELECT *, bn AND NOT bc AND NOT (exact OR has_adr OR off OR dir OR cor) AS only_name FROM b1 WHERE wanted IS NULL OR lower(state) = lower(trim(wanted))),
e1 AS (SELECT *, {_POSITIVE} AS positive_total, {_NEGATIVE} AS negative_total, CASE WHEN coalesce(listed, false) OR starts_with(cin, 'L') THEN 'listed' WHEN contains(lower(company_type), 'private') OR contains(lower(company_type), 'one person') THEN 'private' WHEN contains(lower(company_type), 'public') THEN 'public_unlisted' END AS company_class FROM d1)
SELECT e1.request_id, e1.cin, legal_name, company_class, CASE WHEN on_site THEN 'www.site' || e1.request_id || '.example.com' END AS domain, positive_total, negative_total, least(100, greatest(0, positive_total + negative_total)) AS score, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in zip(("inact", "confl", "incomp", "only_name", "adverse"), K.CONFLICTS.values(), strict=True))}], lambda x: x IS NOT NULL), '|') AS conflicts,
  array_to_string(coalesce(brand_names, []), ',') AS brands, coalesce(hinted.code, CASE WHEN company_class IS NULL THEN 'candidate_company_type_unsupported' END) AS code, CASE WHEN only_name THEN array_to_string(pids[1:20], ',') END AS name_only_ids, CASE WHEN confl THEN array_to_string(cids[1:20], ',') END AS conflict_ids,
  CASE WHEN list_contains(list_transform(coalesce(brand_names, []), lambda x: lower(x)), 'extra') THEN legal_name || ' operates the Extra business/website.' END AS statement,
  row_number() OVER (PARTITION BY e1.request_id ORDER BY least(100, greatest(0, positive_total + negative_total)) DESC, lower(legal_name), e1.cin)::INT AS rank FROM e1 LEFT JOIN hinted USING (request_id, cin)""")
def candidate_generation(spark, d):
    out = K.generate(carried(spark, d, _REQUESTS), carried(spark, d, _SITE), carried(spark, d, _ANSWERS), _records(spark, d), carried(spark, d, _SIGNALS), _hints(spark, d))
    ids = lambda f: F.array_join(F.col("evidence")[f], ",")
    return out.select(
        "request_id", "cin", "legal_name", "company_class", "domain", "positive_total", "negative_total", "score", F.array_join("conflicts", "|").alias("conflicts"), F.array_join("brand_names", ",").alias("brands"), "code",
        ids("name_only_match").alias("name_only_ids"), ids("conflicting_registered_office").alias("conflict_ids"), K.brand_statement(F.col("legal_name"), F.col("brand_names"), F.lit(" extra ")).alias("statement"), "rank",
    )


_BRANCHES = f"""SELECT {_KEY} AS cin, i AS query_no, name || ' Branch ' || i || ' Private Limited' AS legal_name, CASE WHEN i = 3 THEN name || ' Branch 1 Ltd' END AS former, 'Private' AS company_type, 'Active' AS status, true AS active, false AS listed, 'Goa' AS state, '' AS summary
  FROM (SELECT c_custkey AS k, c_name AS name FROM {{customer}}) AS c CROSS JOIN (SELECT CAST(r_regionkey AS BIGINT) AS i FROM {{region}}) AS r"""
_BRANCH_SITE = """SELECT c_custkey AS request_id, 0 AS page_no, 0 AS ord, 'https://site.example.com/' AS url, 'h' AS content_hash, true AS controlled, 'legal_name' AS kind, c_name || ' BRANCH ' || (c_custkey % 4) || ' Pvt. Ltd.' AS value, 'context' AS context FROM {customer}"""


@query(_WALK + ", rec AS (" + plain(_BRANCHES) + "), site AS (" + plain(_BRANCH_SITE) + f"""), m AS (SELECT request_id, cin, min(query_no) AS query_no FROM f GROUP BY 1, 2)
SELECT m.request_id, m.cin, rec.legal_name, {_NAME.format('rec.legal_name')} = {_NAME.format('site.value')} AS company_controlled_legal_page FROM m JOIN rec USING (cin, query_no) JOIN site USING (request_id)""")
def answered_names(spark, d):
    """One register number under different names in the answers to different queries: each request holds to its own."""
    none = carried(spark, d, _SIGNALS).limit(0)
    records = carried(spark, d, _BRANCHES).withColumn("former_names", F.when(F.col("former").isNotNull(), F.array("former"))).drop("former")
    requests = carried(spark, d, _REQUESTS).withColumn("state", F.lit(None).cast("string"))
    out = K.generate(requests, carried(spark, d, _BRANCH_SITE), carried(spark, d, _ANSWERS), records, none, _hints(spark, d).limit(0))
    return out.select("request_id", "cin", "legal_name", "company_controlled_legal_page")


@query("WITH r AS (" + plain(_RECORDS) + f"""), h AS (SELECT *, sha1(unhex('7c20b8e4290f5f26848db49a73fe791d') || encode('q' || k || '|' || cin || '|' || {_NAME.format('legal_name')} || '|' || coalesce(state, ''))) AS s FROM r)
SELECT cin, {_UUID.format('s')} AS candidate_id, CASE k % 3 WHEN 0 THEN 'https://a.example/s' WHEN 1 THEN 'https://a.example/m' END AS url FROM h""")
def candidate_ids(spark, d):
    rows = carried(spark, d, _RECORDS)
    provider, by_name = F.when(F.col("k") % 3 == 2, "other").otherwise("a"), F.col("k") % 3 == 0
    url = K.provider_url(provider, by_name, {"a": ("https://a.example/s", "https://a.example/m")})
    return rows.select("cin", K.candidate_id(F.concat(F.lit("q"), "k"), F.col("cin"), F.col("legal_name"), F.col("state")).alias("candidate_id"), url.alias("url"))
