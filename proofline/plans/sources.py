"""Queries of the scans, over answers and tables derived from all customers, orders and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.sources import companies as C
from proofline.sources import filings as G
from proofline.sources import reports as R
from proofline.sources import web_search as S
from proofline.plans.common import Registry, carried, plain

query = Registry()

_CIN = "'U12345MH2001PTC' || lpad(CAST(k % 1000000 AS STRING), 6, '0')"
_VENDOR = f"""SELECT k, {_CIN} AS cin, name, CASE k % 4 WHEN 0 THEN '01-02-2003' WHEN 1 THEN NULL WHEN 2 THEN '28-02-1999' ELSE '31-12-2010' END AS day, k % 9 AS trouble, k % 3 AS offices, 'State' || (k % 5) AS state FROM (SELECT c_custkey AS k, c_name AS name FROM {{customer}})"""


def _vendor(spark, d):
    return carried(spark, d, _VENDOR)


def _item(*more):
    k, c = F.col("k"), F.col
    address = lambda kind, active, text, state: F.struct(F.lit(kind).alias("type"), F.lit(active).alias("active"), F.concat(F.lit(text), k).alias("fullAddress"), state.alias("state"))
    first, second = address("Registered Office", False, "Old ", F.lit("Goa")), address("registered", True, "New ", c("state"))
    places = F.when(c("offices") == 0, F.array(address("Branch", True, "B ", c("state")))).when(c("offices") == 1, F.array(first)).otherwise(F.array(first, second))
    return [F.lit("Private").alias("type"), F.lit("Active").alias("status"), (k % 2 == 0).alias("active"), F.when(c("trouble") == 1, "2010/01/01").otherwise(c("day")).alias("incorporatedDate"), places.alias("addresses"), *more]


_OFFICE_SQL = "CASE offices WHEN 1 THEN 'Goa' WHEN 2 THEN state END AS state, CASE offices WHEN 1 THEN 'Old ' || k WHEN 2 THEN 'New ' || k END AS summary"
_DAY_SQL = "CASE day WHEN '01-02-2003' THEN DATE '2003-02-01' WHEN '28-02-1999' THEN DATE '1999-02-28' WHEN '31-12-2010' THEN DATE '2010-12-31' END::VARCHAR AS incorporated"


@query("WITH v AS (" + plain(_VENDOR) + f"""), b AS (SELECT *, trouble IN (1, 2, 3) OR trouble = 4 AS bad FROM v) SELECT k AS answer_id, 'company_data_response_invalid' AS code, NULL::INT AS pos, NULL AS cin, NULL AS legal_name, NULL AS incorporated, NULL AS state, NULL AS summary FROM b WHERE bad
UNION ALL SELECT k, NULL, p::INT, cin, name, {_DAY_SQL}, {_OFFICE_SQL} FROM b, (SELECT unnest([0, 1]) AS p) WHERE NOT bad AND trouble <> 5""")
def company_search_answers(spark, d):
    c = F.col
    good = F.struct(F.when(c("trouble") == 2, "bad").otherwise(c("cin")).alias("indexId"), F.when(c("trouble") == 3, "").otherwise(c("name")).alias("businessName"), *_item())
    body = F.when(c("trouble") == 4, '{"x": 1}').when(c("trouble") == 5, "[]").otherwise(F.to_json(F.array(good, good, good)))
    out = C.search_answers(_vendor(spark, d).select(c("k").alias("answer_id"), body.alias("body"), F.lit(2).alias("most")))
    return out.select("answer_id", "code", "pos", "cin", "legal_name", c("incorporated").cast("string").alias("incorporated"), "state", "summary")


@query("WITH v AS (" + plain(_VENDOR) + f"""), b AS (SELECT *, trouble IN (1, 2, 3, 4) AS bad FROM v WHERE trouble <> 5) SELECT k AS answer_id, CASE WHEN bad THEN 'company_data_response_invalid' END AS code, CASE WHEN NOT bad THEN cin END AS cin, CASE WHEN NOT bad THEN name END AS legal_name, CASE WHEN NOT bad THEN CASE WHEN k % 2 = 0 THEN 'Old name' ELSE '' END END AS former,
CASE WHEN NOT bad THEN CASE WHEN k % 7 = 0 THEN true WHEN k % 7 = 1 THEN false END END AS listed, CASE WHEN NOT bad THEN incorporated END AS incorporated, CASE WHEN NOT bad THEN place END AS state FROM (SELECT * EXCLUDE (state), {_DAY_SQL}, CASE offices WHEN 1 THEN 'Goa' WHEN 2 THEN state END AS place FROM b)""")
def company_lookup_answers(spark, d):
    c, k = F.col, F.col("k")
    listed = F.when(k % 7 == 0, True).when(k % 7 == 1, False)
    item = F.struct(
        (c("trouble") != 5).alias("valid"), F.when(c("trouble") == 2, "other").otherwise(c("cin")).alias("reg"), F.when(c("trouble") == 3, F.lit(None)).otherwise(c("name")).alias("businessName"),
        F.when(k % 2 == 0, "Old name").otherwise("").alias("previousName"), *_item(listed.alias("listed")),
    )
    body = F.when(c("trouble") == 4, "oops").otherwise(F.to_json(item))
    out = C.master_answers(_vendor(spark, d).select(k.alias("answer_id"), body.alias("body"), c("cin").alias("expected_cin")))
    return out.select("answer_id", "code", "cin", "legal_name", F.array_join("former_names", ",").alias("former"), "listed", c("incorporated").cast("string").alias("incorporated"), "state")


_REGISTER = "SELECT c_custkey AS k, 'c' || (c_custkey - CASE WHEN c_custkey % 40 = 0 THEN 1 ELSE 0 END) AS cin, c_name AS legal_name FROM {customer}"
_SEARCHES = "SELECT c_custkey AS k, CASE WHEN c_custkey % 50 = 0 THEN 'Same  NAME' ELSE c_name || ' Ltd' END AS legal_name, 'c' || c_custkey AS one, 'c' || (c_custkey + 1) AS two FROM {customer}"


def _register(spark, d):
    records = carried(spark, d, _REGISTER)
    return records, carried(spark, d, _SEARCHES).withColumn("cins", F.array("one", "two"))


@query("WITH r AS (" + plain(_REGISTER) + "), s AS (" + plain(_SEARCHES) + """), h AS (SELECT a.k AS ask_id, p.pos, p.cin FROM s a JOIN s b ON lower(regexp_replace(a.legal_name, '\\s+', ' ', 'g')) = lower(regexp_replace(b.legal_name, '\\s+', ' ', 'g')), LATERAL (SELECT unnest([0, 1]) AS pos, unnest([b.one, b.two]) AS cin) p WHERE p.pos < a.k % 3)
SELECT ask_id, pos::INT AS pos, cin, r.legal_name FROM h JOIN r USING (cin)""")
def register_searches(spark, d):
    records, searches = _register(spark, d)
    asked = searches.select(F.col("k").alias("ask_id"), F.concat(F.lit("  "), F.upper("legal_name")).alias("name"), (F.col("k") % 3).alias("most"))
    return C.search_register(asked, searches, records.drop("k")).select("ask_id", "pos", "cin", "legal_name")


@query("WITH r AS (" + plain(_REGISTER) + "), s AS (" + plain(_SEARCHES) + """) SELECT 'cin_not_unique' AS rule, cin AS value FROM r GROUP BY cin HAVING count(*) > 1 UNION ALL SELECT 'search_not_unique', lower(regexp_replace(legal_name, '\\s+', ' ', 'g')) FROM s GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'cin_unknown', cin FROM (SELECT one AS cin FROM s UNION SELECT two FROM s) WHERE cin NOT IN (SELECT cin FROM r)""")
def register_checks(spark, d):
    records, searches = _register(spark, d)
    return C.register_errors(searches, records)


@query("WITH r AS (" + plain(_REGISTER) + ") SELECT o_orderkey AS ask_id, 'c' || o_custkey AS cin, r.legal_name FROM orders LEFT JOIN r ON r.cin = 'c' || o_custkey")
def register_lookups(spark, d):
    asked = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ask_id"), F.concat(F.lit("c"), "o_custkey").alias("cin"))
    return C.look_up(asked, carried(spark, d, _REGISTER).drop("k"))


_FOUND = "SELECT page_id AS k, url, page_id % 8 AS trouble, page_id % 4 AS most FROM {pages}"


@query("WITH p AS (" + plain(_FOUND) + r"""), n AS (SELECT *, split_part(url, '#', 1) AS u, CASE WHEN most = 0 THEN 0 WHEN trouble = 1 THEN 1 ELSE 0 END AS bad FROM p)
SELECT k AS answer_id, 'search_response_invalid' AS code, NULL::INT AS place, NULL AS url, NULL AS source_id, NULL AS highlights, NULL::DOUBLE AS cost FROM n WHERE most > 0 AND (trouble = 1 OR trouble = 2 AND most >= 2 OR trouble = 3)
UNION ALL SELECT k, NULL, 1, u, 'id' || k, 'a b', CASE WHEN trouble = 5 THEN 0.0 ELSE 0.5 END FROM n WHERE most >= 1 AND NOT (trouble = 1 OR trouble = 2 AND most >= 2 OR trouble = 3)
UNION ALL SELECT k, NULL, 2, 'https://other.example/', 'https://Other.example', '', CASE WHEN trouble = 5 THEN 0.0 ELSE 0.5 END FROM n WHERE most >= 2 AND NOT (trouble = 1 OR trouble = 2 AND most >= 2 OR trouble = 3)""")
def search_answers(spark, d):
    c = F.col
    item = lambda url, id_, title, passages: F.struct(F.lit(title).alias("title"), url.alias("url"), id_.alias("id"), passages.alias("highlights"))
    none = F.lit(None).cast("string")
    a = item(F.when(c("trouble") == 1, "ftp://x").otherwise(c("url")), F.concat(F.lit("id"), c("k")), "t", F.array(F.lit(" a  b "), F.lit("a b"), F.lit(" ")))
    again = item(c("url"), none, "again", F.array().cast("array<string>"))
    last = item(F.when(c("trouble") == 2, "https://u:p@x.example/").otherwise(F.lit("https://Other.example")), none, "o", F.array().cast("array<string>"))
    cost = F.when(c("trouble") != 5, F.struct(F.lit(0.5).alias("total")))
    body = F.when(c("trouble") == 3, '{"results": 1}').otherwise(F.to_json(F.struct(F.array(a, again, last).alias("results"), cost.alias("costDollars"))))
    out = S.search_results(carried(spark, d, _FOUND).select(c("k").alias("answer_id"), body.alias("body"), "most"))
    return out.select("answer_id", "code", "place", "url", "source_id", F.array_join("highlights", ",").alias("highlights"), "cost")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'who is ' || page_id END AS query, '{"query":"q' || page_id || '","type":"auto","numResults":' || (page_id % 20) || ',"moderation":true,"contents":{"highlights":{"query":"q' || page_id || '","maxCharacters":2000}}' || CASE WHEN page_id % 2 = 0 THEN ',"includeDomains":["a.example"]' ELSE '' END || CASE WHEN page_id % 4 = 1 THEN ',"startPublishedDate":"2024-01-01T00:00:00+00:00"' ELSE '' END || '}' AS payload FROM pages""")
def search_requests(spark, d):
    k, no = F.col("page_id"), F.array().cast("array<string>")
    q = F.concat(F.lit("q"), k)
    payload = S.search_payload(q, k % 20, F.when(k % 2 == 0, F.array(F.lit("a.example"))).otherwise(no), no, F.when(k % 4 == 1, "2024-01-01T00:00:00+00:00"), F.lit(None).cast("string"))
    asked = S.search_query(F.when(k % 3 == 0, " \t ").otherwise(F.concat(F.lit("  who  is "), k)))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", asked.alias("query"), payload.alias("payload"))


_HOPS = """SELECT c_custkey AS fetch_id, CAST(n_nationkey AS BIGINT) AS ord, 'https://h' || n_nationkey || '.example/' AS url, CASE WHEN n_nationkey < c_custkey % 8 THEN CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 302 END WHEN c_custkey % 10 = 3 AND n_nationkey = c_custkey % 8 THEN NULL ELSE 200 END AS status,
  CASE WHEN n_nationkey < c_custkey % 8 AND c_custkey % 9 <> 0 THEN 'https://h' || (n_nationkey + 1) || '.example/' END AS target, c_custkey * 90000 AS bytes, CASE WHEN c_custkey % 11 = 0 AND n_nationkey = 2 THEN 'non_public_ip_address' END AS code FROM {customer} CROSS JOIN {nation} WHERE n_nationkey < 12"""


@query("WITH h AS (" + plain(_HOPS) + """), s AS (SELECT *, CASE WHEN status = 302 THEN 1 ELSE 0 END AS red FROM h), t AS (SELECT *, sum(red) OVER w AS reds, count(*) FILTER (status IS NULL) OVER w AS tries FROM s WINDOW w AS (PARTITION BY fetch_id ORDER BY ord)),
e AS (SELECT fetch_id, min(ord) FILTER (code IS NOT NULL OR status = 200 OR reds > 5 OR tries >= 2) AS stop FROM t GROUP BY 1), k AS (SELECT t.* FROM t JOIN e USING (fetch_id) WHERE ord <= stop), l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY fetch_id ORDER BY ord DESC) = 1)
SELECT l.fetch_id, CASE WHEN x.code IS NULL THEN l.url END AS final_url, c.chain, c.n AS attempts, x.code FROM l JOIN (SELECT fetch_id, coalesce(string_agg(target, ',' ORDER BY ord) FILTER (red = 1), '') AS chain, count(*) AS n FROM k GROUP BY 1) c USING (fetch_id),
LATERAL (SELECT CASE WHEN l.code IS NOT NULL THEN l.code WHEN l.reds > 5 THEN 'too_many_redirects' WHEN l.status IS NULL THEN 'fetch_failed' WHEN l.bytes > 10485760 THEN 'response_too_large' END AS code) x""")
def fetch_outcomes(spark, d):
    out = S.fetch_outcome(carried(spark, d, _HOPS))
    return out.withColumn("chain", F.array_join("chain", ","))


@query("SELECT o_orderkey AS ask_id, 'u' || o_custkey AS url, CASE WHEN c_custkey IS NOT NULL THEN 200 END AS status, CASE WHEN c_custkey IS NULL THEN 'page_fixture_missing' END AS code FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey")
def recorded_pages(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    pages = t("customer").filter("c_custkey % 3 <> 0").select(F.concat(F.lit("u"), "c_custkey").alias("url"), F.lit(200).alias("status"))
    return S.fetched_pages(t("orders").select(F.col("o_orderkey").alias("ask_id"), F.concat(F.lit("u"), "o_custkey").alias("url")), pages)


@query("SELECT o_orderkey AS ask_id, 'part ' || (o_orderkey % 50) AS query, p.p_partkey AS pos FROM orders JOIN part p ON p.p_partkey < o_orderkey % 4 AND o_orderkey % 50 < 30")
def recorded_searches(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    recorded = t("part").filter("p_partkey < 4").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("part "), i.cast("string")))).alias("query"), F.col("p_partkey").alias("pos"))
    asked = t("orders").select(F.col("o_orderkey").alias("ask_id"), F.concat(F.lit(" part   "), F.col("o_orderkey") % 50).alias("query"), (F.col("o_orderkey") % 4).alias("most"))
    return S.recorded_results(asked, recorded).select("ask_id", "query", "pos")


_FILED = "SELECT 'd' || o_orderkey AS document_id, 'c' || o_custkey AS cin, o_orderpriority AS filing_type, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '20' || (20 + o_orderkey % 3) END AS financial_year FROM {orders}"
_WANTED = "SELECT c_custkey AS request_id, 'c' || c_custkey AS cin, c_custkey % 3 AS years, c_custkey % 2 AS more FROM {customer}"


def _wanted(spark, d):
    c = F.col
    years = F.when(c("years") == 0, F.array().cast("array<string>")).when(c("years") == 1, F.array(F.lit("2021"))).otherwise(F.array(F.lit("2020"), F.lit("2022")))
    types = F.when(c("more") == 0, F.array(F.lit("1-URGENT"))).otherwise(F.array(F.lit("1-URGENT"), F.lit("5-LOW")))
    return carried(spark, d, _WANTED).select("request_id", "cin", types.alias("types"), years.alias("years"))


@query("WITH f AS (" + plain(_FILED) + "), w AS (" + plain(_WANTED) + """), h AS (SELECT request_id, string_agg(document_id, ',' ORDER BY document_id) AS documents FROM w JOIN f USING (cin) WHERE (filing_type = '1-URGENT' OR more = 1 AND filing_type = '5-LOW') AND (years = 0 OR years = 1 AND financial_year = '2021' OR years = 2 AND financial_year IN ('2020', '2022')) GROUP BY 1)
SELECT request_id, cin, coalesce(documents, '') AS documents, CASE WHEN documents IS NULL THEN 'unavailable' ELSE 'ready' END AS status, CASE WHEN documents IS NULL THEN 'no_matching_documents' END AS action FROM w LEFT JOIN h USING (request_id) UNION ALL SELECT -request_id, cin, '', 'human_action_required', 'mca_vpd_login_payment_required' FROM w""")
def filing_acquisitions(spark, d):
    wanted, filed = _wanted(spark, d), carried(spark, d, _FILED)
    by_hand = G.by_hand(wanted).withColumn("request_id", -F.col("request_id"))
    return G.acquired(wanted, filed).unionByName(by_hand).withColumn("documents", F.array_join("documents", ","))


@query("WITH f AS (" + plain(_FILED) + ") SELECT cin, string_agg(document_id, ',' ORDER BY document_id) AS documents FROM f GROUP BY 1")
def filings_by_company(spark, d):
    return G.grouped(carried(spark, d, _FILED)).withColumn("documents", F.array_join("documents", ","))


@query("SELECT o_orderkey AS request_id, 'c' || o_custkey AS cin, CASE WHEN o_orderkey % 5 = 0 THEN 'filing_entity_not_confirmed' WHEN o_orderkey % 7 = 0 THEN 'corporate_filing_provider_request_mismatch' END AS code FROM orders")
def confirmed_filings(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("report_id"), F.concat(F.lit("c"), "o_custkey").alias("cin"))
    confirmed = orders.filter("report_id % 5 <> 0").select("report_id", F.when(F.col("report_id") % 7 == 0, "other").otherwise(F.col("cin")).alias("cin"))
    return G.for_confirmed(orders, confirmed).select("request_id", "cin", "code")


@query("SELECT doc_id::VARCHAR AS document_id, CASE WHEN text <> '' AND doc_id % 5 <> 0 THEN sha256(text) END AS sha256, CASE WHEN text <> '' AND doc_id % 5 <> 0 THEN octet_length(encode(text))::INT END AS size_bytes, CASE WHEN text <> '' AND doc_id % 5 <> 0 THEN 'pending_malware_scan' END AS quarantine_status, CASE WHEN text <> '' AND doc_id % 5 <> 0 THEN false END AS parse_allowed, CASE WHEN NOT (text <> '' AND doc_id % 5 <> 0) THEN 'file_body_invalid' END AS code FROM documents")
def registered_files(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    body = F.when(F.col("doc_id") % 5 == 0, F.lit(b"")).otherwise(F.encode("text", "UTF-8"))
    return G.registered(docs.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("x").alias("cin"), body.alias("body"))).drop("cin")


_LINES = """SELECT k AS line_no, CASE WHEN k % 10 = 0 THEN 'text' WHEN k % 10 = 1 THEN '|---|' ELSE '| ' || CASE WHEN k % 10 = 2 THEN 'x' ELSE 'REQ' || (k % 100) || '-' || lpad(CAST(k % 37 AS STRING), 2, '0') END || ' | s' || k || ' | a | b | see AT-' || CASE WHEN k % 7 = 0 THEN 'NONE-01' ELSE 'REQ' || (k % 100) || '-' || lpad(CAST(k % 37 AS STRING), 2, '0') END || ' | c | ' ||
  CASE k % 6 WHEN 0 THEN 'Specified' WHEN 1 THEN 'Blocked' WHEN 2 THEN 'Done' WHEN 3 THEN 'Implemented' ELSE 'Verified' END || ' |' END AS value FROM (SELECT o_orderkey AS k FROM {orders})"""
_REQUIRED = "WITH l AS (" + plain(_LINES) + """), q AS (SELECT line_no, 'REQ' || (line_no % 100) || '-' || lpad((line_no % 37)::VARCHAR, 2, '0') AS requirement_id, line_no % 7 AS t, line_no % 6 AS s FROM l WHERE line_no % 10 > 2),
r AS (SELECT line_no, requirement_id, CASE s WHEN 0 THEN 'Specified' WHEN 1 THEN 'Blocked' WHEN 2 THEN 'Done' WHEN 3 THEN 'Implemented' ELSE 'Verified' END AS status, CASE WHEN row_number() OVER (PARTITION BY requirement_id ORDER BY line_no) > 1 THEN 'requirement_duplicate' WHEN s = 2 THEN 'requirement_status_unknown' WHEN t = 0 THEN 'requirement_tag_missing' END AS code, t FROM q)
"""


@query(_REQUIRED + "SELECT line_no, requirement_id, status, code FROM r")
def requirement_rows(spark, d):
    return R.requirements(carried(spark, d, _LINES)).select("line_no", "requirement_id", "status", "code")


@query(_REQUIRED + "SELECT requirement_id, 'NONE-01' AS tag FROM r WHERE t = 0 AND code IS NULL OR t = 0 AND code <> 'x'")
def requirement_stray_tags(spark, d):
    return R.unknown_tags(R.requirements(carried(spark, d, _LINES)))


_TESTS = "SELECT c_custkey AS k, 'suite :: test at_req' || (c_custkey % 100) || '_' || lpad(CAST(c_custkey % 37 AS STRING), 2, '0') || ' and AT-REQ1-011' AS label, c_custkey % 4 <> 0 AS passed FROM {customer}"
_TRACED = _REQUIRED + ", ok AS (SELECT * FROM r WHERE code IS NULL), tc AS (" + plain(_TESTS) + "), tg AS (SELECT *, 'AT-REQ' || (k % 100) || '-' || lpad((k % 37)::VARCHAR, 2, '0') AS tag FROM tc), ps AS (SELECT tag, list_sort(list(DISTINCT label)) AS labels FROM tg WHERE passed GROUP BY 1)\n"


def _traced(spark, d):
    rows = R.requirements(carried(spark, d, _LINES)).filter("code is null")
    return rows, carried(spark, d, _TESTS).withColumn("tags", R.acceptance_tags(F.col("label")))


@query(_TRACED + "SELECT requirement_id, status, array_to_string(coalesce(labels, []), ';') AS labels, CASE WHEN status = 'Verified' AND labels IS NULL THEN 'verified_without_test' END AS code FROM ok LEFT JOIN ps ON tag = 'AT-' || requirement_id")
def requirement_tests(spark, d):
    return R.traceability(*_traced(spark, d)).select("requirement_id", "status", F.array_join("labels", ";").alias("labels"), "code")


@query(_TRACED + "SELECT label, tag FROM tg WHERE tag NOT IN (SELECT 'AT-' || requirement_id FROM ok)")
def unknown_test_tags(spark, d):
    return R.stray_tags(*_traced(spark, d))


@query(_TRACED + """SELECT '1-' || lpad(i::VARCHAR, 3, '0') AS ord, '| ' || name || ' | ' || n || ' |' AS line FROM (SELECT 0 AS i, 'Requirements' AS name, count(*) AS n FROM ok UNION ALL SELECT i, s, (SELECT count(*) FROM ok WHERE status = s) FROM (SELECT unnest([1, 2, 3, 4, 5]) AS i, unnest(['Specified', 'In progress', 'Implemented', 'Verified', 'Blocked']) AS s)
 UNION ALL SELECT 6, 'Test cases', count(*) FROM tc UNION ALL SELECT 7, 'Tagged test cases', count(*) FROM tc) UNION ALL SELECT '2-' || requirement_id, '| ' || requirement_id || ' | AT-' || requirement_id || ' | ' || array_to_string(coalesce(labels, []), '; ') || ' |' FROM ok LEFT JOIN ps ON tag = 'AT-' || requirement_id WHERE status = 'Verified'
UNION ALL SELECT '3-' || tag, '| ' || tag || ' | ' || len(labels) || ' |' FROM ps""")
def traceability_report(spark, d):
    rows, tests = _traced(spark, d)
    return R.report_lines(R.traceability(rows, tests), tests)


_MANIFEST = "SELECT 'f' || (p_partkey % 700) AS fixture_id, 'cap' || p_partkey AS capability, CASE WHEN p_size % 9 = 0 THEN 'live' ELSE 'fixture' END AS backend, CASE p_partkey % 6 WHEN 0 THEN '../x' WHEN 1 THEN '/abs' WHEN 2 THEN 'a//b' WHEN 3 THEN 'a/./b' ELSE 'a/b' || p_partkey || '.json' END AS path FROM {part}"


@query("WITH m AS (" + plain(_MANIFEST) + """), w AS (SELECT 'cap' || (p_partkey + 3) AS capability, 'fixture' AS backend FROM part) SELECT 'id_not_unique' AS rule, fixture_id AS value FROM m GROUP BY fixture_id HAVING count(*) > 1 UNION ALL SELECT 'capability_missing', capability FROM w WHERE capability NOT IN (SELECT capability FROM m)
UNION ALL SELECT 'capability_unknown', capability FROM m WHERE capability NOT IN (SELECT capability FROM w) UNION ALL SELECT 'backend_mismatch', capability FROM m JOIN w USING (capability) WHERE m.backend <> w.backend UNION ALL SELECT 'path_unsafe', path FROM m WHERE path IN ('../x', '/abs', 'a//b', 'a/./b')""")
def manifest_checks(spark, d):
    wanted = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("cap"), F.col("p_partkey") + 3).alias("capability"), F.lit("fixture").alias("backend"))
    return R.manifest_errors(carried(spark, d, _MANIFEST), wanted)


@query("SELECT 'cap' || c_custkey AS capability, CASE c_custkey % 3 WHEN 0 THEN 'unconfigured' WHEN 1 THEN 'fixture' ELSE 'other' END AS backend, CASE WHEN c_custkey % 3 = 2 THEN 'adapter_not_allowlisted' END AS code FROM customer")
def adapter_plan(spark, d):
    k = F.col("c_custkey")
    wanted = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("cap"), k).alias("capability"), "c_custkey")
    settings = wanted.filter("c_custkey % 3 <> 0").select("capability", F.when(k % 3 == 1, "fixture").otherwise("other").alias("backend"))
    return R.selected_adapters(wanted.select("capability"), settings, wanted.select("capability", F.lit("fixture").alias("backend")))
