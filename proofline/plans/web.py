"""Queries of the URL, host and response policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import urls as U
from proofline.functions import web as W
from proofline.plans.common import Registry, carried, plain

query = Registry()

_URLS = """SELECT page_id, CASE page_id % 16
  WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN 'ftp://x.example.com/' || page_id WHEN 3 THEN 'HTTPS://WWW.Example.COM:443/A?b=' || page_id || '#f'
  WHEN 4 THEN 'http://example.com:8080/' || page_id WHEN 5 THEN 'https://example.com/?api_key=1&x=' || page_id WHEN 6 THEN 'https://localhost/' || page_id
  WHEN 7 THEN 'http://printer.local/' || page_id WHEN 8 THEN 'https://a..b.com/' || page_id WHEN 9 THEN 'http://10.0.0.1/' || page_id WHEN 10 THEN 'https:///' || page_id
  WHEN 11 THEN 'https://example.com:99999/' || page_id WHEN 12 THEN 'http://-bad.com/' || page_id WHEN 13 THEN 'http://example.com./' || page_id WHEN 14 THEN 'http://example.com:443?q=' || page_id
  ELSE url END AS url FROM {pages}"""
_PARTS = plain(_URLS).join(["WITH c AS (", "), b AS (SELECT page_id, url, split_part(url, '#', 1) AS u FROM c), "]) + r"""
p AS (SELECT page_id, url, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1) AS authority,
        regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) AS path, CASE WHEN contains(u, '?') THEN regexp_extract(u, '\?(.*)$', 1) ELSE '' END AS query FROM b),
h AS (SELECT *, contains(authority, '@') AS has_user, lower(split_part(regexp_replace(authority, '^.*@', ''), ':', 1)) AS raw_host, regexp_extract(regexp_replace(authority, '^.*@', ''), ':(.*)$', 1) AS port FROM p),
k AS (SELECT *, rtrim(raw_host, '.') AS host, CASE scheme WHEN 'http' THEN '80' WHEN 'https' THEN '443' END AS own_port,
        CASE WHEN query = '' THEN '' ELSE '?' || query END AS asked, CASE WHEN path = '' THEN '/' ELSE path END AS place FROM h),
r AS (SELECT *, CASE WHEN port <> '' AND port::BIGINT > 65535 THEN 'malformed_url' WHEN scheme NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN has_user THEN 'credentials_forbidden'
        WHEN raw_host = '' THEN 'invalid_hostname' WHEN port <> '' AND port <> own_port THEN 'unsupported_port' WHEN regexp_matches(query, '(?i)(^|&)([^=&]*[-_.])?(auth|code|credential|jwt|key|password|secret|session|sig|signature|token)([-_.][^=&]*)?(=|&|$)') THEN 'credentials_forbidden'
        WHEN list_contains(string_split(host, '.'), '') AND host <> '' THEN 'invalid_hostname' WHEN regexp_matches(host, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$') THEN NULL
        WHEN host = '' OR host = 'localhost' OR NOT contains(host, '.') OR regexp_matches(host, '\.(localhost|local|internal|home\.arpa)$') THEN 'non_public_hostname'
        WHEN len(list_filter(string_split(host, '.'), lambda x: NOT regexp_matches(x, '^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$'))) > 0 THEN 'non_public_hostname' END AS code FROM k)
"""


@query(_PARTS + "SELECT page_id, CASE WHEN code IS NULL THEN scheme || '://' || host || place || asked END AS url, CASE WHEN code IS NULL THEN host END AS host, code FROM r")
def canonical_urls(spark, d):
    return W.with_canonical(carried(spark, d, _URLS)).select("page_id", "canonical.url", "canonical.host", "canonical.code")


@query(_PARTS + r""", q AS (SELECT *, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(url_decode(split_part(x, '=', 1))), '^(utm_.*|fbclid|gclid|mc_cid|mc_eid)$')) AS kept FROM r)
SELECT page_id, CASE WHEN code IS NULL THEN scheme || '://' || host || place || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_transform(kept, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') END END AS url, code FROM q""")
def crawl_urls(spark, d):
    rows = W.with_canonical(carried(spark, d, _URLS))
    return rows.select("page_id", W.crawl_url(F.col("canonical"), U.TRACKING_KEYS).alias("c")).select("page_id", "c.url", "c.code")


@query(_PARTS + """SELECT page_id, CASE WHEN scheme IN ('http', 'https') AND raw_host <> '' AND NOT has_user AND (port = '' OR port = own_port) THEN scheme || '://' || host || CASE WHEN port = '' THEN '' ELSE ':' || port END || place || asked END AS found,
CASE WHEN scheme = 'https' AND raw_host <> '' AND NOT has_user AND (port = '' OR port = own_port) THEN scheme || '://' || host || CASE WHEN port = '' THEN '' ELSE ':' || port END || place || asked END AS source FROM r""")
def search_urls(spark, d):
    url = F.col("url")
    return carried(spark, d, _URLS).select("page_id", W.default_port_url(url).alias("found"), W.default_port_url(url, ("https",)).alias("source"))


@query(_PARTS + """SELECT page_id, CASE WHEN code IN ('unsupported_port', 'credentials_forbidden', 'malformed_url', 'unsupported_scheme', 'invalid_hostname', 'non_public_hostname') AND NOT (code = 'unsupported_port' AND port IN ('80', '443')) OR host = '10.0.0.1' THEN NULL
  ELSE scheme || '://' || host || CASE WHEN port = '' OR port = own_port THEN '' ELSE ':' || port END || place || asked END AS url FROM r""")
def intake_urls(spark, d):
    return carried(spark, d, _URLS).select("page_id", W.intake_url(F.col("url"))["url"].alias("url"))


@query(_PARTS + "SELECT page_id, scheme || '://' || authority || '/robots.txt' AS robots, lower(path) LIKE '%.pdf' AS pdf, CASE WHEN raw_host <> '' THEN raw_host END AS root, regexp_replace(host, '^www\\.', '') IN ('example.com', 'ththin.example.com') AS same FROM r WHERE authority <> ''")
def link_parts(spark, d):
    url = F.col("url")
    rows = carried(spark, d, _URLS).filter(W.url_parts(url)["authority"] != "")
    same = U.same_site(url, F.lit("example.com")) | U.same_site(url, F.lit("ththin.example.com"))
    return rows.select("page_id", W.robots_url(url).alias("robots"), W.is_pdf(url).alias("pdf"), W.root_host(url).alias("root"), F.coalesce(same, F.lit(False)).alias("same"))


_DOMAINS = """SELECT page_id, CASE page_id % 9 WHEN 0 THEN ' Example.COM. ' WHEN 1 THEN 'a..b' WHEN 2 THEN '-x.com' WHEN 3 THEN 'http://x.com' WHEN 4 THEN 'x.com/y' WHEN 5 THEN '' WHEN 6 THEN 'x_y.com' WHEN 7 THEN 'sub' || page_id || '.example.org' ELSE 'me@x.com' END AS one,
  CASE WHEN page_id % 7 = 0 THEN 'sub' || page_id || '.example.org' ELSE 'other.example' END AS two, page_id % 5 AS since, page_id % 3 AS until FROM {pages}"""


@query("WITH c AS (" + plain(_DOMAINS) + r"""), n AS (SELECT *, rtrim(lower(trim(one)), '.') AS x FROM c),
v AS (SELECT *, CASE WHEN x <> '' AND NOT regexp_matches(x, '[/@:]') AND len(list_filter(string_split(x, '.'), lambda p: NOT regexp_matches(p, '^[a-z0-9]([a-z0-9-]*[a-z0-9])?$'))) = 0 THEN x END AS domain FROM n)
SELECT page_id, domain, CASE WHEN domain IS NULL THEN 'search_domain_invalid' WHEN domain = two THEN 'search_domains_not_unique' END AS list_code, CASE WHEN domain = two THEN 'search_domain_conflict' WHEN since > until THEN 'search_dates_reversed' END AS filter_code FROM v""")
def search_domains(spark, d):
    rows = carried(spark, d, _DOMAINS).withColumn("domain", W.search_domain(F.col("one")))
    lists, filters = W.domain_list(F.array("one", "two")), W.search_filters(F.array("domain"), F.array("two"), F.col("since"), F.col("until"))
    return rows.select("page_id", "domain", lists["code"].alias("list_code"), filters.alias("filter_code"))


_ADDRESSES = {
    "8.8.8.8": None, "1.1.1.1": None, "10.0.0.1": "non_public_ip_address", "127.0.0.1": "non_public_ip_address", "169.254.169.254": "non_public_ip_address", "172.16.0.9": "non_public_ip_address",
    "192.168.1.1": "non_public_ip_address", "100.64.0.1": "non_public_ip_address", "0.0.0.0": "non_public_ip_address", "224.0.0.1": "non_public_ip_address", "255.255.255.255": "non_public_ip_address",
    "203.0.113.9": "non_public_ip_address", "256.1.1.1": "invalid_ip_address", "x": "invalid_ip_address", "2606:4700:4700::1111": None, "::1": "non_public_ip_address", "fe80::1": "non_public_ip_address",
    "fc00::1": "non_public_ip_address", "::ffff:8.8.8.8": "non_public_ip_address", "2002:808:808::1": "non_public_ip_address", "64:ff9b::808:808": "non_public_ip_address", "64:ff9b:1::1": "non_public_ip_address",
    "2001:0:1::1": "non_public_ip_address", "ff02::1": "non_public_ip_address", "2001:db8::1": "non_public_ip_address",
}
_CODES = ", ".join(f"('{a}', {'NULL' if c is None else repr(c)})" for a, c in _ADDRESSES.items())


@query(f"WITH a AS (SELECT * FROM (VALUES {_CODES}) AS t(address, code)) SELECT c_custkey, t.address, t.code FROM customer, a AS t WHERE c_custkey % {len(_ADDRESSES)} = (SELECT count(*) FROM a AS b WHERE b.address < t.address)")
def public_addresses(spark, d):
    every = F.array(*map(F.lit, sorted(_ADDRESSES)))
    rows = spark.read.parquet(f"{d}/customer.parquet").withColumn("address", F.element_at(every, (F.col("c_custkey") % len(_ADDRESSES) + 1).cast("int")))
    return rows.select("c_custkey", "address", W.public_address(F.col("address")).alias("code"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'dns_resolution_failed' WHEN 1 THEN NULL WHEN 2 THEN 'too_many_dns_answers' ELSE 'non_public_ip_address' END AS code FROM customer""")
def dns_answers(spark, d):
    key = F.col("c_custkey")
    many = F.transform(F.sequence(F.lit(1), F.lit(17)), lambda k: F.concat(F.lit("8.8.4."), k.cast("string")))
    answers = F.when(key % 4 == 0, F.array().cast("array<string>")).when(key % 4 == 1, F.array(F.lit("8.8.8.8"), F.lit("8.8.8.8"))).when(key % 4 == 2, many).otherwise(F.array(F.lit("8.8.8.8"), F.lit("10.1.1.1"), F.lit("zz")))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", W.answers_code(answers).alias("code"))


_ANSWERS = """SELECT event_id, CASE event_id % 11 WHEN 0 THEN 401 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 WHEN 4 THEN 302 WHEN 5 THEN 451 ELSE 200 END AS status,
  CASE event_id % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/plain' ELSE 'text/html' END AS kind, (event_id * 7919) % 3000000 AS size, event_id % 13 <> 0 AS same, event_id % 17 <> 0 AS allowed, event_id % 8 AS delay FROM {events}"""


@query("WITH c AS (" + plain(_ANSWERS) + """) SELECT event_id, CASE WHEN status IN (401, 403, 407, 451) THEN 'page_access_denied' WHEN status = 429 THEN 'page_rate_limited' WHEN status >= 500 THEN 'page_unavailable' WHEN status NOT BETWEEN 200 AND 299 THEN 'page_http_error'
WHEN size > 2097152 THEN 'page_response_too_large' WHEN kind = 'application/pdf' THEN 'page_binary_scan_required' WHEN kind = 'image/png' THEN 'page_content_type_not_parseable' END AS page, status NOT IN (401, 451) AND (status = 429 OR status >= 500) AS again,
CASE WHEN NOT same THEN 'page_robots_offsite_redirect' WHEN status IN (401, 451) THEN 'page_robots_denied' WHEN status = 429 OR status >= 500 THEN 'page_robots_unavailable' WHEN status = 404 THEN NULL WHEN status = 302 THEN 'page_robots_http_error'
WHEN kind NOT IN ('text/plain', 'text/html') THEN 'page_robots_content_type' WHEN size > 262144 THEN 'page_robots_too_large' WHEN NOT allowed THEN 'page_robots_denied' WHEN delay > 5 THEN 'page_robots_delay_exceeds_limit' END AS robots,
CASE WHEN same AND status = 404 THEN 'absent' WHEN same AND status = 200 AND kind IN ('text/plain', 'text/html') AND size <= 262144 AND allowed AND delay <= 5 THEN 'allowed' END AS robots_status FROM c""")
def page_answers(spark, d):
    c = F.col
    page, robots = W.page_code(c("status"), c("kind"), c("size")), W.robots_outcome(c("status"), c("same"), c("kind"), c("size"), c("allowed"), c("delay"))
    return carried(spark, d, _ANSWERS).select("event_id", page["code"].alias("page"), F.coalesce(page["retryable"], F.lit(False)).alias("again"), robots["code"].alias("robots"), robots["status"].alias("robots_status"))


_HEADERS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' Text/HTML; charset=utf-8' WHEN 1 THEN 'image/png' WHEN 2 THEN NULL ELSE 'application/pdf' END AS kind, CASE event_id % 6 WHEN 0 THEN 'gzip' WHEN 1 THEN 'Identity' WHEN 2 THEN '' END AS encoding,
  CASE event_id % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '-1' WHEN 2 THEN '99999999999' WHEN 3 THEN ' 12 ' END AS size, CAST(event_id % 4 AS DOUBLE) AS own, event_id % 3 AS requests FROM {events}"""


@query("WITH c AS (" + plain(_HEADERS) + """), k AS (SELECT *, lower(trim(split_part(coalesce(kind, ''), ';', 1))) AS t FROM c)
SELECT event_id, CASE WHEN t NOT IN ('text/html', 'application/pdf') THEN 'content_type_not_allowed' WHEN encoding = 'gzip' THEN 'content_encoding_not_allowed' WHEN size = 'abc' THEN 'invalid_content_length' WHEN size IN ('-1', '99999999999') THEN 'response_too_large' END AS code,
greatest(CASE WHEN own = 0 THEN 1.5 ELSE own END, CASE WHEN requests > 0 THEN 5.0 / requests ELSE 0 END)::DOUBLE AS delay FROM k""")
def response_headers(spark, d):
    c = F.col
    delay = W.robots_delay(F.when(c("own") != 0, c("own")), F.lit(1.5), F.lit(5.0), c("requests"))
    return carried(spark, d, _HEADERS).select("event_id", W.header_code(c("kind"), c("encoding"), c("size"), 10 << 20).alias("code"), delay.alias("delay"))
