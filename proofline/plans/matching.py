"""Queries of the matching, identifier and rule operators, each with SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import identifiers as I
from proofline.operators import matching as M

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pad(c, n):
    return F.lpad(c.cast("string"), n, "0")


_CARRIER = "'Legal name: ' || c_name || ' CIN: u' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') || 'MH' || (2000 + c_custkey % 25) || 'PTC' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') || ' GSTIN 27ABCDE' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'F1Z5 NSE: ' || c_mktsegment || ' bse code - X' || c_nationkey || ' end'"


@query(f"""WITH c AS (SELECT c_custkey, {_CARRIER} AS t FROM customer) SELECT c_custkey, upper(regexp_extract(t, '(?i)[UL][0-9]{{5}}[A-Z]{{2}}[0-9]{{4}}[A-Z]{{3}}[0-9]{{6}}')) AS cins, upper(regexp_extract(t, '(?i)[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][1-9A-Z]Z[A-Z0-9]')) AS gstins,
'NSE:' || regexp_extract(t, 'NSE: (\\S+)', 1) || ',BSE:' || regexp_extract(t, 'bse code - (\\S+)', 1) AS tickers FROM c""")
def identifier_extract(spark, d):
    key = F.col("c_custkey")
    text = F.concat(
        F.lit("Legal name: "), "c_name", F.lit(" CIN: u"), _pad(key % 100000, 5), F.lit("MH"), (2000 + key % 25).cast("string"), F.lit("PTC"), _pad(key % 1000000, 6),
        F.lit(" GSTIN 27ABCDE"), _pad(key % 10000, 4), F.lit("F1Z5 NSE: "), "c_mktsegment", F.lit(" bse code - X"), "c_nationkey", F.lit(" end"),
    )
    joined = lambda a: F.array_join(a, ",")
    return _t(spark, d, "customer").select("c_custkey", joined(I.found(text, I.CIN)).alias("cins"), joined(I.found(text, I.GSTIN)).alias("gstins"), joined(I.tickers(text)).alias("tickers"))


_STOP = ["floor", "road", "no"]


@query("""WITH a AS (SELECT c_custkey, 'Floor ' || c_nationkey || ' ' || c_mktsegment || ' Tower, MG Road, Pune ' || (c_custkey % 5 + 10) AS site, c_mktsegment || ' tower pune ' || (c_custkey % 3 + 10) || CASE WHEN c_custkey % 2 = 0 THEN ' sector nine block west gate far' ELSE '' END AS master, CASE WHEN c_custkey % 7 = 0 THEN 'Goa' WHEN c_custkey % 7 = 1 THEN 'PUNE' END AS state FROM customer),
t AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(site), '[a-z0-9]+'), lambda v: length(v) > 1 AND v NOT IN ('floor', 'road', 'no'))) AS x, list_distinct(list_filter(regexp_extract_all(lower(master), '[a-z0-9]+'), lambda v: length(v) > 1 AND v NOT IN ('floor', 'road', 'no'))) AS y FROM a)
SELECT c_custkey, (state IS NULL OR contains(lower(site), lower(state))) AND len(list_intersect(x, y)) >= 3 AND len(list_intersect(x, y)) * 2 >= least(len(x), len(y)) AS matches FROM t""")
def address_overlap(spark, d):
    key = F.col("c_custkey")
    site = F.concat(F.lit("Floor "), "c_nationkey", F.lit(" "), "c_mktsegment", F.lit(" Tower, MG Road, Pune "), key % 5 + 10)
    master = F.concat("c_mktsegment", F.lit(" tower pune "), key % 3 + 10, F.when(key % 2 == 0, " sector nine block west gate far").otherwise(""))
    state = F.when(key % 7 == 0, "Goa").when(key % 7 == 1, "PUNE")
    return _t(spark, d, "customer").select("c_custkey", I.addresses_match(site, master, state, _STOP).alias("matches"))


_KINDS, _STATUSES = ["Private limited", "One Person Company", "Public", "Trust", None], ["Active", "Struck Off", "Under liquidation", None, "Dissolved", "Amalgamated"]


@query("""WITH c AS (SELECT c_custkey, ['Private limited', 'One Person Company', 'Public', 'Trust', NULL][c_custkey % 5 + 1] AS k, ['Active', 'Struck Off', 'Under liquidation', NULL, 'Dissolved', 'Amalgamated'][c_custkey % 6 + 1] AS s, c_custkey % 11 = 0 AS listed FROM customer)
SELECT c_custkey, CASE WHEN listed THEN 'listed' WHEN k IN ('Private limited', 'One Person Company') THEN 'private' WHEN k = 'Public' THEN 'public_unlisted' END AS class, coalesce(s IN ('Struck Off', 'Under liquidation', 'Dissolved'), false) AS inactive FROM c""")
def company_classes(spark, d):
    key = F.col("c_custkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    number = F.when(key % 11 == 0, "L1").otherwise("U1")
    return _t(spark, d, "customer").select("c_custkey", I.company_class(number, pick(_KINDS), F.lit(None).cast("boolean")).alias("class"), I.inactive(pick(_STATUSES)).alias("inactive"))


@query("""WITH r AS (SELECT c_custkey AS cin, c_name AS legal_name, c_mktsegment || ' ' || c_custkey % 50 || ' pvt. ltd.' AS former FROM customer), s AS (SELECT s_suppkey AS signal_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS cin, CASE WHEN s_suppkey % 3 = 1 THEN upper(replace(s_name, 'Supplier', 'Customer')) ELSE 'FURNITURE ' || s_suppkey % 50 || ' Private Limited' END AS name FROM supplier)
SELECT signal_id, r.cin FROM s JOIN r ON s.cin = r.cin UNION ALL SELECT signal_id, r.cin FROM s JOIN r ON s.cin IS NULL AND (lower(s.name) = lower(legal_name) OR lower(s.name) = lower(replace(former, ' pvt. ltd.', ' private limited')))""")
def signal_match(spark, d):
    key = F.col("s_suppkey")
    records = _t(spark, d, "customer").select(F.col("c_custkey").alias("cin"), F.col("c_name").alias("legal_name"), F.array(F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey") % 50, F.lit(" pvt. ltd."))).alias("former_names"))
    name = F.when(key % 3 == 1, F.upper(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")))).otherwise(F.concat(F.lit("FURNITURE "), key % 50, F.lit(" Private Limited")))
    return M.match_signals(_t(spark, d, "supplier").select(key.alias("signal_id"), F.when(key % 3 == 0, key).alias("cin"), name.alias("name")), records)


_CODES = [200, 404, 400, 401, 403, 429, 500, 599, 302]


@query(f"""WITH e AS (SELECT event_id, {_CODES}[event_id % 9 + 1] AS s, event_id % 2 = 0 AS json FROM events) SELECT event_id, CASE WHEN s = 404 THEN 'no_approved_capacity' WHEN s = 200 AND json THEN NULL WHEN s = 200 THEN 'model_response_invalid' WHEN s = 400 THEN 'model_invalid_request' WHEN s IN (401, 403) THEN 'model_unauthorized' WHEN s = 429 THEN 'model_rate_limited' WHEN s >= 500 THEN 'model_unavailable' ELSE 'model_http_error' END AS code, CASE WHEN s = 200 AND json THEN NULL ELSE s IN (404, 429) OR s >= 500 END AS retryable FROM e""")
def http_failures(spark, d):
    status = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("event_id") % 9 + 1).cast("int"))
    media = F.when(F.col("event_id") % 2 == 0, " Application/JSON ; charset=utf-8").otherwise("text/html")
    return _t(spark, d, "events").select("event_id", I.http_failure(status, media).alias("f")).select("event_id", "f.code", "f.retryable")


@query("SELECT event_id, event_id % 3 = 0 AS exact FROM events")
def payload_shapes(spark, d):
    payload = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, '{"k": 1, "x": 2}')
    return _t(spark, d, "events").select("event_id", I.exact_keys(payload, ["k"]).alias("exact"))


@query("""SELECT o_orderkey, unnest(list_filter([CASE WHEN length(o_orderpriority) NOT BETWEEN 5 AND 8 THEN 'priority_length' END, CASE WHEN o_orderkey % 4 = 0 AND o_totalprice >= 100000 THEN 'needs_evidence' END, CASE WHEN o_orderkey % 5 = o_custkey % 5 THEN 'ids_unique' END], lambda v: v IS NOT NULL)) AS rule FROM orders""")
def row_violations(spark, d):
    key = F.col("o_orderkey")
    ids = F.array(key % 5, F.col("o_custkey") % 5)
    rules = {
        "priority_length": F.char_length("o_orderpriority").between(5, 8),
        "needs_evidence": (key % 4 != 0) | (F.col("o_totalprice") < 100000),
        "ids_unique": F.size(ids) == F.size(F.array_distinct(ids)),
    }
    return M.violations(_t(spark, d, "orders"), ["o_orderkey"], rules)


@query("SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 4 = 0 GROUP BY 1, 2 HAVING count(*) > 1")
def active_duplicates(spark, d):
    return M.more_than_one(_t(spark, d, "events"), ["user_id", "event_type"], F.col("event_id") % 4 == 0)


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1 HAVING count(*) > 1")
def open_order_duplicates(spark, d):
    """F13 with an active status as the reference has it; ``active_duplicates`` looks at a quarter of the ids."""
    return M.more_than_one(_t(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus").isin("O", "P"))


@query("SELECT DISTINCT o_orderkey % 97 AS job_id, o_orderkey AS claim_id, u.id AS evidence_id FROM orders, LATERAL (SELECT unnest([o_orderkey % 50, o_custkey % 60]) AS id) u WHERE u.id >= 45")
def unknown_evidence(spark, d):
    claims = _t(spark, d, "orders").select((F.col("o_orderkey") % 97).alias("job_id"), F.col("o_orderkey").alias("claim_id"), F.array(F.col("o_orderkey") % 50, F.col("o_custkey") % 60).alias("ids"))
    known = spark.range(97).select(F.col("id").alias("job_id"), F.explode(F.sequence(F.lit(0), F.lit(44)).cast("array<bigint>")).alias("evidence_id"))
    return M.unknown_members(claims, "job_id", "claim_id", "ids", known, "evidence_id")


@query("SELECT user_id, event_id % 13 AS stage, count(*) AS writes, count(DISTINCT props) > 1 AS conflict FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def checkpoint_conflicts(spark, d):
    rows = _t(spark, d, "events").select("user_id", (F.col("event_id") % 13).alias("stage"), F.sha2("props", 256).alias("digest"))
    return M.conflicting_writes(rows, ["user_id", "stage"], "digest")


@query("WITH p AS (SELECT doc_id, count(*) AS tests, count(*) FILTER (quality = 1) AS passes FROM labels GROUP BY 1) SELECT CASE WHEN tests IS NULL THEN 'untested' WHEN passes = tests THEN 'passing' ELSE 'failing' END AS status, count(*) AS n FROM documents LEFT JOIN p USING (doc_id) GROUP BY 1")
def traceability_counts(spark, d):
    results = _t(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"))
    return M.requirement_status(_t(spark, d, "documents").select("doc_id"), results, "doc_id").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT user_id, array_to_string(list(event_id ORDER BY event_id), ',') AS values FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 20 GROUP BY 1")
def ordered_members(spark, d):
    return M.in_order(_t(spark, d, "events"), "user_id", "event_id", "event_id", 20)


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, event_id AS value FROM events")
def ordered_positions(spark, d):
    """``ordered_members`` ends at 20 values of a key; this gives all, a row each."""
    return M.positions(_t(spark, d, "events"), "user_id", "event_id", "event_id")


@query(r"SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, '.')[1:5], lambda p: substr(trim(regexp_replace(p, '\s+', ' ', 'g')), 1, 2000)), lambda p: p <> ''), '|') AS passages FROM conversations WHERE len(list_distinct(list_transform(string_split(text, '.')[1:5], lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))))) = len(string_split(text, '.')[1:5])")
def passage_highlights(spark, d):
    cut = F.split("text", r"\.")
    first = F.transform(F.slice(cut, 1, 5), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    plain = F.size(F.array_distinct(first)) == F.size(first)
    return _t(spark, d, "conversations").filter(plain).select("conv_id", "turn", F.array_join(I.highlights(cut), "|").alias("passages"))


@query(r"WITH p AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, '.')[1:5], lambda p: substr(trim(regexp_replace(p, '\s+', ' ', 'g')), 1, 2000)), lambda p: p <> '') AS l FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS passages FROM p")
def all_passage_highlights(spark, d):
    """``passage_highlights`` leaves out texts with repeated passages; this has them all."""
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(I.highlights(F.split("text", r"\.")), "|").alias("passages"))
