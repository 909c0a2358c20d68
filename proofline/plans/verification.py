"""Queries of claim verification with every rule, over claims derived from all orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import claims as C
from proofline.operators.steps import Steps
from proofline.plans.common import Registry, carried, plain

query = Registry()

_CLAIM_ROWS = """SELECT o_orderkey % 97 AS job_id, 'e' || (o_orderkey % 97) AS entity_id, o_orderkey AS claim_id, o_orderkey AS ord, CASE WHEN o_orderkey % 4 = 0 THEN ' PART  ' ELSE 'Part ' END || (o_custkey % 10) AS subject, o_orderstatus AS predicate,
  CASE o_orderkey % 3 WHEN 0 THEN '2023/24' WHEN 1 THEN ' 2023-24' END AS period, CASE o_orderkey % 8 WHEN 0 THEN 'Rs 5 crore' WHEN 1 THEN 'INR 50000000' WHEN 2 THEN '50 Million' WHEN 3 THEN '12.5%' WHEN 4 THEN '12.5 percent' WHEN 5 THEN 'Rs. five' WHEN 6 THEN 'inr five' ELSE '7 lakhs inr' END AS object,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 50 END AS first_id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey % 60 END AS second_id, o_orderkey % 2 = 0 AS is_material, CASE WHEN o_custkey % 11 = 0 THEN 'stale' ELSE 'current' END AS freshness FROM {orders}"""
_CLAIM_SQL = "WITH c AS (SELECT * EXCLUDE (first_id, second_id), CASE WHEN first_id IS NULL THEN []::BIGINT[] ELSE [first_id, second_id] END AS evidence_ids FROM (" + plain(_CLAIM_ROWS) + r""")),
e AS (SELECT j.job_id, s.i AS evidence_id, CASE s.i % 7 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE 'e' || j.job_id END AS entity_id, (s.i % 5 + 1)::INT AS source_tier, 20200000 + (s.i * 37 + j.job_id) % 1000 AS published, s.i % 13 = 0 AS suspected
      FROM (SELECT unnest(range(0, 97)) AS job_id) j, (SELECT unnest(range(0, 55)) AS i) s),
u AS (SELECT job_id, claim_id, entity_id, unnest(evidence_ids) AS id FROM c),
x AS (SELECT c.job_id, c.claim_id, count(u.id) FILTER (e.evidence_id IS NULL) AS n_unknown, count(e.evidence_id) AS n_known, count(*) FILTER (e.entity_id <> c.entity_id) AS n_other, count(*) FILTER (e.suspected) AS n_suspected,
        count(*) FILTER (e.source_tier >= 4) AS n_weak, coalesce(min(e.source_tier), 5) AS strongest, max(e.published) AS latest FROM c LEFT JOIN u USING (job_id, claim_id) LEFT JOIN e ON e.job_id = c.job_id AND e.evidence_id = u.id GROUP BY 1, 2),
r AS (SELECT c.*, x.* EXCLUDE (job_id, claim_id), list_filter([CASE WHEN n_unknown > 0 THEN 'evidence_reference_unknown' END, CASE WHEN n_other > 0 THEN 'evidence_entity_mismatch' END, CASE WHEN is_material AND len(evidence_ids) = 0 THEN 'material_claim_without_evidence' END,
        CASE WHEN freshness = 'stale' THEN 'claim_stale' END, CASE WHEN n_known > 0 AND n_suspected = n_known THEN 'all_supporting_evidence_prompt_suspected' END, CASE WHEN is_material AND n_known > 0 AND n_weak = n_known THEN 'material_claim_source_too_weak' END], lambda v: v IS NOT NULL) AS rs,
        lower(trim(regexp_replace(subject, '\s+', ' ', 'g'))) AS s, lower(predicate) AS p, replace(trim(coalesce(period, '')), '/', '-') AS t, lower(object) AS o0 FROM c JOIN x USING (job_id, claim_id)),
n AS (SELECT *, regexp_extract(o0, '^((inr|rs\.?)\s*)?([0-9]+(\.[0-9]+)?)\s*(crore|lakhs|million|percent|%)?\s*(inr)?$', 3) AS amount, regexp_extract(o0, '^((inr|rs\.?)\s*)?([0-9]+(\.[0-9]+)?)\s*(crore|lakhs|million|percent|%)?\s*(inr)?$', 5) AS unit FROM r),
k AS (SELECT *, CASE WHEN amount = '' THEN replace(replace(o0, 'rs. ', 'inr '), 'rs ', 'inr ') WHEN unit IN ('percent', '%') THEN 'percent:' || amount::DOUBLE
        ELSE 'number:' || (amount::DOUBLE * CASE unit WHEN 'crore' THEN 1e7 WHEN 'lakhs' THEN 1e5 WHEN 'million' THEN 1e6 ELSE 1 END) END AS o FROM n),
d AS (SELECT *, row_number() OVER (PARTITION BY job_id, s, p, t, o ORDER BY ord) > 1 AS again FROM k),
g AS (SELECT *, CASE WHEN again THEN list_append(rs, 'duplicate_claim') ELSE rs END AS rs2, CASE WHEN again THEN 'rejected' WHEN len(rs) = 0 THEN 'approved' WHEN rs = ['material_claim_source_too_weak'] THEN 'pending' ELSE 'rejected' END AS st FROM d),
f AS (SELECT *, st <> 'rejected' AS live, st <> 'rejected' AND min(o) OVER w <> max(o) OVER w AS disputed, rank() OVER (w ORDER BY strongest, latest DESC NULLS LAST) AS place, min(strongest) OVER w AS best, max(strongest) OVER w AS worst
      FROM g WINDOW w AS (PARTITION BY job_id, s, p, t, st <> 'rejected')),
h AS (SELECT *, CASE WHEN NOT disputed THEN NULL WHEN count(*) FILTER (place = 1) OVER w > 1 THEN 'disclose_as_conflict' WHEN best >= 5 THEN 'convert_to_question' WHEN worst <> best THEN 'prefer_stronger_source' ELSE 'prefer_later' END AS resolution
      FROM f WINDOW w AS (PARTITION BY job_id, s, p, t, live)),
v AS (SELECT *, CASE WHEN resolution LIKE 'prefer%' AND place > 1 THEN 'rejected' WHEN resolution IS NOT NULL AND resolution NOT LIKE 'prefer%' THEN 'conflicted' ELSE st END AS status,
        list_concat(rs2, list_filter([CASE WHEN resolution LIKE 'prefer%' AND place > 1 THEN 'contradicted_by_preferred_claim' END, CASE WHEN resolution IS NOT NULL AND resolution NOT LIKE 'prefer%' THEN 'unresolved_contradiction' END,
          CASE WHEN resolution LIKE 'prefer%' AND len(rs2) = 0 THEN 'resolved_contradiction' END], lambda q: q IS NOT NULL)) AS reasons FROM h),
i AS (SELECT job_id, resolution, entity_id, s, p, t, list_sort(list(claim_id::VARCHAR)) AS claim_ids, list_sort(list_distinct(flatten(list(evidence_ids::VARCHAR[])))) AS evidence_ids, CASE WHEN bool_or(is_material) THEN 'high' ELSE 'medium' END AS severity FROM v WHERE disputed GROUP BY ALL),
y AS (SELECT *, sha1(unhex('2d76f1d14e284c1e9a931c7ef6f53e17') || encode(job_id || ':' || entity_id || ':(''' || s || ''', ''' || p || ''', ''' || t || '''):' || array_to_string(claim_ids, ','))) AS z FROM i),
w AS (SELECT *, substr(z, 1, 8) || '-' || substr(z, 9, 4) || '-5' || substr(z, 14, 3) || '-' || lower(printf('%x', (('0x' || substr(z, 17, 2))::INT & 63) | 128)) || substr(z, 19, 2) || '-' || substr(z, 21, 12) AS contradiction_id FROM y)
"""


def _verified(spark, d, nulls=False):
    rows = carried(spark, d, _CLAIM_ROWS)
    none = F.array().cast("array<bigint>")
    none = F.when(F.col("claim_id") % 12 != 0, none) if nulls else none
    ids = F.when(F.col("first_id").isNull(), none).otherwise(F.array("first_id", "second_id"))
    i, job = F.col("evidence_id"), F.col("job_id")
    jobs = spark.range(97).select(F.col("id").alias("job_id"), F.explode(F.sequence(F.lit(0), F.lit(54)).cast("array<bigint>")).alias("evidence_id"))
    entity = F.when(i % 7 == 0, F.lit(None)).when(i % 7 == 1, "other").otherwise(F.concat(F.lit("e"), job))
    evidence = jobs.select(job, i, entity.alias("entity_id"), (i % 5 + 1).cast("int").alias("source_tier"), (20200000 + (i * 37 + job) % 1000).alias("published"), (i % 13 == 0).alias("suspected"))
    return C.verified(rows.withColumn("evidence_ids", ids), evidence), evidence


@query(_CLAIM_SQL + "SELECT job_id, claim_id, status, array_to_string(reasons, ',') AS reasons, resolution FROM v")
def verified_claims(spark, d):
    return _verified(spark, d)[0].select("job_id", "claim_id", "status", F.array_join("reasons", ",").alias("reasons"), "resolution")


_NULLS_SQL = _CLAIM_SQL.replace("THEN []::BIGINT[] ELSE", "THEN CASE WHEN claim_id % 12 <> 0 THEN []::BIGINT[] END ELSE").replace("is_material AND len(evidence_ids) = 0", "is_material AND coalesce(len(evidence_ids), 0) = 0")


@query(_NULLS_SQL + "SELECT job_id, claim_id, evidence_ids IS NULL AS unstated, status, array_to_string(reasons, ',') AS reasons, resolution FROM v")
def unsupported_claims(spark, d):
    """As verified_claims, where half of the empty lists of evidence are null."""
    rows = _verified(spark, d, nulls=True)[0]
    return rows.select("job_id", "claim_id", F.col("evidence_ids").isNull().alias("unstated"), "status", F.array_join("reasons", ",").alias("reasons"), "resolution")


@query(_CLAIM_SQL + "SELECT job_id, contradiction_id, array_to_string(claim_ids, ',') AS claim_ids, array_to_string(evidence_ids, ',') AS evidence_ids, severity, resolution, resolution NOT LIKE 'prefer%' AS unresolved FROM w")
def contradiction_groups(spark, d):
    found = C.contradictions(_verified(spark, d)[0])
    return found.withColumns({c: F.array_join(c, ",") for c in ("claim_ids", "evidence_ids")})


_REPORT = _CLAIM_SQL + """, t0 AS (SELECT j.job_id, k.ord, 'topic ' || k.ord AS topic FROM (SELECT unnest(range(0, 97)) AS job_id) j, (SELECT unnest(range(0, 9)) AS ord) k),
t2 AS (SELECT t0.job_id, t0.ord, t0.topic, count(a.id) > 0 AS hit FROM t0 LEFT JOIN (SELECT DISTINCT job_id, unnest(evidence_ids) AS id FROM v WHERE status = 'approved') a ON a.job_id = t0.job_id AND a.id % 9 = t0.ord AND t0.ord < 8 AND a.id < 60 GROUP BY 1, 2, 3),
t3 AS (SELECT job_id, list(topic ORDER BY ord) FILTER (hit) AS covered, list(topic ORDER BY ord) FILTER (NOT hit) AS missing, round_even(100.0 * count(*) FILTER (hit) / count(*), 0)::BIGINT AS coverage_percent FROM t2 GROUP BY 1),
c1 AS (SELECT job_id, list_sort(list(claim_id::VARCHAR) FILTER (len(rs2) > 0)) AS unsupported, list_sort(list(claim_id::VARCHAR) FILTER (freshness = 'stale')) AS stale FROM v GROUP BY 1),
o1 AS (SELECT job_id, list_sort(list('contradiction:' || contradiction_id)) AS opened FROM w WHERE resolution NOT LIKE 'prefer%' GROUP BY 1),
e1 AS (SELECT job_id, list_sort(list(evidence_id::VARCHAR)) AS suspicious FROM e WHERE suspected GROUP BY 1),
z1 AS (SELECT t3.job_id, coverage_percent, coalesce(covered, []) AS covered, coalesce(missing, []) AS missing, coalesce(unsupported, []) AS unsupported, coalesce(stale, []) AS stale, coalesce(suspicious, []) AS suspicious, list_concat(coalesce(missing, []), coalesce(opened, [])) AS gaps
       FROM t3 LEFT JOIN c1 USING (job_id) LEFT JOIN o1 USING (job_id) LEFT JOIN e1 USING (job_id))
SELECT job_id, coverage_percent, array_to_string(covered, ',') AS covered, array_to_string(missing, ',') AS missing, array_to_string(unsupported, ',') AS unsupported, array_to_string(stale, ',') AS stale, array_to_string(suspicious, ',') AS suspicious,
  array_to_string(gaps[1:20], ',') AS gaps, len(gaps) > 0 OR len(unsupported) > 0 AS more_research FROM z1"""


@query(_REPORT)
def coverage_reports(spark, d):
    rows, evidence = _verified(spark, d)
    rows = Steps(spark, "coverage").write(rows, "verified")  # the report reads them three times
    ids = F.filter(F.sequence(F.lit(0), F.lit(59)).cast("array<bigint>"), lambda i: (i % 9 == F.col("ord")) & (F.col("ord") < 8))
    topics = spark.range(97).select(F.col("id").alias("job_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("ord")).withColumn("topic", F.concat(F.lit("topic "), "ord")).withColumn("evidence_ids", ids)
    out = C.report(topics, rows, evidence)
    return out.withColumns({c: F.array_join(c, ",") for c in ("covered", "missing", "unsupported", "stale", "suspicious", "gaps")})


_SCOPES = """SELECT o_orderkey AS id, o_orderkey % 50 AS request_id, CASE WHEN o_orderkey % 701 = 0 THEN 99 ELSE o_orderkey % 50 END AS job_id, CASE WHEN o_orderkey % 499 = 0 THEN 'x' ELSE 'e' || (o_orderkey % 50) END AS entity_id FROM {orders}"""


@query("WITH c AS (" + plain(_SCOPES) + """) SELECT DISTINCT request_id AS job_id, 'claim_scope' AS rule FROM c WHERE job_id <> request_id OR entity_id <> 'e' || request_id UNION SELECT request_id, 'evidence_scope' FROM c WHERE job_id <> request_id
UNION SELECT request_id, 'evidence_ids_not_unique' FROM (SELECT request_id, id // 200 AS k FROM c GROUP BY 1, 2 HAVING count(*) > 1) UNION SELECT k, 'topics_not_unique' FROM (SELECT unnest(range(0, 50, 2)) AS k)""")
def verification_scopes(spark, d):
    rows = carried(spark, d, _SCOPES)
    requests = spark.range(50).select(F.col("id").alias("job_id"), F.concat(F.lit("e"), "id").alias("entity_id"))
    topics = spark.range(50).select(F.col("id").alias("job_id"), F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("topic"))
    return C.scope_errors(requests, rows, rows.withColumn("evidence_id", F.floor(F.col("id") / 200)), topics)


_ASSERTIONS = {
    "Rs 5 crore": "number:5.00000e+07", "INR 50000000": "number:5.00000e+07", "₹50 million": "number:5.00000e+07", "５０ million": "number:5.00000e+07", "12.5%": "percent:1.25000e+01", "12.5 PERCENT": "percent:1.25000e+01",
    "1,000": "1,000", "rs. five": "inr five", "Straße": "strasse", "  A   b ": "a b", "3 Lakh INR": "number:3.00000e+05", "7": "number:7.00000e+00", "2.5 billion": "number:2.50000e+09",
}


@query("SELECT c_custkey, v.assertion, v.key FROM customer JOIN (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(_ASSERTIONS.items())) + f") AS v(i, assertion, key) ON c_custkey % {len(_ASSERTIONS)} = v.i")
def assertion_keys(spark, d):
    every = F.array(*map(F.lit, _ASSERTIONS))
    rows = spark.read.parquet(f"{d}/customer.parquet").withColumn("assertion", F.element_at(every, (F.col("c_custkey") % len(_ASSERTIONS) + 1).cast("int")))
    return rows.select("c_custkey", "assertion", T.assertion_key(F.col("assertion")).alias("key"))
