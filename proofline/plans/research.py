"""Queries of research stages: jobs are customers, and their orders what each stage's search has found."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import research as R
from proofline.plans.common import Registry, carried, plain

query = Registry()

STAGES = tuple(R.STAGE_SEARCHES_PAGES)
_STAGE = "CASE {0} % 6 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(STAGES)) + " END"
_RESULTS = "SELECT o_custkey % 200 AS job_id, " + _STAGE.format("o_orderkey") + " AS stage, o_orderkey AS place, 'https://r.example.com/' || o_orderkey AS url FROM {orders}"
_PAGES = "SELECT 'https://r.example.com/' || o_orderkey AS url, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5 > 0 END AS readable, CASE WHEN o_orderkey % 11 > 0 THEN CAST(1 + o_custkey % 5 AS INT) END AS tier FROM {orders} WHERE o_orderkey % 13 > 0"
_RUNS = "SELECT DISTINCT o_custkey % 200 AS job_id, " + _STAGE.format("o_orderkey") + " AS stage, 9000 + o_custkey % 200 % 37 * 1000 AS input_tokens, 1000 + o_custkey % 200 % 29 * 250 AS output_tokens, CAST(o_custkey % 200 % 23 AS DOUBLE) AS cost_inr FROM {orders} WHERE o_orderkey % 4 > 0"
#: Pages to fetch a stage, and limits of a job and a stage that some jobs reach.
PLAN = dict(zip(STAGES, (3, 4, 2, 5, 3, 4), strict=True))
JOB = {"searches": 6, "pages": 17, "model_calls": 6, "input_tokens": 150_000, "output_tokens": 30_000, "cost_inr": 90}
OWN = {s: {"searches": 1, "pages": 4, "model_calls": 1, "input_tokens": 42_000, "output_tokens": 7_500, "cost_inr": 20} for s in STAGES}


def _order(stage: str) -> str:
    return f"CASE {stage} " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(STAGES)) + " END"


_PLAN = "CASE n " + " ".join(f"WHEN {k} THEN {min(p, 4)}" for k, p in enumerate(PLAN.values())) + " END"
_SQL = "WITH RECURSIVE r0 AS (" + plain(_RESULTS) + "), p0 AS (" + plain(_PAGES) + "), u0 AS (" + plain(_RUNS) + f"""), r AS (SELECT job_id, {_order('stage')} AS n, row_number() OVER (PARTITION BY job_id, stage ORDER BY place, url) AS k, coalesce(readable, false) AND tier IS NOT NULL AS ok, tier FROM r0 LEFT JOIN p0 USING (url)),
c AS (SELECT job_id, n, k, count(*) FILTER (ok) OVER w AS admitted, count(*) FILTER (ok AND tier <= 4) OVER w AS cited FROM r WINDOW w AS (PARTITION BY job_id, n ORDER BY k)), m AS (SELECT job_id, n, max(k) AS most FROM r GROUP BY 1, 2),
u AS (SELECT job_id, {_order('stage')} AS n, input_tokens, output_tokens, cost_inr FROM u0),
s AS (SELECT job_id, -1 AS n, 0.0::DOUBLE AS searches, 0.0::DOUBLE AS pages, 0.0::DOUBLE AS calls, 0.0::DOUBLE AS tin, 0.0::DOUBLE AS tout, 0.0::DOUBLE AS cost, 0::BIGINT AS fetched, 0::BIGINT AS admitted, 0::BIGINT AS cited, NULL::VARCHAR AS code FROM (SELECT DISTINCT job_id FROM r0)
  UNION ALL SELECT job_id, n, searches + 1, pages + fetched, calls + (weak IS NULL)::INT, tin + CASE WHEN weak IS NULL AND tokens IS NULL THEN i ELSE 0 END, tout + CASE WHEN weak IS NULL AND tokens IS NULL THEN o ELSE 0 END, cost + CASE WHEN weak IS NULL AND tokens IS NULL AND spent IS NULL THEN x ELSE 0 END,
    fetched, admitted, cited, coalesce(weak, tokens, spent) FROM (
    SELECT *, CASE WHEN admitted = 0 THEN 'research_no_admitted_evidence' WHEN cited = 0 THEN 'research_model_evidence_tier_unsupported' END AS weak,
      CASE WHEN tin + i > 150000 THEN 'budget_input_tokens_exhausted' WHEN i > 42000 THEN 'budget_stage_input_tokens_exhausted' WHEN tout + o > 30000 THEN 'budget_output_tokens_exhausted' WHEN o > 7500 THEN 'budget_stage_output_tokens_exhausted' END AS tokens,
      CASE WHEN cost + x > 90 THEN 'budget_model_cost_exhausted' WHEN x > 20 THEN 'budget_stage_cost_exhausted' END AS spent FROM (
      SELECT f.*, coalesce(c.admitted, 0) AS admitted, coalesce(c.cited, 0) AS cited, coalesce(u.input_tokens, 0) AS i, coalesce(u.output_tokens, 0) AS o, coalesce(u.cost_inr, 0) AS x FROM (
        SELECT g.job_id, g.n, searches, pages, calls, tin, tout, cost, least(coalesce(m.most, 0), {_PLAN.replace('n ', 'g.n ', 1)}, 17 - pages)::BIGINT AS fetched FROM (SELECT * REPLACE (n + 1 AS n) FROM s WHERE code IS NULL AND n < 5) g LEFT JOIN m ON m.job_id = g.job_id AND m.n = g.n) f
      LEFT JOIN c ON c.job_id = f.job_id AND c.n = f.n AND c.k = f.fetched LEFT JOIN u ON u.job_id = f.job_id AND u.n = f.n)))
SELECT job_id, [{", ".join(f"'{s}'" for s in STAGES)}][n + 1] AS stage, searches AS searches_used, pages AS pages_used, calls AS model_calls_used, tin AS input_tokens_used, tout AS output_tokens_used, cost AS cost_inr_used, fetched, admitted, cited, code FROM s WHERE n >= 0"""


@query(_SQL)
def research_stages(spark, d):
    results = carried(spark, d, _RESULTS)
    return R.research(results.select("job_id"), results, carried(spark, d, _PAGES), carried(spark, d, _RUNS), PLAN, JOB, OWN)[0]
