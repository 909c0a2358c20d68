"""Queries of retention: reports are orders, their evidence lineitems, logs events; reports may rest on other reports."""

from __future__ import annotations

from proofline.operators import retention as R
from proofline.plans.common import Registry, carried, plain
from proofline.plans.entitlements import _ENTRIES

query = Registry()

NOW = 400
_ASSETS = """SELECT 'o' || o_orderkey AS asset_id, CASE WHEN o_orderkey % 23 = 0 THEN 'account' ELSE 'report' END AS kind, o_custkey AS owner_id, o_orderkey % 500 AS created_at, CASE WHEN o_orderkey % 41 = 0 THEN o_orderkey % 800 END AS expires_at, CASE WHEN o_orderkey % 31 = 0 THEN true WHEN o_orderkey % 3 = 0 THEN false END AS deleted FROM {orders}
UNION ALL SELECT 'l' || l_orderkey || '-' || l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'raw_page' WHEN 1 THEN 'evidence' ELSE 'letterhead' END, l_suppkey, CASE WHEN l_partkey % 9 > 0 THEN l_partkey % 420 END, CASE WHEN l_linenumber % 3 = 2 THEN l_partkey % 900 END, NULL FROM {lineitem}
UNION ALL SELECT 'e' || event_id, CASE event_type WHEN 'error' THEN 'failed_diagnostics' WHEN 'view' THEN 'audit_log' ELSE 'provider_log' END, user_id, event_id % 450, NULL, NULL FROM {events}"""
_LINKS = """SELECT 'o' || l_orderkey AS parent_id, 'l' || l_orderkey || '-' || l_linenumber AS child_id FROM {lineitem} UNION ALL SELECT 'o' || o_orderkey, 'o' || (2 * o_orderkey + 1) FROM {orders} UNION ALL SELECT 'o' || o_orderkey, 'o' || (o_orderkey - o_orderkey % 17) FROM {orders} WHERE o_orderkey % 5 = 0"""
_HOLDS = "SELECT c_custkey AS owner_id, c_custkey % 600 AS since, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 600 + 200 END AS until FROM {customer} WHERE c_custkey % 7 = 0"
_SQL = "WITH RECURSIVE a0 AS (" + plain(_ASSETS) + "), k AS (SELECT DISTINCT * FROM (" + plain(_LINKS) + ")), h AS (" + plain(_HOLDS) + """),
w AS (SELECT asset_id, kind, owner_id IN (SELECT owner_id FROM h WHERE since <= 400 AND (until IS NULL OR until > 400)) AS held,
  CASE WHEN deleted THEN 'deleted' WHEN expires_at <= 400 THEN 'expired' WHEN created_at + CASE kind WHEN 'raw_page' THEN 30 WHEN 'provider_log' THEN 90 WHEN 'audit_log' THEN 180 WHEN 'failed_diagnostics' THEN 30 WHEN 'letterhead' THEN 1 END <= 400 THEN 'aged' END AS reason FROM a0),
a AS (SELECT asset_id, min(kind) AS kind, bool_or(held) AS held, min(reason) AS reason FROM w GROUP BY 1),
c AS (SELECT asset_id, held, 0 AS depth FROM a WHERE reason IS NOT NULL UNION SELECT b.asset_id, b.held, c.depth + 1 FROM c JOIN k ON k.parent_id = c.asset_id JOIN a b ON b.asset_id = k.child_id WHERE NOT c.held AND b.reason IS NULL AND c.depth < 60)
SELECT a.asset_id, a.kind, CASE WHEN a.held THEN 'held' WHEN a.kind IN ('report', 'account') THEN 'tombstone' ELSE 'purge' END AS action, coalesce(a.reason, 'cascade') AS reason, d.depth FROM a JOIN (SELECT asset_id, min(depth) AS depth FROM c GROUP BY 1) d USING (asset_id)"""


@query(_SQL)
def retention_plan(spark, d):
    return R.purge_plan(carried(spark, d, _ASSETS), carried(spark, d, _LINKS), carried(spark, d, _HOLDS), NOW)


_JOBS = "SELECT o_custkey * 3 + o_orderkey % 3 AS request_id, o_orderstatus = 'P' AS active FROM {orders} WHERE o_orderkey % 4 = 1"


@query("WITH e AS (" + plain(_ENTRIES) + "), j AS (" + plain(_JOBS) + """) SELECT entry_id, user_id, request_id, CASE WHEN request_id IN (SELECT request_id FROM j WHERE active) THEN 'flag' ELSE 'release' END AS action FROM e
WHERE kind = 'reserve' AND "at" <= 400 - 24 AND entry_id NOT IN (SELECT reserve_id FROM e WHERE kind IN ('consume', 'release', 'restore') AND reserve_id IS NOT NULL)""")
def reservation_sweep(spark, d):
    return R.reservation_sweep(carried(spark, d, _ENTRIES), carried(spark, d, _JOBS), NOW)
