"""Queries of the credit ledger, over entries derived from all orders."""

from __future__ import annotations

from proofline.operators import entitlements as E
from proofline.plans.common import Registry, carried, plain

query = Registry()

#: An order is a grant, a reserve, an expiry or a reversal; most reserves end in a second entry.
_ENTRIES = """SELECT 2 * o_orderkey AS entry_id, o_custkey AS user_id, CAST(o_orderkey % 900 AS BIGINT) AS at, CASE o_orderkey % 10 WHEN 0 THEN 'purchase_grant' WHEN 1 THEN 'purchase_grant' WHEN 2 THEN 'trial_grant' WHEN 7 THEN 'expiry' WHEN 8 THEN 'refund_reversal' ELSE 'reserve' END AS kind,
  CASE WHEN o_orderkey % 10 < 3 THEN 1 + o_orderkey % 9 WHEN o_orderkey % 211 = 0 THEN 1 WHEN o_orderkey % 97 = 0 THEN NULL ELSE -1 - o_orderkey % 3 END AS credits, CASE WHEN o_orderkey % 10 < 3 AND o_orderkey % 4 <> 0 THEN o_orderkey % 900 + o_orderkey % 700 END AS expires_at,
  CAST(NULL AS BIGINT) AS reserve_id, CASE WHEN o_orderkey % 10 > 2 THEN o_custkey * 3 + o_orderkey % 3 END AS request_id, CASE WHEN o_orderkey % 5 > 0 THEN 'k' || (o_orderkey - o_orderkey % 40 / 39) END AS idempotency_key, CAST(NULL AS BOOLEAN) AS passed FROM {orders}
UNION ALL SELECT 2 * o_orderkey + 1, o_custkey, o_orderkey % 900 + 5, CASE o_orderkey % 10 WHEN 3 THEN 'consume' WHEN 4 THEN 'consume' WHEN 5 THEN 'release' ELSE 'restore' END, CASE WHEN o_orderkey % 10 < 5 THEN -1 - o_orderkey % 3 ELSE 1 + o_orderkey % 3 END, NULL,
  CASE WHEN o_orderkey % 131 = 0 THEN 1 ELSE 2 * o_orderkey END, NULL, NULL, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 13 > 0 END FROM {orders} WHERE o_orderkey % 10 IN (3, 4, 5, 6) AND o_orderkey % 8 > 0
UNION ALL SELECT 2 * o_orderkey + 1, o_custkey, o_orderkey % 900 + 9, 'release', 1, NULL, 2 * o_orderkey - 2, NULL, NULL, NULL FROM {orders} WHERE o_orderkey % 50 = 19"""
_ENTRIES = _ENTRIES.replace("'k' || (o_orderkey - o_orderkey % 40 / 39)", "'k' || CASE WHEN o_orderkey % 40 = 39 THEN o_orderkey - 1 ELSE o_orderkey END")
_SQL = "WITH e AS (" + plain(_ENTRIES) + """), x AS (SELECT reserve_id, arg_min(kind, entry_id) AS ended_as FROM e WHERE kind IN ('consume', 'release', 'restore') AND reserve_id IS NOT NULL GROUP BY 1),
u AS (SELECT e.user_id, e.entry_id, abs(credits) AS n, sum(abs(credits)) OVER (PARTITION BY user_id ORDER BY "at", entry_id) AS b FROM e WHERE kind IN ('reserve', 'expiry', 'refund_reversal') AND credits <> 0 AND entry_id NOT IN (SELECT reserve_id FROM x WHERE ended_as <> 'consume')),
g AS (SELECT user_id, entry_id, abs(credits) AS n, sum(abs(credits)) OVER (PARTITION BY user_id ORDER BY expires_at NULLS LAST, entry_id) AS b FROM e WHERE kind IN ('purchase_grant', 'trial_grant') AND credits <> 0),
h AS (SELECT u.user_id, u.entry_id AS use_id, g.entry_id AS grant_id, least(u.b, g.b) - greatest(u.b - u.n, g.b - g.n) AS credits FROM u JOIN g ON u.user_id = g.user_id AND u.b > g.b - g.n AND g.b > u.b - u.n),
a AS (SELECT * FROM h UNION ALL SELECT u.user_id, u.entry_id, NULL, u.n - coalesce(s.n, 0) FROM u LEFT JOIN (SELECT use_id, sum(credits) AS n FROM h GROUP BY 1) s ON s.use_id = u.entry_id WHERE u.n > coalesce(s.n, 0)),
l AS (SELECT *, sum(CASE WHEN kind = 'consume' THEN 0 ELSE coalesce(credits, 0) END) OVER (PARTITION BY user_id ORDER BY "at", entry_id) AS balance FROM e)
"""


@query(_SQL + "SELECT user_id, entry_id, CAST(balance AS BIGINT) AS balance FROM l")
def credit_balances(spark, d):
    return E.balances(carried(spark, d, _ENTRIES)).select("user_id", "entry_id", "balance")


@query(_SQL + "SELECT user_id, use_id, grant_id, CAST(credits AS BIGINT) AS credits FROM a")
def credit_allocations(spark, d):
    return E.allocations(carried(spark, d, _ENTRIES))


@query(_SQL + """, p AS (SELECT DISTINCT a.use_id, a.user_id, u."at" AS used_at, u.kind, g."at" AS since, g.expires_at AS until, a.grant_id FROM a JOIN e u ON u.entry_id = a.use_id LEFT JOIN e g ON g.entry_id = a.grant_id)
SELECT 'sign' AS rule, user_id, entry_id FROM e WHERE CASE WHEN kind IN ('purchase_grant', 'trial_grant', 'release', 'restore') THEN coalesce(credits, 0) <= 0 ELSE coalesce(credits, 0) >= 0 END
UNION ALL SELECT 'consume_without_pass', user_id, entry_id FROM e WHERE kind = 'consume' AND passed IS NOT TRUE
UNION ALL SELECT 'idempotency_key_repeated', user_id, entry_id FROM e WHERE idempotency_key IS NOT NULL QUALIFY entry_id > min(entry_id) OVER (PARTITION BY idempotency_key)
UNION ALL SELECT 'trial_repeated', user_id, entry_id FROM e WHERE kind = 'trial_grant' QUALIFY entry_id > min(entry_id) OVER (PARTITION BY user_id)
UNION ALL SELECT 'request_reserved_twice', user_id, entry_id FROM e WHERE kind = 'reserve' AND request_id IS NOT NULL AND entry_id NOT IN (SELECT reserve_id FROM x) QUALIFY entry_id > min(entry_id) OVER (PARTITION BY request_id)
UNION ALL SELECT 'reserve_unknown', user_id, entry_id FROM e WHERE kind IN ('consume', 'release', 'restore') AND NOT EXISTS (SELECT 1 FROM e r WHERE r.kind = 'reserve' AND r.entry_id = e.reserve_id AND r.user_id = e.user_id)
UNION ALL SELECT 'reserve_ended_twice', user_id, entry_id FROM e WHERE kind IN ('consume', 'release', 'restore') QUALIFY entry_id > min(entry_id) OVER (PARTITION BY reserve_id)
UNION ALL SELECT 'balance_negative', user_id, entry_id FROM l WHERE balance < 0
UNION ALL SELECT DISTINCT 'use_not_covered', user_id, use_id FROM p WHERE grant_id IS NULL UNION ALL SELECT DISTINCT 'grant_after_use', user_id, use_id FROM p WHERE since > used_at UNION ALL SELECT DISTINCT 'grant_expired', user_id, use_id FROM p WHERE kind <> 'expiry' AND until <= used_at""")
def credit_violations(spark, d):
    return E.violations(carried(spark, d, _ENTRIES))
