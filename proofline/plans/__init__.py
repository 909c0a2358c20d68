"""Registered queries of the evidence operators, and the SQL that checks them."""

from proofline.plans import candidates, dispatch, entitlements, inspection, matching, pages, queries, requests, research, retention, rules, schemas, sources, state, verification, web

QUERIES = queries.QUERIES | matching.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | matching.ORACLE_SQL
for _module in (web, verification, candidates, dispatch, entitlements, inspection, rules, schemas, state, sources, pages, requests, research, retention):
    QUERIES |= _module.query.queries
    ORACLE_SQL |= _module.query.sql
