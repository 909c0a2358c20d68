"""Queries of dispatch by a table function, over an outbox derived from all orders."""

from __future__ import annotations

from proofline.operators import dispatch as D
from proofline.plans.common import Registry, carried, plain

query = Registry()

_OUTBOX = """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'hot' ELSE o_orderpriority || '-' || (o_custkey % 40) END AS queue, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'sent' ELSE 'pending' END AS state, CAST(o_custkey % 8 AS BIGINT) AS attempts,
  CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 1000 END AS available_at, CAST(400 AS BIGINT) AS now FROM {orders}"""


@query("WITH b AS (" + plain(_OUTBOX) + """) SELECT queue, id, attempts + 1 AS attempts, CASE WHEN attempts < 5 THEN 'dispatched' ELSE 'exhausted' END AS outcome FROM b WHERE state = 'pending' AND (available_at IS NULL OR available_at <= 400)
QUALIFY row_number() OVER (PARTITION BY queue ORDER BY id) = 1""")
def next_dispatches(spark, d):
    D.register(spark)
    return spark.sql("SELECT * FROM dispatch_next(TABLE({outbox}))", outbox=carried(spark, d, _OUTBOX))
