"""Queries of documents held against closed schemas, over messages derived from all orders and the properties of all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import schemas as S
from proofline.plans.common import Registry, carried, plain

query = Registry()

# The shape of a job's message, identifiers only.
MESSAGE = {
    "type": "object", "additionalProperties": False, "required": ["schemaVersion", "jobId", "attempt", "traceId"],
    "properties": {
        "schemaVersion": {"const": 1}, "jobId": {"type": "string", "format": "uuid"}, "attempt": {"type": "integer", "minimum": 1, "maximum": 100},
        "traceId": {"type": "string", "minLength": 8, "maxLength": 128, "pattern": "^[A-Za-z0-9._:-]+$"}, "budgetProfile": {"type": "string", "minLength": 1, "maxLength": 100},
    },
}
_MESSAGES = """SELECT k AS message_id, CASE WHEN k % 31 = 0 THEN NULL ELSE chr(123) || '"schemaVersion":' || CASE WHEN k % 13 = 0 THEN '2' WHEN k % 17 = 0 THEN '"1"' ELSE '1' END || ',"jobId":"' || CASE WHEN k % 7 = 0 THEN 'x' ELSE lpad(CAST(k AS STRING), 8, '0') || '-0000-4000-8000-00000000000a' END || '"'
  || CASE WHEN k % 5 = 0 THEN '' ELSE ',"attempt":' || CASE WHEN k % 11 = 0 THEN '0' WHEN k % 19 = 0 THEN '1.5' WHEN k % 23 = 0 THEN '"3"' ELSE CAST(k % 120 AS STRING) END END || CASE WHEN k % 6 = 0 THEN ',"extra":null' ELSE '' END
  || ',"traceId":"' || CASE WHEN k % 9 = 0 THEN 'short' WHEN k % 10 = 1 THEN 'has a space' ELSE 'trace-' || lpad(CAST(k AS STRING), 8, '0') END || '"' || CASE WHEN k % 29 = 0 THEN '' ELSE chr(125) END END AS doc FROM (SELECT o_orderkey AS k FROM {orders})"""


@query("WITH m AS (" + plain(_MESSAGES) + r"""), j AS (SELECT message_id, doc, json_valid(doc) AS ok FROM m WHERE doc IS NOT NULL),
v AS (SELECT message_id, json_extract(doc, '$.schemaVersion')::VARCHAR AS version, json_extract_string(doc, '$.jobId') AS job, json_type(doc, '$.attempt') AS kind, TRY_CAST(json_extract_string(doc, '$.attempt') AS DOUBLE) AS attempt,
       json_extract_string(doc, '$.traceId') AS trace, list_contains(json_keys(doc), 'extra') AS extra FROM j WHERE ok)
SELECT message_id, '$' AS path, 'not_json' AS rule FROM j WHERE NOT ok
UNION ALL SELECT message_id, '$.schemaVersion', 'const' FROM v WHERE version <> '1'
UNION ALL SELECT message_id, '$.jobId', 'format' FROM v WHERE NOT regexp_full_match(job, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')
UNION ALL SELECT message_id, '$.attempt', 'required' FROM v WHERE kind IS NULL UNION ALL SELECT message_id, '$.attempt', 'type' FROM v WHERE kind IN ('DOUBLE', 'VARCHAR')
UNION ALL SELECT message_id, '$.attempt', 'minimum' FROM v WHERE kind <> 'VARCHAR' AND attempt < 1 UNION ALL SELECT message_id, '$.attempt', 'maximum' FROM v WHERE kind <> 'VARCHAR' AND attempt > 100
UNION ALL SELECT message_id, '$.extra', 'additionalProperties' FROM v WHERE extra
UNION ALL SELECT message_id, '$.traceId', 'minLength' FROM v WHERE length(trace) < 8 UNION ALL SELECT message_id, '$.traceId', 'pattern' FROM v WHERE NOT regexp_full_match(trace, '[A-Za-z0-9._:-]+')""")
def message_schema_violations(spark, d):
    rows = carried(spark, d, _MESSAGES)
    return rows.select("message_id", F.explode(S.violations(F.col("doc"), MESSAGE)).alias("v")).select("message_id", "v.path", "v.rule")


@query("""SELECT event_id, '$.k' AS path, CASE WHEN json_extract(props, '$.k')::BIGINT > 90 THEN 'maximum' ELSE 'minimum' END AS rule FROM events WHERE json_extract(props, '$.k')::BIGINT NOT BETWEEN 10 AND 90
UNION ALL SELECT event_id, '$.' || key, 'additionalProperties' FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) WHERE key <> 'k' UNION ALL SELECT event_id, '$.k', 'required' FROM events WHERE NOT list_contains(json_keys(props), 'k')""")
def event_schema_violations(spark, d):
    schema = {"type": "object", "additionalProperties": False, "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}}}
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select("event_id", F.explode(S.violations(F.col("props"), schema)).alias("v")).select("event_id", "v.path", "v.rule")
