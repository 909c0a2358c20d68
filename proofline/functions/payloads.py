"""JSON payloads: canonical text and digests, keys and values at any depth, redaction, trace ids.

JSON comes as text. Keys at any depth are found by one pattern that consumes
every string of a text in turn, so no text within a value can pass for a key.
Canonical form and redaction rebuild the document, in Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from proofline.functions.web import url_parts

# Fixed values.
CHECKPOINT_KEYS = ("api_key", "apikey", "authorization", "cookie", "letterhead", "matter_narrative", "password", "raw_body", "raw_html", "raw_text", "secret", "set_cookie", "user_email")
MOST_CHECKPOINT_BYTES = 256 * 1024
TRACE_ID = "^[A-Za-z0-9._:-]{8,128}$"
ERROR_CODE = "^[a-z0-9_:-]{1,100}$"
SAFE_LOG_KEYS = frozenset(
    "adapterbackends attempt cost currency demomode durationms errorclass errorcode event failurestate fixturerevision httppath jobid level model modelpromptversion overriddenselectors promptversion provider queuemessageid readcount "
    "reportrequestid service stage status timestamp tokencount traceid userid validationerrorcount version zerospend".split()
)
SENSITIVE_KEYS = frozenset("body content cookie data details email error exception firm fullname letterhead message name password payload phone prompt raw stack text traceback".split())
SENSITIVE_ENDS = ("apikey", "password", "secret", "token")
SENSITIVE_PARTS = ("authorization", "billing", "confidential", "credential", "letterhead", "oauth", "payment", "prompt", "setcookie", "useradded", "webhooksignature", "workproduct")
REDACTED = "[REDACTED]"

_STRINGS = r'(?s)"((?:[^"\\]|\\.)*+)"(\s*+:)?'


def _strings(payload: Column) -> Column:
    """struct(text, key) of every string of a JSON text, in order."""
    part = lambda k: F.regexp_extract_all(payload, F.lit(_STRINGS), F.lit(k))
    plain = lambda t: F.when(t.contains("\\"), F.element_at(F.from_json(F.concat(F.lit('["'), t, F.lit('"]')), "array<string>"), 1)).otherwise(t)
    return F.zip_with(part(1), part(2), lambda t, colon: F.struct(plain(t).alias("text"), (colon != "").alias("key")))


def json_keys(payload: Column) -> Column:
    """Keys of a JSON text at any depth, in order."""
    return F.transform(F.filter(_strings(payload), lambda s: s["key"]), lambda s: s["text"])


def json_values(payload: Column) -> Column:
    """Texts among a JSON text's values at any depth, in order."""
    return F.transform(F.filter(_strings(payload), lambda s: ~s["key"]), lambda s: s["text"])


def has_forbidden_key(payload: Column, keys: tuple[str, ...] = CHECKPOINT_KEYS) -> Column:
    return F.exists(json_keys(payload), lambda k: F.lower(k).isin(*keys))


def key_form(key: Column) -> Column:
    """A key without case, hyphens and underscores."""
    return F.regexp_replace(F.lower(key), "[-_]", "")


def unsafe_case(payload: Column, keys: tuple[str, ...]) -> Column:
    """Error of a test case's document: a forbidden key in any spelling, or a URL beyond the hosts reserved for examples."""
    spelled = [k.lower().replace("-", "").replace("_", "") for k in keys]
    host = lambda v: url_parts(v)["host"]
    reserved = lambda v: host(v).isin("example", "example.com") | host(v).endswith(".example") | host(v).endswith(".example.com")
    outside = F.exists(json_values(payload), lambda v: v.rlike("^https?://") & ~reserved(v))
    return F.when(F.exists(json_keys(payload), lambda k: key_form(k).isin(*spelled)), "forbidden_field").when(outside, "url_not_reserved")


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), ensure_ascii=True, separators=(",", ":"), sort_keys=True, allow_nan=False)
    except (ValueError, TypeError):
        return None


@F.pandas_udf(StringType())
def canonical_json(payload: pd.Series) -> pd.Series:
    """A JSON text with sorted keys, ASCII escapes and no spaces; null if it isn't JSON."""
    return payload.map(_canonical)


@F.pandas_udf(StringType())
def _canonical_sha256(payload: pd.Series) -> pd.Series:
    done = payload.map(_canonical)
    return done.map(lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest())


def payload_sha256(payload: Column) -> Column:
    """Digest of the canonical form, as queues record it."""
    return _canonical_sha256(payload)


def checkpoint_digest(payload: Column) -> Column:
    """struct(sha256, code): digest of a stage's output, or why it may not be kept."""
    body = canonical_json(payload)
    code = F.when(body.isNull(), "payload_not_serializable").when(has_forbidden_key(payload), "payload_contains_forbidden_field").when(F.octet_length(body) > MOST_CHECKPOINT_BYTES, "payload_too_large")
    return F.struct(F.when(code.isNull(), F.sha2(body, 256)).alias("sha256"), code.alias("code"))


def _sensitive(key: str) -> bool:
    plain = re.sub("[^a-z0-9]", "", key.lower())
    if plain in SAFE_LOG_KEYS:
        return False
    return plain in SENSITIVE_KEYS or plain.endswith(SENSITIVE_ENDS) or any(part in plain for part in SENSITIVE_PARTS)


def _redacted(value):
    if isinstance(value, dict):
        return {k: REDACTED if _sensitive(k) else _redacted(v) for k, v in value.items()}
    return [_redacted(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(StringType())
def redacted(event: pd.Series) -> pd.Series:
    """A log event (JSON text) with the values of sensitive keys replaced at any depth; null if it isn't JSON."""

    def one(text):
        try:
            return None if text is None else json.dumps(_redacted(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return event.map(one)


def trace_id(candidate: Column, minted: Column | None = None) -> Column:
    """A given trace id if it has the form of one, else a new one."""
    return F.when(candidate.rlike(TRACE_ID), candidate).otherwise(F.uuid() if minted is None else minted)


def dead_letter(queue: Column, message_id: Column, read_count: Column, code: Column, payload: Column, observed_at: Column) -> Column:
    """The record kept of a message that can't be handled: its payload's digest, never the payload."""
    return F.struct(
        F.lit(1).alias("schemaVersion"), queue.alias("sourceQueue"), message_id.alias("sourceMessageId"), read_count.alias("readCount"),
        F.when(code.rlike(ERROR_CODE), code).otherwise("queue_error").alias("errorCode"), payload_sha256(payload).alias("payloadSha256"),
        F.date_format(observed_at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("observedAt"),
    )


def json_kind(payload: Column) -> Column:
    """object, array, string, number, boolean or null; SQL null for what isn't JSON."""
    t = F.trim(payload)
    good = F.try_parse_json(payload).isNotNull()
    kind = F.when(t.startswith("{"), "object").when(t.startswith("["), "array").when(t.startswith('"'), "string").when(t.isin("true", "false"), "boolean").when(t == "null", "null").otherwise("number")
    return F.when(good, kind)
