"""Identifiers, addresses, company classes and provider answers as column expressions; null in, null out unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.functions.text import isin_valid

# Fixed values.
CIN = r"(?i)(?<![A-Z0-9])([UL][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6})(?![A-Z0-9])"
GSTIN = r"(?i)(?<![A-Z0-9])([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[A-Z0-9])(?![A-Z0-9])"
ISIN = r"(?i)(?<![A-Z0-9])(IN[A-Z0-9]{9}[0-9])(?![A-Z0-9])"
TICKER = r"(?i)\b(NSE|BSE)\s*(?:code|symbol)?\s*[:\-]\s*([A-Z0-9&.-]{1,20})\b"
INACTIVE = "inactive|dissolved|strike off|struck off|liquidat"


def identity_key(cin: Column, name: Column, state: Column) -> Column:
    """``cin:`` and the number in capitals; without one, name and state in small letters."""
    named = F.concat(F.lit("name:"), F.lower(name), F.lit("|state:"), F.lower(F.coalesce(state, F.lit(""))))
    return F.when(F.coalesce(cin, F.lit("")) != "", F.concat(F.lit("cin:"), F.upper(cin))).otherwise(named)


def found(text: Column, pattern: str) -> Column:
    """Distinct upper-case matches, in order of place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.upper))


def isins(text: Column) -> Column:
    return F.filter(found(text, ISIN), isin_valid)


def tickers(text: Column) -> Column:
    """``EXCHANGE:SYMBOL`` of each labelled ticker, once."""
    part = lambda k: F.regexp_extract_all(text, F.lit(TICKER), F.lit(k))
    return F.array_distinct(F.zip_with(part(1), part(2), lambda a, b: F.upper(F.concat_ws(":", a, b))))


def address_tokens(address: Column, stop_words: list[str]) -> Column:
    """Distinct tokens of two or more characters that are no stop words."""
    tokens = F.filter(F.regexp_extract_all(F.lower(address), F.lit("([a-z0-9]+)"), F.lit(1)), lambda t: F.length(t) > 1)
    return F.array_except(tokens, F.array(*map(F.lit, stop_words)))


def addresses_match(site: Column, master: Column, state: Column, stop_words: list[str]) -> Column:
    """At least three common tokens, half of the shorter list or more, and the state named if there is one. Never null."""
    a, b = address_tokens(site, stop_words), address_tokens(master, stop_words)
    common, shorter = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    named = state.isNull() | F.contains(F.lower(site), F.lower(state))
    return F.coalesce(named & (common >= 3) & (common * 2 >= shorter), F.lit(False))


def inactive(status: Column) -> Column:
    return F.coalesce(F.lower(status).rlike(INACTIVE), F.lit(False))


def company_class(cin: Column, kind: Column, listed: Column) -> Column:
    """Listed by flag or number; else by the declared kind; null for a kind that isn't supported."""
    kind = F.lower(F.coalesce(kind, F.lit("")))
    return (
        F.when(F.coalesce(listed, F.lit(False)) | cin.startswith("L"), "listed")
        .when(kind.contains("private") | kind.contains("one person"), "private")
        .when(kind.contains("public"), "public_unlisted")
    )


def http_failure(status: Column, media_type: Column) -> Column:
    """struct(code, retryable) of a model provider's answer; null for a good one."""
    answer = lambda code, again: F.struct(F.lit(code).alias("code"), F.lit(again).alias("retryable"))
    good = F.lower(F.trim(F.split_part(F.coalesce(media_type, F.lit("")), F.lit(";"), F.lit(1)))) == "application/json"
    return (
        F.when(status == 404, answer("no_approved_capacity", True))
        .when((status == 200) & ~good, answer("model_response_invalid", False))
        .when(status == 200, F.lit(None))
        .when(status == 400, answer("model_invalid_request", False))
        .when(status.isin(401, 403), answer("model_unauthorized", False))
        .when(status == 429, answer("model_rate_limited", True))
        .when(status.between(500, 599), answer("model_unavailable", True))
        .otherwise(answer("model_http_error", False))
    )


def highlights(passages: Column, most: int = 5, length: int = 2000) -> Column:
    """The first passages, with single spaces, cut to a length; blank ones and repeats go afterwards."""
    cleaned = F.transform(F.slice(passages, 1, most), lambda p: F.substring(F.trim(F.regexp_replace(p, r"\s+", " ")), 1, length))
    return F.array_distinct(F.filter(cleaned, lambda p: p != ""))


def exact_keys(payload: Column, keys: list[str]) -> Column:
    """Whether a JSON object has these keys and no others; false for anything else."""
    held = F.json_object_keys(payload)
    want = F.array(*map(F.lit, keys))
    return F.coalesce((F.size(F.array_except(held, want)) == 0) & (F.size(F.array_except(want, held)) == 0), F.lit(False))
