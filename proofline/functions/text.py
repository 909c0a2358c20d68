"""Scalar text operators as column expressions; null in, null out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
INJECTION_PATTERNS = (
    r"(?i)\bignore\s+(?:all\s+)?(?:previous|prior|system|developer)\b",
    r"(?i)\b(?:reveal|show|print|repeat)\b.{0,60}\b(?:system prompt|secret|api key|token)\b",
    r"(?i)\b(?:send|upload|exfiltrate)\b.{0,80}\b(?:secret|api key|password|token)\b",
    r"(?i)\b(?:call|invoke|use)\s+(?:the\s+)?(?:tool|function|browser)\b",
    r"(?i)\b(?:follow| obey)\s+(?:these|the following)\s+instructions\b",
)

AMOUNT = r"^(?:(?:inr|rs\.?)\s*)?([0-9]+(?:\.[0-9]+)?)\s*(crore|crores|cr|lakh|lakhs|million|billion|percent|%)?\s*(?:inr)?$"
FACTORS = {"crore": 1e7, "crores": 1e7, "cr": 1e7, "lakh": 1e5, "lakhs": 1e5, "million": 1e6, "billion": 1e9}


def legal_name_key(name: Column) -> Column:
    """A name's comparison key: short company forms spelled out, anything but a-z and 0-9 a space."""
    key = F.regexp_replace(F.lower(name), r"\bpvt\.?\b", "private")
    key = F.regexp_replace(key, r"\bltd\.?\b", "limited")
    return F.trim(F.regexp_replace(key, "[^a-z0-9]+", " "))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalised_lines(text: Column) -> Column:
    """Each line with single spaces; blank lines dropped."""
    lines = F.transform(F.split(text, "\n"), collapsed)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def prompt_injection(text: Column) -> Column:
    found = [text.rlike(p) for p in INJECTION_PATTERNS]
    return found[0] | found[1] | found[2] | found[3] | found[4]


def escaped(text: Column, quotes: bool) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def untrusted_envelope(source_id: Column, url: Column, tier: Column, controlled: Column, suspected: Column, text: Column) -> Column:
    """A source wrapped as data, with escaped attributes and text."""
    flag = lambda c: F.lower(c.cast("string"))
    pairs = {"id": source_id, "url": F.coalesce(url, F.lit("none")), "tier": tier.cast("string"), "company_controlled": flag(controlled), "prompt_injection_suspected": flag(suspected)}
    attributes = F.concat_ws(" ", *[F.concat(F.lit(f'{k}="'), escaped(v, True), F.lit('"')) for k, v in pairs.items()])
    return F.concat(F.lit("<untrusted_source "), attributes, F.lit(">"), escaped(text, False), F.lit("</untrusted_source>"))


def isin_valid(code: Column) -> Column:
    """Check digit of a security number: letters count from 10, then the Luhn sum."""
    spelled = F.transform(F.split(F.upper(code), ""), lambda c: F.conv(c, 36, 10))
    return F.call_function("luhn_check", F.array_join(spelled, ""))


@F.pandas_udf(StringType())
def _unicode_folded(text: pd.Series) -> pd.Series:
    return text.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()))


def folded(text: Column) -> Column:
    """Compatible characters made one, no case, single spaces. Only texts beyond ASCII go to Python."""
    plain = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, F.lower(collapsed(text))).otherwise(_unicode_folded(F.when(~plain, text)))


def period_key(period: Column) -> Column:
    return F.replace(folded(F.coalesce(period, F.lit(""))), F.lit("/"), F.lit("-"))


def assertion_key(value: Column) -> Column:
    """What a stated value says: amounts by number, whatever their unit and currency mark, shares by percent, else the text."""
    text = F.replace(folded(value), F.lit("\u20b9"), F.lit("inr "))
    amount, unit = F.regexp_extract(text, AMOUNT, 1), F.regexp_extract(text, AMOUNT, 2)
    factor = F.coalesce(F.create_map(*[F.lit(x) for pair in FACTORS.items() for x in pair])[unit], F.lit(1.0))
    number = F.format_string("%.5e", F.when(amount != "", amount).otherwise("0").cast("double") * factor)
    kind = F.when(unit.isin("percent", "%"), "percent:").otherwise("number:")
    words = F.replace(F.replace(text, F.lit("rs. "), F.lit("inr ")), F.lit("rs "), F.lit("inr "))
    return F.when(amount != "", F.concat(kind, number)).otherwise(words)


def tuple_text(*parts: Column) -> Column:
    """``('a', 'b')`` as identifiers made elsewhere spell a tuple of printable texts."""

    def quoted(c: Column) -> Column:
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        double = c.contains("'") & ~c.contains('"')
        return F.when(double, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("("), F.concat_ws(", ", *map(quoted, parts)), F.lit(")"))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based identifier of version 5, equal for equal names."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)
