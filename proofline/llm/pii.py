"""Personal data in texts (native: DataFrame functions only).

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod 97 for account numbers, ranges and counts for the rest), and whole words near
a span, on either side, raise or lower its score.

Spans are in code points, end exclusive. The patterns are written so that each
start is tried once: a start inside a run of the same characters could only
fail as the run's start did, which keeps long texts linear.

Defined results: a null text counts as empty and gives empty results; repeated
rows give a row each; other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.llm.common import text_or_empty

#: Characters of an account number by country (the IBAN registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "(?:" + "|".join(v.replace(" ", "|") for v in IBAN_LENGTHS.values()) + ")"
#: What may be a number at a start: of a listed country its length, of others the run and a character after it.
_ACCOUNT = "|".join(
    [rf"(?:{v.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])" for n, v in IBAN_LENGTHS.items()]
    + [rf"(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+[A-Za-z0-9]?+"]
)

#: kind: pattern, score of a confirmed span, words that raise it, words that lower it.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.7, "e?mails?|contacts?|write|reach|kontakt|correo|courriel", "example|sample|beispiel|ejemplo|exemple"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.5, "ip|ipv4|address|host|server|login|logged|adresse", "version|release|section|chapter|build|kapitel"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])", 0.6, "cards?|visa|mastercard|master|credit|debit|karte|kreditkarte|carte|tarjeta", "order|invoice|tracking|isbn|serial|part|bestellung|pedido|commande"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.5, "phone|telephone|tel|call|mobile|cell|fax|rufen|telefon|teléfono|téléphone", "order|invoice|score|sum|total|serial"),
    "iban": (rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=({_ACCOUNT}))[A-Z]{{2}}[0-9]{{2}}", 0.8, "iban|bank|account|transfer|konto|compte|cuenta", "serial|order|part|tracking"),
}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.25
CONTEXT_MALUS = 0.2
BLOCK = 256
_BYTE_PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]+", "")


def _mod_97(value: Column) -> Column:
    """Remainder of an account number: the first four characters go last, letters count from 10."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + code(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _account(run: Column) -> Column:
    """The account number that a run of capitals and digits starts with; null for none.

    It ends where a group does. A country that isn't listed gives no length, so
    the longest such part with the right remainder is taken.
    """
    groups = F.split(run, " ")
    parts = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda n: F.array_join(F.slice(groups, F.lit(1), n), " "))
    fits = lambda v: F.length(F.replace(v, F.lit(" "), F.lit(""))).between(15, 34) & ~v.rlike("[a-z]")
    tried = F.when(run.rlike(f"^{_LISTED}"), F.array(run)).otherwise(F.filter(parts, fits))
    return F.try_element_at(F.filter(tried, lambda v: _mod_97(v) == 1), F.lit(-1))


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike(_BYTE_PART))
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        return value.isNotNull()
    return F.lit(True)


def _running(values: Column) -> Column:
    """Array of a 0 and the running sums of an array."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def _ends(widths: Column) -> Column:
    """Running sums of an array, in blocks: a text with very many spans stays cheap."""
    count = F.ceil(F.size(widths) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(widths, b * BLOCK + 1, F.lit(BLOCK)))
    inner = F.transform(blocks, _running)
    starts = _running(F.transform(inner, lambda sums: F.element_at(sums, -1)))
    return F.flatten(F.zip_with(inner, F.slice(starts, F.lit(1), count), lambda sums, start: F.transform(F.slice(sums, F.lit(2), F.lit(BLOCK)), lambda v: v + start)))


def _spans(kind: str, body: Column, ends: Column, matches: Column) -> Column:
    """Confirmed spans of a kind, from its matches and where they end.

    An account number is longer than its match, so that one number, or what
    looks like one, doesn't hide another that starts within it.
    """
    _, base, raising, lowering = KINDS[kind]

    def span(pair: Column) -> Column:
        value, start = pair["value"], pair["start"]
        end = start + F.length(value)
        before = F.substring(body, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS)))
        near = F.lower(F.concat(before, F.lit(" | "), F.substring(body, end + 1, F.lit(CONTEXT_CHARS))))
        has = lambda words: near.rlike(rf"(?<!\p{{L}})(?:{words})(?!\p{{L}})")
        score = F.lit(base) + F.when(has(raising), CONTEXT_BONUS).otherwise(0.0) - F.when(has(lowering), CONTEXT_MALUS).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"), score.alias("score"))

    pairs = F.zip_with(ends, matches, lambda end, m: F.struct((end - F.length(m)).alias("start"), m.alias("value")))
    if kind == "iban":
        runs = F.regexp_extract_all(body, F.lit(KINDS[kind][0]), F.lit(1))
        pairs = F.zip_with(pairs, runs, lambda pair, run: F.struct(pair["start"].alias("start"), _account(run).alias("value")))
    return F.transform(F.filter(pairs, lambda pair: _confirmed(kind, pair["value"])), span)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with an array column of structs: kind, start, end, value, score.

    Spans are ordered by kind, as in ``KINDS``, then start.
    """
    body = "_pii_text"
    df = docs.withColumn(body, text_or_empty(F.col(f"`{text}`")))
    df = df.withColumns({f"_pii_m_{k}": F.regexp_extract_all(F.col(body), F.lit(p), F.lit(0)) for k, (p, *_) in KINDS.items()})
    df = df.withColumns({
        f"_pii_w_{k}": F.when(F.size(f"_pii_m_{k}") > 0, F.zip_with(
            F.slice(F.split(F.col(body), p, -1), F.lit(1), F.size(f"_pii_m_{k}")), F.col(f"_pii_m_{k}"), lambda gap, m: F.length(gap) + F.length(m)))
        for k, (p, *_) in KINDS.items()
    })
    df = df.withColumns({f"_pii_e_{k}": F.when(F.col(f"_pii_w_{k}").isNotNull(), _ends(F.col(f"_pii_w_{k}"))) for k in KINDS})
    found = {k: F.when(F.col(f"_pii_e_{k}").isNotNull(), _spans(k, F.col(body), F.col(f"_pii_e_{k}"), F.col(f"_pii_m_{k}"))) for k in KINDS}
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")
    df = df.withColumn(out, F.concat(*[F.coalesce(v, empty) for v in found.values()]))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c != out], out)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = ("email", "ip", "card", "phone")
    found = find_pii(docs).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(_joined(F.filter("pii", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        _joined(F.col("pii")).alias("spans"),
        F.round(F.array_max(F.transform("pii", lambda s: s["score"])), 2).alias("max_score"),
    )
