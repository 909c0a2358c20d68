"""What URLs, hosts and addresses may be fetched, as column expressions.

Checks give a code for the first rule that fails and null for none. Null in,
null out. Hosts beyond ASCII and addresses need Python, in Arrow batches; all
else stays in the JVM.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
PORTS = {"http": "80", "https": "443"}
BLOCKED_SUFFIXES = (".localhost", ".local", ".internal", ".home.arpa")
LABEL = r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$"
CREDENTIAL_KEY = r"(?i)(?:^|[-_.])(auth|code|credential|jwt|key|password|secret|session|sig|signature|token)(?:$|[-_.])"
TRANSLATION_NETWORKS = ("64:ff9b::/96", "64:ff9b:1::/48")
MOST_ANSWERS = 16
#: A URL that is its own canonical form up to fragment and an empty path: a public name in small letters, no user, port or query.
PLAIN_URL = (
    r"(?s)\Ahttps?://(?=[^/#]{1,253}(?:[/#]|\z))(?![^/#]*(?:" + "|".join(s.replace(".", r"\.") for s in BLOCKED_SUFFIXES) + r")(?:[/#]|\z))"
    r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z](?:[a-z0-9-]{0,61}[a-z0-9])?(?:/[^?#\x00-\x20]*)?(?:#.*)?\z"
)
FETCHED_TYPES = ("application/pdf", "application/xhtml+xml", "application/xml", "text/html", "text/plain", "text/xml")
READ_TYPES = ("application/xhtml+xml", "application/xml", "text/html", "text/plain", "text/xml")


def _first(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that fails."""
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for broken, code in rules[1:]:
        out = out.when(F.coalesce(broken, F.lit(False)), code)
    return out


def url_parts(url: Column) -> Column:
    """struct(scheme, authority, user, host, port, path, query); user and port are null where there is none."""
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    bare = F.split_part(clean, F.lit("#"), F.lit(1))
    part = lambda k: F.regexp_extract(bare, r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?]*))?([^?]*)(?:\?(.*))?$", k)
    authority = part(2)
    user = F.when(authority.contains("@"), F.regexp_extract(authority, "(?s)^(.*)@", 1))
    place = F.regexp_replace(authority, "(?s)^.*@", "")
    bracketed = place.startswith("[")
    host = F.when(bracketed, F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.split_part(place, F.lit(":"), F.lit(1)))
    port = F.when(bracketed, F.regexp_extract(place, r"\](?::(.*))?$", 1)).otherwise(F.regexp_extract(place, "^[^:]*:(.*)$", 1))
    return F.struct(
        F.lower(part(1)).alias("scheme"), authority.alias("authority"), user.alias("user"), F.lower(host).alias("host"),
        F.when(port != "", port).alias("port"), part(3).alias("path"), part(4).alias("query"),
    )


def malformed(parts: Column) -> Column:
    """A port that is no number up to 65535, or a bracket that isn't closed."""
    port, authority = parts["port"], parts["authority"]
    number = F.when(port.rlike("^[0-9]{1,9}$"), port.cast("int"))
    return (port.isNotNull() & (number.isNull() | (number > 65535))) | (authority.contains("[") != authority.contains("]"))


def _written(value: str) -> str | None:
    try:
        return str(ipaddress.ip_address(value)) if ":" in value else value.encode("idna").decode("ascii")
    except ValueError:
        return None


@F.pandas_udf(StringType())
def written_host(host: pd.Series) -> pd.Series:
    """The ASCII form of a host, the short form of an address; null if it has none."""
    return host.map(lambda v: None if v is None else _written(v))


def _host_of(raw: Column) -> Column:
    """struct(host, code) of a raw host name."""
    bare = F.lower(F.regexp_replace(raw, r"\.+$", ""))
    simple = bare.rlike(r"^[\x00-\x39\x3b-\x7f]*$")
    labels = F.split(bare, r"\.")
    host = F.when(simple, F.when((bare == "") | ~F.exists(labels, lambda p: (p == "") | (F.length(p) > 63)), bare)).otherwise(written_host(F.when(~simple, bare)))
    address = bare.contains(":") | bare.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")
    code = _first(
        (bare.contains(":") & host.isNull(), "malformed_url"),
        (host.isNull(), "invalid_hostname"),
        (~address & ((host == "") | (F.length(host) > 253) | (host == "localhost") | ~host.contains(".")), "non_public_hostname"),
        (~address & (_ends(host, BLOCKED_SUFFIXES) | ~F.forall(F.split(host, r"\."), lambda p: p.rlike(LABEL))), "non_public_hostname"),
    )
    return F.struct(host.alias("host"), code.alias("code"))


def _ends(value: Column, suffixes) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | value.endswith(s)
    return out


def _default_port(parts: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in PORTS.items() for x in pair])[parts["scheme"]]


def _query_keys(query: Column) -> Column:
    """Decoded keys of a query."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))))


def canonical_url(url: Column) -> Column:
    """struct(url, host, code): the URL to fetch, without fragment, or why it may not be fetched."""
    p = url_parts(url)
    return _canonical(url, p, _host_of(p["host"]))


def with_canonical(df: DataFrame, url: str = "url", out: str = "canonical") -> DataFrame:
    """``df`` with ``canonical_url`` in a column; parts and host are computed once, in steps of their own."""
    df = df.withColumn("_parts", url_parts(F.col(url)))
    df = df.withColumn("_host", _host_of(F.col("_parts.host")))
    return df.withColumn(out, _canonical(F.col(url), F.col("_parts"), F.col("_host"))).drop("_parts", "_host")


def _canonical(url: Column, p: Column, host: Column) -> Column:
    wanted = _default_port(p)
    code = _first(
        (malformed(p), "malformed_url"),
        (~p["scheme"].isin(*PORTS), "unsupported_scheme"),
        (p["user"].isNotNull(), "credentials_forbidden"),
        (p["host"] == "", "invalid_hostname"),
        (p["port"].isNotNull() & (p["port"].cast("bigint") != wanted.cast("bigint")), "unsupported_port"),
        (F.exists(_query_keys(p["query"]), lambda k: k.rlike(CREDENTIAL_KEY)), "credentials_forbidden"),
    )
    code = F.when(url.isNotNull(), F.coalesce(code, host["code"]))
    named = F.when(host["host"].contains(":"), F.concat(F.lit("["), host["host"], F.lit("]"))).otherwise(host["host"])
    path = F.when(p["path"] == "", "/").otherwise(p["path"])
    query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")
    built = F.concat(p["scheme"], F.lit("://"), named, path, query)
    return F.struct(F.when(code.isNull(), built).alias("url"), F.when(code.isNull(), host["host"]).alias("host"), code.alias("code"))


def plain_form(url: Column) -> Column:
    """struct(url, host, code, path) of a URL that meets ``PLAIN_URL``: what ``crawl_url`` makes of its canonical form, without parsing it."""
    bare = F.split_part(url, F.lit("#"), F.lit(1))
    host = F.split_part(bare, F.lit("/"), F.lit(3))
    path = F.substr(bare, F.length(F.split_part(bare, F.lit("/"), F.lit(1))) + F.length(host) + 3)
    return F.struct(F.when(path == "", F.concat(bare, F.lit("/"))).otherwise(bare).alias("url"), host.alias("host"), F.lit(None).cast("string").alias("code"), path.alias("path"))


def _quoted(text: Column) -> Column:
    """A decoded query part, encoded anew."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def crawl_url(c: Column, tracking: tuple[str, ...]) -> Column:
    """struct(url, code): a canonical URL (a column of ``canonical_url``) without the query keys that only track; keys and values are encoded anew."""
    head, query = F.split_part(c["url"], F.lit("?"), F.lit(1)), F.regexp_extract(c["url"], r"(?s)\?(.*)$", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(
        F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.try_url_decode(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*tracking) & ~F.lower(p["k"]).startswith("utm_"))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(_quoted(p["k"]), F.lit("="), _quoted(p["v"]))), "&")
    return F.struct(F.when(joined != "", F.concat(head, F.lit("?"), joined)).otherwise(head).alias("url"), c["code"].alias("code"))


def default_port_url(url: Column, schemes: tuple[str, ...] = ("http", "https")) -> Column:
    """A search result's URL, or null if it isn't one; a stated default port stays. With ("https",): a model source's."""
    p = url_parts(F.trim(url))
    bad = malformed(p) | ~p["scheme"].isin(*schemes) | (p["host"] == "") | p["user"].isNotNull()
    bad = bad | F.coalesce(p["port"].cast("bigint") != _default_port(p).cast("bigint"), F.lit(False))
    place = F.concat(F.regexp_replace(p["host"], r"\.+$", ""), F.coalesce(F.concat(F.lit(":"), p["port"].cast("bigint").cast("string")), F.lit("")))
    query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")
    return F.when(~bad, F.concat(p["scheme"], F.lit("://"), place, F.when(p["path"] == "", "/").otherwise(p["path"]), query))


def search_domain(domain: Column) -> Column:
    """A domain in small letters without a last dot, or null if it isn't one."""
    d = F.lower(F.regexp_replace(F.trim(domain), r"\.+$", ""))
    label = lambda p: (p != "") & (F.length(p) <= 63) & ~p.startswith("-") & ~p.endswith("-") & p.rlike(r"^[\p{L}\p{N}-]+$")
    return F.when((d != "") & (F.length(d) <= 253) & ~d.rlike(r"[/@:\x00-\x20\x7f]") & F.forall(F.split(d, r"\."), label), d)


def domain_list(domains: Column) -> Column:
    """struct(domains, code): a list in normal form; null is empty; a bad or repeated one is an error."""
    clean = F.transform(F.coalesce(domains, F.array().cast("array<string>")), search_domain)
    code = _first((F.exists(clean, lambda d: d.isNull()), "search_domain_invalid"), (F.size(clean) != F.size(F.array_distinct(clean)), "search_domains_not_unique"))
    return F.struct(F.when(code.isNull(), clean).alias("domains"), code.alias("code"))


def search_filters(include: Column, exclude: Column, since: Column, until: Column) -> Column:
    """Code of filters that contradict each other: common domains, or dates in reverse."""
    return _first((F.arrays_overlap(include, exclude), "search_domain_conflict"), (since > until, "search_dates_reversed"))


def robots_url(url: Column) -> Column:
    p = url_parts(url)
    return F.concat(p["scheme"], F.lit("://"), p["authority"], F.lit("/robots.txt"))


def is_pdf(url: Column) -> Column:
    return F.lower(url_parts(url)["path"]).endswith(".pdf")


def root_host(url: Column) -> Column:
    host = url_parts(url)["host"]
    return F.when(host != "", host)


def _address_code(value: str) -> str | None:
    try:
        address = ipaddress.ip_address(value)
    except ValueError:
        return "invalid_ip_address"
    if address.version == 6:
        translated = any(address in ipaddress.ip_network(n) for n in TRANSLATION_NETWORKS)
        if translated or address.scope_id is not None or any(v is not None for v in (address.ipv4_mapped, address.sixtofour, address.teredo)):
            return "non_public_ip_address"
    routed = address.is_global and not address.is_multicast and not address.is_unspecified
    return None if routed else "non_public_ip_address"


@F.pandas_udf(StringType())
def public_address(address: pd.Series) -> pd.Series:
    """Why an address is none of the public internet's; null if it is one."""
    return address.map(lambda v: None if v is None else _address_code(v))


@F.pandas_udf(StringType())
def first_bad_address(answers: pd.Series) -> pd.Series:
    """The code of the first address of a list that isn't public."""
    return answers.map(lambda values: None if values is None else next((c for c in map(_address_code, values) if c), None))


def answers_code(answers: Column) -> Column:
    """Why a host's addresses, as one look-up gave them, may not be used; null if all are public."""
    once = F.array_distinct(answers)
    few = F.size(once).between(1, MOST_ANSWERS)
    return F.when(answers.isNull() | (F.size(once) == 0), "dns_resolution_failed").when(F.size(once) > MOST_ANSWERS, "too_many_dns_answers").otherwise(first_bad_address(F.when(few, once)))


def header_code(content_type: Column, encoding: Column, length: Column, most: int) -> Column:
    """Why a response's headers forbid reading it; null if they don't."""
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    number = F.when(F.trim(length).rlike("^[+-]?[0-9]{1,18}$"), F.trim(length).cast("bigint"))
    return _first(
        (~kind.isin(*FETCHED_TYPES), "content_type_not_allowed"),
        (~F.lower(F.trim(F.coalesce(encoding, F.lit("identity")))).isin("", "identity"), "content_encoding_not_allowed"),
        (length.isNotNull() & number.isNull(), "invalid_content_length"),
        ((number < 0) | (number > most), "response_too_large"),
    )


def robots_outcome(status: Column, same_host: Column, content_type: Column, size: Column, allowed: Column, delay: Column, largest: int = 256 * 1024, longest: float = 5.0) -> Column:
    """struct(status, code, retryable) of a robots file's recorded answer; a null status is an answer that never came."""
    row = lambda state, code, again: F.struct(F.lit(state).alias("status"), F.lit(code).alias("code"), F.lit(again).alias("retryable"))
    return (
        F.when(status.isNull(), row(None, "page_robots_unavailable", True))
        .when(~same_host, row(None, "page_robots_offsite_redirect", False))
        .when(status.isin(401, 403, 407, 451), row(None, "page_robots_denied", False))
        .when((status == 429) | (status >= 500), row(None, "page_robots_unavailable", True))
        .when(status.between(400, 499), row("absent", None, False))
        .when(~status.between(200, 299), row(None, "page_robots_http_error", False))
        .when(~content_type.isin("application/xhtml+xml", "text/html", "text/plain"), row(None, "page_robots_content_type", False))
        .when(size > largest, row(None, "page_robots_too_large", False))
        .when(~allowed, row(None, "page_robots_denied", False))
        .when(delay > longest, row(None, "page_robots_delay_exceeds_limit", False))
        .otherwise(row("allowed", None, False))
    )


def robots_delay(own: Column, anyones: Column, seconds: Column, requests: Column) -> Column:
    """Seconds between requests: the stated delay or that of a request rate, whichever is longer."""
    rate = F.when(requests > 0, seconds / requests)
    return F.greatest(F.coalesce(own, anyones, F.lit(0.0)).cast("double"), F.coalesce(rate, F.lit(0.0)))


def page_code(status: Column, content_type: Column, size: Column, largest: int = 2 << 20) -> Column:
    """struct(code, retryable) of a page's recorded answer; null for one that can be read."""
    row = lambda code, again=False: F.struct(F.lit(code).alias("code"), F.lit(again).alias("retryable"))
    return (
        F.when(status.isin(401, 403, 407, 451), row("page_access_denied"))
        .when(status == 429, row("page_rate_limited", True))
        .when(status >= 500, row("page_unavailable", True))
        .when(~status.between(200, 299), row("page_http_error"))
        .when(size > largest, row("page_response_too_large"))
        .when(content_type == "application/pdf", row("page_binary_scan_required"))
        .when(~content_type.isin(*READ_TYPES), row("page_content_type_not_parseable"))
    )


def intake_url(url: Column) -> Column:
    """struct(url, code): a submitted website's URL in normal form, or ``unsafe_url``.

    As ``canonical_url``, but either default port may go with either scheme, an
    empty user is no user, and an address must be public.
    """
    p = url_parts(F.trim(url))
    host = _host_of(p["host"])
    address = host["host"].contains(":") | host["host"].rlike(r"^[0-9.]+$")
    port = p["port"].cast("bigint").cast("string")
    bad = F.coalesce(malformed(p), F.lit(False)) | F.coalesce(~p["scheme"].isin(*PORTS), F.lit(True)) | F.coalesce(F.regexp_replace(p["user"], "^:?$", "") != "", F.lit(False))
    bad = bad | F.coalesce(~port.isin("80", "443"), F.lit(False)) | host["code"].isNotNull() | F.exists(_query_keys(p["query"]), lambda k: k.rlike(CREDENTIAL_KEY))
    bad = bad | F.coalesce(public_address(F.when(address, host["host"])).isNotNull() & address, F.lit(False))
    named = F.when(host["host"].contains(":"), F.concat(F.lit("["), host["host"], F.lit("]"))).otherwise(host["host"])
    shown = F.when(port.isNotNull() & (port != _default_port(p)), F.concat(F.lit(":"), port)).otherwise("")
    built = F.concat(p["scheme"], F.lit("://"), named, shown, F.when(p["path"] == "", "/").otherwise(p["path"]), F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""))
    return F.struct(F.when(~bad, built).alias("url"), F.when(url.isNotNull() & bad, "unsafe_url").alias("code"))
