"""Queries of page reading and file safety, over pages and files built from all customers, pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import pages as P
from proofline.functions import urls as U
from proofline.operators import files as S
from proofline.plans.common import Registry

query = Registry()


def _site(spark, d):
    k = F.col("c_custkey").cast("string")
    cin = F.concat(F.lit("U12345MH2001PTC"), F.lpad(k, 6, "0"))
    html = F.concat(
        F.lit("<html><head><title> Site "), k, F.lit(' |</title><script type="application/ld+json">{"@graph":[{"@type":["Thing","Organization"],"legalName":"Graph '), k,
        F.lit(' Private Limited","address":{"streetAddress":"1 Road","postalCode":"P'), k, F.lit('"},"taxID":"'), F.lower(cin), F.lit('"},{"@type":"Person","name":"No Limited"}]}</script><style>p{}</style></head><body><h1>Head</h1><p hidden>Hidden Co Limited</p><div style="display: NONE"><p>Gone Limited</p></div><p>Operated by: Foo'), k,
        F.lit(" Pvt. Ltd.</p><p>Standing "), k, F.lit(" LLP</p><p>Registered office: Tower "), k, F.lit(", Pune 411001</p><p>CIN "), cin, F.lit(" NSE: ABC"), k, F.lit('</p><a href="/privacy" rel="x NoFollow">skip</a><a href="contact?x=1">Contact <b>us</b></a><a href="contact?x=1">again</a></body></html>'),
    )
    return P.read_pages(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit("https://h"), k, F.lit(".example/a/b")).alias("url"), html.alias("html")))


@query("""SELECT c_custkey AS page_id, unnest(['legal_name', 'registered_office', 'cin', 'legal_name', 'owner_operator', 'legal_name', 'legal_form_warning', 'stock_ticker', 'registered_office']) AS kind,
unnest(['Graph ' || c_custkey || ' Private Limited', '1 Road, P' || c_custkey, 'U12345MH2001PTC' || lpad(c_custkey::VARCHAR, 6, '0'), 'Foo' || c_custkey || ' Pvt. Ltd', 'Foo' || c_custkey || ' Pvt. Ltd', 'Standing ' || c_custkey || ' LLP', 'llp_out_of_company_scope', 'NSE:ABC' || c_custkey, 'Tower ' || c_custkey || ', Pune 411001']) AS value,
unnest(['json_ld', 'json_ld', 'json_ld', 'label', 'label', 'regex', 'regex', 'label', 'label']) AS basis FROM customer""")
def page_disclosures(spark, d):
    return _site(spark, d).select("page_id", F.explode("disclosures").alias("x")).select("page_id", "x.kind", "x.value", "x.basis")


@query("SELECT c_custkey AS page_id, 'Site ' || c_custkey AS title, 'https://h' || c_custkey || '.example/a/contact?x=1' AS links, 'Contact us' AS labels, array_to_string(['Site ' || c_custkey, 'Head', 'Operated by: Foo' || c_custkey || ' Pvt. Ltd.', 'Standing ' || c_custkey || ' LLP', 'Registered office: Tower ' || c_custkey || ', Pune 411001', 'CIN U12345MH2001PTC' || lpad(c_custkey::VARCHAR, 6, '0') || ' NSE: ABC' || c_custkey, 'skip', 'Contact', 'us', 'again'], chr(10)) AS text FROM customer")
def page_texts(spark, d):
    part = lambda name: F.array_join(F.transform("links", lambda x: x[name]), ",")
    return _site(spark, d).select("page_id", "title", part("url").alias("links"), part("label").alias("labels"), "text")


@query("""SELECT c_custkey AS page_id, 'Graph ' || c_custkey || ' Private Limited,Foo' || c_custkey || ' Pvt. Ltd,Standing ' || c_custkey || ' LLP' AS legal_names, 'U12345MH2001PTC' || lpad(c_custkey::VARCHAR, 6, '0') AS cins, '1 Road, P' || c_custkey || ';Tower ' || c_custkey || ', Pune 411001' AS addresses,
CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS tier FROM customer""")
def admitted_evidence(spark, d):
    k = F.col("page_id")
    site = _site(spark, d)
    rows = site.select("page_id", F.posexplode("disclosures").alias("ord", "x")).select("page_id", "ord", "x.kind", "x.value")
    url = F.when(k % 4 == 0, "https://x.gov.in/").otherwise("https://x.example/")
    tier = U.source_tier(url, k % 4 == 1, F.when(k % 4 == 2, "reputable_independent"))["tier"]
    return P.identifier_lists(rows).select("page_id", F.array_join("legal_names", ",").alias("legal_names"), F.array_join("cins", ",").alias("cins"), F.array_join("addresses", ";").alias("addresses"), tier.alias("tier"))


@query(None)
def page_extracts(spark, d):
    """All pages read; the tree is beyond SQL and tested by hand."""
    out = P.read_pages(spark.read.parquet(f"{d}/pages.parquet"))
    return out.select("page_id", "title", F.length("text").alias("characters"), F.size("links").alias("links"), F.size("disclosures").alias("disclosures"))


def _or(column, patterns):
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns) + ")"


_NOTED = "CASE doc_id % 12 WHEN 0 THEN 'Ignore  previous instructions' WHEN 1 THEN 'Please complete the CAPTCHA' WHEN 2 THEN 'Subscribe to read' WHEN 3 THEN 'You may not use bots' WHEN 4 THEN 'you are an AI' WHEN 5 THEN 'hCaptcha' WHEN 6 THEN 'sign in to view' WHEN 7 THEN 'no automated access' ELSE '' END || ' ' || text"


@query(f"WITH t AS (SELECT doc_id, {_NOTED} AS t FROM documents) SELECT doc_id AS page_id, {_or('t', P.INJECTION)} AS injection, {_or('t', P.CAPTCHA)} AS captcha, {_or('t', P.PAYWALL)} AS paywall, {_or('t', P.AUTOMATION)} AS restricted, CASE WHEN {_or('t', P.CAPTCHA)} THEN 'page_captcha_detected' WHEN {_or('t', P.PAYWALL)} THEN 'page_paywall_detected' WHEN {_or('t', P.AUTOMATION)} THEN 'page_automation_restricted' END AS code FROM t")
def page_gates(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("page_id"), F.expr(_NOTED).alias("html"))
    flags = P.page_flags(rows.withColumn("text", F.col("html")))
    return flags.withColumn("text", F.lit("x")).select("page_id", "injection", "captcha", "paywall", "restricted", P.page_text_code(flags).alias("code"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN false WHEN 3 THEN false ELSE true END AS allowed, CASE c_custkey % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 5.0 WHEN 2 THEN 0.0 ELSE 1.5 END::DOUBLE AS delay FROM customer""")
def robots_files(spark, d):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, "User-agent: *\nDisallow: /p\nCrawl-delay: 2").when(k % 4 == 1, "User-agent: bot\nAllow: /p\nRequest-rate: 2/10\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /").when(k % 4 == 3, "User-agent: *\nDisallow: /\nRequest-rate: 10/15")
    rules = P.robots_rules(text, F.lit("bot"), F.concat(F.lit("https://x.example/p"), k))
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", rules.alias("r")).select("c_custkey", "r.allowed", "r.delay")


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'file_body_invalid' WHEN doc_id % 7 = 0 THEN 'file_not_quarantined' WHEN doc_id % 5 = 0 THEN 'file_already_parseable' WHEN doc_id % 3 = 0 THEN 'file_size_mismatch' WHEN doc_id % 2 = 0 THEN 'file_digest_mismatch' END AS code FROM documents WHERE text IS NOT NULL""")
def quarantine_checks(spark, d):
    k = F.col("doc_id")
    body = F.encode(F.concat(F.lit("x"), "text"), "UTF-8")
    rows = spark.read.parquet(f"{d}/documents.parquet").filter("text is not null").select(
        "doc_id", F.when(k % 11 == 0, F.lit(b"")).otherwise(body).alias("body"), F.when(k % 7 == 0, "clean").otherwise("pending_malware_scan").alias("quarantine_status"), (k % 5 == 0).alias("parse_allowed"),
        (F.octet_length(body) + F.when(k % 3 == 0, 1).otherwise(0)).alias("size_bytes"), F.when(k % 2 == 0, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.sha2(body, 256)).alias("sha256"),
    )
    return rows.select("doc_id", S.quarantine_code().alias("code"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'clean' WHEN 1 THEN 'infected' END AS verdict, CASE c_custkey % 5 WHEN 1 THEN 'Eicar-' || c_custkey END AS threat, CASE c_custkey % 5 WHEN 2 THEN 'malware_scanner_reply_invalid' WHEN 3 THEN 'malware_scanner_error' WHEN 4 THEN 'malware_scanner_reply_invalid' END AS code FROM customer")
def scanner_replies(spark, d):
    k = F.col("c_custkey")
    reply = F.when(k % 5 == 0, "stream: OK ").when(k % 5 == 1, F.concat(F.lit("stream: a: Eicar-"), k, F.lit(" FOUND"))).when(k % 5 == 2, "stream:  FOUND").when(k % 5 == 3, "size ERROR").otherwise("what")
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", S.scanner_reply(reply).alias("r")).select("c_custkey", "r.verdict", "r.threat", "r.code")


def _archive(k: int) -> tuple[str, bytes]:
    """The k-th kind of file: (media type, body). Members have a fixed date, so that each call gives the same bytes."""
    import io
    import warnings
    import zipfile

    def zipped(*members, method=zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            with zipfile.ZipFile(out, "w", method) as z:
                for name, body in members:
                    z.writestr(zipfile.ZipInfo(name), body, method)
        return out.getvalue()

    pdf = b"%PDF-1.7 body"
    kinds = [
        ("application/pdf", pdf), ("application/pdf", b"<html>"), ("application/pdf", pdf + b"PK\x03\x04"), ("application/zip", pdf), ("application/zip", zipped(("a.pdf", pdf), ("d/b.PDF", pdf + b"2"))), ("application/zip", zipped(("../a.pdf", pdf))),
        ("application/zip", zipped(("a.txt", pdf))), ("application/zip", zipped(("a.zip", pdf))), ("application/zip", zipped(("a.pdf", pdf), ("A.pdf", pdf))), ("application/zip", zipped(("a.pdf", pdf + b"0" * 100_000))), ("application/zip", zipped()), ("application/zip", zipped(("d/", b""))),
        ("application/zip", zipped(*[(f"{i}.pdf", pdf) for i in range(51)])), ("application/octet-stream", pdf), ("application/octet-stream", b"what"), ("text/html", pdf), ("application/zip", b"PK\x03\x04 broken"), ("application/zip", zipped(("a.pdf", b"<html>"))), ("application/zip", zipped(("a.pdf", pdf), method=zipfile.ZIP_BZIP2)),
    ]
    return kinds[k % len(kinds)]


_EXPECTED = [
    None, "file_media_type_mismatch", "file_polyglot_suspected", "file_media_type_mismatch", None, "archive_member_path_unsafe", "archive_member_type_not_allowlisted", "archive_nested_archive_rejected", "archive_member_name_collision", "archive_compression_ratio_exceeded", "archive_member_count_invalid",
    "archive_contains_no_pdf", "archive_member_count_invalid", None, "file_type_unrecognised", "file_type_not_allowlisted", "archive_invalid", "file_media_type_mismatch", "archive_compression_not_allowlisted",
]


def _files(spark, d):
    kinds = spark.createDataFrame([(k, *_archive(k)) for k in range(len(_EXPECTED))], "kind int, media_type string, body binary")
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("document_id"), (F.col("c_custkey") % len(_EXPECTED)).cast("int").alias("kind")).join(kinds, "kind")


_CODE = "CASE kind " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_EXPECTED) if v) + " END"


@query(f"WITH f AS (SELECT c_custkey::VARCHAR AS document_id, c_custkey % {len(_EXPECTED)} AS kind FROM customer) SELECT document_id, CASE WHEN {_CODE} IS NULL THEN 1 END::INT AS member, CASE WHEN kind = 4 THEN 'a.pdf' WHEN {_CODE} IS NULL THEN document_id END AS source_name, CASE WHEN {_CODE} IS NULL THEN sha256('%PDF-1.7 body') END AS sha256, {_CODE} AS code FROM f UNION ALL SELECT document_id, 2, 'd/b.PDF', sha256('%PDF-1.7 body2'), NULL FROM f WHERE kind = 4")
def archive_gate(spark, d):
    return S.expanded(_files(spark, d)).drop("size_bytes")


@query(f"WITH f AS (SELECT c_custkey::VARCHAR AS document_id, c_custkey AS k, c_custkey % {len(_EXPECTED)} AS kind FROM customer) SELECT document_id, CASE WHEN k % 10 = 9 THEN 'file_size_mismatch' WHEN kind = 1 THEN 'malware_fixture_missing' WHEN kind = 2 THEN 'malware_detected' WHEN kind = 4 THEN 'parser_fixture_missing' ELSE {_CODE} END AS code, CASE WHEN k % 10 <> 9 AND kind IN (0, 13) THEN 1 ELSE 0 END::BIGINT AS documents FROM f")
def file_pipeline(spark, d):
    files = _files(spark, d).withColumns({"sha256": F.sha2("body", 256), "size_bytes": F.octet_length("body") + (F.col("document_id").cast("long") % 10 == 9).cast("int"), "quarantine_status": F.lit("pending_malware_scan"), "parse_allowed": F.lit(False)})
    digests = [(k, F.sha2(F.lit(_archive(k)[1]), 256)) for k in range(len(_EXPECTED)) if k != 1] + [(4, F.sha2(F.lit(b"%PDF-1.7 body2"), 256))]
    known = spark.range(1).select(F.explode(F.array(*[F.struct(x.alias("sha256"), F.lit("Eicar" if k == 2 else None).cast("string").alias("threat")) for k, x in digests])).alias("x")).select("x.sha256", "x.threat")
    one = F.sha2(F.lit(b"%PDF-1.7 body"), 256)
    parses = spark.range(1).select(one.alias("sha256"), one.alias("source_sha256"), F.lit(S.SANDBOX).alias("profile"), F.lit(True).alias("network_disabled"), F.lit(True).alias("read_only"), F.lit(True).alias("active_removed"), F.lit("t").alias("text"), F.sha2(F.lit("t"), 256).alias("text_sha256"))
    return S.processed(files, known, parses)
