"""Corporate filings: acquisition from fixtures, registration of untrusted files, gating by confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
MOST_BYTES = 25 << 20


def grouped(filings: DataFrame) -> DataFrame:
    """(cin, documents): the filings of each company, in order of their ids."""
    return filings.groupBy("cin").agg(F.array_sort(F.collect_list("document_id")).alias("documents"))


def acquired(requests: DataFrame, filings: DataFrame) -> DataFrame:
    """Requests (request_id, cin, types, years) with their filings' ids, status and action code.

    No years means any year. A request without filings is unavailable.
    """
    hits = requests.join(filings, "cin").filter(F.array_contains("types", c("filing_type")) & ((F.size("years") == 0) | F.array_contains("years", c("financial_year"))))
    per = hits.groupBy("request_id").agg(F.array_sort(F.collect_list("document_id")).alias("documents"))
    both = requests.join(per, "request_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<string>")))
    none = F.size("documents") == 0
    return both.select("request_id", "cin", "documents", F.when(none, "unavailable").otherwise("ready").alias("status"), F.when(none, "no_matching_documents").alias("action"))


def by_hand(requests: DataFrame) -> DataFrame:
    """A source that only people can use: every request waits for one."""
    return requests.select("request_id", "cin", F.array().cast("array<string>").alias("documents"), F.lit("human_action_required").alias("status"), F.lit("mca_vpd_login_payment_required").alias("action"))


def for_confirmed(requests: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Requests whose company is the confirmed one of its report; others get a code.

    Confirmed: report_id, cin.
    """
    both = requests.join(confirmed.withColumnRenamed("cin", "_cin"), "report_id", "left")
    code = F.when(c("_cin").isNull(), "filing_entity_not_confirmed").when(c("_cin") != c("cin"), "corporate_filing_provider_request_mismatch")
    return both.withColumn("code", code).drop("_cin")


def registered(files: DataFrame) -> DataFrame:
    """Files (document_id, cin, body) as quarantined references: digest, size, never parseable; code for a body that may not be kept."""
    size = F.octet_length("body")
    code = F.when(F.coalesce(size, F.lit(0)) == 0, "file_body_invalid").when(size > MOST_BYTES, "file_body_too_large")
    kept = lambda v: F.when(c("code").isNull(), v)
    return files.withColumn("code", code).select(
        "document_id", "cin", kept(F.sha2("body", 256)).alias("sha256"), kept(size).alias("size_bytes"), kept(F.lit("pending_malware_scan")).alias("quarantine_status"), kept(F.lit(False)).alias("parse_allowed"), "code"
    )


def by_kind(media_type: Column) -> Column:
    return media_type.isin("application/pdf", "application/zip", "application/octet-stream")
