"""Exact deduplication (native: DataFrame and SQL functions only).

Heavy-hitter split: a Misra-Gries summary (Spark's ``approx_top_k``, whose
sketch is the Misra-Gries counter scheme with batched decrements) proposes the
frequent digests. One aggregation verifies them: exact counts, and the largest
doc_id as winner. The winners, at most ``heavy`` rows, are broadcast, and the
losers of frequent digests are decided where they are read. Winners and all
remaining digests are shuffled by digest as usual.

Defined results: a null text counts as empty; a null doc_id is smaller than any
other; of rows that repeat both doc_id and text one stays; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import cut, row_hash, text_or_empty

#: Digests that the broadcast may hold at most, and counters of the summary.
HEAVY = 1000
COUNTERS = 8192


def duplicate_groups(docs: DataFrame, text: Column | None = None, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    digest = F.sha2(text_or_empty(F.col("text") if text is None else text), 256)
    rows = cut(docs.select("doc_id", digest.alias("text_sha256")))
    frequent = rows.agg(F.expr(f"approx_top_k(text_sha256, {heavy}, {counters})").alias("_top")).select(F.explode("_top").alias("_top"))
    frequent = frequent.select(F.col("_top.item").alias("text_sha256")).filter(F.col("text_sha256").isNotNull())
    winners = (
        rows.join(F.broadcast(frequent), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.count("*").alias("_count"), F.max("doc_id").alias("_winner"))
        .filter("_count > 1")
    )
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    lost = F.col("_count").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("_winner"))
    marked = cut(marked.withColumn("_lost", lost))
    early = marked.filter("_lost").select("doc_id", F.col("_winner").alias("keep_id"), F.col("_count").alias("group_size"), F.lit(False).alias("kept"), "text_sha256")
    group = Window.partitionBy("text_sha256")
    rest = marked.filter(~F.col("_lost")).withColumn("_n", F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last())))
    late = rest.select(
        "doc_id",
        F.max("doc_id").over(group).alias("keep_id"),
        F.coalesce(F.col("_count"), F.count("*").over(group)).alias("group_size"),
        (F.col("_n") == 1).alias("kept"),
        "text_sha256",
    )
    return early.unionByName(late)


def drop_duplicates(docs: DataFrame, text: Column | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    Joined on doc_id and digest of ``text`` (the column of that name, or an
    expression over it). Of rows that repeat both, the one stays whose other
    columns have the least hash, so that reruns agree.
    """
    kept = duplicate_groups(docs, text, **options).filter("kept").select(_key("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
    digest = F.sha2(text_or_empty(F.col("text") if text is None else text), 256)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _key("doc_id").alias("_id"), digest.alias("_digest"), row_hash(docs).alias("_order"))
    packed = packed.join(kept, ["_id", "_digest"], "left_semi")
    packed = packed.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_digest").orderBy("_order")))
    return packed.filter("_n = 1").select("_row.*")


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
