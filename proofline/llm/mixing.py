"""Mixing sources to target weights (native: DataFrame functions only).

Efraimidis-Spirakis sampling: each document draws the exponential key
``-ln(u) / quality`` from a hash of its id, so that sorting a source by key is
weighted sampling without replacement. A source whose target exceeds its size
is first taken in complete epochs; what is left of the target is filled with
the documents whose prefix sum, in key order, comes nearest to it.

A source may hold a third of all rows, so no window spans a source: keys fall
into buckets of about equal counts (by quantiles of the source's own keys), the
sizes of the buckets are summed first, and each row adds its bucket's start to a
prefix sum within the bucket.

Defined results: a null or empty text has size 0 and is taken with 0 words; a
null source is a source of its own, after all others; equal keys (repeated
doc_ids) are ordered by size; repeated rows count each; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.llm.common import cut, row_hash, text_or_empty, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
ROWS_PER_BUCKET = 4096
#: Parts of a source by quantiles, and sources up to which their borders (some 0.5 KB a source) are broadcast.
TOP = 64
MOST_SOURCES = 10_000


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of letters among a text's characters."""
    text = text_or_empty(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.lit(0.1) + F.lit(0.9) * letters / F.greatest(F.length(text), F.lit(1))


def exponential_key(doc_id: Column, quality: Column, seed: str = "mix") -> Column:
    """Smaller keys are taken first; a document of higher quality tends to a smaller one."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10)
    u = (drawn.cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / quality


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Targets of sources from (source, source_size); one row a source.

    Shares follow the repeating weights in code point order of the sources and
    add up to all sizes. A target stops at ``cap`` times its source's size; the
    excess goes to the others by weight. In order of size to weight, the capped
    sources come first, so one pass of prefix sums finds the water level.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_n", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * F.lit(float(cap))
    by_fill = Window.orderBy(limit / F.col("_w"), "_n")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("_at", F.row_number().over(by_fill))
        .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    )
    level = F.col("_left") / F.col("_open")
    ranked = ranked.withColumn("_capped", limit / F.col("_w") <= level)
    first_open = F.min(F.when(~F.col("_capped"), F.struct("_at", level.alias("_level")))).over(everything)
    ranked = ranked.withColumn("_first", first_open)
    return ranked.select(
        "source",
        "source_size",
        F.when(F.col("_capped") | F.col("_first").isNull(), limit).otherwise(F.col("_first._level") * F.col("_w")).alias("target"),
    )


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, written, and marked for broadcast if it has so few rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def _dealt(narrow: DataFrame, rows_per_bucket: int) -> DataFrame:
    """``narrow`` with a bucket that grows with the key within a source, equal keys alike.

    ``TOP`` parts of a source end at approximate quantiles of its keys, whatever
    their distribution; a part is cut as often as its rows ask, evenly, the last
    one by an exponential tail.
    """
    borders = narrow.groupBy("_source").agg(F.percentile_approx("_key", [k / TOP for k in range(1, TOP)], 20 * TOP).alias("_borders"))
    top = F.size(F.filter("_borders", lambda x: x < F.col("_key")))
    narrow = narrow.join(_bounded(borders, MOST_SOURCES), "_source").withColumn("_top", top).drop("_borders")
    parts = narrow.groupBy("_source", "_top").agg(F.count("*").alias("_n"), F.min("_key").alias("_low"), F.max("_key").alias("_high"), F.avg("_key").alias("_mean"))
    parts = parts.withColumn("_n", F.ceil(F.col("_n") / rows_per_bucket).cast("long")).filter("_n > 1 and _high > _low")
    narrow = narrow.join(_bounded(parts, MOST_SOURCES * TOP), ["_source", "_top"], "left")
    over = F.col("_key") - F.col("_low")
    share = F.when(F.col("_top") < TOP - 1, over / (F.col("_high") - F.col("_low"))).otherwise(1 - F.exp(-over / (F.col("_mean") - F.col("_low"))))
    within = F.coalesce(F.least(F.floor(share * F.col("_n")), F.col("_n") - 1), F.lit(0)).cast("long")
    return narrow.withColumn("_bucket", F.struct("_top", within.alias("_in"))).drop("_top", "_n", "_low", "_high", "_mean")


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    cap: float = CAP,
    size: Column | None = None,
    quality: Column | None = None,
    seed: str = "mix",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per document: doc_id, text_key, source, size, source_size, target, copies, taken.

    ``copies`` is the number of times the mix takes the document (complete
    epochs, and one more if it is in the fractional selection); ``taken`` is
    copies times size.
    """
    size = word_count(F.col("text")) if size is None else size.cast("long")
    quality = quality_weight(F.col("text")) if quality is None else quality
    narrow = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        "source",
        _source_key("source").alias("_source"),
        size.alias("size"),
        exponential_key(F.col("doc_id"), quality, seed).alias("_key"),
    )
    narrow = cut(narrow)
    narrow = _dealt(narrow, rows_per_bucket)
    sums = narrow.groupBy("_source", "_bucket").agg(F.first("source").alias("source"), F.sum("size").alias("_part"))
    sums = cut(sums)
    targets = source_targets(sums.groupBy("_source").agg(F.first("source").alias("source"), F.sum("_part").alias("source_size")).drop("_source"), weights, cap)
    targets = targets.select(_source_key("source").alias("_source"), "source_size", "target")
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_source", "_bucket", F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_start")).join(targets, "_source")
    rows = narrow.join(starts, ["_source", "_bucket"])
    within = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("_before", before).withColumn("_epochs", epochs)
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    chosen = (rest > 0) & (F.col("_before") + F.col("size") / 2 <= rest)
    rows = rows.withColumn("copies", F.col("_epochs") + chosen.cast("long"))
    return rows.select("doc_id", "text_key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan takes it.

    Rows and plan meet on source, doc_id and text, so each source has the copies
    its plan asks for. Of rows that repeat all three, whose plans differ by one
    copy at most, those whose other columns have the least hashes get more.
    """
    id_key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("_id")
    keys = ["_source", "_id", "_text_key"]
    plan = mix_plan(docs, **options).select(_source_key("source").alias("_source"), id_key, F.col("text_key").alias("_text_key"), "copies")
    plan = plan.groupBy(keys).agg(F.min("copies").alias("_low"), (F.sum("copies") - F.count("*") * F.min("copies")).alias("_more")).filter("_low + _more > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _source_key("source").alias("_source"), id_key, F.xxhash64("text").alias("_text_key"), row_hash(docs).alias("_order"))
    number = F.row_number().over(Window.partitionBy(keys).orderBy("_order"))
    copies = (F.col("_low") + (number <= F.col("_more")).cast("long")).cast("int")
    taken = rows.join(plan, keys).withColumn("_copies", copies).filter("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def _source_key(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         xxx.key AS k
  FROM documents, LATERAL (
    SELECT -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
           / (0.1 + 0.9 * length(regexp_replace(coalesce(text, ''), '[^\p{L}]+', '', 'g')) / greatest(length(coalesce(text, '')), 1)) AS key) xxx
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS lim FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY lim / w, n) AS place,
        (sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest,
        sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY lim / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS open_w
      FROM w),
q AS (SELECT *, lim / w <= rest / open_w AS capped FROM p),
f AS (SELECT arg_min(rest / open_w, place) AS level FROM q WHERE NOT capped),
t AS (SELECT source, source_size, CASE WHEN capped OR level IS NULL THEN lim ELSE level * w END AS target FROM q, f),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, epochs + CASE WHEN target - epochs * source_size > 0 AND before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END AS copies FROM b)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM c
"""
