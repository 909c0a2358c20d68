"""An append-only ledger of credits: balances, lots, and what breaks its rules.

Entries: entry_id, user_id, at (any ordered type), kind, credits (signed),
expires_at (of grants), reserve_id (of consume, release and restore: the reserve they end),
request_id (of reserves), idempotency_key, passed (of consume). A user's entries are in order of at,
then entry_id. A consume takes the place of its reserve, so it moves no balance.

Sums along a user's entries are taken in blocks: entries are dealt by ranges of
(user, order), summed within a range, and the ranges' totals, a row for each user and range,
are summed in turn. So a user with a third of all entries is dealt like any others.

Defined results: entries without user or id, or with a null time, come first in their order; a null amount counts as zero;
entries that repeat an id are entries each; an empty ledger gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.operators.steps import Steps

# Fixed values.
POSITIVE, NEGATIVE = ("purchase_grant", "trial_grant", "release", "restore"), ("reserve", "consume", "expiry", "refund_reversal")
GRANTS, USES, ENDINGS = ("purchase_grant", "trial_grant"), ("reserve", "expiry", "refund_reversal"), ("consume", "release", "restore")


def running(df: DataFrame, steps: Steps, name: str, key: str, order: list, value: Column, ranges: int | None = None) -> DataFrame:
    """``df`` with _upto, the sum of ``value`` over a key's rows up to each, in an order that tells all rows apart."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_value", value).repartitionByRange(ranges, key, *order).withColumn("_range", F.spark_partition_id())
    dealt = steps.write(dealt, name)
    inner = F.sum("_value").over(Window.partitionBy(key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    totals = dealt.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("_key", "_of", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = dealt.withColumn("_inner", inner).join(totals, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return joined.withColumn("_upto", F.col("_before") + F.col("_inner")).drop("_value", "_range", "_inner", "_key", "_of", "_before")


def _amount() -> Column:
    return F.coalesce(F.col("credits"), F.lit(0)).cast("long")


def balances(entries: DataFrame, ranges: int | None = None) -> DataFrame:
    """Entries with the balance after each."""
    moved = F.when(F.col("kind") == "consume", F.lit(0)).otherwise(_amount())
    return running(entries, Steps(entries.sparkSession, "ledger"), "balances", "user_id", ["at", "entry_id"], moved, ranges).withColumnRenamed("_upto", "balance")


def endings(entries: DataFrame) -> DataFrame:
    """reserve_id, and how often and how each reserve ended: endings, first (the kind of the first one by entry_id)."""
    done = entries.filter(F.col("kind").isin(*ENDINGS) & F.col("reserve_id").isNotNull())
    return done.groupBy("reserve_id").agg(F.count("*").alias("endings"), F.min_by("kind", "entry_id").alias("ended_as"))


def allocations(entries: DataFrame, block: int = 4096, ranges: int | None = None) -> DataFrame:
    """user_id, use_id, grant_id, credits: which grants pay for each use, the first to expire first.

    Uses are reserves that weren't given back, expiries and reversals, in their order; grants
    are in order of expiry (none: last). Both are laid out on the line of a user's credits, one after
    the other, and a use is paid by the grants beside it. The line is cut into blocks of ``block`` credits,
    in each of which the ends of grants and uses are swept once. What no grant covers has a null grant_id.
    """
    steps = Steps(entries.sparkSession, "lots")
    back = endings(entries).filter(F.col("ended_as") != "consume").select(F.col("reserve_id").alias("entry_id"))
    taken = entries.filter(F.col("kind").isin(*USES)).join(back, "entry_id", "left_anti")
    size = F.abs(_amount())
    uses = running(taken.filter(size > 0).select("user_id", "at", "entry_id", "credits"), steps, "uses", "user_id", ["at", "entry_id"], size, ranges)
    given = entries.filter(F.col("kind").isin(*GRANTS)).withColumn("_never", F.col("expires_at").isNull())
    grants = running(given.filter(size > 0).select("user_id", "_never", "expires_at", "entry_id", "credits"), steps, "grants", "user_id", ["_never", "expires_at", "entry_id"], size, ranges)
    uses, grants = steps.write(uses, "used"), steps.write(grants, "granted")
    used = uses.groupBy(F.col("user_id").alias("_u")).agg(F.max("_upto").alias("_most"))
    span = lambda df, side: df.select("user_id", (F.col("_upto") - size).alias("a"), F.col("_upto").alias("b"), F.col("entry_id").alias(side))
    grants = span(grants, "grant_id").join(used, F.col("user_id").eqNullSafe(F.col("_u"))).withColumn("b", F.least("b", "_most")).filter("a < b").drop("_u", "_most")

    def swept(df: DataFrame, side: str, other: str) -> DataFrame:
        cut = df.withColumn("k", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
        a, b = F.greatest("a", F.col("k") * block), F.least("b", (F.col("k") + 1) * block)
        return cut.select("user_id", "k", a.alias("p"), b.alias("end"), F.col(side), F.lit(None).cast(df.schema[side].dataType).alias(other))

    ends = swept(span(uses, "use_id"), "use_id", "grant_id").unionByName(swept(grants, "grant_id", "use_id"))
    ends = ends.withColumns({"use_end": F.when(F.col("use_id").isNotNull(), F.col("end")), "grant_end": F.when(F.col("grant_id").isNotNull(), F.col("end"))})
    stops = ends.filter("grant_end < (k + 1) * %d" % block).select("user_id", "k", F.col("end").alias("p"), *[F.lit(None).cast(ends.schema[c].dataType).alias(c) for c in ("use_id", "grant_id", "use_end", "grant_end")])
    ends = ends.drop("end").unionByName(stops)
    points = ends.groupBy("user_id", "k", "p").agg(*[F.max(c).alias(c) for c in ("use_id", "grant_id", "use_end", "grant_end")])
    line = Window.partitionBy("user_id", "k").orderBy("p")
    held = lambda c: F.last(c, ignorenulls=True).over(line)
    points = points.select("user_id", "p", held("use_id").alias("use_id"), held("grant_id").alias("grant_id"), held("use_end").alias("use_end"), held("grant_end").alias("grant_end"), F.lead("p").over(line).alias("_next"))
    covered = F.col("grant_end") > F.col("p")
    points = points.filter("use_end > p").select("user_id", "use_id", F.when(covered, F.col("grant_id")).alias("grant_id"), (F.least("use_end", "_next") - F.col("p")).alias("credits"))
    return points.groupBy("user_id", "use_id", "grant_id").agg(F.sum("credits").alias("credits"))


def violations(entries: DataFrame, block: int = 4096, ranges: int | None = None) -> DataFrame:
    """(rule, user_id, entry_id) of every entry that breaks a rule of the ledger; nothing is mended."""
    steps = Steps(entries.sparkSession, "violations")
    entries = steps.write(entries, "entries")
    rows = lambda df, rule: df.select(F.lit(rule).alias("rule"), "user_id", "entry_id")
    kind, amount = F.col("kind"), F.coalesce(F.col("credits"), F.lit(0))
    signs = entries.filter((kind.isin(*POSITIVE) & (amount <= 0)) | (kind.isin(*NEGATIVE) & (amount >= 0)) | ~F.coalesce(kind.isin(*POSITIVE, *NEGATIVE), F.lit(False)))
    out = rows(signs, "sign")
    out = out.unionByName(rows(entries.filter((kind == "consume") & ~F.coalesce("passed", F.lit(False))), "consume_without_pass"))

    def again(df: DataFrame, key: str) -> DataFrame:
        """Rows of a key after its first; firsts come from sums by key, so that a hot key isn't gathered."""
        first = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min("entry_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
        return df.join(first, F.col(key) == F.col("_k")).filter("entry_id > _first")

    out = out.unionByName(rows(again(entries, "idempotency_key"), "idempotency_key_repeated"))
    out = out.unionByName(rows(again(entries.filter(kind == "trial_grant").withColumn("_user", F.col("user_id")), "_user"), "trial_repeated"))
    ended = endings(entries)
    reserves = entries.filter(kind == "reserve")
    active = reserves.join(ended.select(F.col("reserve_id").alias("entry_id")), "entry_id", "left_anti")
    out = out.unionByName(rows(again(active, "request_id"), "request_reserved_twice"))
    done = entries.filter(kind.isin(*ENDINGS))
    known = reserves.select(F.col("entry_id").alias("_reserve"), F.col("user_id").alias("_owner")).distinct()
    strange = done.join(known, (F.col("reserve_id") == F.col("_reserve")) & F.col("user_id").eqNullSafe(F.col("_owner")), "left_anti")
    out = out.unionByName(rows(strange, "reserve_unknown"))
    out = out.unionByName(rows(again(done, "reserve_id"), "reserve_ended_twice"))
    out = out.unionByName(rows(balances(entries, ranges).filter("balance < 0"), "balance_negative"))
    paid = allocations(entries, block, ranges)
    paid = steps.write(paid, "paid")
    grants = entries.select(F.col("entry_id").alias("grant_id"), F.col("at").alias("_since"), F.col("expires_at").alias("_until"))
    uses = entries.select(F.col("entry_id").alias("use_id"), F.col("at").alias("_at"), F.col("kind").alias("_kind"))
    paid = paid.join(uses, "use_id").join(grants, "grant_id", "left")
    paid = paid.withColumn("entry_id", F.col("use_id"))
    out = out.unionByName(rows(paid.filter("grant_id is null").dropDuplicates(["use_id"]), "use_not_covered"))
    out = out.unionByName(rows(paid.filter("_since > _at").dropDuplicates(["use_id"]), "grant_after_use"))
    return out.unionByName(rows(paid.filter("_kind <> 'expiry' and _until <= _at").dropDuplicates(["use_id"]), "grant_expired"))
