"""Keyed records: keep-first and keep-last, merging, upserts, replays, rates, transitions, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Legal changes of a request's state.
TRANSITIONS = {
    "draft": "resolving_entity",
    "resolving_entity": "awaiting_entity_confirmation failed_no_charge",
    "awaiting_entity_confirmation": "draft preliminary_research",
    "preliminary_research": "awaiting_clarification failed_no_charge",
    "failed_no_charge": "draft",
    "awaiting_clarification": "queued",
    "queued": "researching cancelled_restored",
    "researching": "verifying retry_wait failed_restored cancelled_restored",
    "verifying": "composing retry_wait failed_restored cancelled_restored",
    "composing": "rendering retry_wait failed_restored cancelled_restored",
    "rendering": "completed retry_wait failed_restored cancelled_restored",
    "retry_wait": "queued",
}
STAGES = (
    "plan", "research_business", "research_industry", "research_competitors", "research_corporate", "research_regulatory", "research_public_risk",
    "verify_contradictions", "analyze_transaction_prep", "compose_brief", "final_verify", "render_pdf", "deliver",
)


def keep_first(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key; partial aggregation would lose ties, so ranks are used."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_place_last_value(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, place, value): where a key came first, and its value where it came last."""
    return rows.groupBy(key).agg(F.min(order).alias("place"), F.max_by(value, order).alias(value))


def merged(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One record a key: the first non-null value of each field."""
    return rows.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def merged_companies(rows: DataFrame, key: str, order: str, fields: list[str], first: list[str], names: str) -> DataFrame:
    """``merged`` with ``first`` columns as the first record has them, null or not, and the names of all records once each, in order."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(order, names))), lambda s: F.coalesce(s[names], F.array().cast("array<string>")))
    whole = [F.min_by(F.struct(f), order)[f].alias(f) for f in first]
    return rows.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields], *whole, F.array_distinct(F.flatten(lists)).alias(names))


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` with rows of ``source`` replacing or joining those of the same key."""
    fields = [c for c in target.columns if c != key]
    new = source.select(key, F.struct(*fields).alias("_new"))
    old = target.select(key, F.struct(*fields).alias("_old"))
    both = old.join(new, key, "full_outer").withColumn("_row", F.coalesce("_new", "_old"))
    return both.select(key, *[F.col(f"_row.{f}").alias(f) for f in fields])


def replay_outcome(commands: DataFrame, keys: list[str], payload: str, order: list[str]) -> DataFrame:
    """``accepted`` for the first use of a key, then ``replayed`` or, with another payload, ``conflict``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.first(payload).over(w)
    outcome = F.when(F.row_number().over(w) == 1, "accepted").when(first.eqNullSafe(F.col(payload)), "replayed").otherwise("conflict")
    return commands.withColumn("outcome", outcome)


def trailing_hour(events: DataFrame, key: str, ts: str, limit: int = 10) -> DataFrame:
    """Events of the same key in the hour up to each, itself included, and whether that passes the limit."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(micros).rangeBetween(-3_600_000_000, 0)
    return events.withColumn("in_hour", F.count("*").over(w)).withColumn("limited", F.col("in_hour") > limit)


def legal(old: Column, new: Column) -> Column:
    table = F.create_map(*[v for k, to in TRANSITIONS.items() for v in (F.lit(k), F.split(F.lit(to), " "))])
    return F.coalesce(F.array_contains(table[old], new), F.lit(False))


def transitions(states: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """Each change of a key's state, and whether it is legal."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return states.withColumn("from_state", before).filter("from_state is not null").withColumn("legal", legal(F.col("from_state"), F.col(state)))


def next_stage(done: DataFrame, key: str) -> DataFrame:
    """The first stage, in order, that a key has not completed; null when all are."""
    order = F.array(*map(F.lit, STAGES))
    missing = F.array_except(order, F.collect_set("stage"))
    return done.groupBy(key).agg(F.try_element_at(missing, F.lit(1)).alias("next_stage"), F.count_distinct("stage").alias("completed"))


def ledger(usage: DataFrame, key: str, amount: str, order: list[str], cap: float) -> DataFrame:
    """Running totals, and whether an entry would take its key over the cap."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return usage.withColumn("running", F.sum(amount).over(w)).withColumn("would_exceed", F.col("running") > cap)


def delivery(read_count: Column, valid: Column, failed: Column, most: int = 4) -> Column:
    """What becomes of a leased message."""
    return F.when(~valid, "dead_letter_invalid").when(read_count > most, "dead_letter_exhausted").when(failed, "redeliver").otherwise("archive")
