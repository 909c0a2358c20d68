"""Matching records, and rules over keyed tables that single rows can't decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.text import legal_name_key


def match_signals(signals: DataFrame, records: DataFrame) -> DataFrame:
    """(signal_id, cin) of each signal's records.

    A signal that names a number matches by it alone; others match the key of a
    record's present or former names. Two equi joins, so neither side is looped
    over. Signals: signal_id, cin, name. Records: cin, legal_name, former_names.
    """
    numbers = records.select("cin").distinct()
    by_number = signals.filter("cin is not null").join(numbers, "cin").select("signal_id", "cin")
    names = records.select("cin", F.explode(F.concat(F.array("legal_name"), F.coalesce("former_names", F.array().cast("array<string>")))).alias("_name"))
    keyed = names.select("cin", legal_name_key(F.col("_name")).alias("_key")).distinct()
    by_name = signals.filter("cin is null").select("signal_id", legal_name_key(F.col("name")).alias("_key")).join(keyed, "_key").select("signal_id", "cin")
    return by_number.unionByName(by_name)


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks; a rule that is null isn't broken."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*keys, F.explode(broken).alias("rule"))


def more_than_one(rows: DataFrame, keys: list[str], active: Column) -> DataFrame:
    """Keys with more than one active row: what a partial unique index forbids."""
    return rows.filter(active).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unknown_members(owners: DataFrame, scope: str, owner: str, members: str, known: DataFrame, member: str) -> DataFrame:
    """(scope, owner, member) for array entries that ``known`` (scope, member) lacks."""
    named = owners.select(scope, owner, F.explode(members).alias(member)).distinct()
    return named.join(known.select(scope, member), [scope, member], "left_anti")


def conflicting_writes(writes: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Keys written more than once, and whether always with one digest."""
    per = writes.groupBy(*keys).agg(F.count("*").alias("writes"), F.min(digest).alias("_a"), F.max(digest).alias("_b"))
    return per.filter("writes > 1").select(*keys, "writes", (F.col("_a") != F.col("_b")).alias("conflict"))


def requirement_status(requirements: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Each requirement's tests and passes, and its status. Results: key, passed."""
    per = results.groupBy(key).agg(F.count("*").alias("tests"), F.count_if("passed").alias("passes"))
    both = requirements.join(per, key, "left").fillna(0, ["tests", "passes"])
    status = F.when(F.col("tests") == 0, "untested").when(F.col("passes") == F.col("tests"), "passing").otherwise("failing")
    return both.withColumn("status", status)


def in_order(rows: DataFrame, key: str, place: str, value: str, most: int) -> DataFrame:
    """The first ``most`` values of each key by place, as an array.

    Ranks cut each key before values are gathered, so an array stays bounded.
    """
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(place))).filter(F.col("_n") <= most)
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda s: s[value].cast("string")), ",").alias("values"))


def positions(rows: DataFrame, key: str, place: str, value: str, blocks: int = 64) -> DataFrame:
    """(key, position, value): all values of each key by a numeric place, from 1 on, one row each.

    Ranks are counted within blocks of places and the sizes of a key's earlier
    blocks added, so a hot key is dealt over many tasks. Null places come first.
    """
    bounds = rows.approxQuantile(place, [k / blocks for k in range(1, blocks)], 0.005) if blocks > 1 else []
    over = [F.when(F.col(place).cast("double") >= b, 1).otherwise(0) for b in sorted(set(bounds))]
    block = F.when(F.col(place).isNull(), -1).otherwise(sum(over, F.lit(0)))
    placed = rows.select(F.col(key).alias("_key"), F.col(place).alias("_place"), F.col(value).alias("_value"), block.alias("_block"))
    ranked = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_block").orderBy("_place")))
    sizes = placed.groupBy("_key", "_block").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    both = ranked.join(starts, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_block") == F.col("_b")))
    return both.select(F.col("_key").alias(key), (F.col("_n") + F.col("_start")).alias("position"), F.col("_value").alias("value"))
