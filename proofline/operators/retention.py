"""What is to be purged when: ages by kind, expiries, deletions, holds that suspend them, and what falls with its parent.

``assets`` (asset_id, kind, owner_id, created_at, expires_at, deleted), times in whole days or any number;
``holds`` (owner_id, since, until): while now lies in [since, until) nothing of the owner goes, an open end being
null; ``links`` (parent_id, child_id): a child goes with its parent, to any depth. Nothing is deleted here: the result
is a plan, a row for each asset that goes or would go.

The cascade runs in rounds over the links of what was added last, and ends when nothing is added; cycles end too, as an asset is added once.
A round reads the links whose child isn't in the plan yet and has links itself; children without follow once, when the rounds are over. A parent with a third of all links is joined like any other.

Defined results: a null creation has no age; a kind without a rule ages never; links to unknown assets and
repeated links change nothing; assets that repeat an id are one, held if one of them is, with the least kind and reason; an empty table gives an empty plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.operators.entitlements import endings
from proofline.operators.steps import Steps

# Days that each kind is kept; reports leave a record behind.
KEPT_DAYS = {"raw_page": 30, "provider_log": 90, "audit_log": 180, "failed_diagnostics": 30, "letterhead": 1}
TOMBSTONES = ("report", "account")
SWEPT_HOURS = 24


def purge_plan(assets: DataFrame, links: DataFrame, holds: DataFrame, now: float, kept: dict[str, int] | None = None) -> DataFrame:
    """asset_id, kind, action (purge, tombstone or held), reason (deleted, expired, aged or cascade) and depth of the cascade."""
    steps = Steps(assets.sparkSession, "retention")
    kept = KEPT_DAYS if kept is None else kept
    days = F.create_map(*[F.lit(x) for pair in kept.items() for x in pair]) if kept else F.create_map().cast("map<string,int>")
    aged = F.col("created_at") + F.try_element_at(days, F.col("kind")) <= now
    reason = F.when(F.coalesce("deleted", F.lit(False)), "deleted").when(F.col("expires_at") <= now, "expired").when(aged, "aged")
    holding = holds.filter(F.coalesce(F.col("since") <= now, F.lit(True)) & F.coalesce(F.col("until") > now, F.lit(True))).select("owner_id").distinct().withColumn("_held", F.lit(True))
    own = assets.filter("asset_id is not null").join(holding, "owner_id", "left").withColumn("reason", reason)
    own = own.groupBy("asset_id").agg(F.min("kind").alias("kind"), F.coalesce(F.bool_or("_held"), F.lit(False)).alias("held"), F.min("reason").alias("reason"))
    own = steps.write(own, "assets")
    plan = [own.filter("reason is not null").withColumn("depth", F.lit(0))]
    spared = own.filter("reason is null").select(F.col("asset_id").alias("child_id"), "kind", "held")
    known = own.filter("not held").select(F.col("asset_id").alias("parent_id"), F.col("reason").isNotNull().alias("_first"))
    edges = steps.write(links.select("parent_id", "child_id").filter("parent_id <> child_id").join(known, "parent_id").join(spared, "child_id").distinct(), "links")
    # only links between what has links of its own are walked in rounds; what ends there follows once
    inner = edges.select(F.col("parent_id").alias("child_id")).distinct()
    open_ = steps.write(edges.join(inner, "child_id", "left_semi"), "open-0")
    number, reached = 0, []
    last = edges.filter("_first").select("parent_id").distinct()
    while True:
        number += 1
        below = open_.join(last, "parent_id", "left_semi").groupBy("child_id").agg(F.first("kind").alias("kind"), F.first("held").alias("held"))
        fresh = steps.write(below.select(F.col("child_id").alias("asset_id"), "kind", "held", F.lit("cascade").alias("reason"), F.lit(number).alias("depth")), f"plan-{number}")
        if fresh.isEmpty():
            break
        reached.append(fresh)
        last = fresh.filter("not held").select(F.col("asset_id").alias("parent_id"))
        open_ = steps.write(open_.join(fresh.select(F.col("asset_id").alias("child_id")), "child_id", "left_anti"), f"open-{number}")
        steps.drop(f"open-{number - 1}")
    plan += reached
    above = edges.filter("_first").select("parent_id", F.lit(0).alias("_depth")).distinct()
    for part in reached:
        above = above.unionByName(part.filter("not held").select(F.col("asset_id").alias("parent_id"), F.col("depth").alias("_depth")))
    ends = edges.join(inner, "child_id", "left_anti").join(above, "parent_id").groupBy("child_id").agg(F.first("kind").alias("kind"), F.first("held").alias("held"), (F.min("_depth") + 1).alias("depth"))
    plan.append(ends.select(F.col("child_id").alias("asset_id"), "kind", "held", F.lit("cascade").alias("reason"), "depth"))
    plan = reduce(DataFrame.unionByName, plan)
    action = F.when(F.col("held"), "held").when(F.col("kind").isin(*TOMBSTONES), "tombstone").otherwise("purge")
    return plan.select("asset_id", "kind", action.alias("action"), "reason", "depth")


def reservation_sweep(entries: DataFrame, jobs: DataFrame, now: float, hours: float = SWEPT_HOURS) -> DataFrame:
    """entry_id, user_id, request_id, action of reserves of ``hours`` or more (at: in hours) that nothing has ended.

    ``release``: no job of the request works any more (jobs: request_id, active); ``flag``: one does.
    """
    open_ = entries.filter((F.col("kind") == "reserve") & (F.col("at") <= now - hours)).join(endings(entries).select(F.col("reserve_id").alias("entry_id")), "entry_id", "left_anti")
    working = jobs.filter("active").select("request_id").distinct().withColumn("_works", F.lit(True))
    return open_.join(working, "request_id", "left").select("entry_id", "user_id", "request_id", F.when(F.col("_works"), "flag").otherwise("release").alias("action"))
