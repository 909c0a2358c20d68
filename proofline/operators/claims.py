"""Verification of claims against evidence.

A fixed chain, as later steps build on earlier ones: rules, duplicates,
contradictions and their resolution. Claims: job_id, claim_id, ord, subject,
predicate, period, object, evidence_ids, is_material, freshness. Evidence:
job_id, evidence_id, source_tier, published, suspected. All joins are within a
job, so rows are partitioned by it. Where both have an entity_id, evidence on
another entity than the claim's is a reason too; a null one fits any. A null list of evidence is an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.text import assertion_key, folded, period_key, tuple_text, uuid5


def claim_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """What each claim's evidence amounts to; one row a claim."""
    whose = "entity_id" in claims.columns and "entity_id" in evidence.columns
    entity = F.col("entity_id") if whose else F.lit(None).cast("string")
    named = claims.select("job_id", "claim_id", entity.alias("_entity"), F.explode_outer("evidence_ids").alias("evidence_id"))
    joined = named.join(evidence.withColumn("_known", F.lit(True)), ["job_id", "evidence_id"], "left")
    known = F.col("_known").isNotNull()
    other = known & F.col("entity_id").isNotNull() & ~F.col("entity_id").eqNullSafe(F.col("_entity")) if whose else F.lit(False)
    return joined.groupBy("job_id", "claim_id").agg(
        F.count_if(F.col("evidence_id").isNotNull() & ~known).alias("n_unknown"),
        F.count_if(known).alias("n_known"),
        F.count_if(other).alias("n_other"),
        F.count_if(known & F.col("suspected")).alias("n_suspected"),
        F.count_if(known & (F.col("source_tier") >= 4)).alias("n_weak"),
        F.coalesce(F.min("source_tier"), F.lit(5)).alias("strongest"),
        F.max("published").alias("latest"),
    )


# Fixed value.
NAMESPACE = "2d76f1d1-4e28-4c1e-9a93-1c7ef6f53e17"


def verify(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """job_id, claim_id, status, reasons, resolution of every claim."""
    return verified(claims, evidence).select("job_id", "claim_id", "status", F.array_join("reasons", ",").alias("reasons"), "resolution")


def verified(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claims`` with status, reasons (an array), resolution, and the keys of the fact that each states.

    Subjects, predicates and periods count as equal without case, width and
    spacing, objects by what they assert.
    """
    df = claims.join(claim_evidence(claims, evidence), ["job_id", "claim_id"])
    material, some = F.col("is_material"), F.col("n_known") > 0
    rules = {
        "evidence_reference_unknown": F.col("n_unknown") > 0,
        "evidence_entity_mismatch": F.col("n_other") > 0,
        "material_claim_without_evidence": material & (F.coalesce(F.size("evidence_ids"), F.lit(0)) == 0),
        "claim_stale": F.col("freshness") == "stale",
        "all_supporting_evidence_prompt_suspected": some & (F.col("n_suspected") == F.col("n_known")),
        "material_claim_source_too_weak": material & some & (F.col("n_weak") == F.col("n_known")),
    }
    df = df.withColumn("reasons", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))
    weak_only = (F.size("reasons") == 1) & (F.col("reasons")[0] == "material_claim_source_too_weak")
    df = df.withColumn("status", F.when(F.size("reasons") == 0, "approved").when(weak_only, "pending").otherwise("rejected"))
    df = df.withColumns({"_s": folded(F.col("subject")), "_p": folded(F.col("predicate")), "_t": period_key(F.col("period")), "_o": assertion_key(F.col("object"))})

    same = Window.partitionBy("job_id", "_s", "_p", "_t", "_o").orderBy("ord")
    again = F.row_number().over(same) > 1
    df = df.withColumn("_again", again)
    df = df.withColumn("reasons", F.when(F.col("_again"), F.concat("reasons", F.array(F.lit("duplicate_claim")))).otherwise(F.col("reasons")))
    df = df.withColumn("status", F.when(F.col("_again"), "rejected").otherwise(F.col("status")))
    df = df.withColumn("_invalid", F.size("reasons") > 0)

    fact = Window.partitionBy("job_id", "_s", "_p", "_t", "_live")
    df = df.withColumn("_live", F.col("status") != "rejected")
    df = df.withColumn("_disputed", F.col("_live") & (F.min("_o").over(fact) != F.max("_o").over(fact)))
    place = F.rank().over(fact.orderBy("strongest", F.desc_nulls_last("latest")))
    df = df.withColumn("_place", place)
    ties = F.sum(F.when(F.col("_place") == 1, 1)).over(fact)
    best = F.min("strongest").over(fact)
    resolution = (
        F.when(~F.col("_disputed"), F.lit(None))
        .when(ties > 1, "disclose_as_conflict")
        .when(best >= 5, "convert_to_question")
        .when(F.max("strongest").over(fact) != best, "prefer_stronger_source")
        .otherwise("prefer_later")
    )
    df = df.withColumn("resolution", resolution)
    settled = F.col("resolution").isin("prefer_stronger_source", "prefer_later")
    lost = F.coalesce(settled & (F.col("_place") > 1), F.lit(False))
    more = F.array_compact(F.array(
        F.when(lost, F.lit("contradicted_by_preferred_claim")),
        F.when(F.col("resolution").isNotNull() & ~settled, F.lit("unresolved_contradiction")),
        F.when(settled & ~F.col("_invalid"), F.lit("resolved_contradiction")),
    ))
    status = F.when(lost, "rejected").when(F.col("resolution").isNotNull() & ~settled, "conflicted").otherwise(F.col("status"))
    return df.select(*claims.columns, status.alias("status"), F.concat("reasons", more).alias("reasons"), "resolution", "_s", "_p", "_t", "_disputed", "_invalid")


def contradictions(rows: DataFrame) -> DataFrame:
    """A row for each fact that live claims state differently, from ``verified`` rows.

    job_id, contradiction_id, claim_ids, evidence_ids (both sorted as texts),
    severity, resolution, unresolved.
    """
    entity = F.col("entity_id") if "entity_id" in rows.columns else F.lit("")
    text = lambda c: c.cast("string")
    per = rows.filter("_disputed").groupBy("job_id", entity.alias("_entity"), "_s", "_p", "_t").agg(
        F.array_sort(F.collect_list(text(F.col("claim_id")))).alias("claim_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col("evidence_ids").cast("array<string>"))))).alias("evidence_ids"),
        F.when(F.bool_or("is_material"), "high").otherwise("medium").alias("severity"),
        F.first("resolution").alias("resolution"),
    )
    name = F.concat_ws(":", text(F.col("job_id")), text(F.col("_entity")), tuple_text(F.col("_s"), F.col("_p"), F.col("_t")), F.array_join("claim_ids", ","))
    unresolved = F.col("resolution").isin("disclose_as_conflict", "convert_to_question")
    return per.select("job_id", uuid5(NAMESPACE, name).alias("contradiction_id"), "claim_ids", "evidence_ids", "severity", "resolution", unresolved.alias("unresolved"))


def report(topics: DataFrame, rows: DataFrame, evidence: DataFrame, most_gaps: int = 20) -> DataFrame:
    """A row for each job of ``topics`` (job_id, ord, topic, evidence_ids), from ``verified`` rows.

    covered and missing topics in order, claims without support, stale claims
    and suspected evidence sorted as texts, coverage_percent (halves to even),
    gaps (missing topics, then unresolved contradictions) and whether more
    research is advised.
    """
    approved = rows.filter("status = 'approved'").select("job_id", F.explode("evidence_ids").alias("evidence_id")).distinct().withColumn("_hit", F.lit(1))
    named = topics.select("job_id", "ord", "topic", F.explode_outer("evidence_ids").alias("evidence_id")).join(approved, ["job_id", "evidence_id"], "left")
    per = named.groupBy("job_id", "ord", "topic").agg(F.coalesce(F.max("_hit"), F.lit(0)).alias("_hit"))
    pick = lambda hit: F.transform(F.array_sort(F.collect_list(F.when(F.col("_hit") == hit, F.struct("ord", "topic")))), lambda s: s["topic"])
    out = per.groupBy("job_id").agg(pick(1).alias("covered"), pick(0).alias("missing"), F.bround(F.sum("_hit") * 100 / F.count("*")).cast("long").alias("coverage_percent"))
    ids = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("claim_id").cast("string"))))
    of_claims = rows.groupBy("job_id").agg(ids(F.col("_invalid")).alias("unsupported"), ids(F.array_contains("reasons", "claim_stale")).alias("stale"))
    suspected = evidence.filter("suspected").groupBy("job_id").agg(F.array_sort(F.collect_set(F.col("evidence_id").cast("string"))).alias("suspicious"))
    open_ = contradictions(rows).filter("unresolved").groupBy("job_id").agg(F.array_sort(F.collect_list(F.concat(F.lit("contradiction:"), "contradiction_id"))).alias("_open"))
    empty = F.array().cast("array<string>")
    out = out.join(of_claims, "job_id", "left").join(suspected, "job_id", "left").join(open_, "job_id", "left")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("unsupported", "stale", "suspicious", "_open")})
    gaps = F.array_distinct(F.concat("missing", "_open"))
    more = (F.size(gaps) > 0) | (F.size("unsupported") > 0)
    return out.withColumn("gaps", F.slice(gaps, 1, most_gaps)).withColumn("more_research", more).drop("_open")


def scope_errors(requests: DataFrame, claims: DataFrame, evidence: DataFrame, topics: DataFrame) -> DataFrame:
    """(job_id, rule) for requests (job_id, entity_id) whose parts don't belong together.

    Claims and evidence name the request they were sent with (request_id).
    """
    claimed = claims.join(requests.select(F.col("job_id").alias("request_id"), F.col("entity_id").alias("_e")), "request_id")
    rules = [
        claimed.filter("job_id <> request_id or not (entity_id <=> _e)").select("request_id", F.lit("claim_scope").alias("rule")),
        evidence.filter("job_id <> request_id").select("request_id", F.lit("evidence_scope").alias("rule")),
        evidence.groupBy("request_id", "evidence_id").agg(F.count("*").alias("n")).filter("n > 1").select("request_id", F.lit("evidence_ids_not_unique").alias("rule")),
        topics.groupBy("job_id", "topic").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("job_id").alias("request_id"), F.lit("topics_not_unique").alias("rule")),
    ]
    out = rules[0]
    for more in rules[1:]:
        out = out.unionByName(more)
    return out.distinct().withColumnRenamed("request_id", "job_id")


def coverage(topics: DataFrame, claims: DataFrame, verified: DataFrame) -> DataFrame:
    """Per job: covered and missing topics, and the share covered, halves to even.

    Topics: job_id, topic, evidence_id, one row for each evidence of a topic
    (null for none). A topic is covered by an approved claim on its evidence.
    """
    approved = verified.filter("status = 'approved'").select("job_id", "claim_id")
    used = claims.join(approved, ["job_id", "claim_id"]).select("job_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    hit = topics.join(used.withColumn("_hit", F.lit(1)), ["job_id", "evidence_id"], "left")
    per = hit.groupBy("job_id", "topic").agg(F.coalesce(F.max("_hit"), F.lit(0)).alias("_hit"))
    share = F.bround(F.sum("_hit") * 100 / F.count("*")).cast("long")
    return per.groupBy("job_id").agg(F.sum("_hit").alias("covered"), (F.count("*") - F.sum("_hit")).alias("missing"), share.alias("coverage_percent"))


def unsupported(verified: DataFrame) -> DataFrame:
    """(job_id, claim_id) of claims that a rule or an earlier claim invalidates.

    Contradictions don't count. Claims of a topic with unknown evidence are
    among them, as that is a rule.
    """
    settled = ("contradicted_by_preferred_claim", "unresolved_contradiction", "resolved_contradiction", "")
    own = F.array_except(F.split("reasons", ","), F.array(*map(F.lit, settled)))
    return verified.filter(F.size(own) > 0).select("job_id", "claim_id")
