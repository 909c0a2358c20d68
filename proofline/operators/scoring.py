"""Scores of candidate entities, their labels and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What each fact adds.
WEIGHTS = {
    "exact_legal_name_and_cin_on_domain": 35,
    "address_contact_matches_master_data": 20,
    "company_controlled_legal_page": 15,
    "official_regulator_exchange_links_domain": 15,
    "directors_promoters_business_match": 10,
    "credible_corroboration": 5,
    "inactive_status": -15,
    "conflicting_registered_office": -10,
    "incompatible_business_description": -15,
    "name_only_match": -20,
    "common_name_adverse_ambiguity": -10,
}
LABELS = ((75, "strong_match"), (50, "probable_match"), (25, "ambiguous"), (0, "insufficient_evidence"))


def confidence_label(score: Column) -> Column:
    out = F.when(score >= LABELS[0][0], LABELS[0][1])
    for least, name in LABELS[1:]:
        out = out.when(score >= least, name)
    return out


def score(facts: DataFrame) -> DataFrame:
    """``facts`` (one boolean column for each weight) with positive_total, negative_total, score, label."""
    parts = {k: F.when(F.col(k), F.lit(w)).otherwise(0) for k, w in WEIGHTS.items()}
    total = lambda sign: sum((parts[k] for k, w in WEIGHTS.items() if w * sign > 0), F.lit(0))
    out = facts.withColumns({"positive_total": total(1), "negative_total": total(-1)})
    out = out.withColumn("score", F.least(F.lit(100), F.greatest(F.lit(0), F.col("positive_total") + F.col("negative_total"))))
    return out.withColumn("label", confidence_label(F.col("score")))


def ranked(candidates: DataFrame, by: str, limit: int = 20) -> DataFrame:
    """Ranks within ``by``: score falling, then name without case, then id; the first ``limit``."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.lower("name"), "id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
