"""Evidence on another entity, and keys of entities without a number."""

from pyspark.sql import functions as F

from proofline.functions.identifiers import identity_key
from proofline.operators import claims as C
from proofline.operators import records as R


def test_evidence_on_another_entity(spark):
    claim = lambda k, ids: (1, k, k, f"s{k}", "p", None, "o", ids, True, "current", "A")
    claims = spark.createDataFrame([claim(1, [1]), claim(2, [2]), claim(3, [3, 1]), claim(4, [2, 9])], "job_id long, claim_id long, ord long, subject string, predicate string, period string, object string, evidence_ids array<long>, is_material boolean, freshness string, entity_id string")
    evidence = spark.createDataFrame([(1, 1, 1, 5, False, "A"), (1, 2, 1, 5, False, "B"), (1, 3, 1, 5, False, None)], "job_id long, evidence_id long, source_tier int, published long, suspected boolean, entity_id string")
    found = {r["claim_id"]: (r["status"], r["reasons"]) for r in C.verify(claims, evidence).collect()}
    assert found == {1: ("approved", ""), 2: ("rejected", "evidence_entity_mismatch"), 3: ("approved", ""), 4: ("rejected", "evidence_reference_unknown,evidence_entity_mismatch")}


def test_identity_key(spark):
    rows = spark.createDataFrame([("u1a", "N", "S"), ("", "Acme Ltd", "GOA"), (None, "Acme", None)], "c string, n string, s string")
    assert [r[0] for r in rows.select(identity_key(F.col("c"), F.col("n"), F.col("s"))).collect()] == ["cin:U1A", "name:acme ltd|state:goa", "name:acme|state:"]


def test_unsupported_claims(spark):
    reasons = ["", "claim_stale", "resolved_contradiction", "contradicted_by_preferred_claim", "duplicate_claim", "material_claim_source_too_weak,unresolved_contradiction"]
    verified = spark.createDataFrame([(1, k, r) for k, r in enumerate(reasons)], "job_id long, claim_id long, reasons string")
    assert sorted(r["claim_id"] for r in C.unsupported(verified).collect()) == [1, 4, 5]


def test_merged_companies(spark):
    rows = [("c", 2, "Two", "r2", "x", ["b", "a", "d"]), ("c", 1, None, "r1", None, ["c", "b"]), ("c", 3, "Three", None, "y", None), ("e", 1, "E", None, None, None)]
    found = R.merged_companies(spark.createDataFrame(rows, "cin string, n long, legal_name string, source_record_id string, status string, former_names array<string>"), "cin", "n", ["status"], ["legal_name", "source_record_id"], "former_names")
    assert sorted(map(tuple, found.collect())) == [("c", "x", None, "r1", ["c", "b", "a", "d"]), ("e", None, "E", None, [])]
