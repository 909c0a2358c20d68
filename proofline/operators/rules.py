"""Rules that rows must meet, by table, as named conditions for ``matching.violations``.

A condition that is null isn't broken, as with a check constraint; where a
missing value is an error, the condition says so. Rules over several rows are
functions of tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofline.functions.web import url_parts
from proofline.operators.candidates import CIN_RULE
from proofline.operators.scoring import WEIGHTS

# Fixed values.
UUID_RULE = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
TASK_KEYS = ["schemaVersion", "taskId", "taskType", "reportRequestId", "userId", "attempt", "traceId"]
TASK_TYPES = ("resolve_entity", "preliminary_research", "render_pdf")
LOCATOR_MARKS = "password=|token=|api_key=|apikey=|secret="
SENSITIVE_TERMS = "password|secret|api key|letterhead|full matter|confidential terms"
MATCH_BASES = ("legal_name", "cin", "address", "director", "official_party_record")
CANDIDATE_STATES = ("awaiting_entity_confirmation", "preliminary_research", "failed_no_charge")

c = F.col


def _unique(values: Column) -> Column:
    """Whether no entry repeats; a null list counts as empty."""
    return F.coalesce(F.size(values) == F.size(F.array_distinct(values)), F.lit(True))


def _between(text: Column, least: int, most: int) -> Column:
    return F.char_length(text).between(least, most)


def exactly_one_input(kind: Column, url: Column, name: Column) -> Column:
    site = F.coalesce(kind == "website", F.lit(False)) & url.isNotNull() & name.isNull()
    return site | (F.coalesce(kind == "legal_name", F.lit(False)) & url.isNull() & name.isNotNull())


def intake_rules() -> dict[str, Column]:
    """Requests and their users: input_kind, input_url, input_legal_name, input_cin, category, idempotency_key; full_name, country, role, phone, phone_verified_at."""
    return {
        "exactly_one_input": exactly_one_input(c("input_kind"), c("input_url"), c("input_legal_name")),
        "input_url_bounded": _between(c("input_url"), 1, 2048),
        "input_legal_name_bounded": _between(c("input_legal_name"), 1, 300),
        "input_cin": c("input_cin").rlike(CIN_RULE),
        "category_bounded": _between(c("category"), 1, 100),
        "idempotency_key": c("idempotency_key").rlike("^[!-~]{1,128}$"),
        "full_name_bounded": _between(c("full_name"), 1, 200),
        "country": c("country").rlike("^[A-Z]{2}$"),
        "role": c("role").isin("partner", "associate", "other"),
        "phone": c("phone").rlike("^\\+[1-9][0-9]{7,14}$"),
        "phone_verified": c("phone_verified_at").isNull() | c("phone").isNotNull(),
    }


def claim_rules() -> dict[str, Column]:
    """Claims: subject, predicate, object, evidence_ids, period, sections, version, is_material."""
    return {
        "subject_bounded": _between(c("subject"), 1, 500),
        "predicate_bounded": _between(c("predicate"), 1, 200),
        "object_bounded": _between(c("object"), 1, 2000),
        "period_bounded": F.char_length(c("period")) <= 200,
        "sections": (F.size(c("sections")) <= 20) & ~F.array_contains(c("sections"), ""),
        "prompt_version": c("version").rlike("^[A-Za-z0-9.-]{1,100}$"),
        "material_evidence": ~c("is_material") | (F.coalesce(F.size(c("evidence_ids")), F.lit(0)) > 0),
        "evidence_ids_unique": _unique(c("evidence_ids")),
    }


def draft_rules() -> dict[str, Column]:
    """Draft claims of a research stage: stage, is_material, rationale, basis, question, proceeding, match_basis, freshness, period, periods (of the plan), since."""
    given = lambda name: F.coalesce(c(name), F.lit("")) != ""
    material = lambda stage: (c("stage") == stage) & c("is_material")
    fresh = c("freshness").isin("current", "recent")
    bases = F.coalesce(c("match_basis"), F.array().cast("array<string>"))
    return {
        "research_competitor_basis_missing": ~material("research_competitors") | (given("rationale") & given("basis")),
        "research_regulatory_confirmation_missing": ~material("research_regulatory") | given("question"),
        "research_public_risk_match_basis_missing": ~material("research_public_risk") | (given("proceeding") & (F.size(bases) > 0)),
        "research_public_risk_identifier_match_weak": ~(material("research_public_risk") & given("proceeding") & (F.size(bases) > 0)) | F.arrays_overlap(bases, F.array(*map(F.lit, MATCH_BASES))),
        "research_current_claim_period_missing": c("period").isNotNull() | ~(c("is_material") & fresh),
        "research_dynamic_period_outside_window": c("period").isNull() | ~fresh | F.array_contains("periods", c("period")),
        "research_historical_period_before_incorporation": c("period").isNull() | c("since").isNull() | (c("period") >= c("since")),
    }


def scope_rules() -> dict[str, Column]:
    """Confirmed requests: entity_id, related_ids, signals, result_ids, evidence_ids."""
    return {
        "related_at_most_two": F.size("related_ids") <= 2,
        "related_unique": _unique(c("related_ids")),
        "related_excludes_primary": ~F.array_contains("related_ids", c("entity_id")),
        "signals_unique": _unique(c("signals")),
        "result_within_evidence": F.size(F.array_except("result_ids", "evidence_ids")) == 0,
    }


def candidate_rules() -> dict[str, Column]:
    """Stored candidates: id, entity_id, score, label, conflicts, rank and their JSON payload and audit."""
    of = lambda name, path: F.get_json_object(name, f"$.{path}")
    number = lambda v: F.when(v.rlike("^-?[0-9]{1,4}$"), v.cast("int"))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    return {
        "payload_identity": same(of("payload", "schemaVersion"), F.lit("1")) & same(of("payload", "candidateId"), c("id")) & same(of("payload", "entityId"), c("entity_id")),
        "payload_score": same(number(of("payload", "confidenceScore")), c("score")) & same(of("payload", "confidenceLabel"), c("label")) & same(of("payload", "conflicts"), c("conflicts")),
        "audit_alignment": same(of("audit", "candidateId"), c("id")) & same(of("audit", "scoringVersion"), F.lit("entity-confidence-v1")) & same(number(of("audit", "finalScore")), c("score")) & F.coalesce(of("audit", "decisions").startswith("["), F.lit(False)),
        "rank_bounded": c("rank").between(1, 20),
    }


def signal_rules() -> dict[str, Column]:
    """Signals: kind, tier, cin, name; relationship hints: brands, reason as well."""
    return {
        "signal_identifies_candidate": c("cin").isNotNull() | c("name").isNotNull(),
        "official_signal_tier": (c("kind") != "official_domain_link") | (c("tier") == 1),
        "corroboration_tier": (c("kind") != "credible_corroboration") | (c("tier") <= 3),
        "tier_bounded": c("tier").between(1, 5),
        "hint_adds_something": (F.coalesce(F.size("brands"), F.lit(0)) > 0) | c("reason").isNotNull(),
    }


def adjustment_errors(adjustments: DataFrame) -> DataFrame:
    """Rows (candidate_id, factor, applied, adjustment) whose adjustment isn't the factor's weight if applied, else 0."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[c("factor")]
    return adjustments.filter(weight.isNull() | (c("adjustment") != F.when(c("applied"), weight).otherwise(0)))


def misaligned(candidates: DataFrame, audits: DataFrame) -> DataFrame:
    """(request_id, rank) at which candidates and audits (request_id, rank, candidate_id, score) aren't the same one with one score."""
    b = audits.select("request_id", "rank", c("candidate_id").alias("_id"), c("score").alias("_score"))
    both = candidates.select("request_id", "rank", "candidate_id", "score").join(b, ["request_id", "rank"], "full_outer")
    return both.filter(~(c("candidate_id").eqNullSafe(c("_id")) & c("score").eqNullSafe(c("_score")))).select("request_id", "rank")


def repeated(rows: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys that more rows than one have, of those that meet a condition: what a partial unique index forbids."""
    rows = rows if where is None else rows.filter(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def decision_code(action: Column, candidate: Column, related: Column, name: Column, cin: Column, state: Column) -> Column:
    """Error of a confirmation command's payload, by action; null if it is in order."""
    none = name.isNull() & cin.isNull() & state.isNull()
    alone = candidate.isNull() & (F.coalesce(F.size(related), F.lit(0)) == 0)
    good = (
        F.when(action == "confirm", candidate.isNotNull() & none)
        .when(action == "none_of_these", alone & none)
        .when(action == "refine", alone & (name.isNotNull() | cin.isNotNull()))
        .otherwise(F.lit(False))
    )
    code = F.when(~action.isin("confirm", "none_of_these", "refine") | action.isNull(), "INVALID_CONFIRMATION_ACTION")
    code = code.when(cin.isNotNull() & ~F.upper(F.trim(cin)).rlike(CIN_RULE), "INVALID_CIN_HINT").when(name.isNotNull() & ~_between(F.trim(name), 1, 300), "INVALID_LEGAL_NAME_HINT")
    return code.when(state.isNotNull() & ~_between(F.trim(state), 1, 100), "INVALID_STATE_HINT").when(~good, "INVALID_CONFIRMATION_PAYLOAD")


def completion_rules() -> dict[str, Column]:
    """Completions: candidates, audits, clarifications, preliminary (JSON texts), request_id, entity_id."""
    length = lambda name: F.json_array_length(name)
    asked = F.get_json_object("clarifications", "$.questions")
    same = lambda path, other: F.coalesce(F.get_json_object("clarifications", path) == c(other).cast("string"), F.lit(False))
    return {
        "candidates_and_audits": F.coalesce((length("candidates") == length("audits")) & (length("candidates") <= 20), F.lit(False)),
        "clarification_set": F.coalesce(F.json_array_length(asked).between(1, 8), F.lit(False)) & same("$.reportRequestId", "request_id") & same("$.entityId", "entity_id"),
        "preliminary_evidence": F.coalesce(length("preliminary") <= 20, F.lit(False)),
    }


def filing_rules() -> dict[str, Column]:
    """Filings and their requests: document_id, provider, locator, year, media_type, sha256, size, status, documents (count), action, years, types, foreign (count of another company's)."""
    ready = c("status") == "ready"
    return {
        "document_id": c("document_id").rlike("^[A-Za-z0-9._:-]{1,128}$"),
        "source_provider": c("provider").rlike("^[a-z][a-z0-9_-]{0,63}$"),
        "locator_credentials": ~F.lower("locator").rlike(LOCATOR_MARKS),
        "financial_year": c("year").rlike("^[0-9]{4}-[0-9]{2}$"),
        "media_type": c("media_type").isin("application/pdf", "application/zip", "application/octet-stream"),
        "sha256": c("sha256").rlike("^[0-9a-f]{64}$"),
        "size_bounded": c("size").between(1, 25 << 20),
        "ready_shape": ~ready | ((c("documents") > 0) & c("action").isNull()),
        "other_shape": ready | ((c("documents") == 0) & c("action").isNotNull()),
        "same_company": c("foreign") == 0,
        "years_valid": F.forall(c("years"), lambda y: F.trim(y).rlike("^[0-9]{4}-[0-9]{2}$")),
        "years_unique": _unique(F.transform(c("years"), lambda y: F.trim(y))),
        "types_unique": _unique(c("types")),
    }


def safety_rules() -> dict[str, Column]:
    """Recorded scans, fetches and evidence: verdict, threat, final_url, chain, url, canonical, admitted, clean and infected digests."""
    return {
        "verdict_shape": F.coalesce((c("verdict") == "infected") == c("threat").isNotNull(), F.lit(False)),
        "redirect_tail": (F.size("chain") == 0) | (F.try_element_at("chain", F.lit(-1)) == c("final_url")),
        "scheme_preserved": url_parts(c("canonical"))["scheme"] == url_parts(c("url"))["scheme"],
        "not_admitted": ~c("admitted"),
        "digests": F.forall(F.concat("clean", "infected"), lambda v: v.rlike("^[0-9a-f]{64}$")),
        "digests_disjoint": ~F.coalesce(F.arrays_overlap("clean", "infected"), F.lit(False)),
    }


def task_payload_valid(payload: Column) -> Column:
    """Whether a JSON text is a light task's message: exactly its keys, and each value of its kind."""
    of = lambda key: F.get_json_object(payload, f"$.{key}")
    keys, want = F.json_object_keys(payload), F.array(*map(F.lit, TASK_KEYS))
    attempt = F.when(of("attempt").rlike("^[0-9]{1,9}$"), of("attempt").cast("int"))
    rules = [
        F.size(F.array_except(keys, want)) == 0, F.size(F.array_except(want, keys)) == 0, of("schemaVersion") == "1", of("taskType").isin(*TASK_TYPES),
        *[of(k).rlike(UUID_RULE) for k in ("taskId", "reportRequestId", "userId")], attempt.between(1, 100), of("traceId").rlike("^[A-Za-z0-9._:-]{8,128}$"),
    ]
    out = F.lit(True)
    for rule in rules:
        out = out & F.coalesce(rule, F.lit(False))
    return out


def identifiers_valid(payload: Column) -> Column:
    """Whether a JSON text has legalNames, cins and addresses, nothing else, each a short list of fitting texts."""
    out = F.coalesce(F.array_sort(F.json_object_keys(payload)) == F.array(F.lit("addresses"), F.lit("cins"), F.lit("legalNames")), F.lit(False))
    rules = {"legalNames": (50, lambda v: _between(v, 1, 300)), "cins": (20, lambda v: v.rlike(CIN_RULE)), "addresses": (20, lambda v: _between(v, 1, 500))}
    for key, (most, fits) in rules.items():
        raw = F.get_json_object(payload, f"$.{key}")
        values = F.from_json(F.when(raw.startswith("["), raw), "array<string>")
        out = out & F.coalesce((F.size(values) <= most) & F.forall(values, fits), F.lit(False))
    return out


def golden_inputs_code(inputs: Column) -> Column:
    """Error of a golden case's inputs (JSON text); null if they have the required shape."""
    keys = F.json_object_keys(inputs)
    of = lambda key: F.get_json_object(inputs, f"$.{key}")
    required = F.array(*map(F.lit, ("submittedUrl", "asOf", "entityHint", "focusTopics")))
    day = F.when(of("asOf").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(of("asOf"), "yyyy-MM-dd"))
    broken = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(broken(F.size(F.array_except(required, keys)) == 0), "missing_keys")
        .when(broken(day.isNotNull()), "as_of_not_a_date")
        .when(broken(of("entityHint").startswith("{")), "entity_hint_not_an_object")
        .when(broken(F.json_array_length(of("focusTopics")) > 0), "focus_topics_empty")
    )


def unsafe_questions(questions: DataFrame) -> DataFrame:
    """(set_id, rule) for clarification sets whose questions (code, mandatory, safe, prompt, reason) aren't in order."""
    sensitive = F.lower(F.concat_ws(" ", "prompt", "reason")).rlike(SENSITIVE_TERMS)
    per = questions.groupBy("set_id").agg(F.bool_or(c("mandatory") & (c("code") == "client_role")).alias("_role"), F.bool_and("safe").alias("_safe"), F.bool_or(sensitive).alias("_sensitive"))
    rule = F.array_compact(F.array(
        F.when(~c("_role"), F.lit("mandatory_client_role_question_missing")), F.when(~c("_safe"), F.lit("clarification_question_not_confidentiality_safe")),
        F.when(c("_sensitive"), F.lit("clarification_question_contains_sensitive_request")),
    ))
    return per.select("set_id", F.explode(rule).alias("rule"))


def finding_errors(findings: DataFrame, claims: DataFrame, notes: DataFrame, coverage: DataFrame) -> DataFrame:
    """(finding_id, rule): scope and uniqueness of a finding's claims, notes on them, evidence of covered topics.

    Findings: finding_id, job_id, entity_id. Claims: finding_id, claim_id,
    job_id, entity_id, evidence_ids. Notes: finding_id, claim_id. Coverage:
    finding_id, topic, evidence_id.
    """
    used = claims.select("finding_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    known = claims.select("finding_id", "claim_id").distinct()
    whose = claims.join(findings.select("finding_id", c("job_id").alias("_job"), c("entity_id").alias("_entity")), "finding_id")
    parts = {
        "coverage_evidence_unknown": coverage.filter("topic = ''").select("finding_id").unionByName(coverage.join(used, ["finding_id", "evidence_id"], "left_anti").select("finding_id")),
        "claim_scope": whose.filter("not (job_id <=> _job) or not (entity_id <=> _entity)"),
        "claim_ids_not_unique": repeated(claims, ["finding_id", "claim_id"]),
        "note_claim_unknown": notes.join(known, ["finding_id", "claim_id"], "left_anti"),
        "note_ids_not_unique": repeated(notes, ["finding_id", "claim_id"]),
    }
    out = None
    for rule, rows in parts.items():
        named = rows.select("finding_id", F.lit(rule).alias("rule"))
        out = named if out is None else out.unionByName(named)
    return out.distinct()


def own_rows(rows: DataFrame, user: Column, parents: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows that a user may see: their own, or those whose parent is."""
    if parents is None:
        return rows.filter(c("user_id") == user)
    return rows.join(parents.filter(c("user_id") == user).select(key).distinct(), key, "left_semi")


def with_admins(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """``rows`` with is_admin of their user; false for unknown and deleted ones."""
    admins = profiles.filter("deleted_at is null").groupBy("user_id").agg(F.bool_or("is_admin").alias("is_admin"))
    return rows.join(admins, "user_id", "left").withColumn("is_admin", F.coalesce("is_admin", F.lit(False)))


def stage_order_errors(plans: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """(plan_id, ord, stage, rule): stages that aren't known, or don't come after the one before."""
    place = F.array_position(F.array(*map(F.lit, stages)), c("stage"))
    rows = plans.withColumn("_p", place).withColumn("_before", F.lag("_p").over(Window.partitionBy("plan_id").orderBy("ord")))
    rule = F.when(c("_p") == 0, "stage_unknown").when(c("_before") >= c("_p"), "stage_out_of_order")
    return rows.select("plan_id", "ord", "stage", rule.alias("rule")).filter("rule is not null")
