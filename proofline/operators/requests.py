"""Requests and their commands: loading, confirmation, clarification, failure, dispatch; JSON lists as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators.rules import CANDIDATE_STATES, decision_code

# Fixed values.
ERROR_CODE = "^[a-z0-9_:-]{1,100}$"
QUESTIONS = {
    "client_role": (True, "single_select", "company_promoter,investor_acquirer,seller_transferor,other"),
    "transaction_category": (False, "optional_select", "investment,acquisition,sale_or_transfer,other"),
    "cross_border": (False, "optional_select", "yes,no,unknown"),
    "known_public_issue": (False, "short_text", ""),
}
SIGNALS = {"transaction_overlay": "transaction_category", "cross_border": "cross_border", "known_public_issue": "known_public_issue"}
OUTCOMES = {
    "RESOLUTION_RATE_LIMITED": 429, "INTAKE_RATE_LIMITED": 429, "IDEMPOTENCY_CONFLICT": 409, "CONFIRMATION_STATE_CONFLICT": 409, "RESOLUTION_STATE_CONFLICT": 409, "REPORT_REQUEST_NOT_FOUND": 404,
    "ENTITY_CANDIDATE_NOT_FOUND": 404, "RESOLUTION_TASK_NOT_FOUND": 404,
}

c = F.col


def resolution_requests(requests: DataFrame) -> DataFrame:
    """Requests in resolution with what to look for: a hint, where there is one, in place of the input."""
    text = lambda hint, given: F.coalesce(hint, given)
    rows = requests.filter("state = 'resolving_entity'")
    return rows.select("request_id", "user_id", "input_url", text("legal_name_hint", "input_legal_name").alias("legal_name"), text("cin_hint", "input_cin").alias("cin"), "state_hint")


def research_requests(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """Requests in preliminary research with their confirmed entity; without one there is no row."""
    return requests.filter("state = 'preliminary_research'").join(entities, c("confirmed_entity_id") == c("entity_id"))


def candidate_lists(candidates: DataFrame, requests: DataFrame, most: int = 20) -> DataFrame:
    """Candidates of requests whose state shows them, by rank, the first ``most``."""
    shown = requests.filter(c("state").isin(*CANDIDATE_STATES)).select("request_id")
    return candidates.filter(c("rank") <= most).join(shown, "request_id", "left_semi")


def related_suggestions(candidates: DataFrame) -> DataFrame:
    """Candidates that aren't selected and carry a reason to be looked at too."""
    return candidates.filter((F.trim(F.coalesce("related_reason", F.lit(""))) != "") & ~c("is_selected"))


def outside_scope(commands: DataFrame, candidates: DataFrame) -> DataFrame:
    """(command_id, related) for related entities (array) that aren't among the request's candidates with a reason."""
    named = commands.select("command_id", "request_id", F.explode("related_ids").alias("related"))
    known = candidates.filter("coalesce(related_reason, '') <> ''").select("request_id", c("entity_id").alias("related"))
    return named.join(known, ["request_id", "related"], "left_anti").select("command_id", "related")


def known_tasks(commands: DataFrame, outbox: DataFrame, kind: str) -> DataFrame:
    """Commands (task_id, request_id) for which the outbox has that task of that kind."""
    tasks = outbox.select(c("id").alias("task_id"), F.get_json_object("payload", "$.reportRequestId").alias("request_id"), F.get_json_object("payload", "$.taskType").alias("_kind"))
    return commands.join(tasks.filter(c("_kind") == kind).drop("_kind"), ["task_id", "request_id"], "left_semi")


def zipped(rows: DataFrame) -> DataFrame:
    """Candidates and audits (JSON lists of a completion) side by side: completion_id, rank, candidate, audit. Lists of other lengths give nothing."""
    a, b = (F.from_json(n, "array<string>") for n in ("candidates", "audits"))
    pairs = rows.select("completion_id", a.alias("a"), b.alias("b")).filter(F.size("a") == F.size("b"))
    both = pairs.select("completion_id", F.posexplode(F.arrays_zip("a", "b")).alias("_p", "x"))
    return both.select("completion_id", (c("_p") + 1).alias("rank"), c("x.a").alias("candidate"), c("x.b").alias("audit"))


def entries(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, ordinality, value) of a JSON list's entries, counted from 1."""
    return rows.select(key, F.posexplode(F.from_json(column, "array<string>")).alias("_p", "value")).select(key, (c("_p") + 1).alias("ordinality"), "value")


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with all rows of a key that ``new`` has replaced by ``new``'s."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def selected(candidates: DataFrame, choices: DataFrame) -> DataFrame:
    """Candidates with is_selected set by choices (request_id, chosen); others keep theirs."""
    both = candidates.join(choices, "request_id", "left")
    return both.withColumn("is_selected", F.when(c("chosen").isNull(), c("is_selected")).otherwise(c("candidate_id") == c("chosen"))).drop("chosen")


def dispatched(outbox: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The outbox (id, attempts, dispatched_at, last_error) after attempts (id, sent)."""
    both = outbox.join(outcomes, "id", "left")
    tried = c("sent").isNotNull()
    return both.withColumns({
        "attempts": c("attempts") + tried.cast("int"), "dispatched_at": F.when(c("sent"), now).otherwise(c("dispatched_at")),
        "last_error": F.when(c("sent"), F.lit(None)).when(tried, "queue_dispatch_failed").otherwise(c("last_error")),
    }).drop("sent")


def oldest_pending(outbox: DataFrame, most: int = 1) -> DataFrame:
    """The entries to dispatch next: pending ones by age, then id."""
    return outbox.filter("dispatched_at is null").orderBy("created_at", "id").limit(most)


def touched(rows: DataFrame, before: DataFrame, key: str, now: Column) -> DataFrame:
    """``rows`` with updated_at moved to ``now`` where any other column differs from what it was."""
    others = [n for n in rows.columns if n not in (key, "updated_at")]
    was = before.select(key, F.struct(*others).alias("_was"))
    both = rows.join(was, key, "left")
    changed = ~F.struct(*others).eqNullSafe(c("_was"))
    return both.withColumn("updated_at", F.when(changed, now).otherwise(c("updated_at"))).drop("_was")


def failed(commands: DataFrame, requests: DataFrame, outbox: DataFrame, kind: str = "resolve_entity", running: str = "resolving_entity", settled: tuple[str, ...] = ("failed_no_charge", "awaiting_entity_confirmation")) -> DataFrame:
    """Commands (command_id, task_id, request_id, error_code) that end a task in failure, with the request's state after it or a code."""
    fine = known_tasks(commands, outbox, kind).select("command_id").withColumn("_task", F.lit(True))
    both = commands.join(fine, "command_id", "left").join(requests.select("request_id", c("state").alias("_s")), "request_id", "left")
    prefix = "RESOLUTION" if kind == "resolve_entity" else "PRELIMINARY"
    code = (
        F.when(~F.coalesce(c("error_code").rlike(ERROR_CODE), F.lit(False)), f"INVALID_{prefix}_ERROR_CODE").when(c("_task").isNull(), f"{prefix}_TASK_NOT_FOUND")
        .when(c("_s").isNull(), "REPORT_REQUEST_NOT_FOUND").when((c("_s") != running) & ~c("_s").isin(*settled), f"{prefix}_STATE_CONFLICT")
    )
    return both.select("command_id", code.alias("code"), F.when(code.isNull(), F.when(c("_s") == running, "failed_no_charge").otherwise(c("_s"))).alias("state"))


def confirmed(commands: DataFrame, requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Confirmation commands with code, or the request's state and entity after them.

    Commands: command_id, request_id, user_id, action, candidate_id,
    related_ids, legal_name, cin, state_hint. One command a request: replays and
    limits are ``sequential.limited``'s.
    """
    payload = decision_code(c("action"), c("candidate_id"), c("related_ids"), c("legal_name"), c("cin"), c("state_hint"))
    own = requests.select("request_id", "user_id", c("state").alias("_s"))
    picked = candidates.select("request_id", "candidate_id", c("entity_id").alias("_entity"))
    strays = outside_scope(commands, candidates).select("command_id").distinct().withColumn("_stray", F.lit(True))
    df = commands.join(own, ["request_id", "user_id"], "left").join(picked, ["request_id", "candidate_id"], "left").join(strays, "command_id", "left")
    related = F.coalesce("related_ids", F.array().cast("array<string>"))
    confirm = c("action") == "confirm"
    waiting = c("_s") == "awaiting_entity_confirmation"
    code = (
        F.when((F.size(related) > 2) | (F.size(related) != F.size(F.array_distinct(related))), "INVALID_RELATED_ENTITY_SCOPE").when(payload.isNotNull(), payload).when(c("_s").isNull(), "REPORT_REQUEST_NOT_FOUND")
        .when(c("action").isin("confirm", "none_of_these") & ~waiting, "CONFIRMATION_STATE_CONFLICT").when((c("action") == "refine") & ~c("_s").isin("draft", "awaiting_entity_confirmation", "failed_no_charge"), "CONFIRMATION_STATE_CONFLICT")
        .when(confirm & c("_entity").isNull(), "ENTITY_CANDIDATE_NOT_FOUND").when(confirm & (F.array_contains(related, c("_entity")) | c("_stray").isNotNull()), "INVALID_RELATED_ENTITY_SCOPE")
    )
    state = F.when(confirm, "preliminary_research").when(c("action") == "none_of_these", "draft").otherwise("resolving_entity")
    return df.select("command_id", code.alias("code"), F.when(code.isNull(), state).alias("state"), F.when(code.isNull() & confirm, c("_entity")).alias("confirmed_entity_id"))


def http_status(code: Column) -> Column:
    """The status that an interface answers for a command's code; 200 for none."""
    return F.when(code.isNull(), 200).otherwise(F.coalesce(F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])[code], F.when(code.startswith("INVALID_"), 400).otherwise(500)))


def material_signals(jurisdiction: Column, related: Column) -> Column:
    return F.array_compact(F.array(F.when(F.coalesce(F.size(related), F.lit(0)) > 0, F.lit("transaction_overlay")), F.when(~jurisdiction.eqNullSafe("IN"), F.lit("cross_border"))))


def questions(requests: DataFrame) -> DataFrame:
    """Clarification questions (request_id, place, code, mandatory, kind, options) of requests with signals: the client's role, then one a signal."""
    code = F.create_map(*[F.lit(x) for pair in SIGNALS.items() for x in pair])
    asked = F.concat(F.array(F.lit("client_role")), F.transform("signals", lambda s: code[s]))
    of = lambda k: F.create_map(*[x for name, row in QUESTIONS.items() for x in (F.lit(name), F.lit(row[k]))])[c("code")]
    rows = requests.select("request_id", F.posexplode(asked).alias("place", "code"))
    return rows.select("request_id", (c("place") + 1).alias("place"), "code", of(0).alias("mandatory"), of(1).alias("kind"), of(2).alias("options"))


def sparse(evidence_ids: Column) -> Column:
    return F.coalesce(F.size(evidence_ids), F.lit(0)) < 2
