"""Decisions that hang on the decisions before them, walked in order within each key.

Rows are dealt by key and sorted, and each partition is walked in Arrow batches
with the state of one key in hand, so a key of any length takes constant memory
(beyond its state). Different keys run apart; within a key order is the point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("searches", "pages", "model_calls", "input_tokens", "output_tokens", "cost_inr", "wall_clock_seconds")
# Fixed values.
STAGE_SEARCHES_PAGES = {
    "research_business": (8, 16), "research_industry": (7, 15), "research_competitors": (8, 16), "research_corporate": (10, 20), "research_regulatory": (7, 13), "research_public_risk": (5, 12),
}
STAGE_CAPS = {"model_calls": 1, "input_tokens": 50_000, "output_tokens": 8_000, "cost_inr": 20, "wall_clock_seconds": 200}
JOB_CAPS = {"searches": 45, "pages": 100, "frontier_model_calls": 4, "input_tokens": 350_000, "output_tokens": 60_000, "cost_inr": 120, "wall_clock_seconds": 1_200}
CODES = {
    "searches": "budget_searches_exhausted", "pages": "budget_pages_exhausted", "model_calls": "budget_model_calls_exhausted", "input_tokens": "budget_input_tokens_exhausted",
    "output_tokens": "budget_output_tokens_exhausted", "cost_inr": "budget_model_cost_exhausted", "wall_clock_seconds": "budget_wall_clock_exhausted",
}


def walk(rows: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, dict], dict], added: str) -> DataFrame:
    """``rows`` with the columns that ``step(state, row)`` gives for each; ``added`` is their DDL."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = [part.strip().split(" ")[0] for part in added.split(",")]
    out_schema = rows.limit(0).selectExpr("*", *[f"cast(null as {part.strip().split(' ', 1)[1]}) as {n}" for n, part in zip(names, added.split(","), strict=True)]).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out_schema)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), {}
        for batch in batches:
            made: dict[str, list] = {n: [] for n in names}
            for row in batch.to_pylist():
                if row[key] != at:
                    at, state = row[key], start()
                got = step(state, row)
                for n in names:
                    made[n].append(got.get(n))
            columns = [*batch.columns, *[pa.array(made[n], arrow.field(n).type) for n in names]]
            yield pa.RecordBatch.from_arrays([col.cast(f.type) for col, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.repartition(parts, key).sortWithinPartitions(key, *order).mapInArrow(run, f"{schema}, {added}")


def budget_ledger(entries: DataFrame, job: dict | None = None, stages: dict | None = None) -> DataFrame:
    """Entries (job_id, ord, kind, stage, amount, second, frontier) with code (null for what was booked) and the job's totals after each.

    Kinds: start_stage, and a dimension to consume; ``tokens`` books amount and
    second at once or not at all. Each is checked before it is booked: sign, the
    job's cap, then the stage's. What is refused changes nothing.
    """
    job = JOB_CAPS if job is None else job
    stages = {s: {"searches": a, "pages": b, **STAGE_CAPS} for s, (a, b) in STAGE_SEARCHES_PAGES.items()} if stages is None else stages
    calls = sum(s["model_calls"] for s in stages.values())

    def start() -> dict:
        return {"stage": None, "used": dict.fromkeys(DIMENSIONS, Decimal(0)), "frontier": 0, "stages": {}}

    def refusal(state: dict, field: str, amount: Decimal) -> str | None:
        full = state["used"][field] + amount > (calls if field == "model_calls" else job[field])
        if field == "cost_inr" and (amount < 0 or full):
            return "budget_model_cost_exhausted"
        if amount < 0:
            return "budget_increment_invalid"
        if state["stage"] is None:
            return "budget_stage_not_started"
        if full:
            return CODES[field]
        if state["stages"][state["stage"]][field] + amount > stages[state["stage"]][field]:
            return "budget_stage_cost_exhausted" if field == "cost_inr" else f"budget_stage_{field}_exhausted"
        return None

    def step(state: dict, row: dict) -> dict:
        kind, amount = row["kind"], Decimal(str(row["amount"] or 0))
        if kind == "start_stage":
            code = None if row["stage"] in stages else "budget_stage_unconfigured"
            if code is None:
                state["stage"] = row["stage"]
                state["stages"].setdefault(row["stage"], dict.fromkeys(DIMENSIONS, Decimal(0)))
        else:
            wanted = {"input_tokens": amount, "output_tokens": Decimal(str(row["second"] or 0))} if kind == "tokens" else {kind: amount}
            code = None
            if kind == "model_calls" and row["frontier"] and (amount < 0 or state["frontier"] + amount > job["frontier_model_calls"]):
                code = "budget_frontier_model_calls_exhausted"
            for field, value in wanted.items():
                code = code or refusal(state, field, value)
            if code is None:
                for field, value in wanted.items():
                    state["used"][field] += value
                    state["stages"][state["stage"]][field] += value
                state["frontier"] += amount if kind == "model_calls" and row["frontier"] else 0
        return {"code": code, "frontier_used": int(state["frontier"]), **{f"{f}_used": float(v) for f, v in state["used"].items()}}

    return walk(entries, "job_id", ["ord"], start, step, "code string, frontier_used bigint, " + ", ".join(f"{f}_used double" for f in DIMENSIONS))


def exhausted(job: dict | None = None, calls: int = len(STAGE_SEARCHES_PAGES)) -> Column:
    """Whether a ledger's totals have reached any cap."""
    job = JOB_CAPS if job is None else job
    out = F.lit(False)
    for f in DIMENSIONS:
        out = out | (F.col(f"{f}_used") >= (calls if f == "model_calls" else job[f]))
    return out


def stopping(done: Column, supported: Column, transient: Column) -> Column:
    return F.when(~done, "continue").when(supported, "stop_to_questions").when(transient, "retry_wait").otherwise("failed_restored")


def profile_errors(profiles: DataFrame, slices: DataFrame) -> DataFrame:
    """(name, rule): profiles whose stages repeat or ask for more, in sum, than the job's caps (columns of both)."""
    fields = [f for f in DIMENSIONS if f != "model_calls"]
    per = slices.groupBy("name").agg((F.count("*") != F.count_distinct("stage")).alias("_again"), *[F.sum(f).alias(f"_{f}") for f in fields])
    both = profiles.join(per, "name")
    rules = [F.when(F.col("_again"), F.lit("stages_not_unique"))] + [F.when(F.col(f"_{f}") > F.col(f), F.lit(f"{f}_exceed_job")) for f in fields]
    return both.select("name", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def limited(commands: DataFrame, key: str, limit: int = 10, seconds: int = 3600) -> DataFrame:
    """Commands (key, ord, at in seconds, idempotency_key, payload) with outcome: accepted, replayed, conflict or limited.

    A known key is answered before the limit is looked at, and only accepted
    commands count towards it, so what happens to one depends on those before.
    Kept per key: accepted times of the last period, and the keys seen.
    """

    def step(state: dict, row: dict) -> dict:
        seen, name = state["seen"], row["idempotency_key"]
        if name is not None and name in seen:
            return {"outcome": "replayed" if seen[name] == row["payload"] else "conflict"}
        state["times"] = [t for t in state["times"] if t >= row["at"] - seconds]
        if len(state["times"]) >= limit:
            return {"outcome": "limited"}
        state["times"].append(row["at"])
        if name is not None:
            seen[name] = row["payload"]
        return {"outcome": "accepted"}

    return walk(commands, key, ["ord"], lambda: {"times": [], "seen": {}}, step, "outcome string")


class Queue:
    """A queue's messages as commands change them; times are seconds.

    Messages wait in a heap by the time they are visible from, and those that a lease has found visible in one by id. Entries of a time that is
    no longer a message's own are passed over, and go once they outnumber the messages; a clock that goes back sends messages back to wait.
    """

    def __init__(self):
        self.next_id, self.messages = 1, {}
        self.waiting: list[tuple[float, int]] | None = None  # None: to be built from the messages
        self.ready: list[tuple[int, float]] = []

    def _wait(self, visible: float, message_id: int) -> None:
        if self.waiting is not None and visible == visible:
            heappush(self.waiting, (visible, message_id))

    def _taken(self, at: float) -> int | None:
        """The least id that is visible, taken off its heap."""
        if self.waiting is None or len(self.waiting) + len(self.ready) > 2 * len(self.messages) + 64:
            self.waiting, self.ready = [(v, k) for k, (v, _) in self.messages.items() if v == v], []
            heapify(self.waiting)
        while self.waiting and self.waiting[0][0] <= at:
            visible, k = heappop(self.waiting)
            if k in self.messages and self.messages[k][0] == visible:
                heappush(self.ready, (k, visible))
        while self.ready:
            k, visible = heappop(self.ready)
            if k in self.messages and self.messages[k][0] == visible:
                if visible <= at:
                    return k
                self._wait(visible, k)
        return None

    def apply(self, op: str, at: float, message_id: int | None = None, seconds: float = 0) -> tuple[str, int | None, int | None]:
        """(outcome, message_id, read_count). Ops: send, lease, extend, archive, dead_letter."""
        if op == "send":
            if seconds < 0:
                return "invalid_delay", None, None
            new = self.next_id
            self.next_id += 1
            self.messages[new] = [at + seconds, 0]
            self._wait(at + seconds, new)
            return "sent", new, 0
        if op in ("lease", "extend") and seconds <= 0:
            return "invalid_timeout", None, None
        if op == "lease":
            found = self._taken(at)
            if found is None:
                return "empty", None, None
            reads = self.messages[found][1] + 1
            self.messages[found] = [at + seconds, reads]
            self._wait(at + seconds, found)
            return "leased", found, reads
        if message_id not in self.messages:
            return "not_found", message_id, None
        if op == "extend":
            self.messages[message_id][0] = at + seconds
            self._wait(at + seconds, message_id)
            return "extended", message_id, self.messages[message_id][1]
        return {"archive": "archived", "dead_letter": "dead_lettered"}[op], message_id, self.messages.pop(message_id)[1]


def queue_replay(commands: DataFrame) -> DataFrame:
    """Commands (queue, ord, at, op, message_id, seconds) with outcome, subject (the message's id) and reads."""

    def step(state: dict, row: dict) -> dict:
        outcome, subject, reads = state["queue"].apply(row["op"], row["at"], row["message_id"], row["seconds"] or 0)
        return {"outcome": outcome, "subject": subject, "reads": reads}

    return walk(commands, "queue", ["ord"], lambda: {"queue": Queue()}, step, "outcome string, subject bigint, reads bigint")


def queue_snapshot(replayed: DataFrame) -> DataFrame:
    """(queue, message_id, reads, visible_at) of the messages that are left after a replay."""
    last = replayed.filter("subject is not null and outcome <> 'not_found'").groupBy("queue", "subject").agg(
        F.max_by(F.struct("outcome", "reads", (F.col("at") + F.coalesce("seconds", F.lit(0))).alias("visible_at")), "ord").alias("s")
    )
    left = last.filter("s.outcome not in ('archived', 'dead_lettered')")
    return left.select("queue", F.col("subject").alias("message_id"), "s.reads", "s.visible_at")


def job_delivery(read_count: Column, valid: Column, result: Column, most: int = 4) -> Column:
    """struct(action, code) for a leased job message; result: ok, timeout or error."""
    return _delivery(read_count, valid, result, most, "invalid_job_message", "max_deliveries_exceeded", "job_timeout")


def light_delivery(read_count: Column, valid: Column, result: Column, failure_kept: Column, most: int = 4) -> Column:
    """As for jobs; a message read too often is first recorded as failed, and stays if that doesn't succeed (failure_kept)."""
    plain = _delivery(read_count, valid, result, most, "invalid_light_task_message", "max_light_task_deliveries_exceeded", "light_task_timeout")
    deferred = F.struct(F.lit("redeliver").alias("action"), F.lit("failure_persistence_failed").alias("code"))
    return F.when(valid & (read_count > most) & ~failure_kept, deferred).otherwise(plain)


def _delivery(read_count: Column, valid: Column, result: Column, most: int, invalid: str, worn: str, late: str) -> Column:
    row = lambda action, code: F.struct(F.lit(action).alias("action"), F.lit(code).cast("string").alias("code"))
    return F.when(~valid, row("dead_letter", invalid)).when(read_count > most, row("dead_letter", worn)).when(result == "timeout", row("redeliver", late)).when(result == "error", row("redeliver", "handler_error")).otherwise(row("archive", None))
