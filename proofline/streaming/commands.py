"""Commands of users and requests as streams with state: replays and rate limits, and the state machine of requests.

Each key's commands are decided in order, so a batch's rows of one key are sorted
in memory; commands must come in order from batch to batch. State is kept by the store that
``spark.sql.streaming.stateStore.providerClass`` names, which must be RocksDB's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from proofline.operators.records import TRANSITIONS
from proofline.operators.sequential import walk

_EDGES = {(a, b) for a, to in TRANSITIONS.items() for b in to.split()}
LIMITED = "user_id bigint, ord bigint, at double, idempotency_key string, payload string, outcome string"
GUARDED = "request_id bigint, ord bigint, to_state string, from_state string, outcome string"


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values("ord", kind="stable")


class _Limits(StatefulProcessor):
    """Replays before limits. Kept per user: the accepted times of the last period, at most ``limit``, and each idempotency key for ``remember`` milliseconds."""

    def __init__(self, limit: int, seconds: int, remember: int):
        self.limit, self.seconds, self.remember = limit, seconds, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "times array<double>")
        self.keys = handle.getMapState("keys", "name string", "payload string", self.remember)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _in_order(rows)
        times = list(self.times.get()[0]) if self.times.exists() else []
        outcomes = []
        for at, name, payload in zip(df["at"], df["idempotency_key"], df["payload"], strict=True):
            name, payload = None if pd.isna(name) else name, None if pd.isna(payload) else payload
            if name is not None and self.keys.containsKey((name,)):
                outcomes.append("replayed" if self.keys.getValue((name,))[0] == payload else "conflict")
                continue
            times = [t for t in times if t >= at - self.seconds]
            if len(times) >= self.limit:
                outcomes.append("limited")
                continue
            times.append(float(at))
            if name is not None:
                self.keys.updateValue((name,), (payload,))
            outcomes.append("accepted")
        self.times.update((times,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1000 * self.seconds, self.remember))
        yield df.assign(user_id=key[0], outcome=outcomes)[[c.split()[0] for c in LIMITED.split(", ")]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A user who has sent nothing for long leaves no state."""
        self.times.clear()
        self.keys.clear()
        yield pd.DataFrame({c.split()[0]: pd.Series(dtype="object") for c in LIMITED.split(", ")})

    def close(self) -> None:
        pass


def limited_stream(commands: DataFrame, limit: int = 10, seconds: int = 3600, remember_ms: int = 7 * 86_400_000) -> DataFrame:
    """Commands (user_id, ord, at in seconds, idempotency_key, payload) with outcome: accepted, replayed, conflict or limited.

    As ``sequential.limited``, but a key is forgotten after ``remember_ms`` of the clock, and a user's
    state after the longer of that and the period without a command.
    """
    rows = commands.selectExpr("user_id", "ord", "cast(at as double) at", "idempotency_key", "payload")
    return rows.groupBy("user_id").transformWithStateInPandas(_Limits(limit, seconds, remember_ms), LIMITED, "Append", "ProcessingTime")


class _Guard(StatefulProcessor):
    """The state of each request; a change along no edge of the state machine is rejected and leaves it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = _in_order(rows)
        held = self.state.get()[0] if self.state.exists() else None
        before, outcomes = [], []
        for to in df["to_state"]:
            outcome = guarded(held, None if pd.isna(to) else to)
            before.append(held)
            outcomes.append(outcome)
            held = to if outcome != "rejected" else held
        if held is not None:
            self.state.update((held,))
        yield df.assign(request_id=key[0], from_state=before, outcome=outcomes)[[c.split()[0] for c in GUARDED.split(", ")]]

    def close(self) -> None:
        pass


def guarded(held: str | None, to: str | None) -> str:
    """started (only as a draft), changed, or rejected."""
    if held is None:
        return "started" if to == "draft" else "rejected"
    return "changed" if (held, to) in _EDGES else "rejected"


def guarded_stream(changes: DataFrame) -> DataFrame:
    """Changes (request_id, ord, to_state) of a stream with from_state and outcome."""
    rows = changes.select("request_id", "ord", "to_state")
    return rows.groupBy("request_id").transformWithStateInPandas(_Guard(), GUARDED, "Append", "None")


def guarded_changes(changes: DataFrame) -> DataFrame:
    """The same over a table."""

    def step(state: dict, row: dict) -> dict:
        outcome, before = guarded(state["at"], row["to_state"]), state["at"]
        if outcome != "rejected":
            state["at"] = row["to_state"]
        return {"from_state": before, "outcome": outcome}

    return walk(changes.select("request_id", "ord", "to_state"), "request_id", ["ord"], lambda: {"at": None}, step, "from_state string, outcome string")
