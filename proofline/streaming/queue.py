"""The queue as a stream: commands in, outcomes out, messages kept as state of their queue.

The same rules as ``operators.sequential.queue_replay``; commands of a queue
must arrive in order from micro-batch to micro-batch, and are sorted within one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from proofline.operators.sequential import Queue

OUTPUT = "queue string, ord bigint, at double, op string, message_id bigint, seconds double, outcome string, subject bigint, reads bigint"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    queue = Queue()
    if state.exists:
        queue.next_id, messages = json.loads(state.get[0])
        queue.messages = {int(k): v for k, v in messages.items()}
    rows = pd.concat(list(frames)).sort_values("ord", kind="stable")
    made = []
    for row in rows.itertuples(index=False):
        number = None if pd.isna(row.message_id) else int(row.message_id)
        made.append(queue.apply(row.op, row.at, number, 0 if pd.isna(row.seconds) else row.seconds))
    state.update((json.dumps([queue.next_id, queue.messages]),))
    out = rows.assign(outcome=[m[0] for m in made], subject=pd.array([m[1] for m in made], "Int64"), reads=pd.array([m[2] for m in made], "Int64"))
    yield out[["queue", "ord", "at", "op", "message_id", "seconds", "outcome", "subject", "reads"]]


def queue_stream(commands: DataFrame) -> DataFrame:
    """Outcomes of a stream of commands (queue, ord, at, op, message_id, seconds)."""
    rows = commands.selectExpr("queue", "ord", "cast(at as double) at", "op", "message_id", "cast(seconds as double) seconds")
    return rows.groupBy("queue").applyInPandasWithState(_advance, OUTPUT, "messages string", "append", "NoTimeout")


def outbox_relay(entries: DataFrame, key: str = "idempotency_key", at: str | None = None, delay: str = "1 day", dispatched: DataFrame | None = None) -> DataFrame:
    """Entries to dispatch from a stream of an outbox's rows: each key once within ``delay`` of ``at`` (or of its arrival).

    Keys older than the watermark leave the state. Rows that come later than that aren't
    sent by the stream, nor are keys of ``dispatched``, a table; ``undispatched`` finds what the stream has passed by.
    """
    if dispatched is not None:
        entries = entries.join(dispatched.select(key).distinct(), key, "left_anti")
    time = at or "_arrived"
    rows = entries if at else entries.withColumn(time, F.current_timestamp())
    rows = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return rows if at else rows.drop(time)


def undispatched(entries: DataFrame, dispatched: DataFrame, key: str = "idempotency_key", order: str = "id") -> DataFrame:
    """Of a table of entries, the first of each key that was never sent."""
    first = entries.groupBy(key).agg(F.min_by(F.struct(*entries.columns), order).alias("_first")).select("_first.*")
    return first.join(dispatched.select(key).distinct(), key, "left_anti")
