"""The queue as a stream agrees with its replay; the relay sends each key once."""

import random
import time

from proofline.operators.sequential import Queue, queue_replay
from proofline.plans.state import _QUEUE
from proofline.plans.common import carried
from proofline.streaming.queue import outbox_relay, queue_stream

SF = "/root/testdata/sf0.001"


def run(stream, tmp_path, name):
    out = f"{tmp_path}/{name}"
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/{name}-c").trigger(availableNow=True).start().awaitTermination(120)
    return out


def test_stream_is_replay(spark, tmp_path):
    commands = carried(spark, SF, _QUEUE)
    bounds = [0, 300, 301, 700, 10**9]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):  # files are read by age, one a batch
        commands.filter(f"ord >= {a} and ord < {b}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = spark.read.parquet(run(queue_stream(rows), tmp_path, "queue"))
    want = queue_replay(commands)
    pick = lambda df: sorted((r["queue"], r["ord"], r["outcome"], r["subject"] or 0, r["reads"] or 0) for r in df.collect())
    assert pick(got) == pick(want)


def test_relay_sends_a_key_once(spark, tmp_path):
    entries = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "idempotency_key string, id long")
    for _ in range(2):
        entries.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = spark.read.parquet(run(outbox_relay(rows), tmp_path, "outbox"))
    assert sorted(r["idempotency_key"] for r in got.collect()) == ["a", "b"]


class PlainQueue:
    """Leases by a look at all messages."""

    def __init__(self):
        self.next_id, self.messages = 1, {}

    def apply(self, op, at, message_id=None, seconds=0):
        if op == "send":
            if seconds < 0:
                return "invalid_delay", None, None
            self.messages[self.next_id] = [at + seconds, 0]
            self.next_id += 1
            return "sent", self.next_id - 1, 0
        if op in ("lease", "extend") and seconds <= 0:
            return "invalid_timeout", None, None
        if op == "lease":
            found = min((k for k, (v, _) in self.messages.items() if v <= at), default=None)
            if found is None:
                return "empty", None, None
            self.messages[found] = [at + seconds, self.messages[found][1] + 1]
            return "leased", found, self.messages[found][1]
        if message_id not in self.messages:
            return "not_found", message_id, None
        if op == "extend":
            self.messages[message_id][0] = at + seconds
            return "extended", message_id, self.messages[message_id][1]
        return {"archive": "archived", "dead_letter": "dead_lettered"}[op], message_id, self.messages.pop(message_id)[1]


def test_leases_are_those_of_a_plain_queue():
    draw = random.Random(4)
    for back in (0, 40):  # a clock that only goes on, and one that also goes back
        for _ in range(40):
            ours, plain, at = Queue(), PlainQueue(), 0.0
            for k in range(400):
                at += draw.randrange(-back, 60) if back else draw.randrange(20)
                op = draw.choice(("send", "send", "lease", "lease", "extend", "archive", "dead_letter"))
                command = (op, at, draw.randrange(1, 40), draw.choice((-1, 0, 5, 5, 30, 300)))
                assert ours.apply(*command) == plain.apply(*command)
                if k == 200:  # as a stream takes a queue up again
                    again = Queue()
                    again.next_id, again.messages = ours.next_id, ours.messages
                    ours = again
            assert ours.messages == plain.messages


def test_long_queues_are_leased_in_short_time():
    queue, began = Queue(), time.process_time()
    for k in range(30_000):
        queue.apply("send", float(k), None, 0)
    for k in range(30_000):
        assert queue.apply("lease", 30_000.0 + k, None, 1e9)[:2] == ("leased", k + 1)
    for k in range(100_000):
        queue.apply("extend", 60_000.0 + k, 7, 1e9)
        queue.apply("lease", 60_000.0 + k, None, 1)
    assert time.process_time() - began < 10 and len(queue.waiting) + len(queue.ready) < 70_000
