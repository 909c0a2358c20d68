"""Streams with state against walks over the same rows, across batches and restarts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from proofline.operators.records import TRANSITIONS
from proofline.operators.sequential import limited
from proofline.streaming import commands as C
from proofline.streaming.queue import outbox_relay, undispatched


@pytest.fixture(autouse=True)
def rocks(spark):
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cut(spark, rows, schema, folder, seed):
    """Files of consecutive rows, of random lengths; read a file a batch."""
    draw, at = random.Random(seed), 0
    while at < len(rows):
        end = at + draw.randrange(1, len(rows) // 2 + 2)
        spark.createDataFrame(rows[at:end], schema).coalesce(1).write.mode("append").parquet(folder)
        at = end


def run(spark, folder, schema, make, out, files=1):
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    query = make(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    assert query.exception() is None
    return query


COMMANDS = "user_id long, ord long, at double, idempotency_key string, payload string"


def test_limits_are_the_walk(spark, tmp_path):
    draw = random.Random(4)
    rows = [(draw.choice([1, 1, 1, 2, 3]), k, k * 40.0, draw.choice([None, f"k{draw.randrange(60)}"]), draw.choice(["p", "q"])) for k in range(240)]
    want = {(r["user_id"], r["ord"]): r["outcome"] for r in limited(spark.createDataFrame(rows, COMMANDS), "user_id").collect()}
    assert set(want.values()) == {"accepted", "replayed", "conflict", "limited"}
    half = len(rows) // 2  # the stream stops between, and starts again from its checkpoint
    for part in (rows[:half], rows[half:]):
        cut(spark, part, COMMANDS, f"{tmp_path}/in", 5)
        run(spark, f"{tmp_path}/in", COMMANDS, C.limited_stream, f"{tmp_path}/out")
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(found) == len(rows) and {(r["user_id"], r["ord"]): r["outcome"] for r in found} == want


def test_keys_are_forgotten(spark, tmp_path):
    """Without a command for long, keys go: the stream runs on, so that its clock does."""
    file = lambda k: spark.createDataFrame([(1, 10 * k + j, 10.0 * k, "a", "p") for j in range(2)], COMMANDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    file(0)
    rows = spark.readStream.schema(COMMANDS).parquet(f"{tmp_path}/in")
    query = C.limited_stream(rows, remember_ms=1500).writeStream.format("memory").queryName("forgotten").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
    outcomes = lambda: {r["ord"]: r["outcome"] for r in spark.table("forgotten").collect()}

    def wait(many):
        until = time.time() + 40
        while len(outcomes()) < many and time.time() < until:
            time.sleep(0.5)

    try:
        wait(2)
        time.sleep(3)
        file(1)
        wait(4)
    finally:
        query.stop()
    assert outcomes() == {0: "accepted", 1: "replayed", 10: "accepted", 11: "replayed"}


def test_state_machine_is_the_walk(spark, tmp_path):
    draw, states = random.Random(6), list(TRANSITIONS)
    rows, held = [], {}
    for k in range(300):
        request = draw.choice([1, 1, 1, 2, 3, 4])
        follow = TRANSITIONS.get(held.get(request), "draft").split()
        to = draw.choice([*follow, *follow, *follow, draw.choice(states), None])
        rows.append((request, k, to))
        if C.guarded(held.get(request), to) != "rejected":
            held[request] = to
    shape = "request_id long, ord long, to_state string"
    want = sorted(tuple(r) for r in C.guarded_changes(spark.createDataFrame(rows, shape)).select("request_id", "ord", "from_state", "outcome").collect())
    assert {w[3] for w in want} == {"started", "changed", "rejected"}
    for part in (rows[:170], rows[170:]):
        cut(spark, part, shape, f"{tmp_path}/in", 7)
        run(spark, f"{tmp_path}/in", shape, C.guarded_stream, f"{tmp_path}/out")
    found = spark.read.parquet(f"{tmp_path}/out").select("request_id", "ord", "from_state", "outcome").collect()
    assert sorted(map(tuple, found)) == want


def test_relay_forgets_keys_behind_the_watermark(spark, tmp_path):
    shape = "idempotency_key string, id long, at timestamp"
    hour = lambda h, rows: spark.createDataFrame([(k, i, 3600.0 * h) for k, i in rows], "idempotency_key string, id long, at double").withColumn("at", F.timestamp_seconds("at")).coalesce(1)
    batches = [hour(1, [("a", 1), ("a", 2), ("sent", 3)]), hour(2, [("a", 4), ("b", 5)]), hour(50, [("c", 6)]), hour(51, [("d", 7)]), hour(1, [("late", 8), ("e", 9)])]
    dispatched = spark.createDataFrame([("sent",)], "idempotency_key string")
    make = lambda rows: outbox_relay(rows, at="at", delay="10 hours", dispatched=dispatched)
    for batch in batches:
        batch.write.mode("append").parquet(f"{tmp_path}/in")
    query = run(spark, f"{tmp_path}/in", shape, make, f"{tmp_path}/out")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    found = sorted(r["idempotency_key"] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == ["a", "b", "c", "d"]
    assert max(held) >= 2 and held[-1] <= 2  # a and b have left the state
    entries = spark.read.parquet(f"{tmp_path}/in")
    left = undispatched(entries, spark.read.parquet(f"{tmp_path}/out").select("idempotency_key").unionByName(dispatched))
    assert sorted(r["id"] for r in left.collect()) == [8, 9]
