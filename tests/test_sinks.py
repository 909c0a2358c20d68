"""Sinks of streams: replays, crashes between data and commit, conflicts, and how many folders there are."""

import os

import pytest

from proofline.operators.records import STAGES
from proofline.sources import sinks as S

STAGE = "job_id long, attempt int, stage string, ord long, payload_hash string"


def table(spark, folder, **more):
    return S.BucketedTable(spark, f"{folder}/t", STAGE, ["job_id", "attempt", "stage"], "ord", "payload_hash", **({"buckets": 8} | more))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_are_stored_once(spark, tmp_path):
    t = table(spark, tmp_path)
    first = [(k, 1, "plan", 2 * k, f"h{k}") for k in range(50)] + [(7, 1, "plan", 15, "h7"), (8, 1, "plan", 99, "other"), (None, 1, None, 5, "n")]
    again = [(3, 1, "plan", 200, "h3"), (4, 1, "plan", 201, "changed"), (3, 2, "plan", 202, "x")]
    make = lambda rows: spark.createDataFrame(rows, STAGE)
    assert t.commit(make(first), 0, False) and t.commit(make(again), 1, False)
    want = {(k, 1, "plan"): f"h{k}" for k in range(50)} | {(3, 2, "plan"): "x", (None, 1, None): "n"}
    assert {r[:3]: r[4] for r in rows_of(t.read())} == want
    assert rows_of(t.errors()) == [(4, 1, "plan", 201, "changed"), (8, 1, "plan", 99, "other")]
    before = rows_of(t.read()), rows_of(t.errors())
    assert not t.commit(make([(9, 9, "plan", 1, "z")]), 1, False)  # a replay
    assert (rows_of(t.read()), rows_of(t.errors())) == before
    folders = [d for _, names, _ in os.walk(tmp_path / "t") for d in names if d.startswith("_bucket")]
    assert len(folders) <= 2 * 8 and len(set(folders)) <= 8
    left = S.pending_stages(make([(3, 1, "", 0, ""), (60, 1, "", 0, "")]), t.read()).collect()
    assert sorted((r["job_id"], r["place"]) for r in left) == [(3, k) for k in range(1, len(STAGES))] + [(60, k) for k in range(len(STAGES))]


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    make = lambda rows: spark.createDataFrame(rows, STAGE)
    t.commit(make([(1, 1, "plan", 1, "a"), (2, 1, "plan", 2, "b")]), 0, True)
    with monkeypatch.context() as m:
        m.setattr(S.BucketedTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.commit(make([(1, 1, "plan", 3, "half")]), 1, True)
    assert rows_of(t.read()) == [(1, 1, "plan", 1, "a"), (2, 1, "plan", 2, "b")]
    assert t.commit(make([(1, 1, "plan", 4, "d"), (1, 1, "plan", 3, "c"), (5, 1, "plan", 1, "e")]), 1, True)
    assert rows_of(t.read()) == [(1, 1, "plan", 4, "d"), (2, 1, "plan", 2, "b"), (5, 1, "plan", 1, "e")]


def test_a_stream_that_restarts(spark, tmp_path):
    source = f"{tmp_path}/in"
    for part in range(3):
        spark.createDataFrame([(k, 1, "plan", 10 * part + k, f"p{part}") for k in range(part, part + 4)], STAGE).coalesce(1).write.mode("append").parquet(source)
        if part != 1:  # the second start finds one batch, the third two
            stream = spark.readStream.schema(STAGE).option("maxFilesPerTrigger", 1).parquet(source)
            stream.writeStream.foreachBatch(S.completion_sink(table(spark, tmp_path))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(60)
    found = {r["job_id"]: r["payload_hash"] for r in table(spark, tmp_path).read().collect()}
    assert found == {0: "p0", 1: "p1", 2: "p2", 3: "p2", 4: "p2", 5: "p2"}


def test_empty_table_and_batch(spark, tmp_path):
    t = table(spark, tmp_path)
    assert rows_of(t.read()) == [] and rows_of(t.errors()) == []
    assert t.commit(spark.createDataFrame([], STAGE), 0, False) and rows_of(t.read()) == []
