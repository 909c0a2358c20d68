"""Recorded answers as a data source: filters choose files before they are opened, streams resume; dispatch as a table function."""

import json
import os

import pytest

from proofline.operators import dispatch as D
from proofline.sources import recorded


def write(folder, provider, name, rows):
    os.makedirs(f"{folder}/{provider}", exist_ok=True)
    with open(f"{folder}/{provider}/{name}", "w") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


@pytest.fixture
def folder(spark, tmp_path):
    recorded.register(spark)
    for provider in ("maps", "news", "web"):
        for k in range(2):
            write(tmp_path / "in", provider, f"{k:03}.jsonl", [{"query": f"{provider} {k} {j}", "answered_at": j, "body": {"n": j}} for j in range(3)])
    return f"file://{tmp_path}/in"


def test_rows_and_odd_lines(spark, folder, tmp_path):
    write(tmp_path / "in", "odd", "000.jsonl", ["", "nope", "[1]", '{"query": 5, "answered_at": "x"}', '{"body": null, "answered_at": true}'])
    write(tmp_path / "in", "odd", "001.jsonl", [])
    rows = spark.read.format("recorded_answers").load(folder).collect()
    assert len(rows) == 18 + 4
    assert {(r["query"], r["answered_at"], r["body"]) for r in rows if r["provider"] == "odd"} == {(None, None, "nope"), (None, None, "[1]"), (None, None, None)}
    assert {r["body"] for r in rows if r["provider"] == "web"} == {'{"n": 0}', '{"n": 1}', '{"n": 2}'}


def test_only_matching_files_are_opened(spark, folder, tmp_path):
    os.chmod(tmp_path / "in/maps/000.jsonl", 0)
    os.symlink("/nowhere", tmp_path / "in/maps/001x.jsonl")  # can't be opened by anyone
    read = spark.read.format("recorded_answers").load(folder)
    for found in (read.filter("provider = 'web'"), read.filter("provider in ('web', 'news') and provider = 'web'"), read.filter("provider in ('web', 'gone')")):
        assert found.rdd.getNumPartitions() == 2 and found.count() == 6
    assert read.filter("provider = 'web' and answered_at > 1").count() == 2
    assert read.filter("provider = 'gone'").count() == 0


def test_a_stream_resumes(spark, folder, tmp_path):
    def run():
        rows = spark.readStream.format("recorded_answers").load(folder)
        query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["query"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert len(run()) == 18
    write(tmp_path / "in", "web", "002.jsonl", [{"query": "new"}])
    write(tmp_path / "in", "late", "000.jsonl", [{"query": "other"}])
    again = run()
    assert len(again) == 20 and again.count("new") == again.count("other") == 1


def test_dispatch(spark):
    D.register(spark)
    shape = "queue string, id long, state string, attempts long, available_at long, now long"
    rows = [("a", 2, "pending", 0, 1, 5), ("a", 1, "pending", 0, 9, 5), ("a", 3, "pending", 0, 1, 5), ("b", 1, "sent", 0, 1, 5), (None, 7, "pending", None, None, 5), ("c", 1, "pending", 5, 5, 5)]
    rows += [("hot", k, "pending", 0, 0, 5) for k in range(5000)]
    found = spark.sql("SELECT * FROM dispatch_next(TABLE({o}))", o=spark.createDataFrame(rows, shape)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([("a", 2, 1, "dispatched"), (None, 7, 1, "dispatched"), ("c", 1, 6, "exhausted"), ("hot", 0, 1, "dispatched")], key=repr)
    assert spark.sql("SELECT * FROM dispatch_next(TABLE({o}))", o=spark.createDataFrame([], shape)).collect() == []
