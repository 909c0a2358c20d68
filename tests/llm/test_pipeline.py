"""The stages against a plain composition, and odd rows."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from proofline.llm import mixing
from tests.llm.test_operators import SF, brute_components, empty, odd  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept_by_hand(rows):
    """What the first three stages keep of rows of documents."""
    rows = [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]
    last = {}
    for r in rows:
        if r["text"] not in last or last[r["text"]]["doc_id"] < r["doc_id"]:
            last[r["text"]] = r
    group = brute_components([(r["doc_id"], r["text"]) for r in last.values()])
    return [r for r in last.values() if group[r["doc_id"]][1] == r["doc_id"]]


def test_against_a_plain_composition(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = kept_by_hand([r.asDict() for r in docs.collect()])
    for name, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == COLUMNS
    got = docs.toPandas().sort_values("doc_id")
    assert got["doc_id"].tolist() == sorted(r["doc_id"] for r in want)

    db = duckdb.connect()
    db.register("documents", pd.DataFrame(want)[COLUMNS])
    copies = dict(db.sql(mixing.OP1_SQL).select("doc_id", "copies").fetchall())
    mixed = corpus_pipeline.mixture(spark, docs, SF)
    assert mixed.columns == COLUMNS
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: n for k, n in copies.items() if n}

    packed = corpus_pipeline.packing(spark, mixed, SF).toPandas()
    ends = packed.groupby("sequence_id").apply(lambda g: (g.sort_values("offset")["offset"].tolist(), g.sort_values("offset")["length"].tolist()), include_groups=False)
    for offsets, lengths in ends:
        assert offsets == [sum(lengths[:k]) for k in range(len(lengths))] and sum(lengths) <= 2048
    assert packed.groupby("doc_id")["piece"].apply(lambda p: (p == 0).sum()).to_dict() == {k: n for k, n in copies.items() if n}
    assert len(ends) <= 1.02 * packed["length"].sum() / 2048 + 1


def test_runs_agree(spark):
    first, second = (corpus_pipeline.run(spark, SF).toPandas() for _ in range(2))
    order = ["doc_id", "piece", "sequence_id", "offset"]
    pd.testing.assert_frame_equal(first.sort_values(order, ignore_index=True), second.sort_values(order, ignore_index=True))


def test_odd_rows(spark, odd, tmp_path):  # noqa: F811
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/odd-{name}")
        docs = spark.read.parquet(f"{tmp_path}/odd-{name}")
        assert docs.columns == before.columns
    assert docs.filter(F.col("text").isNull()).isEmpty() and not docs.isEmpty()
    assert corpus_pipeline.packing(spark, docs, SF).count() >= docs.count()


def test_empty_table(spark, tmp_path):
    docs = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.isEmpty(), name


def test_mix_keeps_sources_apart(spark):
    rows = [(k, f"some words of text {k}", s) for k in range(100) for s in ("a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.mix_plan(docs).collect()}
    for parts in (1, 3, 7):
        got = {(r["doc_id"], r["source"]): r["count"] for r in mixing.mix(docs.repartition(parts)).groupBy("doc_id", "source").count().collect()}
        assert got == {k: n for k, n in plan.items() if n}


def test_drop_duplicates_of_an_expression(spark):
    from proofline.llm.exact_dedup import drop_duplicates

    docs = spark.createDataFrame([(1, "A b", "x"), (2, "a B", "y"), (3, "q", "z"), (3, "q", "w")], "doc_id long, text string, lang string")
    got = [sorted(map(tuple, drop_duplicates(docs.repartition(n), F.lower("text")).collect())) for n in (1, 3)]
    assert got[0] == got[1] and [r[:2] for r in got[0]] == [(2, "a B"), (3, "q")]
