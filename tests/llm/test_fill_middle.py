"""Fill-in-middle against a plain version over code points."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from proofline.llm import fill_middle as fim


def plain(text, doc_id, seed=7, transformed=100, spm=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= transformed:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    draw = random.Random(5)
    alphabet = ["\n", "\n", "\r\n", "<", "<P", "P>", ">", "S", "<M", "a", "b c", "é", "ß", "漢", "𝒳", "\x00", " ", "\x85"]
    out = [None, "", "\n", "\n\n", "a", "a\n", "é", "<P>", "x<S>y", "<M>", "<P\n>", "<<P>", "<P<P>", "<PS>", "𝒳\n𝒳", "<", "a<M", "long line " * 200_000 + "\n" + "end"]
    return out + ["".join(draw.choices(alphabet, k=draw.randrange(40))) for _ in range(1500)]


def test_rows_equal_a_plain_version(spark):
    rows = [(None if k % 97 == 0 else k, t) for k, t in enumerate(texts())]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("x")).withColumn("h1", F.lit(3)).repartition(3)
    for options in ({}, {"seed": 11, "transformed": 60, "spm": 10}):
        done = fim.fill_in_middle(docs, **options).withColumn("again", fim.restored(F.col("output"), F.col("form")))
        found = [tuple(r) for r in done.collect()]
        want = [(k, *plain(t, k, **options), t or "") for k, t in rows]
        key = lambda r: tuple(map(repr, r))
        assert sorted(found, key=key) == sorted(want, key=key)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_scan_in_slices(spark, monkeypatch):
    some = [t or "" for t in texts()[:300]]
    raw = [t.encode() for t in some]
    assert [s for part in fim._slices([len(t) for t in raw], 50) for s in raw[part]] == raw


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(empty).collect() == []


def test_query_reads_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = {r["doc_id"]: r for r in fim.op11_fill_in_middle(spark, "/root/testdata/sf0.001").collect()}
    assert len(found) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for d in docs:
        *rest, output = plain(d["text"], d["doc_id"])
        assert tuple(found[d["doc_id"]])[1:] == (*rest, sha(output), sha(d["text"] or ""))
