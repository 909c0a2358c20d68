"""Fixtures, cases and test reports on disk, and odd inputs of operators."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from proofline.functions import pages as P
from proofline.functions import payloads as J
from proofline.functions import web as W
from proofline.operators import sequential as Q
from proofline.sources import reports as R


def test_fixtures_and_cases(spark, tmp_path):
    (tmp_path / "fx" / "a").mkdir(parents=True)
    good, bad = b'{"x": 1}', b"[1]"
    (tmp_path / "fx/a/one.json").write_bytes(good)
    (tmp_path / "fx/two.json").write_bytes(bad)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [("f1", "a/one.json", sha(good)), ("f2", "two.json", sha(bad)), ("f3", "two.json", sha(good)), ("f4", "none.json", sha(good))]
    found = R.fixture_payloads(spark, str(tmp_path / "fx"), spark.createDataFrame(rows, "fixture_id string, path string, sha256 string"))
    assert {r["fixture_id"]: (r["code"], r["payload"]) for r in found.collect()} == {"f1": (None, '{"x": 1}'), "f2": ("fixture_not_an_object", None), "f3": ("fixture_digest_mismatch", None), "f4": ("fixture_missing", None)}

    (tmp_path / "cases").mkdir()
    for name, body in {"GC-01": '{"caseId": "GC-01"}', "GC-02": '{"caseId": "GC-09"}', "GC-03": "oops", "GC-04": json.dumps({"caseId": "GC-04", "pad": "x" * 70_000}), "GC-77": '{"caseId": "GC-77"}'}.items():
        (tmp_path / "cases" / f"{name}.json").write_text(body)
    got = {r["case_id"]: r["code"] for r in R.case_files(spark, str(tmp_path / "cases"), [f"GC-0{k}" for k in range(1, 6)]).collect()}
    assert got == {"GC-01": None, "GC-02": "case_id_mismatch", "GC-03": "case_not_json", "GC-04": "case_too_large", "GC-05": "case_missing", "GC-77": "case_unexpected"}


def test_test_reports(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        '<testsuites><testsuite name="s"><testcase classname="c" name="t at_req_01"/><testcase name="u"><failure message="x">boom</failure></testcase>'
        '<testcase classname="c" name="v" file="f.py"><skipped/></testcase><testcase/></testsuite></testsuites>'
    )
    got = {(r["label"], r["passed"], ",".join(r["tags"])) for r in R.test_cases(spark, str(tmp_path / "r.xml")).collect()}
    assert ("c :: t at_req_01", True, "AT-REQ-01") in got and ("u", False, "") in got and len(got) == 4


def test_page_reading():
    page = P.read_page("<a href='http://[bad'>x</a><p>Copyright © 2020-2024 Acme Limited. CIN U12345MH2001PTC123456</p><div aria-hidden=TRUE>no<img></div>after", "https://x.example/")
    assert [(d["kind"], d["value"]) for d in page["disclosures"]] == [("legal_name", "Acme Limited"), ("copyright_owner", "Acme Limited"), ("cin", "U12345MH2001PTC123456")]
    assert "no" not in page["text"].split() and page["text"].endswith("after") and page["title"] == "Untitled page"
    assert P.read_page(None, None)["text"] == "" and P.read_page("<title>t", None)["title"] == "t"


def test_hostile_urls(spark):
    cases = {
        "https://user@example.com/": "credentials_forbidden", "https://example.com:0/": "unsupported_port", "http://[::1]/": None, "http://[::1/": "malformed_url", "https://exa mple.com/": "non_public_hostname", "https://münchen.example/": None,
        "javascript:alert(1)": "unsupported_scheme", "https://a.internal/": "non_public_hostname", "https://example.com/?x-signature=1": "credentials_forbidden", "https://example.com/?monkey=1": None, "": "unsupported_scheme",
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string").withColumn("c", W.canonical_url(F.col("url")))
    got = {r["url"]: r["c"]["code"] for r in df.collect()}
    assert got == cases
    assert df.filter("url = 'https://münchen.example/'").first()["c"]["url"] == "https://xn--mnchen-3ya.example/"
    assert spark.sql("select cast(null as string) url").select(W.canonical_url(F.col("url")).alias("c")).first()["c"]["code"] is None


def test_json_keys_and_values(spark):
    text = '{"a\\"b": "x\\": y", "c": ["k:", {"d": "e"}], "f\\u0067": 1}'
    row = spark.createDataFrame([(text,)], "t string").select(J.json_keys(F.col("t")).alias("k"), J.json_values(F.col("t")).alias("v")).first()
    assert row["k"] == ['a"b', "c", "d", "fg"] and row["v"] == ['x": y', "k:", "e"]


def test_frontier_calls_and_cost(spark):
    rows = [("j", 1, "model_calls", None, 1, 0, False), ("j", 2, "start_stage", "research_business", 0, 0, False), ("j", 3, "model_calls", None, 1, 0, True), ("j", 4, "model_calls", None, 1, 0, True), ("j", 5, "cost_inr", None, 21, 0, False), ("j", 6, "cost_inr", None, 20, 0, False), ("j", 7, "cost_inr", None, 121, 0, False), ("j", 8, "wall_clock_seconds", None, -1, 0, False), ("j", 9, "tokens", None, 50_000, 8_001, False)]
    df = spark.createDataFrame(rows, "job_id string, ord int, kind string, stage string, amount int, second int, frontier boolean")
    got = Q.budget_ledger(df).orderBy("ord").collect()
    assert [r["code"] for r in got] == ["budget_stage_not_started", None, None, "budget_stage_model_calls_exhausted", "budget_stage_cost_exhausted", None, "budget_model_cost_exhausted", "budget_increment_invalid", "budget_stage_output_tokens_exhausted"]
    assert got[-1]["cost_inr_used"] == 20 and got[-1]["input_tokens_used"] == 0 and got[-1]["frontier_used"] == 1
    assert Q.budget_ledger(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,want", [("rs. 5 CRORE", "number:5.00000e+07"), (None, None), ("", "")])
def test_assertions(spark, text, want):
    from proofline.functions.text import assertion_key

    assert spark.createDataFrame([(text,)], "t string").select(assertion_key(F.col("t")).alias("k")).first()["k"] == want


def test_made_archives_have_no_clock(monkeypatch):
    import time

    from proofline.plans import pages

    first = [pages._archive(k) for k in range(len(pages._EXPECTED))]
    monkeypatch.setattr(time, "localtime", lambda *_: time.struct_time((2031, 5, 6, 7, 8, 10, 1, 126, 0)))
    assert [pages._archive(k) for k in range(len(pages._EXPECTED))] == first


def test_frequent_names_are_dealt_out(spark):
    from proofline.sources.companies import ASKS, search_register

    n = 8 * ASKS
    asked = spark.range(n, numPartitions=2).select(F.col("id").alias("ask_id"), F.lit(" SAME name").alias("name"), (F.col("id") % 3).alias("most")).unionByName(spark.sql("select -1L ask_id, 'other' name, 1L most union all select -2L, null, 2L"))
    searches = spark.sql("select 'Same Name' legal_name, array('a', 'b') cins union all select 'same  name', array('c', 'x') union all select 'Other', array('b', 'a') union all select null, array('a')")
    records = spark.sql("select * from values ('a', 'A'), ('b', 'B'), ('b', 'B2'), ('c', 'C') t(cin, legal_name)")
    found = search_register(asked, searches, records)
    want = {(k, pos, cin, name) for k in range(n) for pos, cin, name in ((0, "a", "A"), (1, "b", "B"), (1, "b", "B2"), (0, "c", "C")) if pos < k % 3} | {(-1, 0, "b", "B"), (-1, 0, "b", "B2")}
    rows = [tuple(r) for r in found.select("ask_id", "pos", "cin", "legal_name").collect()]
    assert len(rows) == len(want) and set(rows) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = search_register(asked, searches, records).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 0.9 * len(rows)


def test_many_records_of_a_name_are_dealt_out(spark):
    from proofline.sources.companies import search_register

    n, each = 20_000, 12
    asked = spark.range(each).selectExpr("id ask_id", "if(id < 0, 'other', 'Same name') name", f"{n} - id most")
    numbers = spark.range(n).selectExpr("'c' || id cin", "id")
    searches = numbers.groupBy().agg(F.array_sort(F.collect_list(F.struct("id", "cin"))).alias("v")).selectExpr("if(size(v) > 0, 'same NAME', '') legal_name", "v.cin cins")
    found = search_register(asked, searches, numbers.selectExpr("cin", "'N' || id legal_name")).withColumn("task", F.spark_partition_id()).toPandas()
    assert len(found) == sum(n - k for k in range(each)) and len(found.drop_duplicates(["ask_id", "pos"])) == len(found)
    assert (found["cin"] == "c" + found["pos"].astype(str)).all() and (found["legal_name"] == "N" + found["pos"].astype(str)).all()
    sizes = found.groupby("task").size()
    assert len(sizes) > 1 and sizes.max() < 0.9 * len(found)
    # the asks of a record stand together
    assert (found["cin"] != found["cin"].shift()).sum() == n
