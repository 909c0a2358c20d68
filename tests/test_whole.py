"""Queries and operators do the whole job: no prefix, cap or subset of the rows."""

from pyspark.sql import functions as F

from proofline.operators import matching as M
from proofline.operators import scoring as S
from proofline.plans import matching, queries


def test_name_keys_read_whole_texts(spark, tmp_path):
    rows = [(1, "a" * 80 + " One Pvt"), (2, "a" * 80 + " Two"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    end = " private limited"
    assert dict(map(tuple, queries.QUERIES["whole_name_keys"](spark, str(tmp_path)).collect())) == {1: "a" * 80 + " one private" + end, 2: "a" * 80 + " two" + end, 3: None, 4: end.strip()}


def test_positions_keep_all_members(spark):
    rows = [(1 if k % 3 else k % 5, (k * 7919) % 3001) for k in range(3000)] + [(None, 5), (None, 4), (2, None)]
    want = {}
    for key, place in rows:
        want.setdefault(key, []).append(place)
    want = {k: sorted(v, key=lambda p: -1 if p is None else p) for k, v in want.items()}
    assert max(map(len, want.values())) > 2000
    for blocks in (1, 8):
        found = {}
        for key, n, value in sorted(M.positions(spark.createDataFrame(rows, "k long, p long"), "k", "p", "p", blocks).collect(), key=lambda r: r["position"]):
            found.setdefault(key, []).append(value)
            assert n == len(found[key])
        assert found == want


def test_no_row_is_left_out_by_id(spark, tmp_path):
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    save([(k, k // 2, "OPFO"[k % 4], "p", k) for k in range(1, 12)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate long", "orders")
    save([(3, "c3"), (9, "c9")], "c_custkey long, c_name string", "customer")
    save([(3, "s3"), (4, "s4")], "s_suppkey long, s_name string", "supplier")
    run = lambda f: sorted(map(tuple, f(spark, str(tmp_path)).collect()))
    assert run(matching.QUERIES["open_order_duplicates"]) == [(2, 2), (4, 2)]
    assert run(queries.QUERIES["open_order_heads"]) == [("p", 3, 5)]
    assert run(queries.QUERIES["whole_upsert"]) == [("cin:3", "c3"), ("cin:4", "s4"), ("cin:9", "c9")]


def test_candidate_scores_read_lineitems(spark):
    sf = "/root/testdata/sf0.001"
    scored = queries.QUERIES["candidate_scores"](spark, sf)
    assert any("lineitem" in f for f in scored.inputFiles()) and scored.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_scores_of_all_facts(spark):
    names = list(S.WEIGHTS)
    facts = spark.range(1 << len(names)).select("id", *[(F.col("id").bitwiseAND(1 << k) != 0).alias(n) for k, n in enumerate(names)])
    for r in S.score(facts).collect():
        held = [S.WEIGHTS[n] for n in names if r[n]]
        assert (r["positive_total"], r["negative_total"], r["score"]) == (sum(w for w in held if w > 0), sum(w for w in held if w < 0), min(100, max(0, sum(held))))
