"""Texts with repeated passages give rows, and null texts do."""

from proofline.plans import matching


def test_repeated_passages_give_a_row(spark, tmp_path):
    rows = [(1, 1, "a. b. a .c"), (1, 2, None), (2, 1, ""), (2, 2, "x.x.x.x.x.y")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = matching.QUERIES["all_passage_highlights"](spark, str(tmp_path)).collect()
    assert {(r["conv_id"], r["turn"]): r["passages"] for r in found} == {(1, 1): "a|b|c", (1, 2): None, (2, 1): "", (2, 2): "x"}
