import pytest

from proofline.llm.pii import find_pii

CARD = "4111 1111 1111 1111"
CASES = [
    (f"my card {CARD} now", 0.85), (f"{CARD} is my card", 0.85), (f"discarded {CARD} x", 0.6), (f"ORDER {CARD}", 0.4), (f"order paid by card {CARD}", 0.65), (f"x {CARD}", 0.6),
    ("the ship 10.0.0.1", 0.5), ("IP 10.0.0.1", 0.75), ("10.0.0.1 (server)", 0.75), ("version 10.0.0.1", 0.3), ("a hotel +49 30 1234567", 0.5), ("tel. +49 30 1234567", 0.75),
]


def test_whole_words_on_both_sides(spark):
    got = find_pii(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "doc_id long, text string")).orderBy("doc_id").collect()
    for row, (text, score) in zip(got, CASES, strict=True):
        assert [s["score"] for s in row["pii"]] == [pytest.approx(score)], text
