"""Account numbers among other text."""

from pyspark.sql import functions as F

from proofline.llm import pii


def test_account_numbers_before_capitals_and_digits(spark):
    de, spaced, gb, other = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "ZZ33 1234 5678 9012 345"
    cases = {
        f"{de} Please": [de], f"{spaced} BIC COBADEFF": [spaced], f"{spaced} {gb} {de} 12": [spaced, gb, de], f"AT12 {spaced} 7": [spaced],
        f"{other} OK 1": [other], f"{other[:-1]}4 OK 1": [], f"{de}PLEASE": [], f"{de}x {gb}": [gb], f"\U0001d4b3 {de} \U0001d4b3": [de], f"{other}b": [],
        f"(NO9386011117947) MT84MALT011000012345MTLCAST001S A": ["NO9386011117947", "MT84MALT011000012345MTLCAST001S"],
    }
    found = pii.find_pii(spark.createDataFrame([(t,) for t in cases], "text string")).select("text", F.filter("pii", lambda s: s["kind"] == "iban")).collect()
    for text, spans in found:
        assert [s["value"] for s in spans] == cases[text], text
        assert all(text[s["start"] : s["end"]] == s["value"] for s in spans)
