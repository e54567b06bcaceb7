from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.keys import edge_id, key, pmid


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_keys(spark):
    assert one(spark, " A ", key) == "a" and one(spark, " \t", key) is None and one(spark, None, key) is None
    assert one(spark, "PMID: 12 ", pmid) == "12" and one(spark, "PMC12", pmid) is None
    assert one(spark, " edge_id:E_1", edge_id) == "E_1" and one(spark, "edge:", edge_id) is None


def test_claims_and_answers(spark):
    assert one(spark, "A b [edge:E1]. C  d!\n\nE.", T.claims) == ["A b", "C d!", "E"]
    assert one(spark, None, T.claims) == []
    assert one(spark, "Direct answer: Yes, 5.1 mg/day [PMID:1].", T.answer) == "yes 5.1 mg/day"
    assert one(spark, "Correct.", T.label) == "yes" and one(spark, "unlikely", T.label) == "unlikely"
    assert one(spark, "It may be. No!", T.decision) == "no" and one(spark, "nothing", T.decision) == "nothing"


def test_numbers(spark):
    got = one(spark, "5.1 mg/day, 12% of 3x and 7 L", T.numbers)
    assert [(r["value"], r["unit"]) for r in got] == [(5.1, "mg"), (12.0, ""), (7.0, "l")]
    df = spark.createDataFrame([("5 mg", "5.2 mg"), ("5 mg", "9 mg"), ("5 mg", "9 kg")], "a string, b string")
    x = df.select(T.numeric_compatible(T.numbers(F.col("a")), T.numbers(F.col("b"))).alias("c"), T.numeric_conflict(T.numbers(F.col("a")), T.numbers(F.col("b"))).alias("d")).collect()
    assert [(r["c"], r["d"]) for r in x] == [(True, False), (False, True), (False, False)]


def test_references_and_types(spark):
    assert one(spark, "see [edge:E1]. PMID:12, edge_id:E2;", T.evidence_refs) == ["edge:E1", "PMID:12", "edge:E2"]
    for raw, want in ((" pmid:12 ", "PMID:12"), (" EDGE:E1 ", "edge:E1"), ("N/A", "none"), ("edgeE123", "edgeE123"), ("edge_id:E9", "edge:E9")):
        assert one(spark, raw, T.evidence_id) == want
    assert one(spark, "What dose of warfarin?", T.question_type) == "dosage"
    assert one(spark, "Avoid in children", T.claim_type) == "life_critical"
    assert one(spark, "Warfarin reduces clots, and heat causes rash", T.triples) == ["warfarin|reduces|clots", "and heat|causes|rash"]


def test_phrases(spark):
    assert one(spark, "the heart failure of man", T.phrases) == ["failure of man", "heart failure", "heart", "failure", "man"]
    assert one(spark, "", T.phrases) == []
