import math

from pyspark.sql import functions as F

from graphloom.operators import grounding as Gr
from graphloom.operators import metrics, quality, reasoning, retrieval
from graphloom.workspace import Workspace

from .conftest import rows


def evidence(spark):
    e = spark.createDataFrame([(1, 0, "E1", "drug:warfarin", "disease:bleeding", "contraindication", "contraindication")], "k int, pos int, edge_id string, head string, tail string, relation string, display_relation string")
    p = spark.createDataFrame([(1, 5, "12", "Warfarin", "Warfarin is effective against stroke.")], "k int, pos bigint, pmid string, title string, abstract string")
    return Gr.evidence_of(e, p)


def test_grounding(spark):
    c = spark.createDataFrame([(1, 0, "Warfarin is effective against stroke"), (1, 1, "Bananas grow slowly"), (1, 2, "Stroke [PMID:99]"), (2, 0, "Nothing here")], "k int, claim_pos int, claim string")
    v = Gr.ground_claims(c, evidence(spark))
    got = {(r["k"], r["claim_pos"]): (r["verdict"], r["evidence_id"]) for r in v.collect()}
    assert got == {(1, 0): ("supported", "PMID:12"), (1, 1): ("unsupported", "none"), (1, 2): ("unsupported", "none"), (2, 0): ("unsupported", "none")}
    r = {x["k"]: x for x in Gr.grounding_rollup(spark.createDataFrame([(1,), (2,), (3,)], "k int"), v).collect()}
    assert r[3]["faithfulness"] == 0 and r[3]["recommendation"] == "ACCEPT" and r[1]["n_supported"] == 1
    q = spark.createDataFrame([(1, "Which?"), (2, "Why?"), (3, None)], "k int, text string")
    a = {x["k"]: x["label"] for x in Gr.audit_rollup(q, Gr.audit_claims(c, evidence(spark), q), evidence(spark)).collect()}
    assert a == {1: "partial", 2: "partial", 3: "partial"}


def test_bm25_against_a_direct_computation(spark):
    docs = {1: "warfarin prevents stroke", 2: "warfarin warfarin bleeding risk", 3: "diet"}
    q = spark.createDataFrame([(7, "warfarin stroke")], "k int, text string")
    got = {r["doc"]: r["bm25"] for r in retrieval.bm25(q, spark.createDataFrame([(7, i, t) for i, t in docs.items()], "k int, doc int, text string")).collect()}
    toks = {i: t.split() for i, t in docs.items()}
    n, mean = 3, sum(map(len, toks.values())) / 3
    terms = {w for t in toks.values() for w in t}
    idf = {w: math.log(n - sum(w in t for t in toks.values()) + 0.5) - math.log(sum(w in t for t in toks.values()) + 0.5) for w in terms}
    avg = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * avg if x < 0 else x for w, x in idf.items()}
    for i, t in toks.items():
        want = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in ("warfarin", "stroke") if w in t)
        assert abs(got[i] - want) < 1e-9


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = retrieval.nearest_vectors(v, v.where("vec_id in (0, 3)"), 1)
    assert [(r["query_id"], r["vec_id"]) for r in got.collect()] == [(0, 1)]
    book = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "code_id int, vec array<double>")
    assert rows(retrieval.quantize(v, book).select("vec_id", "code_id")) == [(0, 7), (1, 7), (2, 8), (4, 7)]
    assert sum(r["n"] for r in retrieval.code_usage(retrieval.quantize(v, book), book).collect()) == 4
    assert retrieval.nearest_vectors(v.limit(0), v.limit(0), 3).count() == 0


def test_metrics(spark):
    x = spark.createDataFrame([("yes", "yes"), ("no", "no"), ("maybe", "maybe"), ("yes", "no")], "p string, g string")
    assert abs(metrics.macro_f1(x, "p", "g").first()[0] - 0.7777777777777777) < 1e-12
    assert metrics.macro_f1(x.limit(0), "p", "g").first()[0] == 0
    m = spark.createDataFrame([(True, True)] * 830 + [(False, True)] * 30 + [(True, False)] * 5, "a boolean, b boolean")
    r = metrics.mcnemar(m, "a", "b").first()
    assert r["only_b"] == 30 and r["p_value"] < 0.05
    b = metrics.bootstrap_mean(spark.range(400).select(F.col("id").alias("row_key"), (F.col("id") % 10).alias("v")), "v").first()
    assert b["low"] < 4.5 < b["high"] and 0.3 < b["high"] - b["low"] < 0.9
    s = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], []), ([], ["a"])], "p array<string>, g array<string>")
    got = s.select(*[c.alias(n) for c, n in zip(metrics.set_scores(F.col("p"), F.col("g")), "xyz")]).collect()
    assert [(round(r["x"], 4), r["y"]) for r in got] == [(0.3333, 0.5), (1.0, 1.0), (0.0, 0.0)]


def test_paths(spark):
    e = "array<struct<head:string,tail:string>>"
    df = spark.createDataFrame([([("a", "b"), ("b", "c")],), ([("b", "a"), ("b", "c")],), ([("a", "b")],), ([],), ([("a", "b"), ("x", "y")],)], f"e {e}")
    assert [r["p"] for r in df.select(quality.node_path(F.col("e")).alias("p")).collect()] == [["a", "b", "c"], ["a", "b", "c"], ["a", "b"], [], ["a", "b", "x", "y"]]
    w = spark.createDataFrame([([0.9, 0.9, 0.3, 0.9],), ([0.5, 0.5],), ([],)], "w array<double>")
    assert [round(r["c"], 6) for r in w.select(reasoning.path_confidence(F.col("w")).alias("c")).collect()] == [0.177147, 0.25, 0.0]


def test_decoding(spark):
    scores = spark.createDataFrame([(1, n, s) for n, s in (("w", 0.9), ("af", 0.8), ("i", 0.7), ("b", 0.6))], "k int, node string, score double")
    edges = spark.createDataFrame([(1, "E1", "w", "af", 0.9, 0.9), (1, "E2", "w", "i", 0.9, 0.3), (1, "E3", "i", "b", 0.9, 0.9), (1, "E4", "b", "w", 0.9, 0.9)], "k int, edge_id string, head string, tail string, reliability double, confidence double")
    got = reasoning.decode_paths(scores, edges, Workspace(spark, "t")).orderBy("rank").collect()
    assert len(got) == 5 and all(len(set(r["nodes"])) == len(r["nodes"]) == len(r["edges"]) + 1 for r in got)
    assert len(got[0]["edges"]) == 3


def test_provenance(spark):
    df = spark.createDataFrame([("Good one [edge:E1]. Bad one [PMID:9]. None here.", ["edge:E1"])], "a string, t array<string>")
    assert df.select(reasoning.enforce_provenance(F.col("a"), F.col("t")).alias("x")).first()["x"] == "Good one [edge:E1]."


def test_buckets(spark):
    cases = [(3, 3, 4, 2, None, "stable_graph"), (2, 3, 3, 0, None, "threshold_a"), (1, 3, 1, 0, None, "threshold_b"), (0, 3, 0, 0, None, "hard_absent"), (0, 3, 0, 0, True, "threshold_b"), (0, 3, 0, 0, False, "hard_absent")]
    df = spark.createDataFrame(cases, "s int, p int, n int, l int, e boolean, want string")
    assert all(r["b"] == r["want"] for r in df.withColumn("b", quality.bucket(*[F.col(c) for c in "spnle"])).collect())
    man = spark.createDataFrame([("a", "stable_graph"), ("a", "stable_graph"), ("b", "odd")], "sample_id string, bucket string")
    assert {r["bucket"]: r["ok"] for r in quality.output_checks(man, man).collect()} == {"stable_graph": False, "odd": False}


def test_contradiction_by_polarity(spark):
    from graphloom.operators import reasoning as R

    e = spark.createDataFrame(
        [(1, "E1", "drug:warfarin", "disease:af", "indication", "indication"), (2, "E3", "drug:ibuprofen", "disease:bleeding", "contraindication", "contraindication"), (3, "E4", "drug:x", "disease:y", "drug_effect", "Contra effect"), (4, "E1", "drug:warfarin", "disease:af", "indication", "indication")],
        "k int, edge_id string, head string, tail string, relation string, display_relation string",
    )
    p = spark.createDataFrame(
        [(1, "w", "Warfarin is not effective and not recommended."), (2, "i", "Ibuprofen is seen with bleeding."), (3, "z", None), (3, "y", "X does not matter to y.")],
        "k int, title string, abstract string",
    )
    got = {r["k"]: r["contradiction"] for r in R.contradiction_scores(e, p).collect()}
    # mixed cues against a positive edge; no cue against a negative one; contra in the display relation agrees; no passage
    assert got == {1: 0.8, 2: 0.35, 3: 0.0, 4: 0.0}


def test_faithfulness_with_abbreviations_and_contradictions(spark):
    from graphloom.operators import metrics as M

    rows_ = [
        (1, "AF requires anticoagulation.", ["Atrial fibrillation needs anticoagulation therapy."]), (2, "Drug unsafe in pregnancy.", ["Drug safe in pregnancy."]), (3, "Warfarin dose is 5.1 mg/day for AF.", ["In atrial fibrillation (AF) the warfarin dose is 5 mg/day."]),
        (4, None, ["x"]), (5, "A claim.", None), (6, "The ZQ helps.", ["Zonal quirk (ZQ) helps."]), (7, "!!", ["x"]),
    ]
    got = {r["k"]: r["faithfulness"] for r in M.faithfulness(spark.createDataFrame(rows_, "k int, a string, c array<string>"), "a", "c").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0, 4: 1.0, 5: 0.0, 6: 1.0, 7: 0.0}


def test_bm25_by_task_and_by_joins(spark, monkeypatch):
    import random

    from graphloom.operators import retrieval as R

    r = random.Random(1)
    q = spark.createDataFrame([(k, " ".join(r.choice("abcde") + "x" for _ in range(4)) if k else None) for k in range(6)], "k int, text string")
    c = spark.createDataFrame([(k, f"d{i}", None if i == 3 else " ".join(r.choice("abcdefgh") + "X" for _ in range(r.randrange(12)))) for k in range(1, 7) for i in range(k + 1)] + [(0, "only", "")], "k int, doc string, text string")
    one = {(x["k"], x["doc"]): x["bm25"] for x in R.bm25(q, c).collect()}
    monkeypatch.setattr(R, "CORPUS_AT_ONCE", 2)
    two = {(x["k"], x["doc"]): x["bm25"] for x in R.bm25(q, c).collect()}
    assert one.keys() == two.keys() and len(one) == c.count() and max(abs(one[x] - two[x]) for x in one) < 1e-9 and max(one.values()) > 0
    assert R.bm25(q, c.limit(0)).count() == 0


def test_nearest_vectors_in_blocks(spark):
    from graphloom.operators import retrieval as R

    v = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(60)] + [(99, None), (98, [0.0, 0.0, 0.0])], "vec_id bigint, embedding array<float>")
    q = v.where("vec_id % 3 = 0")
    assert rows(R.nearest_vectors(v, q, 4)) == rows(R.nearest_vectors(v, q, 4, block=5)) and R.nearest_vectors(v, q.limit(0), 4).count() == 0


def test_cosine_and_running_counts(spark):
    from graphloom.operators import retrieval as R
    from graphloom.streaming import events as E

    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([2.0, 2.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in v.select(R.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 1.0]
    assert rows(E.bucket_counts(spark.createDataFrame([("x",), ("x",), (None,)], "bucket string"))) == [("x", 2), (None, 1)]


def test_run_config(spark, tmp_path):
    import pytest

    from graphloom.streaming import events as E

    E.check_run(spark, str(tmp_path), {"a": 1})
    E.check_run(spark, str(tmp_path), {"a": 1})
    with pytest.raises(ValueError):
        E.check_run(spark, str(tmp_path), {"a": 2})


def test_scores_of_claims_and_steps(spark):
    from graphloom.functions import text as T

    x = spark.createDataFrame([("Drug is safe.", "Drug is harmful.", ["s ", "", None]), ("Dose 5 mg.", "Dose 50 mg.", None), ("a b", None, None)], "c string, t string, s array<string>")
    got = x.select(metrics.contradiction_score(F.col("c"), F.col("t")), metrics.entailment_score(F.col("c"), F.col("t")), T.audit_claims_of(F.col("c"), F.col("s"))).collect()
    assert [r[0] for r in got] == [0.8, 0.7, 0.0] and got[0][1] == 0.5 and got[0][2] == ["Drug is safe.", "s"]
    assert spark.sql("select 'x [edge_id:E1] [PMID:2] [edge:E1]' t").select(T.answer_tags(F.col("t"))).first()[0] == ["edge:E1", "PMID:2"]
