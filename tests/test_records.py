import pytest
from pyspark.sql import functions as F

from graphloom.operators import evaluation as E
from graphloom.operators import records as R
from graphloom.operators import trace as X

from .conftest import rows


def test_fields_by_alias_and_nesting(spark):
    df = spark.createDataFrame(
        [(1, None, {"a": "x ", "b": None}, [" p", "", None, "q"], (" s ", ["t"]), "extra"), (2, " first ", None, None, None, None)],
        "record_id bigint, question string, query map<string,string>, context array<string>, abstract struct<u:string,v:array<string>>, clash string",
    )
    got = df.select("record_id", R.first_text(df, R.QUESTION).alias("q"), R.all_texts(df, R.CONTEXT).alias("c"), R.first_text(df, ["absent"], "-").alias("none")).collect()
    assert [tuple(r) for r in got] == [(1, "x", ["p", "q", "s", "t"], "-"), (2, "first", [], "-")]


def test_normalized_records(spark):
    s = "record_id bigint, group_id string, question string, options array<string>, answer string, reasoning string"
    df = spark.createDataFrame([(1, "g", "Which?", ["a", None], "A", None), (2, " ", "Which?\nOptions: (0) a (1) b", ["a", "b"], None, "r"), (3, None, " ", ["a"], "x", "y"), (4, None, "Q", [], None, None)], s)
    assert rows(R.normalized_records(df)) == [(1, "Which?\nOptions: (0) a (1) ", "A", "A", "g"), (2, "Which?\nOptions: (0) a (1) b", "", "r", "2"), (4, "Q", "", "Q", "4")]
    assert R.normalized_records(df.limit(0)).count() == 0


def test_gold_answers(spark):
    df = spark.createDataFrame([(1, "medqa", "b", ["x", " y "]), (2, "medqa", "1", ["x", "y"]), (3, "medqa", "z", ["x"]), (4, "pubmedqa", "yes", None), (5, None, None, None), (6, "medqa", "12345", ["x"])], "k int, d string, answer string, options array<string>")
    assert rows(df.select("k", R.gold_answer(df, F.col("d"), F.col("answer")))) == [(1, "y"), (2, "y"), (3, "z"), (4, "yes"), (5, ""), (6, "12345")]


def test_ids_selection_and_windows(spark):
    df = spark.createDataFrame([(i, f"d{i % 2}" if i else None, i if i > 1 else None, f"q{i}" if i != 3 else " ", None if i else "sid") for i in range(6)], "record_id bigint, dataset_name string, id_in_dataset bigint, question string, sample_id string")
    assert rows(df.select(R.sample_id(df))) == [("1",), ("d0:2",), ("d0:4",), ("d1:3",), ("d1:5",), ("sid",)]
    ids = lambda d: [r["record_id"] for r in d.collect()]
    assert ids(R.select_record(df, "record_id", index=2)) == [2] and ids(R.select_record(df, "record_id", name="4")) == [4] and ids(R.select_record(df, "record_id")) == [0]
    assert ids(R.select_record(df, "record_id", seed=1)) == ids(R.select_record(df.repartition(3), "record_id", seed=1))
    with pytest.raises(ValueError):
        R.select_record(df, "record_id", index=1, seed=2)
    assert ids(R.window_of_records(df, "record_id", 1, 10, 3)) == [1, 2, 4]
    m = df.withColumn("split", F.lit("x")).withColumn("type", F.lit(None).cast("string"))
    assert m.select(R.sample_metadata(m)).first()[0] == {"split": "x"}


def test_references_types_and_overrides(spark):
    df = spark.createDataFrame([(1, "by edge: E_1, edge_id='E_2' and [edge:a|r|b|0]; knowledge: x edge=E_1."), (2, None)], "k int, t string")
    assert rows(df.select("k", R.edge_references(F.col("t")))) == [(1, ["E_1", "E_2", "a|r|b|0", "x", "E_1."]), (2, [])]
    q = spark.createDataFrame([(1, "DDI", None, "x", None), (2, "odd", "2", "x", None), (3, None, None, "why does it", ["a"]), (4, None, "9", "x", ["what dose"]), (5, None, None, None, None)], "k int, question_type string, puzzle_id string, question string, options array<string>")
    t = R.inferred_type(q, "factoid")
    assert rows(q.select("k", t, R.canonical_type(t))) == [(1, "drug_interaction", "drug_interaction"), (2, "dosage", "dosage"), (3, "etiology", "etiology"), (4, "dosage", "dosage"), (5, "factoid", "other")]
    assert R.parse_overrides(["a= x, y,x", "b=z"]) == {"a": ["x", "y"], "b": ["z"]}
    for bad in ("a", "=x", "a= ,"):
        with pytest.raises(ValueError):
            R.parse_overrides([bad])


def test_payloads_times_hashes(spark):
    df = spark.createDataFrame([(1, 'say {"a": {"b": 1}} done'), (2, "[{}, {}]"), (3, "} {"), (4, None), (5, "{a")], "k int, t string")
    assert rows(df.select("k", R.json_payload(F.col("t")))) == [(1, '{"a": {"b": 1}}'), (2, None), (3, None), (4, None), (5, None)]
    e = spark.createDataFrame([("2024-01-01T00:00:00Z", "2024-01-01T00:00:02.5Z"), ("2024-01-02T00:00:00Z", "2024-01-01T00:00:00Z"), ("x", None)], "a string, b string")
    assert [r[0] for r in e.select(R.elapsed_seconds(F.col("a"), F.col("b"))).collect()] == [2.5, 0.0, 0.0]
    import hashlib

    assert spark.sql("select array('a','b') x").select(R.schema_hash(F.col("x"))).first()[0] == hashlib.sha256(b'["a","b"]').hexdigest()


def test_cache_samples_keys(spark):
    cache = spark.createDataFrame([("Q ", 20, 1, "p"), ("q", 50, 2, "old"), ("q", 50, 3, "new"), ("r", 20, 4, "r1"), ("r", 30, 5, "r2")], "query string, retmax int, line int, value string")
    q = spark.createDataFrame([(1, " Q"), (2, "r"), (3, "s"), (4, None)], "k int, query string")
    assert rows(R.cached_first(q, cache)) == [(1, "exact", "new"), (2, "prefix", "r1")]
    n = spark.createDataFrame([(f"n{i}",) for i in range(200)], "node string")
    got = R.sampled_nodes(n, 10, 3).collect()
    assert len({r["node"] for r in got}) == len(got) and all(sum(r["sample"] == s for r in got) == s % 3 + 1 for s in range(10))
    a, b = (spark.createDataFrame(x, "key string, shape string") for x in ([("a", "1"), ("b", "1"), ("c", None)], [("a", "1"), ("b", "2"), ("d", "1"), ("c", None)]))
    assert rows(R.compared_keys(a, b)) == [("compatible", 2), ("shape_mismatch", 1), ("unexpected", 1)]


def test_evaluation_of_two_questions(spark):
    g = spark.createDataFrame([(1, "q", "yes", ["Warfarin helps. Yes."], ["edge:E1"], None), (2, "q", "no", ["No benefit."], ["E2"], ["no"])], "k int, question string, gold_answer string, context array<string>, gold_edges array<string>, gold_claims array<string>")
    p = spark.createDataFrame([(1, "Yes, it does [edge:E1].", ["edge:E1", "PMID:1"], 0.8, False, 10.0), (2, "no", ["edge:E2", "edge_id:E9"], 0.6, False, 20.0)], "k int, answer_text string, provenance array<string>, confidence double, abstention boolean, latency_ms double")
    r = E.evaluate(p, g).first().asDict()
    assert len(r) == 17 and r["samples"] == 2 and r["exact_match"] == 1 and r["macro_f1"] == 1 and r["abstention_rate"] == 0 and r["mean_provenance_count"] == 2
    assert abs(r["mean_confidence"] - 0.7) < 1e-9 and r["latency_p50_ms"] == 15 and r["reasoning_completeness_score"] == 1 and r["reasoning_necessity_score"] == 1
    assert set(E.evaluate(p, g.limit(0)).first().asDict().values()) == {0.0}


def test_traces(spark):
    st = "array<struct<stage:string,status:string>>"
    df = spark.createDataFrame([(1, [("gold_mapping", "fail"), ("entity_extraction", "fail")], "silver", 2, "partial", None, False), (2, [("x", "ok")], "goldish", 3, None, None, None), (3, [], "silver", 1, "golden", "abstain", False), (4, [("pubmed_retrieval", "fail")], "reject", 1, "", None, None), (5, None, "silver", 0, None, None, None)], f"k int, s {st}, tier string, n int, label string, rec string, h5 boolean")
    df = df.withColumn("failed", X.first_failed(F.coalesce("s", F.array().cast(st))))
    status, stage = X.verdict(F.col("failed"), F.col("tier"), F.col("n"), F.col("label"), F.col("rec"), F.col("h5"))
    assert rows(df.select("k", status, stage)) == [(1, "reject", "entity_extraction"), (2, "golden", None), (3, "reject", "posthoc_audit"), (4, "partial", "pubmed_retrieval"), (5, "reject", "seed_quality")]
    m = spark.createDataFrame([("a", 1, "x", 1, 2.0), ("a", 3, "y", 0, 4.0), ("b", 2, "y", 0, None)], "sample_id string, row_index int, bucket string, error_count int, duration_ms double")
    kept, state = X.rebuilt(m)
    assert rows(kept.select("sample_id", "bucket")) == [("a", "y"), ("b", "y")] and ("all", 2, 0, 2.0) in rows(state)
    left = X.not_yet_done(spark.createDataFrame([(1, "z"), (9, "a"), (9, "z")], "row_index int, sample_id string"), m).collect()
    assert [(r["row_index"], r["sample_id"]) for r in left] == [(9, "z")]
    k = spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "a int, b int")
    assert [r[0] for r in k.select(X.skip_stage(F.col("a"), F.col("b"))).collect()] == ["entity_linking", "retrieval", "edge_mapping"]
