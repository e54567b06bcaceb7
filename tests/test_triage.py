from pyspark.sql import functions as F

from graphloom.operators import quality as Q
from graphloom.operators import triage
from graphloom.workspace import Workspace

from .conftest import rows
from .test_graph import toy

RECORD = "record_id bigint, question string, options array<string>, answer string, reasoning string, direct_edge_ids array<string>"
NODES = [("drug:w", "drug", "warfarin"), ("disease:af", "disease", "atrial fibrillation"), ("drug:i", "drug", "ibu-profen sodium"), ("drug:p", "drug", "prazole acid")]


def test_passes(spark):
    nodes = spark.createDataFrame(NODES, "node_id string, node_type string, node_name string")
    r = [
        (1, "Which tree is tall?", None, "An oak.", "none", ["E777", "E778"]),  # names edges that do not exist, links to no node
        (2, "Which drug?", ["A. warfarin", "B. AF"], "warfarin treats atrial fibrillation", "", []),
        (3, "Does AF heal?", None, "x", "", ["E1"]),  # only the normalized pass knows the abbreviation
        (4, None, None, None, None, None),
    ]
    p = triage.triage_passes(spark.createDataFrame(r, RECORD), nodes, toy(spark), Workspace(spark, "t")).cache()
    got = {(x["sample_id"], x["pass_name"]): (x["success"], x["nodes"], x["labels"]) for x in p.collect()}
    assert len(got) == 12 and all(got[i, n] == (False, 0, 0) for i in (1, 4) for n in ("exact", "normalized", "broad"))
    assert got[2, "exact"][0] and got[2, "exact"][2] >= 2 and got[2, "normalized"][1] >= got[2, "exact"][1]
    assert not got[3, "exact"][0] and got[3, "normalized"][0] and got[3, "normalized"][2] >= 2 and not got[3, "broad"][0]
    assert rows(Q.sample_summary(p).select("sample_id", "bucket")) == [(1, "hard_absent"), (2, "stable_graph"), (3, "threshold_b"), (4, "hard_absent")]


def test_texts(spark):
    df = spark.createDataFrame([(1, "T2DM & pain?\n", ["A) one", "Options:", " 2. two\n- three"])], "record_id bigint, question string, options array<string>")
    t = {x["pass_name"]: x["text"] for x in triage.pass_texts(df).collect()}
    assert t["exact"] == "T2DM & pain?\nOptions:\none\ntwo\nthree" and t["normalized"] == "type 2 diabetes and pain\nOptions:\none\ntwo three"


def test_evidence_of_a_record(spark):
    nodes = spark.createDataFrame(NODES, "node_id string, node_type string, node_name string")
    r = spark.createDataFrame([(1, "Is warfarin given?", None, "warfarin, indication: af", "", []), (2, "Which tree?", None, "", "", ["E1"]), (3, "Why warfarin?", None, "", "", ["E1", "E999"])], RECORD)
    work = Workspace(spark, "t")
    seeds, e = triage.record_evidence(r, nodes, toy(spark), work)
    scores = {(x["k"], x["edge_id"]): x["score"] for x in Q.score_edges_against_text(e, r).collect()}
    assert scores[1, "E1"] >= 3 and (1, "E4") in scores and not any(k == 2 for k, _ in scores)  # record 1 names no edge
    t = {x["k"]: x for x in Q.tiers(triage.record_coverage(r, seeds, e, work), *[F.col("n_evidence"), F.lit("direct"), F.lit("scispacy_umls"), F.lit("edge_node_csv")]).collect()}
    assert t[1]["tier"] == "goldish" and t[1]["n_gold"] >= 1
    assert t[2]["tier"] == "reject" and t[2]["reasons"][0] == "missing_evidence_edges" and t[2]["edge_coverage"] == 0
    assert t[3]["edge_coverage"] == 0.5 and t[3]["missing"] == ["E999"] and t[3]["label_ratio"] == 1.0
