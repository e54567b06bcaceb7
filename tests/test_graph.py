from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.workspace import Workspace

from .conftest import rows

COLS = "row_index bigint, edge_id string, head string, tail string, relation string, display_relation string, source_reliability double, amg_confidence double, supporting_pmids array<string>, source string"


def toy(spark):
    e = [
        (1, "E1", "Drug:W", "disease:af", "indication", "indication", None, 0.9, ["1"], "drugbank"),
        (2, "edge:E2", "drug:w", "drug:i", "drug_drug", "", 0.9, None, ["PMID:2"], None),
        (3, "E3", "drug:i", "disease:b", "contraindication", "contraindication", 0.9, 0.9, None, "x"),
        (4, "E4", "disease:af", "disease:s", "disease_disease", "d", 0.5, 1.0, [], "primekg"),
        (5, "E1", "drug:w", "disease:af", "indication", "indication", 0.95, 0.8, ["1", "9"], "drugbank"),
        (6, "E5", " ", "disease:s", "indication", "x", 0.5, 1.0, [], "x"),
    ]
    return G.graph_edges(spark.createDataFrame(e, COLS))


def test_edges(spark):
    e = {r["edge_id"]: r for r in toy(spark).collect()}
    assert set(e) == {"E1", "E2", "E3", "E4"} and e["E1"]["confidence"] == 0.8 and e["E1"]["pmids"] == ["1", "9"]
    assert e["E2"]["reliability"] == 0.9 and e["E2"]["confidence"] == 1.0


def test_expansion_and_routing(spark):
    e = toy(spark)
    seeds = spark.createDataFrame([(1, "drug:w"), (2, "disease:s")], "k int, node string")
    assert rows(G.expand(seeds, G.incidence(e))) == [(1, "E1", 1), (1, "E2", 1), (1, "E3", 2), (1, "E4", 2), (2, "E1", 2), (2, "E4", 1)]
    q = spark.createDataFrame([(1, "what dose?"), (2, "why does it happen, mechanism?")], "k int, text string")
    found, stages = G.routed_expansion(q, seeds, e, Workspace(spark, "t"))
    assert rows(stages.select("k", "stage")) == [(1, "none"), (2, "compact_fallback")]
    assert rows(found) == [(1, "E1", 1), (2, "E1", 2), (2, "E4", 1)]
    assert rows(G.candidate_path_counts(seeds, G.incidence(e))) == [(1, 4), (2, 2)]


def test_pagerank_against_a_direct_computation(spark):
    import numpy as np

    w = spark.createDataFrame([(1, "a", "b", 2), (1, "b", "c", 1), (1, "a", "c", 1), (1, "d", "a", 1)], "k int, head string, tail string, weight bigint")
    seeds = spark.createDataFrame([(1, "a"), (1, "zz")], "k int, node string")
    got = {r["node"]: r["score"] for r in G.pagerank(w, seeds, Workspace(spark, "t")).collect()}
    n = "abcd"
    m = np.zeros((4, 4))
    for h, t, x in (("a", "b", 2 / 3), ("b", "c", 1), ("a", "c", 1 / 3), ("d", "a", 1)):
        m[n.index(t), n.index(h)] = x
    p, s = np.array([1.0, 0, 0, 0]), np.full(4, 0.25)
    while True:  # until the summed change is below nodes x tolerance
        last, s = s, 0.85 * (m @ s + s[2] * p) + 0.15 * p
        if np.abs(s - last).sum() < 4 * 1e-6:
            break
    assert all(abs(got[c] - s[i]) < 1e-12 for i, c in enumerate(n))


def test_links(spark):
    q = spark.createDataFrame([(1, "Does warfarin help atrial fibrillation?"), (2, None)], "k int, text string")
    n = spark.createDataFrame([("drug:w", "drug", "Warfarin"), ("drug:x", "drug", "warfarin"), ("disease:af", "disease", "atrial fibrillation")], "node_id string, node_type string, node_name string")
    assert rows(G.link_entities(q, n, G.node_degrees(toy(spark))).select("k", "phrase", "node")) == [(1, "atrial fibrillation", "disease:af"), (1, "warfarin", "drug:w")]


def test_links_of_long_names(spark):
    name = "postural dry corvial cough in the early morning hours"
    q = spark.createDataFrame([(1, f"Why a {name}?"), (2, "postural dry corvial cough")], "k int, text string")
    n = spark.createDataFrame([("symptom:p", "symptom", name), ("symptom:c", "symptom", "cough")], "node_id string, node_type string, node_name string")
    assert rows(G.link_entities(q, n, G.node_degrees(toy(spark))).select("k", "phrase", "node")) == [(1, "cough", "symptom:c"), (1, name, "symptom:p"), (2, "cough", "symptom:c")]
    assert G.link_entities(q, n.limit(0), G.node_degrees(toy(spark))).count() == 0


def test_top_edges_breaks_ties_by_id(spark):
    e = toy(spark)
    seeds = spark.createDataFrame([(1, "drug:w")], "k int, node string")
    found = G.expand(seeds, G.incidence(e))
    none = spark.createDataFrame([], "k int, node string, score double")
    top = G.top_edges(found, e, none, seeds, 2)
    assert [(r["edge_id"], r["rank"]) for r in top.orderBy("rank").collect()] == [("E1", 1), ("E2", 2)]
    assert top.where(F.col("score").isNull()).count() == 0


def test_broad_match(spark):
    n = spark.createDataFrame([("d:1", "acute heart failure"), ("d:2", "heart failure"), ("d:3", "liver"), (None, "heart")], "node_id string, node_name string")
    e = spark.createDataFrame([("Heart-Failure",), ("failing heart",), ("zz",), (None,), ("heart failure",)], "surface string")
    deg = spark.createDataFrame([("d:1", 100)], "node string, degree bigint")
    assert rows(G.broad_match(e, n, deg).select("surface", "node", "score")) == [("failing heart", "d:1", 3.5), ("heart failure", "d:2", 135.0)]
    assert G.broad_match(e.limit(0), n, deg).count() == 0


def test_rank_by_task_and_by_joins_agree(spark, monkeypatch):
    import random

    r = random.Random(3)
    edges = [(k, f"n{r.randrange(12)}", f"n{r.randrange(12)}", float(r.randrange(1, 4))) for k in range(4) for _ in range(25)]
    w = spark.createDataFrame([(k, h, t, x) for k, h, t, x in edges], "k bigint, head string, tail string, weight double").groupBy("k", "head", "tail").sum("weight").withColumnRenamed("sum(weight)", "weight")
    seeds = spark.createDataFrame([(0, "n1"), (0, "n2"), (1, "absent"), (2, "n0")], "k bigint, node string")
    one = {(x["k"], x["node"]): x["score"] for x in G.pagerank(w, seeds, Workspace(spark, "t")).collect()}
    monkeypatch.setattr(G, "SOLVED_AT_ONCE", 0)
    two = {(x["k"], x["node"]): x["score"] for x in G.pagerank(w, seeds, Workspace(spark, "t")).collect()}
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-9
    for k in range(4):
        assert abs(sum(v for (q, _), v in one.items() if q == k) - 1) < 1e-6
    # a fixed point, to the tolerance
    ws = [tuple(x) for x in w.where("k = 0").collect()]
    out = {}
    for _, h, _, x in ws:
        out[h] = out.get(h, 0) + x
    nodes = {n for (q, n) in one if q == 0}
    lost = sum(one[0, n] for n in nodes if n not in out)
    restart = {n: (0.5 if n in ("n1", "n2") else 0.0) for n in nodes}
    for n in nodes:
        want = 0.85 * (sum(one[0, h] * x / out[h] for _, h, t, x in ws if t == n) + lost * restart[n]) + 0.15 * restart[n]
        assert abs(want - one[0, n]) < 2e-5
    assert G.pagerank(w.limit(0), seeds, Workspace(spark, "t")).count() == 0
