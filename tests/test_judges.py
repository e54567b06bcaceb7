from pyspark.sql import functions as F

from graphloom.operators import features as V
from graphloom.operators import grounding as G
from graphloom.operators import judges as J
from graphloom.operators import labels as L
from graphloom.operators import quality as Q
from graphloom.workspace import Workspace

from .conftest import rows


def test_entities(spark):
    q = spark.createDataFrame([(1, "Does warfarin help AF?"), (2, "x"), (3, None)], "k int, text string")
    e = spark.createDataFrame([(1, "warfarin", "C0043031", "drug:warfarin"), (1, "AF", None, "disease:af"), (1, "stroke", "C0000000", "disease:"), (2, "x", "C0043031", "drug:x")], "k int, surface string, cui string, node string")
    got = {r["k"]: r for r in J.validate_entities(q, e).collect()}
    assert got[1]["missing"] == ["AF"] and got[1]["mislinked"] == ["stroke: invalid concept C0000000", "stroke: invalid node disease:", "stroke: surface not in the question"]
    assert abs(got[1]["confidence"] - (1 - 4 / 6)) < 1e-9 and not got[1]["valid"] and got[2]["valid"] and got[2]["confidence"] == 1 and not got[3]["valid"] and got[3]["confidence"] == 1


EDGES = "k int, edge_id string, head string, tail string, relation string, display_relation string"


def test_soundness_claims(spark):
    q = spark.createDataFrame([(1, "How does it work?"), (2, "What is it?"), (3, "x")], "k int, text string")
    p = spark.createDataFrame([(1, 1, ["a:1", "a:2"], ["E1"], 0.9), (1, 2, ["a:2"], [], 0.5), (2, 1, ["a:1", "a:3"], ["E2"], 0.8)], "k int, rank int, nodes array<string>, edges array<string>, confidence double")
    e = spark.createDataFrame([(1, "E1", "a:1", "a:2", "indication", "Treats"), (2, "E2", "a:1", "a:3", "contraindication", "x")], EDGES)
    flag = spark.createDataFrame([(2, True)], "k int, flag boolean")
    ent = spark.createDataFrame([(1, "a:1"), (1, "a:9"), (2, None)], "k int, node string")
    got = {r["k"]: r for r in J.path_soundness(q, p, e, flag, ent).collect()}
    assert got[1]["gaps"] == ["path_skips_a_step"] and abs(got[1]["rcs"] - 0.7) < 1e-9 and got[1]["rns"] == 0.5 and got[1]["cdr"] == 1 and not got[1]["sound"]
    assert got[2]["gaps"] == ["contradiction_flag", "path_crosses_conflicting_relations"] and got[2]["cdr"] == 0 and got[2]["rns"] == 1
    assert got[3]["gaps"] == ["no_path"] and got[3]["rcs"] == 0 and got[3]["rns"] == 0
    assert rows(J.path_claims(q, p, e)) == [(1, ["1 treats 2."]), (2, ["1 x 3."]), (3, ["Retrieved evidence is relevant to x."])]


def test_revision_ends(spark):
    ed = spark.createDataFrame([(1, 0, "E1", "drug:warfarin", "disease:stroke", "indication", "prevents")], "k int, pos int, edge_id string, head string, tail string, relation string, display_relation string")
    ev = G.evidence_of(ed, spark.createDataFrame([], "k int, pos int, pmid string, title string, abstract string"))
    a = spark.createDataFrame([(1, "Warfarin prevents stroke. Bananas sing loudly."), (2, "Nothing known.")], "k int, answer string")
    got = {r["k"]: (r["answer"], r["rounds"]) for r in J.revise(a, ev, Workspace(spark, "t")).collect()}
    assert got == {1: ("Warfarin prevents stroke. [edge:E1]", 1), 2: ("Nothing known.", 0)}
    c = spark.createDataFrame([(1, 0, "A edge:E1", "supported", "edge:E1"), (1, 1, "B", "supported", "PMID:2"), (1, 2, "C", "contradicted", "PMID:2")], "k int, claim_pos int, claim string, verdict string, evidence_id string")
    assert rows(J.revised_answers(a, c)) == [(1, "A edge:E1 B [PMID:2]"), (2, "Nothing known.")]


def test_small_judges(spark):
    r = spark.createDataFrame([(4, 3), (0, 0)], "a int, s int")
    assert J.parse_success(r, "a", "s").first()[0] == 0.75 and J.parse_success(r.limit(0), "a", "s").first()[0] == 1.0
    o = spark.createDataFrame([(1, 2, "x"), (1, 1, "x"), (1, 3, "y")], "k int, pos int, v string")
    assert rows(J.outputs_once(o, "k", "pos")) == [(1, 1, "x"), (1, 3, "y")]
    e = spark.createDataFrame([(1, "fine", 0.5, None), (2, None, 0.9, "timeout")], "k int, answer string, confidence double, err string")
    assert rows(J.emergency(e, F.col("err")).select("k", "confidence", "abstention")) == [(1, 0.5, False), (2, 0.0, True)]
    p = spark.createDataFrame([(1, "a bb cc", "bb dd"), (2, None, None)], "k int, p string, h string")
    assert rows(J.model_scores(p, "p", "h", J.overlap_model).select("k", "label", "score")) == [(1, "entailment", 0.5), (2, "neutral", 0.0)]
    odd = lambda a, b: [{"label": "Contradicts", "confidence": 0.9}, ("SUPPORTED", 0.7)][: len(a)]
    assert rows(J.model_scores(p.coalesce(1), "p", "h", odd).select("k", "label")) == [(1, "contradiction"), (2, "entailment")] and J.model_scores(p, "p", "h", None).where("label is null").count() == 2


def test_audit_rules(spark):
    claims = spark.createDataFrame([(1, 0, "Warfarin prevents stroke [edge:E1]."), (1, 1, "It is said [PMID:99]."), (2, 0, "??"), (3, 0, "The dose is fine."), (4, 0, "Warfarin prevents stroke")], "k int, claim_pos int, claim string")
    ed = spark.createDataFrame([(k, 0, "E1", "drug:warfarin", "disease:stroke", "indication", "prevents") for k in (1, 2, 4)], "k int, pos int, edge_id string, head string, tail string, relation string, display_relation string")
    ev = G.evidence_of(ed, spark.createDataFrame([], "k int, pos int, pmid string, title string, abstract string"))
    q = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x"), (5, "What dose?")], "k int, text string")
    a = G.audit_claims(claims, ev, q)
    got = {(r["k"], r["claim_pos"]): (r["verdict"], r["evidence_id"], r["severity"], r["unknown"]) for r in a.collect()}
    assert got == {(1, 0): ("supported", "edge:E1", 0, []), (1, 1): ("unsupported", "none", 2, ["PMID:99"]), (2, 0): ("out_of_scope", "none", 0, []), (3, 0): ("unsupported", "none", 3, []), (4, 0): ("supported", "edge:E1", 0, [])}
    r = {x["k"]: (x["faithfulness"], x["gaps"], x["label"]) for x in G.audit_rollup(q, a, ev).collect()}
    assert r[1] == (0.4, ["unknown_references", "unsupported_claims"], "partial") and r[3] == (0.0, ["no_evidence", "unsupported_claims"], "reject") and r[4] == (1.0, [], "golden") and r[5] == (0.0, ["no_evidence", "no_claims"], "partial")


def test_labels_of_gold_paths(spark):
    items = spark.createDataFrame([(1, p, n, t) for p, (n, t) in enumerate([("CYP2C9", 103), ("warfarin", 101), ("metronidazole", 102), ("clarithromycin", 104)])] + [(1, 4, "PMID:1", 7), (1, 5, "__pad__", 4095), (1, 6, "warfarin", 999)], "k int, pos int, item string, token bigint")
    paths = spark.createDataFrame([(1, ["warfarin", "metronidazole", "CYP2C9", "absent"])], "k int, path array<string>")
    r = L.path_labels(paths, items).first()
    assert r["labels"][:4] == [101, 102, 103, -100] and len(r["labels"]) == 256 and r["source_positions"] == [1, 2, 0] and r["labelled"] == 3 and r["missing"] == ["absent"]
    assert L.path_labels(paths.limit(0), items).count() == 0
    row = L.token_rows(items, 4095).first()
    assert len(row["inputs"]) == 256 and row["inputs"][6:9] == [999, 4095, 4095] and row["items"][255] == "__pad__"
    assert rows(L.token_types(items)) == [(1, 5, 1, 1, 0)]
    cut = {x["pos"]: (x["item"], x["token"]) for x in L.reduced_tokens(items, 2, 4095).collect()}
    assert cut[1] == ("warfarin", 101) and cut[2] == ("__pad__", 4095) and cut[6][0] == "__pad__"
    acc = spark.createDataFrame([([1, 2, 3], [1, -100, 4]), ([1], [-100])], "predicted array<bigint>, labels array<bigint>")
    assert tuple(L.accuracies(acc).first()) == (0.5, 0.5, 2)
    assert tuple(L.label_stats(acc.withColumn("puzzle_id", F.lit(3))).first()) == (2, 2, 1.0, [3])
    g = spark.createDataFrame([(3, 2, 1, 2, 2), (0, 0, 0, 0, 0)], "n_edges int, n_nodes int, n_passages int, n_gold int, labelled int")
    s = L.graph_stats(g).first()
    assert (s["examples_saved"], s["examples_skipped"], s["reject_rate"], s["mean_labelled_count"]) == (1, 1, 0.5, 2.0)


def test_tiers_by_fixture(spark):
    """The rows of the seed-quality fixture: covered, silver by backend, by coverage, and the causes of rejection."""
    s = "k int, n_gold bigint, n_covered bigint, missing array<string>, path array<string>"
    c = spark.createDataFrame([(1, 2, 2, [], ["a", "b", "c"]), (2, 1, 1, [], ["a", "b"]), (3, 2, 1, ["E2"], ["a", "b"]), (4, 1, 0, ["E_9"], []), (5, 1, 1, [], ["g", "h"]), (6, 0, 0, [], [])], s)
    sel = spark.createDataFrame([(k, n) for k in (1, 2, 3) for n in "abc"], "k int, node string")
    here = sel.unionByName(spark.createDataFrame([(5, "g"), (5, "h")], "k int, node string"))
    cov = Q.coverage(c, sel, here)
    linker, backend = F.when(F.col("k") == 2, "rule_based").otherwise("scispacy_umls"), F.when(F.col("k") == 2, "heuristic").otherwise("direct")
    got = {r["k"]: (r["tier"], r["reasons"]) for r in Q.tiers(cov, F.lit(3), backend, linker, F.lit("csv")).collect()}
    assert got[1] == ("goldish", ["passed_goldish_gate"]) and got[2] == ("silver", ["edge_mapper_backend:heuristic", "entity_linker_backend:rule_based"])
    assert got[3] == ("silver", ["missing_edge_mapping", "gold_edge_coverage_below_threshold"]) and got[4] == ("reject", ["missing_edge_mapping"])
    assert got[5] == ("reject", ["missing_due_to_ppr_pruning"]) and got[6] == ("reject", ["empty_gold_path"])
    e = "array<struct<head:string,tail:string>>"
    p = spark.createDataFrame([(1, [("a", "a"), ("a", "b")]), (2, [("x", "y"), ("z", "x"), ("z", "z")]), (3, [])], f"k int, e {e}")
    assert rows(p.select("k", Q.node_path(F.col("e")))) == [(1, ["a", "b"]), (2, ["y", "x", "z"]), (3, [])]


def test_vectors(spark):
    e = spark.createDataFrame([(1, "E1", "drug:a", "disease:b", "r1", 0.5, 1.0), (1, "E2", "drug:a", "disease:b", "r2", 0.4, 0.9), (1, "E3", "drug:a", "drug:a", "zz", 0.3, 0.8)], "k int, edge_id string, head string, tail string, relation string, reliability double, confidence double")
    f = {r["node"]: r for r in V.node_features(e).collect()}
    assert f["drug:a"]["degree"] == 3 and f["drug:a"]["features"][1] == 1.0 and f["drug:a"]["features"][-2:] == [1.0, 1.0] and len(f["disease:b"]["features"]) == 12
    ids = spark.createDataFrame([("r1", 0), ("r2", 1)], "relation string, relation_id int")
    assert {r["edge_id"]: (r["head_index"], r["tail_index"], r["features"]) for r in V.edge_features(e, ids).collect()} == {"E1": (1, 0, [0.0, 0.5, 1.0]), "E2": (1, 0, [1.0, 0.4, 0.9]), "E3": (1, 1, [0.0, 0.3, 0.8])}
    b = V.initial_codebook(spark, 3, 4).collect()
    assert len(b) == 3 and all(abs(sum(x * x for x in r["vec"]) - 1) < 1e-9 for r in b)
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "node string, vec array<double>")
    inc = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "b"), ("a", "zz")], "node string, other string")
    got = V.neighbour_means(v, inc).collect()
    assert len(got) == 1 and got[0]["node"] == "c" and [round(x, 4) for x in got[0]["vec"]] == [0.3333, 0.6667]
    q = spark.createDataFrame([(1, 5), (2, 6)], "vec_id bigint, code_id int")
    assert tuple(V.token_stability(q, q).first()) == (2, 2, 1.0)
    assert V.encode(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda xs: [[len(x), 1.0] for x in xs], 2).select("embedding").collect()[0][0] in ([2.0, 1.0], [0.0, 1.0])
    assert spark.sql("select array(5L, -1L) x").select(V.remapped(F.col("x"), 4)).first()[0] == [1, 3]


def test_entities_resolved_and_mapped(spark):
    from graphloom.operators import entities as E

    n = spark.createDataFrame([("drug:w", "drug", "Warfarin"), ("disease:w", "disease", "warfarin "), ("disease:s", "disease", "stroke"), ("drug:c", "drug", "coded")], "node_id string, node_type string, node_name string")
    deg = spark.createDataFrame([("disease:w", 9), ("drug:w", 1)], "node string, degree bigint")
    con = spark.createDataFrame([("C0000001", "drug:c")], "cui string, node string")
    e = spark.createDataFrame([(1, 0, "WARFARIN", None, None, "drug"), (1, 1, "warfarin", None, None, "other"), (1, 2, "x", "c0000001", None, "drug"), (1, 3, "x", None, "disease:s", "drug"), (1, 4, "zz", None, "gone:1", "other")], "k int, pos int, surface string, cui string, node string, entity_type string")
    assert [r["node"] for r in E.resolve_entities(e, n, deg, con).orderBy("pos").collect()] == ["drug:w", "disease:w", "drug:c", "disease:s", None]
    t = spark.createDataFrame([("Aspirin",), ("xmab",), ("pain",), ("q",), (None,)], "s string").select(E.entity_type(F.col("s")))
    assert [r[0] for r in t.collect()] == ["drug", "drug", "symptom", "other", "other"]
    m = spark.createDataFrame([(1, 9, " Zz ", None, "x", "other"), (1, 8, "new", None, None, "drug")], e.schema)
    assert sorted(r["pos"] for r in E.merged_entities(e, m).collect()) == [0, 1, 2, 3, 4, 8]
    c = spark.createDataFrame([(1, "s", 0, "A", 0.5, 0.9), (1, "s", 1, "B", 0.9, 0.1), (2, "s", 0, "A", 0.5, 0.2), (2, "s", 1, "B", 0.5, 0.2)], "k int, surface string, pos int, cui string, score double, context double")
    assert rows(E.best_candidates(c)) == [(1, "s", "B"), (2, "s", "A")]
    assert [E.mapper_backend(*x) for x in (("auto", ""), ("AUTO", "m"), ("direct", "m"))] == ["heuristic", "llm", "direct"]
    r = spark.createDataFrame([(1, ["edge:E1", "E9"]), (2, None)], "record_id bigint, direct_edge_ids array<string>")
    ev = spark.createDataFrame([(1, "E1"), (1, "E2"), (2, "E3")], "k bigint, edge_id string")
    sc = spark.createDataFrame([(1, "E2", 4.0, 5), (1, "E1", 2.0, 1), (2, "E3", 3.0, 0)], "k bigint, edge_id string, score double, first_pos int")
    got = {x["k"]: (x["direct"], x["missing"], x["selected"]) for x in E.map_edges(r, ev, sc).collect()}
    assert got == {1: (["E1", "E9"], ["E9"], ["E1", "E2"]), 2: ([], [], ["E3"])}
    assert {x["k"]: x["selected"] for x in E.map_edges(r, ev, sc, "direct").collect()} == {1: ["E1"], 2: []}
    pick = lambda d: d.select("k", F.array(F.lit("E2"), F.lit("E8")).alias("edge_ids"))
    assert {x["k"]: x["selected"] for x in E.map_edges(r, ev, sc, "llm", pick).collect()} == {1: ["E2"], 2: ["E3"]}
