"""Multi-hop paths by beam search, answers with enforced provenance, abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..workspace import Workspace
from .skew import heavy_light_join

BEAM, EDGES_MOST, TOP_PATHS, CANDIDATES = 5, 3, 5, 10
ABSTAIN_BELOW, UNSURE_BELOW = 0.4, 0.7


def path_confidence(weights: Column) -> Column:
    """Product of the edge weights; beyond two edges times the first and the last once more; 0 without edges."""
    product = F.aggregate(weights, F.lit(1.0), lambda a, w: a * w)
    return F.when(F.size(weights) == 0, 0.0).when(F.size(weights) > 2, product * F.element_at(weights, 1) * F.element_at(weights, -1)).otherwise(product)


def candidate_nodes(scores: DataFrame) -> DataFrame:
    """k, node, score: the best CANDIDATES nodes of each question by score, then id."""
    w = Window.partitionBy("k").orderBy(F.desc("score"), "node")
    return scored_once(scores).withColumn("r", F.row_number().over(w)).where(F.col("r") <= CANDIDATES)


def scored_once(scores: DataFrame) -> DataFrame:
    return scores.groupBy("k", "node").agg(F.max("score").alias("score"))


def decode_paths(scores: DataFrame, edges_of: DataFrame, work: Workspace) -> DataFrame:
    """k, rank, nodes, edges, confidence, ranking of the best TOP_PATHS paths of each question.

    ``scores`` has k, node, score; ``edges_of`` k, edge_id, head, tail, reliability, confidence.  A beam of the best
    BEAM candidates grows along head-to-tail edges into other candidates, without a cycle, up to EDGES_MOST edges; each
    round keeps the BEAM best by ranking, then nodes.  Ranking: path confidence times the score of the new end.
    Connected paths come first, longer ones before shorter, then the single nodes.  Questions without candidates have
    no row.
    """
    cand = work.keep(candidate_nodes(scores), "candidates")
    steps = work.keep(
        edges_of.select("k", "edge_id", "head", "tail", (F.col("reliability") * F.col("confidence")).alias("weight"))
        .join(cand.select("k", F.col("node").alias("tail"), F.col("score").alias("end_score")), ["k", "tail"]),
        "steps",
    )
    beam = cand.where(F.col("r") <= BEAM).select(
        "k", F.array("node").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.array().cast("array<double>").alias("weights"), F.col("score").alias("ranking"), F.col("score").alias("confidence")
    )
    paths = [beam]
    for _ in range(EDGES_MOST):
        grown = beam.withColumn("head", F.element_at("nodes", -1)).join(steps, ["k", "head"]).where(~F.array_contains("nodes", F.col("tail")))
        weights = F.concat("weights", F.array("weight"))
        conf = F.round(path_confidence(weights), 12)
        grown = grown.select("k", F.concat("nodes", F.array("tail")).alias("nodes"), F.concat("edges", F.array("edge_id")).alias("edges"), weights.alias("weights"), F.round(conf * F.col("end_score"), 12).alias("ranking"), conf.alias("confidence"))
        grown = work.keep(grown, "grown")
        paths.append(grown)
        w = Window.partitionBy("k").orderBy(F.desc("ranking"), "nodes", "edges")
        beam = grown.withColumn("b", F.row_number().over(w)).where(F.col("b") <= BEAM).drop("b")
    every = paths[0]
    for p in paths[1:]:
        every = every.unionByName(p)
    every = every.groupBy("k", "nodes", "edges").agg(F.max_by("confidence", "ranking").alias("confidence"), F.max("ranking").alias("ranking"))
    w = Window.partitionBy("k").orderBy(F.desc(F.size("edges")), F.desc("ranking"), F.desc("confidence"), "nodes", "edges")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP_PATHS).select("k", "rank", "nodes", "edges", "confidence", "ranking")


def contradiction_scores(edges_of: DataFrame, passages: DataFrame) -> DataFrame:
    """k, contradiction: the strongest clash of an edge with a passage of its question that names one of its ends.

    An edge is negative by its relation or a display relation with ``contra``.  A positive edge counts .8 against a
    passage with a negative cue, whatever else it says; a negative edge .8 against one with a positive cue and .35
    against one with no cue at all.  Edges of both polarities between the same nodes count at least .6.  Questions
    without edges or without passages have 0 (no edge: no row).
    """
    e = edges_of.select(
        "k", "head", "tail", (T.text(F.col("relation")).isin(K.NEGATIVE_RELATIONS) | T.has_any(F.col("display_relation"), ["contra"])).alias("neg"),
        F.lower(T.humanized(F.col("head"))).alias("h"), F.lower(T.humanized(F.col("tail"))).alias("t"),
    )
    p = passages.select("k", F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))).alias("body"))
    p = p.select("k", "body", T.has_any(F.col("body"), K.CLASH_NEGATIVE).alias("n"), T.has_any(F.col("body"), K.CLASH_POSITIVE).alias("p"))
    j = e.join(p, "k").where(F.col("body").contains(F.col("h")) | F.col("body").contains(F.col("t")))
    clash = F.when(F.col("neg") & F.col("p"), 0.8).when(~F.col("neg") & F.col("n"), 0.8).when(F.col("neg") == F.col("n"), 0.0).otherwise(0.35)
    one = j.groupBy("k").agg(F.max(clash).alias("c"))
    mixed = e.groupBy("k", "head", "tail").agg(F.count_distinct("neg").alias("n")).groupBy("k").agg(F.max("n").alias("n"))
    some = passages.select("k").distinct().withColumn("some", F.lit(True))
    both = mixed.join(one, "k", "left").join(some, "k", "left")
    score = F.greatest(F.coalesce("c", F.lit(0.0)), F.when(F.col("n") > 1, 0.6).otherwise(0.0))
    return both.select("k", F.when(F.col("some"), score).otherwise(0.0).alias("contradiction"))


def provenance_tags(edges: Column, pmids: Column, other_edges: Column, passages: Column, most: int = 3) -> Column:
    """Distinct tags: path edges, path articles, bundle edges, passages, in this order."""
    tag = lambda a, p: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.concat(F.lit(p), x))
    return F.slice(F.array_distinct(F.concat(tag(edges, "edge:"), tag(pmids, "PMID:"), tag(other_edges, "edge:"), tag(passages, "PMID:"))), 1, most)


def enforce_provenance(answer: Column, allowed: Column) -> Column:
    """The sentences of an answer whose references are all allowed, with at least one, joined by spaces.

    Legacy ``edge_id:`` reads as ``edge:``; a sentence without final punctuation gets a point.
    """
    kept = F.filter(T.judge_claims(answer), lambda s: (F.size(T.evidence_refs(s)) > 0) & F.forall(T.evidence_refs(s), lambda r: F.array_contains(allowed, r)))
    tidy = F.transform(kept, lambda s: F.regexp_replace(T.squeeze(s), r"\[edge_id:", "[edge:"))
    return F.array_join(F.transform(tidy, lambda s: F.when(s.rlike("[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))), " ")


def should_abstain(validity: Column, contradiction: Column, h5: Column, recommendation: Column, faithfulness: Column) -> Column:
    return (validity < ABSTAIN_BELOW) | (contradiction >= 0.5) | h5 | (recommendation == "ABSTAIN") | (faithfulness < ABSTAIN_BELOW)


def answer_text(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """k, answer, confidence: one statement a path edge of the best path, each with its tag; doubt is worded below .7.

    Questions whose best path has no edge or a confidence below .4 get the abstention text.
    """
    best = paths.where("rank = 1")
    steps = best.select("k", F.posexplode("edges").alias("pos", "edge_id"))
    said = heavy_light_join(steps, edges.select("edge_id", "head", "tail", "display_relation"), ["edge_id"])
    s = F.concat(T.humanized(F.col("head")), F.lit(" "), "display_relation", F.lit(" "), T.humanized(F.col("tail")), F.lit(" [edge:"), "edge_id", F.lit("]."))
    text = said.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", s.alias("s")))), lambda x: x["s"]), " ").alias("said"))
    j = best.select("k", "confidence").join(text, "k", "left")
    out = F.when(F.col("said").isNull() | (F.col("confidence") < ABSTAIN_BELOW), "The evidence does not support an answer.").when(F.col("confidence") < UNSURE_BELOW, F.concat(F.lit("Evidence suggests: "), "said")).otherwise(F.col("said"))
    return j.select("k", out.alias("answer"), "confidence")
