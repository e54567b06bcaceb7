"""Gold paths, coverage and tiers of training records; triage buckets; checks of written outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .bundles import named_edges
from .skew import heavy_light_join

LABEL_TOKENS, IGNORE = 256, -100
MIN_NODE_COVERAGE, MIN_LABEL_RATIO, MIN_EDGE_COVERAGE = 0.8, 0.8, 1.0
#: Accepted edge mappers and refused graphs (fixed values).
BACKENDS = ["direct", "llm_*"]
BAD_GRAPHS = ["", "empty", "missing"]


def node_path(edges: Column) -> Column:
    """Nodes along an array of struct<head, tail> in order; the first edge is turned so that the second continues it.

    A node is not repeated in a row; an edge that does not continue the path adds both of its ends.
    """
    first, second = F.element_at(edges, 1), F.try_element_at(edges, F.lit(2))
    joins = lambda x: (x == second["head"]) | (x == second["tail"])
    turned = F.when(F.size(edges) > 1, joins(first["head"]) & ~joins(first["tail"])).otherwise(False)
    start = F.array_distinct(F.when(turned, F.array(first["tail"], first["head"])).otherwise(F.array(first["head"], first["tail"])))

    def step(path, e):
        last = F.element_at(path, -1)
        more = F.when(e["head"] == last, F.array(e["tail"])).when(e["tail"] == last, F.array(e["head"])).otherwise(F.array(e["head"], e["tail"]))
        kept = F.filter(F.array_distinct(more), lambda n, i: (i > 0) | (n != last))
        return F.concat(path, kept)

    walked = F.aggregate(F.slice(edges, 2, F.greatest(F.size(edges), F.lit(1))), start, step)
    return F.when(F.size(edges) > 0, walked).otherwise(F.array().cast("array<string>"))


def gold_paths(records: DataFrame, edges: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """k, n_gold, n_covered, missing, path of each record: named edges, those that exist, ids that do not, node path.

    ``edges`` with k are each record's own evidence.  ``named`` (k, pos, edge_id) takes the place of the record's ids.
    """
    named = named_edges(records) if named is None else named
    on = [c for c in ("k", "edge_id") if c in edges.columns]
    j = heavy_light_join(named, edges.select(*on, "head", "tail"), on, "left")
    g = j.groupBy("k").agg(
        F.count("*").alias("n_gold"), F.count("head").alias("n_covered"),
        F.array_sort(F.collect_list(F.when(F.col("head").isNotNull(), F.struct("pos", "head", "tail")))).alias("found"),
        F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("pos", "edge_id")))).alias("lost"),
    )
    all_ = records.select(F.col("record_id").alias("k")).distinct().join(g, "k", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    found = empty(F.col("found"), "array<struct<pos:int,head:string,tail:string>>")
    return all_.select(
        "k", F.coalesce("n_gold", F.lit(0)).cast("bigint").alias("n_gold"), F.coalesce("n_covered", F.lit(0)).cast("bigint").alias("n_covered"),
        F.transform(empty(F.col("lost"), "array<struct<pos:int,edge_id:string>>"), lambda x: x["edge_id"]).alias("missing"), node_path(found).alias("path"),
    )


def coverage(paths: DataFrame, selected: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Adds edge_coverage, n_nodes, n_present, n_labelled, node_coverage, label_ratio.

    ``selected`` (k, node) are the nodes kept for the record, ``present`` those of its evidence (None: all of the path).
    """
    nodes = paths.select("k", F.explode(F.array_distinct("path")).alias("node"))
    j = nodes.join(selected.select("k", "node").distinct().withColumn("in", F.lit(1)), ["k", "node"], "left")
    j = j.withColumn("here", F.lit(1)) if present is None else j.join(present.select("k", "node").distinct().withColumn("here", F.lit(1)), ["k", "node"], "left")
    n = j.groupBy("k").agg(F.count("*").alias("n_nodes"), F.count("here").alias("n_present"), F.count("in").alias("n_labelled"), F.count_if(F.col("here").isNotNull() & F.col("in").isNull()).alias("n_pruned"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    j = paths.join(n, "k", "left").fillna(0, ["n_nodes", "n_present", "n_labelled", "n_pruned"])
    return (
        j.withColumn("edge_coverage", ratio(F.col("n_covered"), F.col("n_gold"))).withColumn("node_coverage", ratio(F.col("n_present"), F.col("n_nodes"))).withColumn("label_ratio", ratio(F.col("n_labelled"), F.col("n_nodes")))
    )


def tiers(c: DataFrame, n_evidence: Column, edge_backend: Column, linker: Column, graph_backend: Column, has_seeds: Column | None = None) -> DataFrame:
    """Adds reasons and tier: reject, silver or goldish; reasons are distinct and in order.

    The cause of poor coverage is the first of: no gold path, an edge that is missing, a node of the evidence that was
    not kept, a node that is not in the evidence or a question without linked nodes, else too little coverage.
    """
    seeds = F.lit(True) if has_seeds is None else has_seeds
    cause = (
        F.when(F.col("n_gold") == 0, "empty_gold_path").when(F.size("missing") > 0, "missing_edge_mapping").when(F.col("n_pruned") > 0, "missing_due_to_ppr_pruning")
        .when((F.col("n_present") < F.col("n_nodes")) | ~seeds, "missing_entity_link").otherwise("insufficient_gold_path_coverage")
    )
    when = lambda cond, x: F.when(cond, x)
    bad_graph = T.text(graph_backend).isin(BAD_GRAPHS)
    rejects = F.array(
        when(F.col("n_gold") < 1, F.lit("empty_gold_path")), when(n_evidence == 0, F.lit("missing_evidence_edges")),
        when(bad_graph, F.concat(F.lit("primekg_backend:"), T.text(graph_backend))), when(F.col("n_labelled") == 0, cause),
    )
    low_e, low_n, low_l = F.col("edge_coverage") < MIN_EDGE_COVERAGE, F.col("node_coverage") < MIN_NODE_COVERAGE, F.col("label_ratio") < MIN_LABEL_RATIO
    silvers = F.array(
        when(~T.matches_pattern(edge_backend, BACKENDS), F.concat(F.lit("edge_mapper_backend:"), edge_backend)), when(linker != "scispacy_umls", F.concat(F.lit("entity_linker_backend:"), linker)),
        when(graph_backend == "unknown", F.lit("primekg_backend:unknown")), when(low_e, cause), when(low_e, F.lit("gold_edge_coverage_below_threshold")),
        when(low_n, cause), when(low_n, F.lit("gold_node_coverage_below_threshold")), when(low_l, cause), when(low_l, F.lit("labeled_token_ratio_below_threshold")),
    )
    tidy = lambda a: F.array_distinct(F.array_compact(a))
    r, s = tidy(rejects), tidy(silvers)
    reasons = F.when(F.size(r) > 0, r).when(F.size(s) > 0, s).otherwise(F.array(F.lit("passed_goldish_gate")))
    return c.withColumn("reasons", reasons).withColumn("tier", F.when(F.size(r) > 0, "reject").when(F.size(s) > 0, "silver").otherwise("goldish"))


def tier_reasons(tiered: DataFrame) -> DataFrame:
    """tier, reason, n."""
    return tiered.select("tier", F.explode("reasons").alias("reason")).groupBy("tier", "reason").agg(F.count("*").alias("n"))


def tier_summary(tiered: DataFrame) -> DataFrame:
    """tier (``all`` for every record), n, means of the coverages, labelled nodes in all."""
    s = tiered.rollup("tier").agg(F.count("*").alias("n"), F.round(F.avg("edge_coverage"), 6).alias("mean_edge_coverage"), F.round(F.avg("node_coverage"), 6).alias("mean_node_coverage"), F.round(F.avg("label_ratio"), 6).alias("mean_label_ratio"), F.sum("n_labelled").alias("n_labelled"))
    return s.withColumn("tier", F.coalesce("tier", F.lit("all")))


def top_reasons(tiered: DataFrame, most: int = 10) -> DataFrame:
    """reason, n: the most frequent reasons outside the goldish tier."""
    return tiered.where("tier <> 'goldish'").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(most)


def score_edges_against_text(edges_of: DataFrame, records: DataFrame) -> DataFrame:
    """k, edge_id, score, first_pos of each bundle edge against its record's question, answer and reasoning.

    Head and tail count 2 each, the relation phrase 1, relation words .3 up to 1.2, an article id 1, the literal edge id
    100; a phrase that does not occur whole counts by the share of its longer words that do.
    """
    words = records.select(F.col("record_id").alias("k"), T.alnum(F.concat_ws(" ", "question", "answer", "reasoning")).alias("t"))
    e = edges_of.select(
        "k", "edge_id", T.alnum(F.col("edge_id")).alias("id"), T.alnum(T.humanized(F.col("head"))).alias("h"), T.alnum(T.humanized(F.col("tail"))).alias("ta"),
        T.alnum(F.when(F.col("display_relation") != "", F.col("display_relation")).otherwise(F.col("relation"))).alias("r"), T.alnum(F.col("relation")).alias("rr"), "pmids",
    )
    j = e.join(words, "k")
    t = F.col("t")
    far = F.length(t)

    def longer(c):
        return F.filter(F.split(c, " "), lambda w: F.length(w) > 2)

    def phrase(c):
        at = F.instr(t, c)
        ws = longer(c)
        got = F.filter(ws, lambda w: t.contains(w))
        score = F.when(c == "", 0.0).when(at > 0, 1.0).when(F.size(ws) > 0, F.size(got) / F.size(ws)).otherwise(0.0)
        pos = F.when(c == "", far).when(at > 0, at - 1).otherwise(F.coalesce(F.array_min(F.transform(got, lambda w: F.instr(t, w) - 1)), far))
        return score, pos

    hs, hp = phrase(F.col("h"))
    ts, tp = phrase(F.col("ta"))
    rs, rp = phrase(F.col("r"))
    rel = F.least(0.3 * F.size(F.filter(longer(F.col("rr")), lambda w: t.contains(w))), F.lit(1.2))
    cited = F.filter("pmids", lambda p: t.contains(p))
    literal = (F.col("id") != "") & t.contains(F.col("id"))
    score = F.when(literal, 100.0).otherwise(0.0) + 2.0 * hs + 2.0 * ts + rs + rel + F.size(cited)
    pos = F.least(far, hp, tp, rp, F.when(literal, F.instr(t, F.col("id")) - 1).otherwise(far), F.coalesce(F.array_min(F.transform(cited, lambda p: F.instr(t, p) - 1)), far))
    return j.select("k", "edge_id", F.round(score, 6).alias("score"), pos.alias("first_pos"))


def mapped_edges(scored: DataFrame, least: float = 3.0) -> DataFrame:
    """k, edge_ids: edges that score at least ``least``, by first position, falling score, id."""
    s = F.array_sort(F.collect_list(F.struct("first_pos", (-F.col("score")).alias("s"), "edge_id")))
    return scored.where(F.col("score") >= least).groupBy("k").agg(F.transform(s, lambda x: x["edge_id"]).alias("edge_ids"))


def bucket(successes: Column, passes: Column, max_nodes: Column, max_labels: Column, error: Column) -> Column:
    """Triage bucket of a sample: stable_graph, threshold_a, threshold_b or hard_absent.

    ``error`` is null, or whether the failed sample left a partial graph.
    """
    rate = F.when(passes > 0, successes / passes).otherwise(0.0)
    return (
        F.when(error.isNotNull(), F.when(error, "threshold_b").otherwise("hard_absent"))
        .when((passes > 0) & (successes == passes) & (max_labels > 0), "stable_graph")
        .when((successes >= 2) | ((rate >= 0.66) & (max_nodes > 0)), "threshold_a")
        .when((successes == 1) | (max_nodes > 0), "threshold_b")
        .otherwise("hard_absent")
    )


def sample_summary(passes: DataFrame) -> DataFrame:
    """sample_id, successes, passes, support_rate, max_nodes, max_labels, errors, bucket from pass rows.

    Pass rows: sample_id, success, nodes, labels, and, where the table has them, edges (max_edges comes with it) and error.
    """
    more = [F.max("edges").alias("max_edges")] if "edges" in passes.columns else []
    errors = F.count_if(F.col("error").isNotNull()) if "error" in passes.columns else F.lit(0).cast("bigint")
    g = passes.groupBy("sample_id").agg(F.count_if("success").alias("successes"), F.count("*").alias("passes"), F.max("nodes").alias("max_nodes"), F.max("labels").alias("max_labels"), *more, errors.alias("errors"))
    g = g.withColumn("support_rate", F.round(F.col("successes") / F.col("passes"), 6))
    return g.withColumn("bucket", bucket(F.col("successes"), F.col("passes"), F.col("max_nodes"), F.col("max_labels"), F.lit(None).cast("boolean")))


def output_checks(manifest: DataFrame, buckets: DataFrame) -> DataFrame:
    """bucket, n_manifest, n_bucket, n_duplicates, ok: a manifest held against the rows written per bucket."""
    m = manifest.groupBy("bucket").agg(F.count("*").alias("n_manifest"))
    b = buckets.groupBy("bucket").agg(F.count("*").alias("n_bucket"))
    d = manifest.groupBy("bucket", "sample_id").count().where("count > 1").groupBy("bucket").agg(F.count("*").alias("n_duplicates"))
    j = m.join(b, "bucket", "full").join(d, "bucket", "left").fillna(0)
    known = F.col("bucket").isin("stable_graph", "threshold_a", "threshold_b", "hard_absent")
    return j.withColumn("ok", known & (F.col("n_manifest") == F.col("n_bucket")) & (F.col("n_duplicates") == 0))
