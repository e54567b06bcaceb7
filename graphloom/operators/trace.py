"""Stages of one record's way through the pipeline: where it failed, what to look at, and summaries of what was left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the stages, in order (fixed values).
STAGES = ["sample_load", "question_type", "entity_extraction", "primekg_retrieval", "pubmed_retrieval", "gold_mapping", "tensorization_preview", "seed_quality", "posthoc_audit"]
HINTS = {
    "sample_load": "Check the source, its split and the record's id.",
    "entity_extraction": "Look at the linked names and whether they have nodes.",
    "primekg_retrieval": "Check the graph, the relation filter, the seeds and the hops.",
    "gold_mapping": "Gold edges are not among the retrieved ones.",
    "tensorization_preview": "Check whether the gold path's nodes were selected.",
    "seed_quality": "Look at the coverage and its thresholds.",
    "posthoc_audit": "Look at the claims' verdicts and the references that are not supported.",
    "pubmed_retrieval": "No passage was found; check the cache and the connection.",
}


def first_failed(stages: Column) -> Column:
    """The first stage, in their order, whose status is ``fail``, of array<struct<stage, status>>; null if none is."""
    bad = F.transform(F.filter(stages, lambda s: s["status"] == "fail"), lambda s: s["stage"])
    return F.try_element_at(F.filter(F.array(*[F.lit(s) for s in STAGES]), lambda s: F.array_contains(bad, s)), F.lit(1))


def verdict(failed: Column, tier: Column, labelled: Column, label: Column, recommendation: Column, h5: Column) -> tuple[Column, Column]:
    """(status: golden, partial or reject; failed stage) of a trace."""
    label, rec = F.lower(F.coalesce(label, F.lit(""))), F.upper(F.coalesce(recommendation, F.lit("")))
    audit = (label == "reject") | (rec == "ABSTAIN") | F.coalesce(h5, F.lit(False))
    fine, some = failed.isNull(), F.coalesce(labelled, F.lit(0)) > 0
    status = (
        F.when(audit, "reject").when((label == "golden") & fine & some, "golden").when((label == "partial") & fine & some, "partial")
        .when(fine & (tier == "goldish") & some, "golden").when(fine & (tier == "silver") & some, "partial").when((failed == "pubmed_retrieval") & some, "partial").otherwise("reject")
    )
    stage = F.coalesce(failed, F.when(audit, "posthoc_audit").when(status == "reject", "seed_quality"))
    return status, stage


def hint(stage: Column) -> Column:
    out = F.lit("The trace is usable.")
    for s, h in HINTS.items():
        out = F.when(stage == s, h).otherwise(out)
    return out


def skip_stage(n_entities: Column, n_edges: Column) -> Column:
    """Where a record without gold edges was lost: linking, retrieval or the mapping of edges."""
    return F.when(n_entities == 0, "entity_linking").when(n_edges == 0, "retrieval").otherwise("edge_mapping")


def skip_summary(skipped: DataFrame) -> DataFrame:
    """skip_stage, skip_reason (``all`` in the totals), n, mean_edges, mean_entities of skipped rows."""
    x = skipped.select(F.coalesce("skip_stage", F.lit("unknown")).alias("skip_stage"), F.coalesce("skip_reason", F.lit("unknown")).alias("skip_reason"), F.coalesce("edge_count", F.lit(0)).alias("e"), F.coalesce("entity_count", F.lit(0)).alias("n"))
    g = x.groupingSets([["skip_stage"], ["skip_reason"], []], "skip_stage", "skip_reason").agg(F.count("*").alias("n_rows"), F.round(F.avg("e"), 6).alias("mean_edges"), F.round(F.avg("n"), 6).alias("mean_entities"))
    return g.select(F.coalesce("skip_stage", F.lit("all")).alias("skip_stage"), F.coalesce("skip_reason", F.lit("all")).alias("skip_reason"), "n_rows", "mean_edges", "mean_entities")


def filter_benchmark(without: DataFrame, with_: DataFrame, stages: DataFrame, gold: DataFrame, most: int = 200) -> DataFrame:
    """fallback_stage (``all`` in the total), n, means of edges before and after the relation filter, questions with any, gold edges retained.

    ``without`` and ``with_`` have k and edge_id, ``stages`` k and stage, ``gold`` k and edge_id.  Edges count up to ``most``.
    """
    n = lambda d, name: d.groupBy("k").agg(F.count("*").alias(name))
    kept = lambda d, name: gold.distinct().join(d.select("k", "edge_id").distinct(), ["k", "edge_id"], "left_semi").groupBy("k").agg(F.count("*").alias(name))
    j = stages.select("k", "stage").join(n(without, "a"), "k", "left").join(n(with_, "b"), "k", "left").join(kept(without, "ka"), "k", "left").join(kept(with_, "kb"), "k", "left")
    return filter_summary(j, gold, most)


def filter_summary(counts: DataFrame, gold: DataFrame, most: int = 200) -> DataFrame:
    """``filter_benchmark`` of k, stage, a, b (edges before and after the filter), ka, kb (gold edges among them; null: none)."""
    j = counts.join(gold.distinct().groupBy("k").agg(F.count("*").alias("g")), "k", "left").fillna(0)
    j = j.withColumn("a", F.least("a", F.lit(most))).withColumn("b", F.least("b", F.lit(most)))
    share = lambda c: F.when(F.col("g") > 0, F.col(c) / F.col("g")).otherwise(0.0)
    g = j.rollup("stage").agg(
        F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_before"), F.round(F.avg("b"), 6).alias("mean_after"), F.count_if(F.col("a") > 0).alias("any_before"), F.count_if(F.col("b") > 0).alias("any_after"),
        F.round(F.avg(share("ka")), 6).alias("retained_before"), F.round(F.avg(share("kb")), 6).alias("retained_after"),
    )
    return g.select(F.coalesce("stage", F.lit("all")).alias("fallback_stage"), *g.columns[1:])


def run_state(rows: DataFrame) -> DataFrame:
    """bucket (``all`` in the total), done, errors, mean_duration_ms of manifest rows: bucket, error_count, duration_ms."""
    g = rows.rollup("bucket").agg(F.count("*").alias("done"), F.count_if(F.coalesce("error_count", F.lit(0)) > 0).alias("errors"), F.round(F.avg(F.coalesce("duration_ms", F.lit(0.0))), 3).alias("mean_duration_ms"))
    return g.select(F.coalesce("bucket", F.lit("all")).alias("bucket"), "done", "errors", "mean_duration_ms")


def not_yet_done(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows whose row_index and sample_id are both absent from the manifest."""
    return rows.join(manifest.select("row_index").distinct(), "row_index", "left_anti").join(manifest.select("sample_id").distinct(), "sample_id", "left_anti")


def rebuilt(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the last row of each sample by row_index, their summary per bucket): what the outputs of a run must hold."""
    rows = manifest.groupBy("sample_id").agg(F.max_by(F.struct(*[c for c in manifest.columns if c != "sample_id"]), "row_index").alias("r")).select("sample_id", "r.*")
    return rows, run_state(rows)
