"""References to records that are missing, deleted or late, from signed counts per key.

Every change is a delta: a referring row adds +1 to the reference count of a key, its retraction -1; a delivered target
adds +1 to the key's existence count, a deletion -1.  The state holds, per key, the counts and the times at which
existence rose first and fell first.  Deltas add up in any order and any number of batches, so the state is maintained:
``apply_deltas`` folds a batch into the stored state and writes its next version, once however often the batch is
delivered.  Keys with positive references and zero existence are the current orphans; a reference made while existence
was zero (before the first arrival, or after the first deletion) is an orphan of its period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import edge_id, pmid
from ..workspace import Workspace
from .skew import heavy_light_join

STATE = "target string, ref_key string, refs bigint, deliveries bigint, deletions bigint, first_in timestamp, first_out timestamp, first_ref timestamp, last_ref timestamp"


def reference_rows(edges: DataFrame, qa: DataFrame) -> DataFrame:
    """ref_table, row_key, target, ref_key, at, a row for each distinct reference.

    Entries that are null, blank or not of the target's form are no references; repeats in one row count once.
    """
    p = edges.select(
        F.lit("kg_edges").alias("ref_table"),
        F.col("row_index").cast("bigint").alias("row_key"),
        F.lit("articles").alias("target"),
        F.explode(F.array_distinct(F.filter(F.transform("supporting_pmids", pmid), lambda x: x.isNotNull()))).alias("ref_key"),
        F.col("loaded_at").alias("at"),
    )
    e = qa.select(
        F.lit("qa_records").alias("ref_table"),
        F.col("record_id").cast("bigint").alias("row_key"),
        F.lit("kg_edges").alias("target"),
        F.explode(F.array_distinct(F.filter(F.transform("direct_edge_ids", edge_id), lambda x: x.isNotNull()))).alias("ref_key"),
        F.col("created_at").alias("at"),
    )
    return p.unionByName(e)


def target_deltas(articles: DataFrame, edges: DataFrame) -> DataFrame:
    """target, ref_key and the state columns of each delivered target row; targets without a readable key are none."""
    a = articles.select(F.lit("articles").alias("target"), pmid(F.col("pmid")).alias("ref_key"), F.col("received_at").alias("first_in"), F.col("withdrawn_at").alias("first_out"))
    e = edges.select(F.lit("kg_edges").alias("target"), edge_id(F.col("edge_id")).alias("ref_key"), F.col("loaded_at").alias("first_in"), F.col("retired_at").alias("first_out"))
    t = a.unionByName(e).where(F.col("ref_key").isNotNull())
    none = F.lit(None).cast("timestamp")
    return t.select(
        "target", "ref_key", F.lit(0).cast("bigint").alias("refs"), F.lit(1).cast("bigint").alias("deliveries"),
        F.col("first_out").isNotNull().cast("bigint").alias("deletions"), "first_in", "first_out", none.alias("first_ref"), none.alias("last_ref"),
    )


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """A delta for each reference; ``sign`` -1 retracts references (their times stay those of the period)."""
    none = F.lit(None).cast("timestamp")
    return refs.select(
        "target", "ref_key", F.lit(sign).cast("bigint").alias("refs"), F.lit(0).cast("bigint").alias("deliveries"), F.lit(0).cast("bigint").alias("deletions"),
        none.alias("first_in"), none.alias("first_out"), F.col("at").alias("first_ref"), F.col("at").alias("last_ref"),
    )


def fold(deltas: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The state after ``deltas``: sums of the signed counts, extremes of the times; combined before the shuffle."""
    every = deltas if state is None else state.unionByName(deltas)
    return every.groupBy("target", "ref_key").agg(
        *[F.sum(c).alias(c) for c in ("refs", "deliveries", "deletions")],
        *[F.min(c).alias(c) for c in ("first_in", "first_out", "first_ref")],
        F.max("last_ref").alias("last_ref"),
    )


def _versions(spark, path: str) -> list[int]:
    """Numbers of the complete versions of a stored state."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [x.getPath() for x in fs.listStatus(root)]
    return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(hadoop.Path(p, "_SUCCESS")))


def current_state(spark, path: str) -> DataFrame | None:
    """The last complete version of the state at ``path``; None if nothing was applied yet."""
    v = _versions(spark, path)
    return spark.read.schema(STATE).parquet(f"{path}/v={v[-1]}") if v else None


def apply_deltas(deltas: DataFrame, batch_id: int, path: str, keep: int = 2) -> DataFrame:
    """The state after ``deltas``, written as version ``batch_id``; a batch that was applied before changes nothing.

    Use as a ``foreachBatch`` function: batch numbers rise.  The last ``keep`` versions stay, so a reader or a failed
    writer never meets a half-written state.
    """
    spark = deltas.sparkSession
    have = _versions(spark, path)
    if batch_id not in have and (not have or batch_id > have[-1]):
        fold(deltas, current_state(spark, path)).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/v={batch_id}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for v in have[: max(0, len(have) + 1 - keep)]:
            old = hadoop.Path(f"{path}/v={v}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return current_state(spark, path)


def maintain_stream(deltas: DataFrame, path: str, checkpoint: str) -> None:
    """Fold what has arrived on a stream of deltas into the state at ``path`` and stop; a later call resumes after it."""
    q = deltas.writeStream.foreachBatch(lambda df, i: apply_deltas(df, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys with positive references and zero existence (deliveries less deletions): never delivered, or all deleted."""
    gone = F.col("deliveries") - F.col("deletions") <= 0
    return state.where((F.col("refs") > 0) & gone).select("target", "ref_key", "refs", F.when(F.col("deliveries") == 0, "missing").otherwise("deleted").alias("reason"))


def orphan_references(refs: DataFrame, state: DataFrame) -> DataFrame:
    """ref_table, row_key, ref_key, at, reason of every reference made while its key had no existence.

    ``missing``: no target row has the key; else ``late``: the first arrival is after the reference; else ``deleted``:
    the first deletion is not after it.  A reference without a time can only be missing.  Only keys whose state admits
    a case are joined back to their rows.
    """
    suspect = state.where(
        (F.col("refs") > 0)
        & ((F.col("deliveries") == 0) | (F.col("first_in") > F.col("first_ref")) | (F.col("first_out") <= F.col("last_ref")))
    ).select("target", "ref_key", "deliveries", "first_in", "first_out")
    j = heavy_light_join(refs, suspect, ["target", "ref_key"])
    reason = (
        F.when(F.col("deliveries") == 0, "missing")
        .when(F.col("first_in") > F.col("at"), "late")
        .when(F.col("first_out") <= F.col("at"), "deleted")
    )
    return j.select("ref_table", "row_key", "ref_key", "at", reason.alias("reason")).where(F.col("reason").isNotNull())


def maintained(edges: DataFrame, qa: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, state) with the targets' changes applied as one batch of deltas and the references as the next."""
    path = Workspace(edges.sparkSession, "orphans").folder("state")
    refs = reference_rows(edges, qa)
    apply_deltas(target_deltas(articles, edges), 0, path)
    return refs, apply_deltas(reference_deltas(refs), 1, path)


def find_orphans(edges: DataFrame, qa: DataFrame, articles: DataFrame) -> DataFrame:
    """The orphan references of both tables; empty tables give no rows."""
    return orphan_references(*maintained(edges, qa, articles))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Count per table, month of the referring row and reason; rows without a time have a null month."""
    return orphans.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))
