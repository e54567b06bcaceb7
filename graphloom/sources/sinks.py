"""Sinks: tiered records, dead letters, manifests, reports; all by Spark's own commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tiers(tiered: DataFrame, path: str) -> DataFrame:
    """JSON lines per tier under ``path/records/tier=...`` and the summary under ``path/summary``; the summary.

    The summary has a row a tier: n, the mean of each coverage column the table has, and its reasons with their counts.
    """
    tiered.write.mode("overwrite").partitionBy("tier").json(f"{path}/records")
    back = tiered.sparkSession.read.schema(tiered.schema).json(f"{path}/records")
    means = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in tiered.columns if c.endswith(("_coverage", "_ratio"))]
    summary = back.groupBy("tier").agg(F.count("*").alias("n"), *means)
    if "reasons" in tiered.columns:
        r = back.select("tier", F.explode("reasons").alias("r")).groupBy("tier", "r").agg(F.count("*").alias("c")).groupBy("tier").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r", "c")))).alias("reasons"))
        summary = summary.join(r, "tier", "left")
    summary.write.mode("overwrite").json(f"{path}/summary")
    return summary


def write_with_dead_letters(df: DataFrame, reason, path: str, order: str | None = None, most_saved: int | None = None) -> None:
    """Rows whose ``reason`` (a column) is null to ``path/saved``, the others with their reason to ``path/skipped``.

    The table is evaluated once, into ``path/all``, parted by whether a row is skipped.  ``most_saved``: at most so many
    saved rows, the first by ``order``.
    """
    marked = df.withColumn("skip_reason", reason).withColumn("_skipped", F.col("skip_reason").isNotNull())
    marked.write.mode("overwrite").partitionBy("_skipped").parquet(f"{path}/all")
    back = df.sparkSession.read.schema(marked.schema).parquet(f"{path}/all")
    saved = back.where("not _skipped").drop("skip_reason", "_skipped")
    (saved.orderBy(order).limit(most_saved) if most_saved is not None else saved).write.mode("overwrite").json(f"{path}/saved")
    back.where("_skipped").drop("_skipped").write.mode("overwrite").json(f"{path}/skipped")


def write_training_rows(rows: DataFrame, path: str, about: dict) -> None:
    """Token and label rows as Parquet under ``path/rows``, and what is known about them as one JSON row under ``path/dataset``."""
    import json

    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/dataset")


def write_codebook(codebook: DataFrame, path: str, about: dict) -> str:
    """A code book as Parquet with its description; gives its version, a hash of the description."""
    import hashlib
    import json

    text = json.dumps(about, sort_keys=True)
    version = "cb-" + hashlib.sha256(text.encode()).hexdigest()[:12]
    codebook.write.mode("overwrite").parquet(f"{path}/codes")
    codebook.sparkSession.createDataFrame([(json.dumps({**about, "version": version}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return version


def read_codebook(spark, path: str, expected: dict | None = None) -> DataFrame:
    """A saved code book; an error if its description differs from what is expected of it."""
    import json

    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    wrong = {k: (v, about.get(k)) for k, v in (expected or {}).items() if about.get(k) != v}
    if wrong:
        raise ValueError(f"the code book does not fit: {wrong}")
    return spark.read.parquet(f"{path}/codes")


def append_events(events: DataFrame, path: str) -> None:
    """Events (timestamp, layer, event, data, session_id) appended as JSON lines, a folder a day."""
    events.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A one-row table of metrics as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_trace(questions: DataFrame, edges: DataFrame, passages: DataFrame, path: str) -> None:
    """A JSON document for each question (k, ...) with its edges and passages (k, pos, ...), as lines under ``path``."""
    e = edges.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in edges.columns if c not in ("k", "pos")]))).alias("top_edges"))
    p = passages.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in passages.columns if c not in ("k", "pos")]))).alias("passages"))
    questions.join(e, "k", "left").join(p, "k", "left").write.mode("overwrite").json(path)


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """One micro-batch of a resumable run: bucketed rows and manifest, idempotent by batch id."""
    rows = batch.withColumn("batch_id", F.lit(batch_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "bucket").parquet(f"{path}/rows")
    rows.select("sample_id", "bucket", "batch_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").csv(f"{path}/manifest", header=True)


def markdown_report(df: DataFrame, title: str) -> DataFrame:
    """value: the lines of a Markdown table, for a text sink; row order is that of the sorted lines."""
    head = df.sparkSession.createDataFrame([(0, f"# {title}"), (1, "| " + " | ".join(df.columns) + " |"), (2, "|" + " --- |" * len(df.columns))], "n int, value string")
    body = df.select(F.lit(3).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |")).alias("value"))
    return head.unionByName(body).orderBy("n", "value").select("value")
