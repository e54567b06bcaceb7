"""Event logs and resumable runs as streams; each function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def _watermarked(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", LATE) if events.isStreaming else events


def tumbling_latency(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """start, event_type, n, mean_value per window; events later than the watermark are left out of a stream."""
    w = _watermarked(events).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def sliding_counts(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return _watermarked(events).groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, end, n: runs of a user's events without a gap of ``gap`` or more."""
    g = _watermarked(events).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_of_each(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each key once; state is kept no longer than the watermark."""
    return _watermarked(events).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def layer_summary(events: DataFrame) -> DataFrame:
    """event_type, n, mean_value, mean_k: counts and means per type; k comes from the JSON payload, bad payloads give null."""
    k = F.from_json("props", "k bigint")["k"]
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.avg(k), 6).alias("mean_k"))


def bucket_counts(rows: DataFrame) -> DataFrame:
    """Running count per bucket (update mode)."""
    return rows.groupBy("bucket").count()


def run_available(stream: DataFrame, path: str, checkpoint: str, write) -> None:
    """Process what is there and stop; a later call resumes after it.  ``write`` is a foreachBatch function."""
    q = stream.writeStream.foreachBatch(lambda df, i: write(df, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def check_run(spark, path: str, config: dict) -> None:
    """Store what a resumable run was started with, or raise if it is resumed with something else."""
    import json

    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = fs.Path(f"{path}/run_config")
    text = json.dumps(config, sort_keys=True)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        had = spark.read.text(f"{path}/run_config").first()["value"]
        if had != text:
            raise ValueError(f"the run was started with {had}, not with {text}")
    else:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/run_config")
