"""Session settings for large joins and aggregations."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[8]", app: str = "graphloom", **more: str) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**SETTINGS, **more}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def read(spark: SparkSession, sf_dir: str, name: str):
    """A table of a data folder: one Parquet file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
