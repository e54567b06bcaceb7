"""Intermediate tables in the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only where none is named (tests, a laptop) a
temporary one is set.  Tables are plain Parquet: they survive the loss of any executor, cut the lineage and carry
column statistics, which an RDD checkpoint does not.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one is set only if the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    key = id(spark.sparkContext)
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(_OWN[key])
        atexit.register(_remove_local, _OWN[key])
    return _OWN[key]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """The table in at least as many partitions as the cluster has cores; a table that has them is left as it is.

    For scans of few small files ahead of costly row-wise work; at scale a scan has its partitions and nothing moves.
    A plan that shuffles is left as it is: to ask for its partitions would run it.
    """
    if "Exchange" in (plan := df._jdf.queryExecution().executedPlan().toString()) or "AdaptiveSparkPlan" in plan:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if have >= cores else df.repartition(cores)


class Workspace:
    """Written tables of one query: ``keep`` writes and reads back, ``drop`` deletes what is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        atexit.register(self._delete, self.root)

    def folder(self, label: str) -> str:
        """A new path in the shared folder."""
        self.n += 1
        return f"{self.root}/{self.n:04d}-{label}"

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.folder(label)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._graphloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table; the caller has read it for the last time."""
        path = getattr(df, "_graphloom_path", None)
        if path:
            self._delete(path)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit; the folder is the cluster's to clean
            pass
