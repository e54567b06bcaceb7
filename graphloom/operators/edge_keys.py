"""Per-key results of the graph's edges: every head, tail and relation with its counts, however skewed the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import key
from ..workspace import Workspace
from .skew import heavy_keys, heavy_light_aggregate, heavy_light_join

FIELDS = ("head", "tail", "relation")
FOUND_SHARE = 0.05


def keyed_rows(edges: DataFrame) -> DataFrame:
    """A row for each edge and field: field, key_value (trimmed, lower-cased), source_reliability."""
    return edges.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), key(F.col(f)).alias("key_value")) for f in FIELDS])).alias("k"),
        F.col("source_reliability").cast("double").alias("source_reliability"),
    ).select("k.field", "k.key_value", "source_reliability")


def edge_key_stats(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """Count, count with a reliability, and mean reliability of each value of head, tail and relation.

    Every row counts, repeated deliveries too.  Blank and null keys are no keys.  Null reliabilities do not enter the
    mean; a key with none has a null mean.  ``share`` is of the rows of one field.  No edges: no rows.
    """
    rows = keyed_rows(edges).where(F.col("key_value").isNotNull())
    # three rows an edge: a third of the share of one field's rows
    heavy = heavy_keys(rows, ["field", "key_value"], share / len(FIELDS))
    return heavy_light_aggregate(
        rows,
        ["field", "key_value"],
        {"n_rows": F.count("*"), "n_rated": F.count("source_reliability"), "mean_reliability": F.avg("source_reliability")},
        heavy,
    )


def heavy_edge_keys(edges: DataFrame, least: float = FOUND_SHARE) -> DataFrame:
    """field, key_value of the values that hold at least ``least`` of all rows; no edges give no rows."""
    n = edges.count()
    return edge_key_stats(edges, least / 2).where(F.col("n_rows") >= F.lit(least * n - 1e-9)).select("field", "key_value")


def edges_with_node_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """row_index, head_name, tail_name: both endpoints looked up by heavy/light joins; unknown endpoints give null.

    A node id that the node table repeats (after trimming and lower-casing) counts once, with its smallest name.
    """
    names = nodes.select(key(F.col("node_id")).alias("id"), "node_name").groupBy("id").agg(F.min("node_name").alias("name"))
    rows = edges.select("row_index", key(F.col("head")).alias("head_key"), key(F.col("tail")).alias("tail_key"))
    one = heavy_light_join(rows, names.select(F.col("id").alias("head_key"), F.col("name").alias("head_name")), ["head_key"], "left")
    one = Workspace(edges.sparkSession, "named").keep(one, "heads")  # read more than once below
    two = heavy_light_join(one, names.select(F.col("id").alias("tail_key"), F.col("name").alias("tail_name")), ["tail_key"], "left", heavy_keys(rows, ["tail_key"]))
    return two.select("row_index", "head_name", "tail_name")
