"""Vectors of nodes and edges, code books, and the checks of a quantisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.keys import strip
from .skew import heavy_light_join

#: Types with a place of their own in a node's vector, and id prefixes that mean another type (fixed values).
NODE_TYPES = ["disease", "drug", "protein", "symptom", "anatomy", "phenotype", "pathway", "exposure", "bioprocess", "other"]
PREFIXES = {"cellcomp": "other", "molfunc": "other", "effect": "other"}


def node_type(c: Column) -> Column:
    """The type of an id by its prefix."""
    p = F.lower(strip(F.substring_index(c, ":", 1)))
    return F.when(F.contains(T.text(c), F.lit(":")) & p.isin(NODE_TYPES), p).otherwise("other")


def one_hot(c: Column, names=NODE_TYPES) -> Column:
    return F.array(*[(c == n).cast("double") for n in names])


def node_features(edges_of: DataFrame) -> DataFrame:
    """k, node, node_type, degree, features: one-hot type, degree and log degree over the largest of the question's graph.

    Degrees count distinct head-tail pairs, as a simple directed graph has them; a self-loop counts twice.
    """
    pairs = edges_of.select("k", "head", "tail").distinct()
    d = pairs.select("k", F.explode(F.array("head", "tail")).alias("node")).groupBy("k", "node").agg(F.count("*").alias("degree"))
    most = F.max("degree").over(Window.partitionBy("k"))
    share, log = F.col("degree") / F.greatest(most, F.lit(1)), F.log1p(F.col("degree").cast("double")) / F.greatest(F.log1p(most.cast("double")), F.lit(1.0))
    t = node_type(F.col("node"))
    return d.select("k", "node", t.alias("node_type"), "degree", F.concat(one_hot(t), F.array(share, log)).alias("features"))


def edge_features(edges_of: DataFrame, relation_ids: DataFrame) -> DataFrame:
    """k, edge_id, head_index, tail_index, features: ends by their place in the order of the question's nodes; relation id, reliability, confidence.

    ``relation_ids`` has relation and relation_id; an unknown relation has 0.
    """
    n = edges_of.select("k", F.explode(F.array("head", "tail")).alias("node")).distinct()
    n = n.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("node")) - 1)
    e = edges_of.join(F.broadcast(relation_ids.select("relation", "relation_id")), "relation", "left")
    e = e.join(n.select("k", F.col("node").alias("head"), F.col("i").alias("head_index")), ["k", "head"]).join(n.select("k", F.col("node").alias("tail"), F.col("i").alias("tail_index")), ["k", "tail"])
    return e.select("k", "edge_id", "head_index", "tail_index", F.array(F.coalesce("relation_id", F.lit(0)).cast("double"), F.col("reliability"), F.col("confidence")).alias("features"))


def neighbour_means(vectors: DataFrame, inc: DataFrame) -> DataFrame:
    """node, vec: the mean of a node's neighbours' vectors, each edge counting; one step of message passing.

    ``vectors`` has node and vec, ``inc`` node and other.  Nodes whose neighbours have no vector have no row.
    """
    j = heavy_light_join(inc.select(F.col("node").alias("at"), F.col("other").alias("node")), vectors.select("node", "vec"), ["node"])
    each = j.select(F.col("at").alias("node"), F.posexplode("vec").alias("pos", "x")).groupBy("node", "pos").agg(F.avg("x").alias("x"))
    return each.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))


def initial_codebook(spark, size: int, width: int) -> DataFrame:
    """code_id, vec: sin(.017 code + .013 dim) + cos(.007 code - .019 dim), scaled to length 1."""
    at = F.sequence(F.lit(0), F.lit(width - 1))
    raw = F.transform(at, lambda d: F.sin(F.col("id") * 0.017 + d * 0.013) + F.cos(F.col("id") * 0.007 - d * 0.019))
    x = spark.range(size).select(F.col("id").cast("int").alias("code_id"), raw.alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, v: a + v * v))
    return x.withColumn("n", norm).select("code_id", F.transform("raw", lambda v: v / F.greatest(F.col("n"), F.lit(1e-12))).alias("vec"))


def usage_summary(usage: DataFrame) -> DataFrame:
    """total_vectors, unique_codes_used, dead_code_count, dead_code_ratio of code_id, n.  One row."""
    dead = F.count_if(F.col("n") == 0)
    return usage.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_vectors"), F.count_if(F.col("n") > 0).alias("unique_codes_used"), dead.alias("dead_code_count"), F.round(F.coalesce(dead / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("dead_code_ratio"))


def top_codes(usage: DataFrame, most: int = 10) -> DataFrame:
    """code_id, n, share of the codes used most, ties by id."""
    return usage.where("n > 0").orderBy(F.desc("n"), "code_id").limit(most)


def token_stability(one: DataFrame, two: DataFrame) -> DataFrame:
    """n, identical, ratio: vectors that both quantisations (vec_id, code_id) give the same code."""
    j = one.select("vec_id", F.col("code_id").alias("a")).join(two.select("vec_id", F.col("code_id").alias("b")), "vec_id", "full")
    same = F.count_if(F.col("a") == F.col("b"))
    return j.agg(F.count("*").alias("n"), same.alias("identical"), F.round(F.coalesce(same / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)), 6).alias("ratio"))


def encode(df: DataFrame, text: str, encoder, width: int) -> DataFrame:
    """``df`` with ``embedding`` (array<float>) from ``encoder``: a function of a list of texts to a matrix, in Arrow batches."""
    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        import numpy as np

        m = np.asarray(encoder(t.fillna("").tolist()), np.float32).reshape(len(t), width)
        return pd.Series(list(m))

    return df.withColumn("embedding", run(text))


def remapped(tokens: Column, size: int) -> Column:
    """Token ids brought into a vocabulary of ``size`` by remainder."""
    return F.transform(tokens, lambda x: F.pmod(x, F.lit(size)))
