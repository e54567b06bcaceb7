"""Evidence bundles of records: the edges they name and the articles that support those edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import edge_id, pmid
from .skew import heavy_light_join


def named_edges(records: DataFrame) -> DataFrame:
    """k, pos, edge_id: the distinct canonical edge ids of each record (record_id, direct_edge_ids), in order."""
    ids = F.array_distinct(F.filter(F.transform("direct_edge_ids", edge_id), lambda x: x.isNotNull()))
    return records.select(F.col("record_id").alias("k"), F.posexplode(ids).alias("pos", "edge_id"))


def bundle_edges(records: DataFrame, edges: DataFrame) -> DataFrame:
    """k, pos and the edge's columns for each named edge that exists."""
    return heavy_light_join(named_edges(records), edges, ["edge_id"])


def canonical_articles(articles: DataFrame) -> DataFrame:
    """pmid, title, abstract: the last delivery of each article with a readable id."""
    a = articles.select(pmid(F.col("pmid")).alias("pmid"), "title", "abstract", "article_row").where("pmid is not null")
    last = a.groupBy("pmid").agg(F.max_by(F.struct("title", "abstract"), "article_row").alias("a"))
    return last.select("pmid", "a.title", "a.abstract")


def bundle_passages(edges_of: DataFrame, articles: DataFrame) -> DataFrame:
    """k, pos, pmid, title, abstract: the articles that the bundle's edges cite, ordered by their number."""
    p = edges_of.select("k", F.explode("pmids").alias("pmid")).distinct()
    return heavy_light_join(p, articles, ["pmid"]).select("k", F.coalesce(F.col("pmid").try_cast("bigint"), F.lit(0)).alias("pos"), "pmid", "title", "abstract")
