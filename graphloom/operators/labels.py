"""Training rows from gold paths: token rows, labels, their statistics and accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .quality import IGNORE, LABEL_TOKENS

PAD = "__pad__"


def ranked_tokens(nodes: DataFrame, passages: DataFrame, most: int = LABEL_TOKENS) -> DataFrame:
    """k, pos, item, score: nodes (k, node, score) and passages (k, pmid, score) in one order by score, then name; the first ``most``."""
    both = nodes.select("k", F.col("node").alias("item"), "score").unionByName(passages.select("k", F.concat(F.lit("PMID:"), "pmid").alias("item"), "score"))
    w = Window.partitionBy("k").orderBy(F.desc("score"), "item")
    return both.withColumn("pos", F.row_number().over(w) - 1).where(F.col("pos") < most).select("k", "pos", "item", "score")


def token_rows(items: DataFrame, pad: int, width: int = LABEL_TOKENS) -> DataFrame:
    """k, inputs (array<bigint> of ``width``), items (array<string>): tokens by position, padded.  ``items``: k, pos, item, token."""
    g = items.where(F.col("pos") < width).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "item"))).alias("l"))
    fill = lambda c, v, kind: F.slice(F.concat(c, F.array_repeat(F.lit(v).cast(kind), width)), 1, width)
    return g.select("k", fill(F.transform("l", lambda x: x["token"].cast("bigint")), pad, "bigint").alias("inputs"), fill(F.transform("l", lambda x: x["item"]), PAD, "string").alias("items"))


def filled(c: Column, value, kind: str, width: int | Column = LABEL_TOKENS) -> Column:
    """The array's first ``width`` entries, with ``value`` for those that it lacks (``width`` at most LABEL_TOKENS)."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(value).cast(kind), LABEL_TOKENS)), F.lit(1), width if isinstance(width, Column) else F.lit(width))


def tokens_in_order(items: DataFrame) -> DataFrame:
    """k, tokens (array<bigint>) by position, not filled.  ``items``: k, pos, token, positions from 0 without a gap."""
    g = items.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("token").cast("bigint").alias("token")))).alias("l"))
    return g.select("k", F.transform("l", lambda x: x["token"]).alias("tokens"))


def unfilled(rows: DataFrame) -> DataFrame:
    """k, labels without IGNORE."""
    return rows.select("k", F.filter("labels", lambda x: x != IGNORE).alias("labels"))


def path_labels(paths: DataFrame, items: DataFrame, width: int = LABEL_TOKENS) -> DataFrame:
    """k, labels, source_positions, labelled, missing of each gold path.

    ``paths`` has k and path (nodes in order), ``items`` k, pos, item, token.  A node's token is that of its first
    position; passages and padding are no nodes.  Labels are the tokens of the path's nodes that have one, in the path's
    order, filled with IGNORE; at most ``width``.  A path without a node has no row.
    """
    first = items.where(~F.col("item").startswith("PMID:") & (F.col("item") != PAD)).groupBy("k", F.col("item").alias("node")).agg(F.min_by(F.struct("pos", F.col("token").cast("bigint").alias("token")), "pos").alias("t"))
    steps = paths.select("k", F.posexplode("path").alias("step", "node")).join(first, ["k", "node"], "left")
    g = steps.groupBy("k").agg(
        F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("step", F.col("t.pos").alias("pos"), F.col("t.token").alias("token"))))).alias("l"),
        F.array_sort(F.collect_list(F.when(F.col("t").isNull(), F.struct("step", "node")))).alias("m"),
    )
    found = F.slice("l", 1, width)
    labels = F.slice(F.concat(F.transform(found, lambda x: x["token"]), F.array_repeat(F.lit(IGNORE).cast("bigint"), width)), 1, width)
    return g.select("k", labels.alias("labels"), F.transform(found, lambda x: x["pos"]).alias("source_positions"), F.size(found).alias("labelled"), F.array_distinct(F.transform("m", lambda x: x["node"])).alias("missing"))


def reduced_tokens(items: DataFrame, keep: int, pad: int) -> DataFrame:
    """``items`` (k, pos, item, token) with all but the first ``keep`` positions that are no padding turned into padding."""
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    active = F.count_if(F.col("item") != PAD).over(w)
    cut = (F.col("item") != PAD) & (active > keep)
    return items.withColumn("_c", cut).select("k", "pos", F.when(F.col("_c"), PAD).otherwise(F.col("item")).alias("item"), F.when(F.col("_c"), pad).otherwise(F.col("token")).alias("token"))


def token_types(items: DataFrame) -> DataFrame:
    """k, nodes, passages, pads, others of each row of tokens."""
    i = F.col("item")
    return items.groupBy("k").agg(
        F.count_if((i != PAD) & (i != "") & ~i.startswith("PMID:")).alias("nodes"), F.count_if(i.startswith("PMID:")).alias("passages"), F.count_if(i == PAD).alias("pads"), F.count_if((i == "") | i.isNull()).alias("others")
    )


def puzzle_id(question_type: Column) -> Column:
    out = F.lit(4)
    for n, t in K.PUZZLES.items():
        out = F.when(question_type == t, n).otherwise(out)
    return out


def graph_stats(rows: DataFrame) -> DataFrame:
    """One row over examples (n_edges, n_nodes, n_passages, n_gold, labelled): counts, means, maxima, the share rejected.

    An example without a gold edge or without a labelled token is rejected.
    """
    bad = (F.col("n_gold") == 0) | (F.col("labelled") == 0)
    mean, most = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6), lambda c: F.coalesce(F.max(c), F.lit(0)).cast("bigint")
    kept = lambda c: F.when(~bad, F.col(c))
    return rows.agg(
        F.count("*").alias("examples_seen"), F.count_if(~bad).alias("examples_saved"), F.count_if(bad).alias("examples_skipped"), F.round(F.coalesce(F.count_if(bad) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("reject_rate"),
        mean("n_edges").alias("mean_edge_count"), most("n_edges").alias("max_edge_count"), mean("n_nodes").alias("mean_node_count"), most("n_nodes").alias("max_node_count"), mean("n_passages").alias("mean_passage_count"),
        mean("n_gold").alias("mean_gold_path_length"), mean(kept("labelled")).alias("mean_labelled_count"), most(kept("labelled")).alias("max_labelled_count"),
    )


def label_stats(rows: DataFrame) -> DataFrame:
    """examples, valid_label_tokens, mean_valid_label_tokens, puzzle_ids of rows with labels (array) and puzzle_id."""
    n = F.size(F.filter("labels", lambda x: x != IGNORE))
    return rows.agg(F.count("*").alias("examples"), F.coalesce(F.sum(n), F.lit(0)).alias("valid_label_tokens"), F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias("mean_valid_label_tokens"), F.array_sort(F.collect_set("puzzle_id")).alias("puzzle_ids"))


def accuracies(rows: DataFrame, predicted: str = "predicted", labels: str = "labels") -> DataFrame:
    """token_accuracy (weighted by labelled tokens), sequence_accuracy, tokens; a row without labels counts as correct."""
    z = F.filter(F.arrays_zip(F.col(predicted).alias("p"), F.col(labels).alias("l")), lambda x: x["l"] != IGNORE)
    right = F.size(F.filter(z, lambda x: x["p"] == x["l"]))
    x = rows.select(F.size(z).alias("n"), right.alias("r"))
    return x.agg(F.round(F.coalesce(F.sum("r") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)), 6).alias("token_accuracy"), F.round(F.coalesce(F.avg((F.col("n") == F.col("r")).cast("double")), F.lit(0.0)), 6).alias("sequence_accuracy"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
