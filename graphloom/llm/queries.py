"""Queries of the problems tagged llm."""

from __future__ import annotations

from ..session import read
from . import contamination, near_duplicates, oracles, packing, pairs, splits, tokenize, truncation


def p1_found(spark, d):
    return splits.related_records(read(spark, d, "qa_records"))


def p1_splits(spark, d):
    return splits.grouped_splits(read(spark, d, "qa_records"))


def p2_found(spark, d):
    return near_duplicates.similar_pairs(read(spark, d, "qa_records"))


def p2_classes(spark, d):
    return near_duplicates.document_classes(read(spark, d, "qa_records"))


def p5_found(spark, d):
    return pairs.broken_pairs(read(spark, d, "qa_records"))


def p5_counts(spark, d):
    return pairs.defect_counts(read(spark, d, "qa_records"))


def p6_found(spark, d):
    return contamination.cross_split_overlaps(read(spark, d, "eval_examples"), read(spark, d, "qa_records")).select("eval_id", "train_table", "train_key")


def p6_report(spark, d):
    return contamination.overlap_report(read(spark, d, "eval_examples"), read(spark, d, "qa_records"))


def p7_ids(spark, d):
    return tokenize.encode_column(read(spark, d, "documents"), ["doc_id"])


def p8_containers(spark, d):
    return packing.pack_documents(read(spark, d, "documents"), read(spark, d, "pack_sizes"))


def p8_fill(spark, d):
    return packing.fill_report(p8_containers(spark, d), read(spark, d, "pack_sizes"))


def p9_found(spark, d):
    return truncation.score_documents(read(spark, d, "documents")).where("cut").select("doc_id")


def p9_sources(spark, d):
    return truncation.cut_share(read(spark, d, "documents"))


def queries():
    return {f.__name__: f for f in (p1_found, p1_splits, p2_found, p2_classes, p5_found, p5_counts, p6_found, p6_report, p7_ids, p8_containers, p8_fill, p9_found, p9_sources)}


def oracle_sql():
    return oracles.oracle_sql()
