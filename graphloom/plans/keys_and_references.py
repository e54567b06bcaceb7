"""Queries of problems 3 (a few keys hold most rows) and 4 (references to records that do not exist)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edge_keys, references
from ..session import read

_K = "nullif(lower(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"
_KEYED = " UNION ALL ".join(f"SELECT '{c}' AS field, {_K.format(c=c)} AS key_value, source_reliability FROM kg_edges" for c in edge_keys.FIELDS)


def p3_found(spark, d):
    return edge_keys.heavy_edge_keys(read(spark, d, "kg_edges"))


def p3_key_stats(spark, d):
    return edge_keys.edge_key_stats(read(spark, d, "kg_edges")).select("field", "key_value", "n_rows", "n_rated", F.round("mean_reliability", 6).alias("mean_reliability"))


def p3_named_edges(spark, d):
    return edge_keys.edges_with_node_names(read(spark, d, "kg_edges"), read(spark, d, "kg_nodes"))


def _orphans(spark, d):
    return references.find_orphans(read(spark, d, "kg_edges"), read(spark, d, "qa_records"), read(spark, d, "articles"))


def p4_found(spark, d):
    return _orphans(spark, d).select("ref_table", "row_key", "ref_key", "reason")


def p4_report(spark, d):
    return references.orphan_report(_orphans(spark, d))


def p4_current(spark, d):
    return references.current_orphans(references.maintained(read(spark, d, "kg_edges"), read(spark, d, "qa_records"), read(spark, d, "articles"))[1])


_STRIP = "trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"
_PM = f"regexp_replace({_STRIP.format(c='{c}')}, '(?i)^pmid:\\s*', '')"
_ED = "nullif(" + _STRIP.format(c=f"regexp_replace({_STRIP.format(c='{c}')}, '^(edge_id|edge):', '')") + ", '')"
_REFS = f"""
 raw AS (
  SELECT 'kg_edges' AS ref_table, row_index AS row_key, 'articles' AS target, {_PM.format(c='p')} AS ref_key, loaded_at AS ref_time
  FROM (SELECT row_index, loaded_at, unnest(supporting_pmids) AS p FROM kg_edges) WHERE regexp_full_match({_PM.format(c='p')}, '[0-9]+')
  UNION ALL
  SELECT 'qa_records', record_id, 'kg_edges', {_ED.format(c='p')}, created_at
  FROM (SELECT record_id, created_at, unnest(direct_edge_ids) AS p FROM qa_records) WHERE {_ED.format(c='p')} IS NOT NULL),
 refs AS (SELECT DISTINCT * FROM raw),
 tgt AS (
  SELECT 'articles' AS target, {_PM.format(c='pmid')} AS ref_key, min(received_at) AS first_in, min(withdrawn_at) AS first_out, count(*) - count(withdrawn_at) AS existence FROM articles
  WHERE regexp_full_match({_PM.format(c='pmid')}, '[0-9]+') GROUP BY 1, 2
  UNION ALL
  SELECT 'kg_edges', {_ED.format(c='edge_id')}, min(loaded_at), min(retired_at), count(*) - count(retired_at) FROM kg_edges WHERE {_ED.format(c='edge_id')} IS NOT NULL GROUP BY 1, 2),
 orphans AS (
  SELECT ref_table, row_key, r.ref_key, ref_time,
   CASE WHEN t.ref_key IS NULL THEN 'missing' WHEN first_in > ref_time THEN 'late' WHEN first_out <= ref_time THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN tgt t ON r.target = t.target AND r.ref_key = t.ref_key)
"""


def queries():
    return {f.__name__: f for f in (p3_found, p3_key_stats, p3_named_edges, p4_found, p4_report, p4_current)}


def oracle_sql():
    return {
        "p3_found": f"SELECT field, key_value FROM ({_KEYED}) WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.05 * (SELECT count(*) FROM kg_edges)",
        "p3_key_stats": f"SELECT field, key_value, count(*) AS n_rows, count(source_reliability) AS n_rated, round(avg(source_reliability), 6) AS mean_reliability FROM ({_KEYED}) WHERE key_value IS NOT NULL GROUP BY 1, 2",
        "p3_named_edges": f"""WITH n AS (SELECT {_K.format(c='node_id')} AS id, min(node_name) AS name FROM kg_nodes GROUP BY 1)
          SELECT row_index, h.name AS head_name, t.name AS tail_name FROM kg_edges e LEFT JOIN n h ON {_K.format(c='e.head')} = h.id LEFT JOIN n t ON {_K.format(c='e.tail')} = t.id""",
        "p4_found": f"WITH {_REFS} SELECT ref_table, row_key, ref_key, reason FROM orphans WHERE reason IS NOT NULL",
        "p4_report": f"""WITH {_REFS} SELECT ref_table, strftime(ref_time, '%Y-%m') AS month, reason, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys
          FROM orphans WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
        "p4_current": f"""WITH {_REFS} SELECT r.target, r.ref_key, count(*) AS refs, CASE WHEN any_value(t.ref_key) IS NULL THEN 'missing' ELSE 'deleted' END AS reason
          FROM refs r LEFT JOIN tgt t ON r.target = t.target AND r.ref_key = t.ref_key GROUP BY 1, 2 HAVING any_value(t.ref_key) IS NULL OR any_value(t.existence) <= 0""",
    }
