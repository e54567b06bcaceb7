"""Event-log, split and triage-output queries: the batch twins of the streams, and file layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..session import read
from ..sources import readers
from ..streaming import events as E


def event_windows(spark, d):
    return E.tumbling_latency(read(spark, d, "events"))


def event_sliding(spark, d):
    return E.sliding_counts(read(spark, d, "events"))


def event_sessions(spark, d):
    return E.sessions(read(spark, d, "events"))


def event_layers(spark, d):
    return E.layer_summary(read(spark, d, "events"))


def record_positional_split(spark, d):
    return readers.positional_split(read(spark, d, "qa_records").select("record_id"), "record_id")


def edge_table_layout(spark, d):
    shown = F.when(F.col("row_index") % 5 > 0, F.col("display_relation"))
    t = read(spark, d, "kg_edges").select("row_index", F.col("head").alias("x_id"), F.col("tail").alias("y_id"), F.col("head").alias("x_name"), F.lit(None).cast("string").alias("y_name"), F.lit(" ").alias("x_type"), F.lit("t").alias("y_type"), "relation", shown.alias("display_relation"), F.col("source").alias("resource"), F.when(F.col("row_index") % 7 > 0, F.col("edge_id")).alias("id"), F.array_join("supporting_pmids", ",").alias("pmids"))
    return readers.edges_from_table(t, number="row_index").select("row_index", "edge_id", "head", "tail", "head_name", "tail_name", "head_type", "relation", "display_relation", "source_reliability", F.size("supporting_pmids").alias("n_pmids"))


def two_table_layout(spark, d):
    n = read(spark, d, "kg_nodes")
    ids = n.select(F.lower(F.trim("node_id")).alias("id"), "node_index").groupBy("id").agg(F.min("node_index").alias("i"))
    e = read(spark, d, "kg_edges").select("row_index", F.lower(F.trim("head")).alias("h"), F.lower(F.trim("tail")).alias("t"), "relation", "display_relation")
    e = e.join(ids.select(F.col("id").alias("h"), F.col("i").alias("x_index")), "h", "left").join(ids.select(F.col("id").alias("t"), F.col("i").alias("y_index")), "t", "left").drop("h", "t")
    return readers.edges_from_two_tables(n, e, number="row_index").select("row_index", "edge_id", "head", "tail", "head_name", "relation", "source", "source_reliability")


def article_fields(spark, d):
    a = read(spark, d, "articles")
    year = F.regexp_extract(T.text(F.col("publication_year")), "(?:19|20)[0-9]{2}", 0)
    return a.select("article_row", F.nullif(year, F.lit("")).cast("int").alias("year"), F.coalesce(F.nullif(T.squeeze(T.text(F.col("title"))), F.lit("")), F.lit("untitled")).alias("title"), F.size(F.coalesce("mesh_terms", F.array().cast("array<string>"))).alias("n_mesh"))


def queries():
    return {f.__name__: f for f in (event_windows, event_sliding, event_sessions, event_layers, record_positional_split, edge_table_layout, two_table_layout, article_fields)}


def oracle_sql():
    from ..functions import constants as K
    from . import sql as S

    return {
        "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
        "event_sliding": "SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1",
        "event_sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g)
          SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
        "event_layers": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg(json_extract(props, '$.k')::BIGINT), 6) AS mean_k FROM events GROUP BY 1",
        "record_positional_split": "SELECT record_id, CASE WHEN i < floor(n * 0.9) THEN 'train' WHEN i < floor(n * 0.95) THEN 'validation' ELSE 'test' END AS split FROM (SELECT record_id, row_number() OVER (ORDER BY record_id) - 1 AS i, count(*) OVER () AS n FROM qa_records)",
        "edge_table_layout": f"""SELECT row_index, coalesce(id, h || '|' || r || '|' || t || '|' || row_index) AS edge_id, h AS head, t AS tail, h AS head_name, t AS tail_name, 'other' AS head_type, r AS relation, coalesce(nullif(trim(CASE WHEN row_index % 5 > 0 THEN display_relation END, ' '), ''), replace(r, '_', ' ')) AS display_relation, {S.mapped("lower(s)", K.RELIABILITY, str(K.OTHER_RELIABILITY))}::DOUBLE AS source_reliability, n_pmids
          FROM (SELECT row_index, display_relation, nullif(trim(CASE WHEN row_index % 7 > 0 THEN edge_id END, ' '), '') AS id, coalesce(nullif(trim(head, ' '), ''), 'node:' || row_index || ':head') AS h, coalesce(nullif(trim(tail, ' '), ''), 'node:' || row_index || ':tail') AS t, trim(coalesce(relation, ''), ' ') AS r, coalesce(nullif(trim(source, ' '), ''), 'primekg') AS s,
          len(list_filter(regexp_split_to_array(coalesce(trim(array_to_string(supporting_pmids, ','), ' '), ''), '[|,; ]+'), lambda p: regexp_full_match(p, '[0-9]+')))::INT AS n_pmids FROM kg_edges) WHERE r <> ''""",
        "two_table_layout": f"""WITH n AS (SELECT lower(trim(node_id, ' ')) AS id, min(node_index) AS i FROM kg_nodes GROUP BY 1), m AS (SELECT trim(node_index, ' ') AS i, nullif(trim(node_id, ' '), '') AS id, nullif(trim(node_name, ' '), '') AS name, nullif(trim(node_source, ' '), '') AS src FROM kg_nodes)
          SELECT row_index, h.id || '|' || r || '|' || t.id || '|' || row_index AS edge_id, h.id AS head, t.id AS tail, coalesce(h.name, h.id) AS head_name, r AS relation, coalesce(h.src, t.src, 'primekg') AS source, {S.mapped("lower(coalesce(h.src, t.src, 'primekg'))", K.RELIABILITY, str(K.OTHER_RELIABILITY))}::DOUBLE AS source_reliability
          FROM (SELECT row_index, trim(coalesce(relation, ''), ' ') AS r, a.i AS x, b.i AS y FROM kg_edges JOIN n a ON a.id = lower(trim(head, ' ')) JOIN n b ON b.id = lower(trim(tail, ' '))) JOIN m h ON h.i = x JOIN m t ON t.i = y WHERE r <> ''""",
        "article_fields": f"SELECT article_row, nullif(regexp_extract(coalesce(publication_year, ''), '(?:19|20)[0-9]{{2}}'), '')::INT AS year, coalesce(nullif({S.squeeze(S.txt('title'))}, ''), 'untitled') AS title, coalesce(len(mesh_terms), 0)::INT AS n_mesh FROM articles",
    }
