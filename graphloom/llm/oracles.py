"""DuckDB SQL of the queries that SQL can express: exact components, trigram sets and overlaps, for small tables.

DuckDB has canonical normalisation only; of the compatibility characters those of the full-width ASCII range and the micro
sign are mapped.
"""

from __future__ import annotations

from .splits import ABSENT

_SP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def body(c: str) -> str:
    return f"regexp_extract(coalesce({c}, ''), '(?is)^(.*?)(?:(?:^|[\\n\\r])[ \\t]*options:.*)?$', 1)"


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("＇", "") + "\u00b5"
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "") + "\u03bc"


def words(c: str) -> str:
    return f"regexp_extract_all(lower(nfc_normalize(translate({c}, '{_WIDE}', '{_PLAIN}'))), '[\\p{{L}}\\p{{N}}]+')"


def grams(w: str) -> str:
    """Distinct runs of three words of a list."""
    return f"list_distinct(list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2]))"


def blocks_sql() -> str:
    absent = "(" + ", ".join(f"'{x}'" for x in ("", *ABSENT)) + ")"
    return f"""rc AS MATERIALIZED (SELECT record_id, CASE WHEN lower(trim(coalesce(group_id, ''), {_SP})) NOT IN {absent} THEN lower(trim(group_id, {_SP})) END AS g, nullif(array_to_string({words(body('question'))}, ' '), '') AS q FROM qa_records),
 pr AS MATERIALIZED (SELECT DISTINCT g, q FROM rc WHERE g IS NOT NULL AND q IS NOT NULL), fs AS MATERIALIZED (SELECT q, min(g) AS fg FROM pr GROUP BY 1),
 ed AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT g AS a, fg AS b FROM pr JOIN fs USING (q) WHERE g <> fg UNION ALL SELECT fg, g FROM pr JOIN fs USING (q) WHERE g <> fg)),
 rr AS (SELECT DISTINCT a AS g, a AS root FROM ed UNION SELECT ed.b, rr.root FROM rr JOIN ed ON ed.a = rr.g), rt AS MATERIALIZED (SELECT g, min(root) AS root FROM rr GROUP BY 1),
 nd AS (SELECT record_id, q, coalesce(rc.g, fg) AS node FROM rc LEFT JOIN fs USING (q)),
 cm AS (SELECT record_id, CASE WHEN node IS NOT NULL THEN 'g:' || coalesce(root, node) WHEN q IS NOT NULL THEN 'q:' || q ELSE 'r:' || record_id END AS comp FROM nd LEFT JOIN rt ON rt.g = node),
 bl AS MATERIALIZED (SELECT record_id, CASE WHEN starts_with(comp, 'g:') THEN substr(comp, 3) ELSE (min(record_id) OVER (PARTITION BY comp))::VARCHAR END AS block_id, count(*) OVER (PARTITION BY comp) AS n FROM cm)"""


def pairs_sql(num: int = 7, den: int = 10) -> str:
    """CTEs up to cp: a, b, the pairs of distinct trigram sets (by their sorted text) of similarity num/den or more."""
    return f"""rs AS MATERIALIZED (SELECT record_id, list_sort({grams('w')}) AS s FROM (SELECT record_id, {words(body('question') + " || ' ' || coalesce(reasoning, '')")} AS w FROM qa_records)),
 mb AS MATERIALIZED (SELECT record_id, md5(array_to_string(s, '|')) AS cls, len(s) AS n FROM rs WHERE len(s) > 0),
 cs AS MATERIALIZED (SELECT md5(array_to_string(s, '|')) AS cls, any_value(s) AS s, any_value(len(s)) AS n FROM rs WHERE len(s) > 0 GROUP BY 1),
 cg AS MATERIALIZED (SELECT cls, n, unnest(s) AS g FROM cs),
 cp AS MATERIALIZED (SELECT a, b FROM (SELECT x.cls AS a, y.cls AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM cg x JOIN cg y ON x.g = y.g AND x.cls < y.cls AND {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) GROUP BY 1, 2) WHERE {den} * c >= {num} * (na + nb - c))"""


def overlaps_sql() -> str:
    """CTEs up to ov: eval_id, train_table, train_key of the pairs of similarity 0.6 or more."""
    full = lambda q, a: f"{body(q)} || ' ' || coalesce({a}, '')"
    held = "lower(trim(coalesce(split, ''), ' ')) <> 'train'"
    return f"""ew AS MATERIALIZED (SELECT 'qa_records' AS tt, eval_id AS id, {words(body('question'))} AS w FROM eval_examples WHERE {held} UNION ALL SELECT 'eval_examples', eval_id, {words(full('question', 'gold_answer'))} FROM eval_examples WHERE {held}),
 tw AS MATERIALIZED (SELECT 'qa_records' AS tt, record_id AS id, {words(body('question'))} AS w FROM qa_records UNION ALL SELECT 'eval_examples', eval_id, {words(full('question', 'gold_answer'))} FROM eval_examples WHERE NOT ({held})),
 eg AS MATERIALIZED (SELECT tt, id, len(s) AS n, unnest(s) AS g FROM (SELECT tt, id, {grams('w')} AS s FROM ew)), tg AS MATERIALIZED (SELECT tt, id, len(s) AS n, unnest(s) AS g FROM (SELECT tt, id, {grams('w')} AS s FROM tw)),
 ov AS MATERIALIZED (SELECT tt AS train_table, e AS eval_id, t AS train_key FROM (SELECT e.tt, e.id AS e, t.id AS t, any_value(e.n) AS ne, any_value(t.n) AS nt, count(*) AS c FROM eg e JOIN tg t ON e.g = t.g AND e.tt = t.tt GROUP BY 1, 2, 3) WHERE 10 * c >= 6 * (ne + nt - c))"""


def matches_sql() -> str:
    """CTE lm behind ``overlaps_sql``: the longest maximal match of each pair, in words, by runs on diagonals."""
    at = lambda t: f"SELECT tt, id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g, i FROM (SELECT tt, id, w, unnest(range(1, len(w) - 1)) AS i FROM {t})"
    return f"""eo AS MATERIALIZED ({at('ew')}), tp AS MATERIALIZED ({at('tw')}),
 hit AS (SELECT train_table, eval_id, train_key, t.i AS p, t.i - e.i AS diag FROM ov JOIN eo e ON e.tt = train_table AND e.id = eval_id JOIN tp t ON t.tt = train_table AND t.id = train_key AND t.g = e.g),
 isl AS (SELECT *, p - row_number() OVER (PARTITION BY train_table, eval_id, train_key, diag ORDER BY p) AS run FROM hit),
 lm AS (SELECT train_table, eval_id, train_key, max(n) + 2 AS longest FROM (SELECT train_table, eval_id, train_key, diag, run, count(*) AS n FROM isl GROUP BY ALL) GROUP BY 1, 2, 3)"""


def oracle_sql() -> dict[str, str]:
    split = "nullif(lower(trim(split, ' ')), '')"
    return {
        "p1_found": f"WITH RECURSIVE {blocks_sql()} SELECT record_id, block_id FROM bl WHERE n >= 2",
        "p2_found": f"""WITH {pairs_sql()} SELECT least(x, y) AS record_id_a, greatest(x, y) AS record_id_b FROM (SELECT x.record_id AS x, y.record_id AS y FROM cp JOIN mb x ON x.cls = a JOIN mb y ON y.cls = b UNION ALL SELECT x.record_id, y.record_id FROM mb x JOIN mb y ON x.cls = y.cls AND x.record_id < y.record_id)""",
        "p2_classes": f"""WITH {pairs_sql()}, lk AS (SELECT cls, count(*) AS n FROM (SELECT a AS cls FROM cp UNION ALL SELECT b FROM cp) GROUP BY 1)
          SELECT record_id, min(record_id) OVER (PARTITION BY mb.cls) AS class_id, count(*) OVER (PARTITION BY mb.cls) AS n_copies, coalesce(lk.n, 0) AS n_links FROM mb LEFT JOIN lk ON lk.cls = mb.cls UNION ALL SELECT record_id, record_id, 1, 0 FROM rs WHERE len(s) = 0""",
        "p6_found": f"WITH {overlaps_sql()} SELECT eval_id, train_table, train_key FROM ov",
        "p6_report": f"""WITH {overlaps_sql()}, {matches_sql()} SELECT {split} AS split, dataset_name, train_table, count(*) AS n_pairs, count(DISTINCT eval_id) AS n_eval, max(longest)::INT AS longest_match FROM lm JOIN (SELECT eval_id, split, dataset_name FROM eval_examples) USING (eval_id) GROUP BY 1, 2, 3""",
    }
