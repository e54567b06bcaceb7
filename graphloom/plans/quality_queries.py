"""Metric, quality, triage and reasoning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.keys import edge_id
from ..operators import bundles as B
from ..operators import graph, metrics, quality, reasoning, triage
from ..session import read
from ..workspace import Workspace
from . import sql as S
from .evidence_queries import BUNDLE, _Bundles
from .graph_queries import EDGES, rank_ctes, record_evidence_ctes
from .text_queries import _CLOSE, _SAME, _numbers


def exact_match(spark, d):
    r = read(spark, d, "qa_records")
    hit = T.answer(F.col("answer")) == T.answer(F.col("reasoning"))
    return r.groupBy("dataset_name").agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("double")), 6).alias("exact_match"))


def _labels(spark, d):
    e = read(spark, d, "eval_examples")
    return e.select("eval_id", T.label(T.decision(F.col("gold_answer"))).alias("gold"), T.label(T.decision(F.try_element_at("gold_claims", F.lit(1)))).alias("predicted"))


def label_f1(spark, d):
    return metrics.label_scores(_labels(spark, d), "predicted", "gold").withColumn("f1", F.round("f1", 6))


def macro_f1(spark, d):
    return metrics.macro_f1(_labels(spark, d), "predicted", "gold").select(F.round("macro_f1", 6).alias("macro_f1"))


def edge_set_scores(spark, d):
    r = read(spark, d, "qa_records")
    gold = F.filter(F.transform(F.coalesce("direct_edge_ids", F.array().cast("array<string>")), edge_id), lambda x: x.isNotNull())
    rcs, rns, both = metrics.set_scores(metrics.reasoning_edge_ids(F.col("reasoning")), gold)
    return r.select("record_id", F.round(rcs, 6).alias("rcs"), F.round(rns, 6).alias("rns"), both.alias("shared"))


def hallucination_f1(spark, d):
    e = read(spark, d, "eval_examples").select(T.claims(F.col("gold_answer")).alias("predicted"), "gold_claims", F.col("context").alias("supported"))
    return metrics.hallucination_scores(e, "supported", "predicted", "gold_claims")


def answer_faithfulness(spark, d):
    e = metrics.faithfulness(read(spark, d, "eval_examples"), "gold_answer", "context")
    return e.select("eval_id", F.round("faithfulness", 6).alias("faithfulness"))


def mcnemar(spark, d):
    x = read(spark, d, "qa_records").select((F.length(T.text(F.col("answer"))) > 20).alias("a"), (F.size(T.claims(F.col("reasoning"))) > 3).alias("b"))
    return metrics.mcnemar(x, "a", "b").select("only_a", "only_b", F.round("chi_square", 6).alias("chi_square"))


def mcnemar_p(spark, d):
    x = read(spark, d, "qa_records").select((F.length(T.text(F.col("answer"))) > 20).alias("a"), (F.size(T.claims(F.col("reasoning"))) > 3).alias("b"))
    return metrics.mcnemar(x, "a", "b").select("only_a", "only_b", F.round("chi_square", 6).alias("chi_square"), F.round("p_value", 6).alias("p_value"))


def bootstrap_interval(spark, d):
    return metrics.bootstrap_mean(read(spark, d, "events").select(F.col("event_id").alias("row_key"), "value"), "value")


def latency_percentiles(spark, d):
    return metrics.percentiles(read(spark, d, "events"), "value", ["event_type"])


def _paths(spark, d, name):
    work = Workspace(spark, name)
    records = read(spark, d, "qa_records")
    edges = work.keep(graph.graph_edges(read(spark, d, "kg_edges")), "edges")
    return work, records, edges, quality.gold_paths(records, edges)


def gold_paths(spark, d):
    return _paths(spark, d, "gold")[3].select("k", "n_gold", "n_covered", F.array_join("missing", ",").alias("missing"), F.array_join("path", ">").alias("path"))


def _evidence(spark, d, name):
    work = Workspace(spark, name)
    records = read(spark, d, "qa_records")
    edges = work.keep(graph.graph_edges(read(spark, d, "kg_edges")), "edges")
    return work, records, *triage.record_evidence(records, read(spark, d, "kg_nodes"), edges, work)


def _tiered(spark, d):
    work, records, seeds, evidence = _evidence(spark, d, "tiers")
    c = triage.record_coverage(records, seeds, evidence, work)
    return quality.tiers(c, F.col("n_evidence"), F.lit("direct"), F.lit("scispacy_umls"), F.lit("edge_node_csv"), F.col("has_seeds"))


def record_tiers(spark, d):
    return _tiered(spark, d).select("k", F.round("edge_coverage", 6).alias("edge_coverage"), F.round("node_coverage", 6).alias("node_coverage"), F.round("label_ratio", 6).alias("label_ratio"), "tier", F.array_join("reasons", ",").alias("reasons"))


def tier_summary(spark, d):
    return quality.tier_summary(_tiered(spark, d))


def tier_reasons(spark, d):
    return quality.tier_reasons(_tiered(spark, d))


def top_failure_reasons(spark, d):
    return quality.top_reasons(_tiered(spark, d))


def edge_mapping_scores(spark, d):
    _, records, _, evidence = _evidence(spark, d, "mapping")
    return quality.score_edges_against_text(evidence, records)


def mapped_edges(spark, d):
    return quality.mapped_edges(edge_mapping_scores(spark, d)).select("k", F.array_join("edge_ids", ",").alias("edge_ids"))


def triage_buckets(spark, d):
    work = Workspace(spark, "triage")
    edges = work.keep(graph.graph_edges(read(spark, d, "kg_edges")), "edges")
    return quality.sample_summary(triage.triage_passes(read(spark, d, "qa_records"), read(spark, d, "kg_nodes"), edges, work))


def _decoded(spark, d, name):
    x = _Bundles(spark, d, name)
    ends = x.edges.select("k", F.explode(F.array("head", "tail")).alias("node"))
    n = ends.groupBy("k", "node").agg(F.count("*").alias("n"))
    best = n.groupBy("k").agg(F.max("n").alias("m"))
    return x, reasoning.decode_paths(n.join(best, "k").select("k", "node", (F.col("n") / F.col("m")).alias("score")), x.edges, x.work)


def decoded_paths(spark, d):
    p = _decoded(spark, d, "decode")[1]
    return p.select("k", "rank", F.array_join("nodes", ">").alias("nodes"), F.array_join("edges", ",").alias("edges"), F.round("confidence", 6).alias("confidence"), F.round("ranking", 6).alias("ranking"))


def path_answers(spark, d):
    x, p = _decoded(spark, d, "answers")
    return reasoning.answer_text(x.work.keep(p, "paths"), x.work.keep(graph.graph_edges(read(spark, d, "kg_edges")), "all")).select("k", "answer", F.round("confidence", 6).alias("confidence"))


def passage_contradictions(spark, d):
    x = _Bundles(spark, d, "clash")
    return reasoning.contradiction_scores(x.edges, x.passages)


def enforced_answers(spark, d):
    x = _Bundles(spark, d, "enforce")
    tags = x.edges.select("k", F.concat(F.lit("edge:"), "edge_id").alias("tag")).unionByName(x.passages.select("k", F.concat(F.lit("PMID:"), "pmid").alias("tag"))).groupBy("k").agg(F.collect_set("tag").alias("allowed"))
    j = x.records.select(F.col("record_id").alias("k"), "answer").join(tags, "k", "left")
    return j.select("k", reasoning.enforce_provenance(F.col("answer"), F.coalesce("allowed", F.array().cast("array<string>"))).alias("answer"))


def queries():
    return {f.__name__: f for f in (exact_match, label_f1, macro_f1, edge_set_scores, hallucination_f1, answer_faithfulness, mcnemar, mcnemar_p, bootstrap_interval, latency_percentiles, gold_paths, record_tiers, tier_summary, tier_reasons, top_failure_reasons, edge_mapping_scores, mapped_edges, triage_buckets, decoded_paths, path_answers, passage_contradictions, enforced_answers)}


_LAB = f"lb AS (SELECT eval_id, {S.label('g')} AS gold, {S.label('p')} AS predicted FROM (SELECT eval_id, {S.answer('g')} AS g, {S.answer('p')} AS p FROM (SELECT eval_id, {S.decision('gold_answer')} AS g, {S.decision('gold_claims[1]')} AS p FROM eval_examples)))"
_LS = f"WITH {_LAB}, e AS (SELECT gold, predicted, unnest(list_distinct([gold, predicted])) AS label FROM lb), n AS (SELECT label, count(*) FILTER (predicted = label AND gold = label) AS tp, count(*) FILTER (predicted = label AND gold <> label) AS fp, count(*) FILTER (predicted <> label AND gold = label) AS fn FROM e GROUP BY 1), f AS (SELECT *, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM n)"
_GP = f"""{EDGES},
 nm0 AS (SELECT record_id AS k, list_filter(list_transform(coalesce(direct_edge_ids, []::VARCHAR[]), lambda x: {S.edge_id('x')}), lambda x: x IS NOT NULL) AS l FROM qa_records),
 nm AS MATERIALIZED (SELECT k, edge_id, min(i) AS pos FROM (SELECT k, unnest(l) AS edge_id, unnest(range(len(l))) AS i FROM nm0) GROUP BY 1, 2),
 gp AS (SELECT nm.k, count(*) AS n_gold, count(e.head) AS n_covered, list(nm.edge_id ORDER BY pos) FILTER (e.head IS NULL) AS missing FROM nm LEFT JOIN e USING (edge_id) GROUP BY 1)"""
_AL = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _erfc(z):
    """The complementary error function by its continued fraction for z above 2, by its series below."""
    series = f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: pow(-1, n) * pow({z}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))))"
    frac = z
    for n in range(40, 0, -1):
        frac = f"({z} + {n / 2} / {frac})"
    return f"CASE WHEN {z} < 2 THEN {series} ELSE exp(-{z} * {z}) / sqrt(pi()) / {frac} END"


def node_path_sql(edges):
    """The nodes along a list of [head, tail] lists, as ``quality.node_path`` walks them."""
    touches = lambda n: f"coalesce({edges}[2][1] = {n} OR {edges}[2][2] = {n}, false)"
    start = f"CASE WHEN len({edges}) > 1 AND {touches(f'{edges}[1][1]')} AND NOT {touches(f'{edges}[1][2]')} THEN [{edges}[1][2], {edges}[1][1]] ELSE {edges}[1] END"
    once = lambda l: f"CASE WHEN {l}[1] = {l}[2] THEN [{l}[1]] ELSE {l} END"
    step = f"list_concat(p, list_filter(CASE WHEN x[1] = p[-1] THEN [x[2]] WHEN x[2] = p[-1] THEN [x[1]] ELSE {once('x')} END, lambda n, i: i > 1 OR n <> p[-1]))"
    return f"CASE WHEN len({edges}) = 0 THEN []::VARCHAR[] ELSE list_reduce(list_prepend({once(f'({start})')}, {edges}[2:]), lambda p, x: {step}) END"


def gold_ctes():
    """CTEs up to gpath: k, n_gold, n_covered, missing, path of each record by the edges it names."""
    return f"""{_GP}, gfound AS (SELECT nm.k, list([e.head, e.tail] ORDER BY pos) AS l FROM nm JOIN e USING (edge_id) GROUP BY 1),
 gpath AS MATERIALIZED (SELECT r.k, coalesce(n_gold, 0) AS n_gold, coalesce(n_covered, 0) AS n_covered, coalesce(missing, []::VARCHAR[]) AS missing, CASE WHEN l IS NULL THEN []::VARCHAR[] ELSE {node_path_sql('l')} END AS path
   FROM (SELECT DISTINCT record_id AS k FROM qa_records) r LEFT JOIN gp ON gp.k = r.k LEFT JOIN gfound ON gfound.k = r.k)"""


def _score_sql():
    """CTE es (k, edge_id, score, first_pos): each edge of the evidence against its record's text, behind ``record_evidence_ctes``."""
    longer = lambda c: f"list_filter(string_split({c}, ' '), lambda w: length(w) > 2)"
    got = lambda c: f"list_filter({longer(c)}, lambda w: contains(t, w))"
    score = lambda c: f"CASE WHEN {c} = '' THEN 0.0 WHEN contains(t, {c}) THEN 1.0 WHEN len({longer(c)}) > 0 THEN len({got(c)}) / len({longer(c)})::DOUBLE ELSE 0.0 END"
    pos = lambda c: f"CASE WHEN {c} = '' THEN length(t) WHEN contains(t, {c}) THEN strpos(t, {c}) - 1 ELSE coalesce(list_min(list_transform({got(c)}, lambda w: strpos(t, w) - 1)), length(t)) END"
    lit = "id <> '' AND contains(t, id)"
    cited = "list_filter(pmids, lambda p: contains(t, p))"
    return f"""tx2 AS MATERIALIZED (SELECT record_id AS k, {_AL("concat_ws(' ', question, answer, reasoning)")} AS t FROM qa_records),
 es0 AS (SELECT ev2.k, edge_id, {_AL('edge_id')} AS id, {_AL(S.humanized('head'))} AS h, {_AL(S.humanized('tail'))} AS ta, {_AL("CASE WHEN display_relation <> '' THEN display_relation ELSE relation END")} AS r, {_AL('relation')} AS rr, pmids, t FROM ev2 JOIN tx2 USING (k)),
 es AS MATERIALIZED (SELECT k, edge_id, round(CASE WHEN {lit} THEN 100.0 ELSE 0.0 END + 2.0 * {score('h')} + 2.0 * {score('ta')} + {score('r')} + least(0.3 * len({got('rr')}), 1.2) + len({cited}), 6)::DOUBLE AS score,
   least(length(t), {pos('h')}, {pos('ta')}, {pos('r')}, CASE WHEN {lit} THEN strpos(t, id) - 1 ELSE length(t) END, coalesce(list_min(list_transform({cited}, lambda p: strpos(t, p) - 1)), length(t)))::INT AS first_pos FROM es0)"""


def _tiers_sql():
    """CTEs up to td: the tier of each record by the evidence retrieved for its question."""
    edges = "list([head, tail] ORDER BY pos)"
    return f"""WITH RECURSIVE {record_evidence_ctes()}, {_score_sql()},
 nm0 AS (SELECT record_id AS k, list_filter(list_transform(coalesce(direct_edge_ids, []::VARCHAR[]), lambda x: {S.edge_id('x')}), lambda x: x IS NOT NULL) AS l FROM qa_records),
 nm AS MATERIALIZED (SELECT k, edge_id, min(i) AS pos FROM (SELECT k, unnest(l) AS edge_id, unnest(range(len(l))) AS i FROM nm0) GROUP BY 1, 2),
 gd AS MATERIALIZED (SELECT k, edge_id, pos FROM nm UNION ALL SELECT k, edge_id, row_number() OVER (PARTITION BY k ORDER BY first_pos, -score, edge_id) FROM es ANTI JOIN nm USING (k) WHERE score >= 3.0),
 gg AS (SELECT gd.k, count(*) AS n_gold, count(head) AS n_covered, count(*) - count(head) AS n_missing FROM gd LEFT JOIN ev2 ON ev2.k = gd.k AND ev2.edge_id = gd.edge_id GROUP BY 1),
 gl AS (SELECT k, {node_path_sql('l')} AS path FROM (SELECT gd.k, {edges} AS l FROM gd JOIN ev2 ON ev2.k = gd.k AND ev2.edge_id = gd.edge_id GROUP BY 1)),
 en AS MATERIALIZED (SELECT DISTINCT k, unnest([head, tail]) AS node FROM ev2), mk AS MATERIALIZED (SELECT k FROM en GROUP BY 1 HAVING count(*) > 256),
 w2 AS MATERIALIZED (SELECT DISTINCT k, head, tail, 1 AS weight FROM ev2 SEMI JOIN mk USING (k)), {rank_ctes('z', 'w2', 'seeds')},
 sl AS MATERIALIZED (SELECT k, node FROM en ANTI JOIN mk USING (k) UNION ALL SELECT k, node FROM (SELECT k, node FROM prz QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(score, 9) DESC, node) <= 256)),
 gn2 AS (SELECT DISTINCT k, unnest(path) AS node FROM gl), nl AS (SELECT g.k, count(*) AS n_nodes, count(e.node) AS n_present, count(s.node) AS n_labelled, count(*) FILTER (e.node IS NOT NULL AND s.node IS NULL) AS n_pruned FROM gn2 g LEFT JOIN en e ON e.k = g.k AND e.node = g.node LEFT JOIN sl s ON s.k = g.k AND s.node = g.node GROUP BY 1),
 c2 AS (SELECT r.k, coalesce(n_gold, 0) AS n_gold, coalesce(n_covered, 0) AS n_covered, coalesce(n_missing, 0) AS n_missing, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_present, 0) AS n_present, coalesce(n_labelled, 0) AS n_labelled, coalesce(n_pruned, 0) AS n_pruned, coalesce(ne, 0) AS n_ev, r.k IN (SELECT k FROM seeds) AS seeded
   FROM (SELECT DISTINCT record_id AS k FROM qa_records) r LEFT JOIN gg ON gg.k = r.k LEFT JOIN nl ON nl.k = r.k LEFT JOIN (SELECT k, count(*) AS ne FROM ev2 GROUP BY 1) x ON x.k = r.k),
 d2 AS (SELECT *, CASE WHEN n_gold > 0 THEN n_covered / n_gold::DOUBLE ELSE 0.0 END AS edge_coverage, CASE WHEN n_nodes > 0 THEN n_present / n_nodes::DOUBLE ELSE 0.0 END AS node_coverage, CASE WHEN n_nodes > 0 THEN n_labelled / n_nodes::DOUBLE ELSE 0.0 END AS label_ratio,
   CASE WHEN n_gold = 0 THEN 'empty_gold_path' WHEN n_missing > 0 THEN 'missing_edge_mapping' WHEN n_pruned > 0 THEN 'missing_due_to_ppr_pruning' WHEN n_present < n_nodes OR NOT seeded THEN 'missing_entity_link' ELSE 'insufficient_gold_path_coverage' END AS cause FROM c2),
 r2 AS (SELECT *, list_filter([CASE WHEN n_gold < 1 THEN 'empty_gold_path' END, CASE WHEN n_ev = 0 THEN 'missing_evidence_edges' END, CASE WHEN n_labelled = 0 THEN cause END], lambda x: x IS NOT NULL) AS r,
   list_filter([CASE WHEN edge_coverage < 1.0 THEN cause END, CASE WHEN edge_coverage < 1.0 THEN 'gold_edge_coverage_below_threshold' END, CASE WHEN node_coverage < 0.8 THEN cause END, CASE WHEN node_coverage < 0.8 THEN 'gold_node_coverage_below_threshold' END, CASE WHEN label_ratio < 0.8 THEN cause END, CASE WHEN label_ratio < 0.8 THEN 'labeled_token_ratio_below_threshold' END], lambda x: x IS NOT NULL) AS s FROM d2),
 td AS (SELECT *, CASE WHEN len(r) > 0 THEN 'reject' WHEN len(s) > 0 THEN 'silver' ELSE 'goldish' END AS tier, CASE WHEN len(r) > 0 THEN {S.distinct('r')} WHEN len(s) > 0 THEN {S.distinct('s')} ELSE ['passed_goldish_gate'] END AS reasons FROM r2)"""


def faithful(table, id_, answer):
    """fa (id, faithfulness): claims of an answer column that a chunk of the table's context supports."""
    pat = r"\b([A-Za-z][A-Za-z -]{2,})[ \t\n\r\f]*\(([A-Za-z0-9-]{2,10})\)"
    fixed = "[" + ", ".join(S.q(f"{a}\x01{b}") for a, b in K.ABBREVIATIONS.items()) + "]"
    return f"""fa0 AS MATERIALIZED (SELECT {id_}, {S.txt(answer)} AS a, {S.claims(answer)} AS c, list_filter(coalesce(context, []::VARCHAR[]), lambda x: trim(coalesce(x, ''), ' ') <> '') AS x FROM {table}),
 fa1 AS (SELECT *, list_concat({fixed}, list_transform(flatten(list_transform(list_concat([a], x), lambda t: regexp_extract_all(t, '{pat}'))), lambda m: lower(regexp_extract(m, '{pat}', 2)) || chr(1) || {S.squeeze(f"lower(regexp_extract(m, '{pat}', 1))")})) AS e FROM fa0),
 fa2 AS MATERIALIZED (SELECT {id_}, c, x, list_transform({S.distinct("list_transform(e, lambda y: split_part(y, chr(1), 1))")}, lambda n: list_filter(e, lambda y: split_part(y, chr(1), 1) = n)[-1]) AS e FROM fa1),
 fa3 AS (SELECT {id_}, i, side, {S.squeeze("list_reduce(list_prepend(t, e), lambda a, y: regexp_replace(a, '\\b' || split_part(y, chr(1), 1) || '\\b', split_part(y, chr(1), 2), 'g'))")} AS t
   FROM (SELECT {id_}, i, 0 AS side, e, {S.answer('v')} AS t FROM (SELECT {id_}, e, unnest(c) AS v, unnest(range(len(c))) AS i FROM fa2) UNION ALL SELECT {id_}, i, 1, e, {S.answer('v')} FROM (SELECT {id_}, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM fa2))),
 fa4 AS MATERIALIZED (SELECT {id_}, i, side, {S.tokens('t')} AS w, {_numbers('t')} AS n, {S.has_any('t', K.POSITIVE_CUES)} AS p, {S.has_any('t', K.NEGATIVE_CUES)} AS m FROM fa3),
 fa5 AS (SELECT DISTINCT c.{id_}, c.i FROM fa4 c JOIN fa4 x ON c.{id_} = x.{id_} AND c.side = 0 AND x.side = 1 WHERE len(c.w) > 0 AND ({S.overlap('c.w', 'x.w')}) >= {K.LEXICAL_SUPPORT} AND len(list_filter(c.n, lambda x1: len(list_filter(x.n, lambda y1: {_SAME.replace('x.', 'x1.').replace('y.', 'y1.')} AND {_CLOSE.replace('x.', 'x1.').replace('y.', 'y1.')})) = 0)) = 0
   AND NOT (list_has_any(c.w, x.w) AND ((c.p AND x.m) OR (c.m AND x.p))) AND len(list_filter(c.n, lambda x1: len(list_filter(x.n, lambda y1: {_SAME.replace('x.', 'x1.').replace('y.', 'y1.')} AND NOT {_CLOSE.replace('x.', 'x1.').replace('y.', 'y1.')})) > 0)) = 0),
 fa AS MATERIALIZED (SELECT fa2.{id_}, CASE WHEN len(c) = 0 THEN 1.0 WHEN len(x) = 0 THEN 0.0 ELSE coalesce(n, 0) / len(c)::DOUBLE END AS faithfulness FROM fa2 LEFT JOIN (SELECT {id_}, count(*) AS n FROM fa5 GROUP BY 1) USING ({id_}))"""


def decoded_ctes():
    """CTEs up to rk: k, rank, nodes, edges, confidence, ranking of the best paths."""
    grow = "".join(
        f""",
 g{i} AS (SELECT b.k, list_append(b.nodes, s.tail) AS nodes, list_append(b.edges, s.edge_id) AS edges, list_append(b.weights, s.weight) AS weights, s.end_score FROM b{i - 1} b JOIN dst s ON s.k = b.k AND s.head = b.nodes[-1] WHERE NOT list_contains(b.nodes, s.tail)),
 p{i} AS MATERIALIZED (SELECT k, nodes, edges, weights, round(conf * end_score, 12) AS ranking, conf AS confidence FROM (SELECT *, round({'weights[1]' if i == 1 else 'weights[1] * weights[2]' if i == 2 else 'weights[1] * weights[2] * weights[3] * weights[1] * weights[3]'}, 12) AS conf FROM g{i})),
 b{i} AS (SELECT * FROM p{i} QUALIFY row_number() OVER (PARTITION BY k ORDER BY ranking DESC, nodes, edges) <= {reasoning.BEAM})"""
        for i in range(1, reasoning.EDGES_MOST + 1)
    )
    every = " UNION ALL ".join(f"SELECT k, nodes, edges, confidence, ranking FROM {t}" for t in ("b0", "p1", "p2", "p3"))
    return f"""{BUNDLE}, dn AS (SELECT k, node, count(*) AS n FROM (SELECT k, unnest([head, tail]) AS node FROM be) GROUP BY 1, 2), dsc AS (SELECT k, node, n / (max(n) OVER (PARTITION BY k))::DOUBLE AS score FROM dn),
 ca AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, node) AS r FROM dsc QUALIFY r <= {reasoning.CANDIDATES}),
 dst AS MATERIALIZED (SELECT be.k, be.edge_id, be.head, be.tail, reliability * confidence AS weight, ca.score AS end_score FROM be JOIN ca ON ca.k = be.k AND ca.node = be.tail),
 b0 AS (SELECT k, [node] AS nodes, []::VARCHAR[] AS edges, []::DOUBLE[] AS weights, score AS ranking, score AS confidence FROM ca WHERE r <= {reasoning.BEAM}){grow},
 dal AS ({every}), rk AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY len(edges) DESC, ranking DESC, confidence DESC, nodes, edges))::INT AS rank FROM dal QUALIFY rank <= {reasoning.TOP_PATHS})"""


def oracle_sql():
    eid = f"list_filter(list_transform(coalesce(direct_edge_ids, []::VARCHAR[]), lambda x: {S.edge_id('x')}), lambda x: x IS NOT NULL)"
    named = f"list_filter(list_transform(regexp_extract_all(coalesce(reasoning, ''), 'E_[0-9]+[A-Za-z]?|(?:edge_id|edge):[A-Za-z0-9_:|.-]+'), lambda x: {S.edge_id('x')}), lambda x: x IS NOT NULL)"
    jc = f"list_filter(list_transform({S.sentences('trim(' + S.txt('answer') + ', chr(32))')}, lambda s: trim(s, ' ')), lambda s: s <> '')"
    return {
        "exact_match": f"SELECT dataset_name, count(*) AS n, round(avg(({S.answer('answer')} = {S.answer('reasoning')})::INT), 6) AS exact_match FROM qa_records GROUP BY 1",
        "label_f1": f"{_LS} SELECT label, tp, fp, fn, round(f1, 6) AS f1 FROM f",
        "macro_f1": f"{_LS} SELECT round(coalesce(avg(f1), 0.0), 6) AS macro_f1 FROM f",
        "edge_set_scores": f"""SELECT record_id, round(CASE WHEN len(g) = 0 THEN 1.0 ELSE b / len(g)::DOUBLE END, 6) AS rcs, round(CASE WHEN len(p) = 0 THEN CASE WHEN len(g) = 0 THEN 1.0 ELSE 0.0 END ELSE b / len(p)::DOUBLE END, 6) AS rns, b::INT AS shared
          FROM (SELECT record_id, p, g, len(list_intersect(p, g)) AS b FROM (SELECT record_id, list_distinct({named}) AS p, list_distinct({eid}) AS g FROM qa_records))""",
        "hallucination_f1": f"""WITH s AS (SELECT DISTINCT {S.answer('c')} AS c FROM (SELECT unnest(context) AS c FROM eval_examples)), p AS (SELECT DISTINCT {S.answer('c')} AS c FROM (SELECT unnest({S.claims('gold_answer')}) AS c FROM eval_examples)), g AS (SELECT DISTINCT {S.answer('c')} AS c FROM (SELECT unnest(gold_claims) AS c FROM eval_examples)),
          n AS (SELECT (SELECT count(*) FROM s) AS s, (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM g) AS g, (SELECT count(*) FROM s SEMI JOIN g USING (c)) AS m), x AS (SELECT CASE WHEN g = 0 THEN s ELSE m END AS m, p, g FROM n), y AS (SELECT CASE WHEN p = 0 THEN 0.0 ELSE m / p::DOUBLE END AS pr, CASE WHEN g = 0 THEN 0.0 ELSE m / g::DOUBLE END AS re FROM x)
          SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM y""",
        "mcnemar": f"""SELECT only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 0.0 ELSE pow(abs(only_a - only_b) - 1, 2) / (only_a + only_b) END, 6) AS chi_square FROM (SELECT count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b FROM (SELECT length(coalesce(answer, '')) > 20 AS a, len({S.claims('reasoning')}) > 3 AS b FROM qa_records))""",
        "latency_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
        "answer_faithfulness": f"WITH {faithful('eval_examples', 'eval_id', 'gold_answer')} SELECT eval_id, round(faithfulness, 6) AS faithfulness FROM fa",
        "record_tiers": f"{_tiers_sql()} SELECT k, round(edge_coverage, 6) AS edge_coverage, round(node_coverage, 6) AS node_coverage, round(label_ratio, 6) AS label_ratio, tier, array_to_string(reasons, ',') AS reasons FROM td",
        "tier_summary": f"{_tiers_sql()} SELECT coalesce(tier, 'all') AS tier, count(*) AS n, round(avg(edge_coverage), 6) AS mean_edge_coverage, round(avg(node_coverage), 6) AS mean_node_coverage, round(avg(label_ratio), 6) AS mean_label_ratio, sum(n_labelled)::BIGINT AS n_labelled FROM td GROUP BY ROLLUP (tier)",
        "tier_reasons": f"{_tiers_sql()} SELECT tier, reason, count(*) AS n FROM (SELECT tier, unnest(reasons) AS reason FROM td) GROUP BY 1, 2",
        "top_failure_reasons": f"{_tiers_sql()} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM td WHERE tier <> 'goldish') GROUP BY 1 ORDER BY n DESC, reason LIMIT 10",
        "edge_mapping_scores": f"WITH RECURSIVE {record_evidence_ctes()}, {_score_sql()} SELECT k, edge_id, score, first_pos FROM es",
        "mapped_edges": f"WITH RECURSIVE {record_evidence_ctes()}, {_score_sql()} SELECT k, string_agg(edge_id, ',' ORDER BY first_pos, -score, edge_id) AS edge_ids FROM es WHERE score >= 3.0 GROUP BY 1",
        "decoded_paths": f"WITH {decoded_ctes()} SELECT k, rank, array_to_string(nodes, '>') AS nodes, array_to_string(edges, ',') AS edges, round(confidence, 6) AS confidence, round(ranking, 6) AS ranking FROM rk",
        "path_answers": f"""WITH {decoded_ctes()}, st1 AS (SELECT k, confidence, edges, unnest(edges) AS edge_id, unnest(range(len(edges))) AS i FROM rk WHERE rank = 1),
          sy AS (SELECT k, string_agg({S.humanized('head')} || ' ' || display_relation || ' ' || {S.humanized('tail')} || ' [edge:' || edge_id || '].', ' ' ORDER BY i) AS said FROM st1 JOIN e USING (edge_id) GROUP BY 1)
          SELECT k, CASE WHEN said IS NULL OR confidence < {reasoning.ABSTAIN_BELOW} THEN 'The evidence does not support an answer.' WHEN confidence < {reasoning.UNSURE_BELOW} THEN 'Evidence suggests: ' || said ELSE said END AS answer, round(confidence, 6) AS confidence FROM rk LEFT JOIN sy USING (k) WHERE rank = 1""",
        "gold_paths": f"WITH {gold_ctes()} SELECT k, n_gold, n_covered, array_to_string(missing, ',') AS missing, array_to_string(path, '>') AS path FROM gpath",
        "mcnemar_p": f"""WITH m AS (SELECT only_a, only_b, CASE WHEN only_a + only_b = 0 THEN 0.0 ELSE pow(abs(only_a - only_b) - 1, 2) / (only_a + only_b) END AS x FROM (SELECT count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b FROM (SELECT length(coalesce(answer, '')) > 20 AS a, len({S.claims('reasoning')}) > 3 AS b FROM qa_records)))
          SELECT only_a, only_b, round(x, 6) AS chi_square, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE round({_erfc('sqrt(x / 2)')}, 6) END AS p_value FROM m""",
        "passage_contradictions": f"""WITH {BUNDLE}, ed AS (SELECT k, head, tail, relation IN {S.values(K.NEGATIVE_RELATIONS)} OR contains(lower(display_relation), 'contra') AS neg, lower({S.humanized('head')}) AS h, lower({S.humanized('tail')}) AS t FROM be), ps AS (SELECT k, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS body FROM bp),
          cl AS (SELECT ed.k, max(CASE WHEN neg AND p THEN 0.8 WHEN NOT neg AND n THEN 0.8 WHEN neg = n THEN 0.0 ELSE 0.35 END)::DOUBLE AS c FROM ed JOIN (SELECT *, {S.has_any('body', K.CLASH_NEGATIVE)} AS n, {S.has_any('body', K.CLASH_POSITIVE)} AS p FROM ps) ps ON ed.k = ps.k AND (contains(body, h) OR contains(body, t)) GROUP BY 1),
          mx AS (SELECT k, max(n) AS n FROM (SELECT k, head, tail, count(DISTINCT neg) AS n FROM ed GROUP BY 1, 2, 3) GROUP BY 1)
          SELECT mx.k, CASE WHEN mx.k IN (SELECT k FROM ps) THEN greatest(coalesce(c, 0.0), CASE WHEN n > 1 THEN 0.6 ELSE 0.0 END) ELSE 0.0 END::DOUBLE AS contradiction FROM mx LEFT JOIN cl USING (k)""",
        "enforced_answers": f"""WITH {BUNDLE}, tg AS (SELECT k, list(evidence_id) AS allowed FROM ev GROUP BY 1),
          s AS (SELECT record_id AS k, {S.distinct(jc)} AS l, coalesce(allowed, []::VARCHAR[]) AS allowed FROM qa_records LEFT JOIN tg ON k = record_id),
          f AS (SELECT k, list_transform(list_filter(l, lambda s: len({S.refs('s')}) > 0 AND len(list_filter({S.refs('s')}, lambda r: NOT list_contains(allowed, r))) = 0), lambda s: replace({S.squeeze('s')}, '[edge_id:', '[edge:')) AS l FROM s)
          SELECT k, array_to_string(list_transform(l, lambda s: CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END), ' ') AS answer FROM f""",
    }
