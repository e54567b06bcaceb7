"""Records, their fields and ids; the evaluation of a whole set of answers; caches, samples and checks of schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import evaluation, graph, records, trace
from ..session import read
from . import sql as S
from .graph_queries import EDGES
from .quality_queries import faithful

OVERRIDES = ["diagnosis=gene disease,no_such_relation", "dosage=drug drug, contraindication"]


def normalized_records(spark, d):
    return records.normalized_records(read(spark, d, "qa_records").drop("dataset_name"))


def resolved_answers(spark, d):
    r = read(spark, d, "qa_records").select("record_id", "answer", "options")
    return r.select("record_id", records.gold_answer(r, F.lit("medqa"), F.col("answer")).alias("gold"), records.gold_answer(r.drop("options"), F.lit("pubmedqa")).alias("decision"))


def eval_contexts(spark, d):
    e = read(spark, d, "eval_examples")
    c = records.all_texts(e, records.CONTEXT)
    kept = e.where(records.first_text(e, records.QUESTION) != "")
    return kept.select("eval_id", F.size(c).alias("n_context"), F.array_join(c, " ").alias("context"), records.first_text(e, ["final_decision", "gold_claims", "gold_answer"]).alias("first"))


def sample_ids(spark, d):
    r = read(spark, d, "qa_records").withColumn("id_in_dataset", F.when(F.col("record_id") % 2 == 0, F.col("record_id")))
    sid = records.sample_id(r)
    return r.select("record_id", sid.alias("sample_id"), F.regexp_replace(sid, "[^A-Za-z0-9_.-]+", "_").alias("safe_id"))


def record_selection(spark, d):
    e = read(spark, d, "eval_examples").withColumnRenamed("eval_id", "n")
    pick = lambda how, x: x.select(F.lit(how).alias("how"), F.col("n").alias("eval_id"))
    return pick("index", records.select_record(e, "n", index=7)).unionByName(pick("id", records.select_record(e, "n", name="11"))).unionByName(pick("seed", records.select_record(e, "n", seed=5)))


def record_window(spark, d):
    return records.window_of_records(read(spark, d, "qa_records"), "record_id", 20, 50, 80).select("record_id")


def record_question_types(spark, d):
    r = read(spark, d, "qa_records")
    t = records.inferred_type(r, "factoid")
    return r.select("record_id", t.alias("question_type"), records.canonical_type(t).alias("routed_as"), F.element_at(F.array(*[F.lit(0)]), 1).alias("zero"), records.hard_constraints(t, F.col("question")).getField("dosage_sensitive").alias("dosage_sensitive"), records.hard_constraints(t, F.col("question")).getField("ddi_sensitive").alias("ddi_sensitive")).drop("zero")


def relation_resolution(spark, d):
    edges = graph.graph_edges(read(spark, d, "kg_edges"))
    return graph.relation_resolution(edges.select("relation").distinct(), records.parse_overrides(OVERRIDES))


def reasoning_references(spark, d):
    return read(spark, d, "qa_records").select("record_id", F.array_join(records.edge_references(F.col("reasoning")), ",").alias("refs"))


def json_payloads(spark, d):
    p = records.json_payload(F.col("reasoning"))
    return read(spark, d, "qa_records").select("record_id", p.isNotNull().alias("has_payload"), F.length(p).alias("size"))


def ingestion_delays(spark, d):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    a = F.when(F.col("record_id") % 11 == 0, "no time").otherwise(iso("created_at"))
    return read(spark, d, "qa_records").select("record_id", records.elapsed_seconds(a, iso("ingested_at")).alias("seconds"))


def relation_schema_hash(spark, d):
    n = graph.graph_edges(read(spark, d, "kg_edges")).agg(F.array_sort(F.collect_set("relation")).alias("names"))
    return n.select(F.size("names").alias("n"), records.schema_hash(F.col("names")).alias("sha256"))


def cache_lookup(spark, d):
    r = read(spark, d, "qa_records").select(F.col("question").alias("query"), F.when(F.col("record_id") % 2 == 0, 50).otherwise(20).alias("retmax"), F.col("record_id").alias("line"), F.col("record_id").alias("value"))
    q = read(spark, d, "qa_records").select(F.col("record_id").alias("k"), F.col("question").alias("query"))
    return records.cached_first(q, r)


def sampled_seeds(spark, d):
    n = read(spark, d, "kg_nodes").select(F.col("node_id").alias("node"))
    return records.sampled_nodes(n, 40, 7)


def node_key_comparison(spark, d):
    n = read(spark, d, "kg_nodes").select(records.strip(F.lower("node_id")).alias("key"), F.lower("node_type").alias("shape")).distinct()
    e = graph.graph_edges(read(spark, d, "kg_edges"))
    ends = e.select(F.explode(F.array("head", "tail")).alias("key")).distinct().select("key", T.id_type(F.col("key")).alias("shape"))
    return records.compared_keys(n, ends)


def schema_rejects(spark, d):
    return records.schema_rejects(read(spark, d, "kg_edges")).select("row_index", F.array_join("reasons", ",").alias("reasons"))


def run_state(spark, d):
    e = read(spark, d, "events")
    return trace.run_state(e.select(F.col("event_type").alias("bucket"), (F.col("value") > 50).cast("int").alias("error_count"), F.col("value").alias("duration_ms")))


def evaluation_metrics(spark, d):
    g = read(spark, d, "eval_examples").select(F.col("eval_id").alias("k"), "question", "gold_answer", "context", "gold_edges", "gold_claims")
    r = read(spark, d, "qa_records")
    edges = F.transform(records.edge_references(F.col("reasoning")), lambda x: F.concat(F.lit("edge:"), x))
    named = F.transform(F.coalesce("direct_edge_ids", F.array().cast("array<string>")), lambda x: F.concat(F.lit("edge:"), T.text(x)))
    p = r.select(F.col("record_id").alias("k"), F.col("answer").alias("answer_text"), F.array_distinct(F.concat(edges, named)).alias("provenance"), (F.col("record_id") % 100 / 100.0).alias("confidence"), (F.trim(T.text(F.col("answer"))) == "").alias("abstention"))
    t = read(spark, d, "events").select(F.col("event_id").alias("k"), F.col("value").alias("latency_ms"))
    out = evaluation.evaluate(p.join(t, "k", "left"), g)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def queries():
    return {
        f.__name__: f
        for f in (normalized_records, resolved_answers, eval_contexts, sample_ids, record_selection, record_window, record_question_types, relation_resolution, reasoning_references, json_payloads, ingestion_delays, relation_schema_hash, cache_lookup, sampled_seeds, node_key_comparison, schema_rejects, run_state, evaluation_metrics)
    }


def _strip(c):
    return S.STRIP.format(c=c)


def _type(text):
    return S.question_type(text, "factoid")


def oracle_sql():
    from .text_queries import _CLOSE, _SAME

    blank = lambda c: f"coalesce({_strip(c)}, '') = ''"
    opts = "nullif(array_to_string(list_transform(list_zip(options, range(len(options))), lambda z: '(' || z[2] || ') ' || coalesce(z[1], '')), ' '), '')"
    low = f"lower({_strip(S.txt('answer'))})"
    at = f"CASE WHEN regexp_full_match({low}, '[a-z]') THEN ascii({low}) - 97 WHEN regexp_full_match({low}, '[0-9]{{1,4}}') THEN {low}::INT END"
    ref = """(?i)(?:edge_id|edge)\\s*[:=]\\s*[''"]?([A-Za-z0-9_.:-]+)|\\[edge:([^\\]]+)\\]"""
    refs = lambda c: S.distinct(f"list_filter(list_transform(regexp_extract_all({S.txt(c)}, '{ref}'), lambda m: regexp_replace(regexp_replace(trim(CASE WHEN starts_with(m, '[') THEN regexp_extract(m, '{ref}', 2) ELSE regexp_extract(m, '{ref}', 1) END), '^edge:', ''), '^edge_id:', '')), lambda x: x <> '')")
    over = {"diagnosis": ["gene disease", "no_such_relation"], "dosage": ["contraindication", "drug drug"]}
    wanted = [(t, r) for t in ("drug_interaction", "dosage", "diagnosis", "etiology", "other") for r in over.get(t, K.ROUTES[t])]
    rows = ", ".join(f"({S.q(t)}, {S.q(r)}, {S.q('type_override' if t in over else 'question_type_default')})" for t, r in wanted)
    fam = " ".join(f"WHEN array_to_string(regexp_extract_all(lower(requested), '[a-z0-9]+'), ' ') = {S.q(k)} THEN {S.arr(v)}" for k, v in K.FAMILIES.items())
    spelled = ", ".join(f"array_to_string({w}, '{x}')" for w in ("w", "v") for x in (" ", "", "_", "-"))
    alias = lambda c: f"list_distinct([{spelled}]) AS key FROM (SELECT *, list_transform(w, lambda x: {S.mapped('x', K.TOKEN_SYNONYMS, 'x')}) AS v FROM (SELECT *, regexp_extract_all(lower({c}), '[a-z0-9]+') AS w"
    body = "strpos(t, '{')"
    last = "(length(t) - strpos(reverse(t), '}') + 1)"
    pay = f"CASE WHEN {body} > 0 AND strpos(t, '}}') > 0 AND {last} > {body} AND json_valid(substr(t, {body}, {last} - {body} + 1)) THEN substr(t, {body}, {last} - {body} + 1) END"
    dec = lambda c: f"CASE WHEN {S.decision(c)} IN ('yes', 'no', 'maybe') THEN {S.decision(c)} END"
    canon = lambda l: f"list_distinct(list_transform({l}, lambda e: regexp_replace(regexp_replace(trim(e), '^edge:', ''), '^edge_id:', '')))"
    ev = f"""ev0 AS MATERIALIZED (SELECT g.eval_id, g.context, coalesce(g.gold_answer, '') AS gold, coalesce(g.gold_edges, []::VARCHAR[]) AS ge, coalesce(g.gold_claims, []::VARCHAR[]) AS gc, coalesce(r.answer, '') AS said, coalesce({S.distinct(f"list_concat(list_transform({refs('r.reasoning')}, lambda x: 'edge:' || x), list_transform(coalesce(r.direct_edge_ids, []::VARCHAR[]), lambda x: 'edge:' || coalesce(x, '')))")}, []::VARCHAR[]) AS pv,
     CASE WHEN r.record_id IS NULL THEN 0.0 ELSE r.record_id % 100 / 100.0 END::DOUBLE AS confidence, CASE WHEN r.record_id IS NULL THEN false ELSE trim(coalesce(r.answer, ''), ' ') = '' END AS abst, v.value AS latency FROM eval_examples g LEFT JOIN qa_records r ON r.record_id = g.eval_id LEFT JOIN events v ON v.event_id = r.record_id),
   ev1 AS MATERIALIZED (SELECT *, {dec('said')} AS pl, {dec('gold')} AS gl, coalesce({dec('said')}, said) AS answer FROM ev0), {faithful('ev1', 'eval_id', 'answer')},
   ev2 AS MATERIALIZED (SELECT ev1.*, faithfulness, {S.claims('answer')} AS cl, {canon("list_filter(pv, lambda r: starts_with(r, 'edge:'))")} AS pe, {canon('ge')} AS g2 FROM ev1 JOIN fa USING (eval_id)),
   pr AS (SELECT eval_id, i, c, {S.tokens('c')} AS t, {_numbers_of('c')} AS n, {S.has_any('c', K.POSITIVE_CUES)} AS p, {S.has_any('c', K.NEGATIVE_CUES)} AS m FROM (SELECT eval_id, unnest(cl) AS c, unnest(range(len(cl))) AS i FROM ev2)),
   cd AS (SELECT eval_id, avg(bad::INT) AS rate FROM (SELECT a.eval_id, list_has_any(a.t, b.t) AND ((a.p AND b.m) OR (a.m AND b.p) OR len(list_filter(a.n, lambda x: len(list_filter(b.n, lambda y: {_SAME} AND NOT {_CLOSE})) > 0)) > 0) AS bad FROM pr a JOIN pr b ON a.eval_id = b.eval_id AND a.i < b.i) GROUP BY 1),
   ls AS (SELECT pl, gl FROM ev2 WHERE pl IS NOT NULL AND gl IS NOT NULL), lb AS (SELECT label, count(*) FILTER (pl = label AND gl = label) AS tp, count(*) FILTER (pl <> gl) AS wrong FROM (SELECT pl, gl, unnest(list_distinct([pl, gl])) AS label FROM ls) GROUP BY 1),
   cs AS (SELECT DISTINCT {S.answer('c')} AS c FROM (SELECT unnest(list_slice(cl, 1, round_even(faithfulness * len(cl), 0)::INT)) AS c FROM ev2)), cp AS (SELECT DISTINCT {S.answer('c')} AS c FROM (SELECT unnest(cl) AS c FROM ev2)), cg AS (SELECT DISTINCT {S.answer('c')} AS c FROM (SELECT unnest(CASE WHEN len(gc) > 0 THEN gc ELSE {S.claims('gold')} END) AS c FROM ev2)),
   hn AS (SELECT (SELECT count(*) FROM cp) AS p, (SELECT count(*) FROM cg) AS g, (SELECT count(*) FROM cs SEMI JOIN cg USING (c)) AS m), hs AS (SELECT CASE WHEN p = 0 THEN 0.0 ELSE m / p::DOUBLE END AS pr, CASE WHEN g = 0 THEN 0.0 ELSE m / g::DOUBLE END AS re FROM hn)"""
    return {
        "normalized_records": f"""SELECT record_id, CASE WHEN o IS NOT NULL AND NOT contains(lower(q), lower(o)) THEN q || chr(10) || 'Options: ' || o ELSE q END AS question, coalesce(a, '') AS answer, coalesce(r, a, CASE WHEN o IS NOT NULL AND NOT contains(lower(q), lower(o)) THEN q || chr(10) || 'Options: ' || o ELSE q END) AS reasoning, coalesce(nullif({_strip('group_id')}, ''), record_id::VARCHAR) AS group_id
          FROM (SELECT record_id, group_id, {opts} AS o, nullif({_strip('question')}, '') AS q, nullif({_strip('answer')}, '') AS a, nullif({_strip('reasoning')}, '') AS r FROM qa_records) WHERE q IS NOT NULL""",
        "resolved_answers": f"SELECT record_id, coalesce(nullif({_strip(f'options[({at}) + 1]')}, ''), {_strip(S.txt('answer'))}) AS gold, {_strip(S.txt('answer'))} AS decision FROM qa_records",
        "eval_contexts": f"""SELECT eval_id, len(c)::INT AS n_context, array_to_string(c, ' ') AS context, coalesce(nullif(array_to_string(g, ' '), ''), {_strip(S.txt('gold_answer'))}) AS first
          FROM (SELECT *, list_filter(list_transform(coalesce(context, []::VARCHAR[]), lambda x: {_strip("coalesce(x, '')")}), lambda x: x <> '') AS c, list_filter(list_transform(coalesce(gold_claims, []::VARCHAR[]), lambda x: {_strip("coalesce(x, '')")}), lambda x: x <> '') AS g FROM eval_examples) WHERE NOT ({blank('question')})""",
        "sample_ids": f"SELECT record_id, s AS sample_id, regexp_replace(s, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe_id FROM (SELECT record_id, coalesce(CASE WHEN dataset_name IS NOT NULL AND record_id % 2 = 0 THEN trim(dataset_name, ' ') || ':' || record_id END, nullif({_strip('group_id')}, ''), record_id::VARCHAR) AS s FROM qa_records)",
        "record_selection": "(SELECT 'index' AS how, eval_id FROM eval_examples ORDER BY eval_id OFFSET 7 LIMIT 1) UNION ALL (SELECT 'id', eval_id FROM eval_examples WHERE eval_id = 11) UNION ALL (SELECT 'seed', eval_id FROM eval_examples ORDER BY sha256('5:' || eval_id), eval_id LIMIT 1)",
        "record_window": f"SELECT record_id FROM qa_records WHERE NOT ({blank('question')}) ORDER BY record_id OFFSET 20 LIMIT 50",
        "record_question_types": f"""SELECT record_id, t AS question_type, CASE WHEN t = 'factoid' THEN 'other' ELSE t END AS routed_as, t = 'dosage' OR {S.has_any('question', ['dose', 'dosage', 'mg', 'mcg'])} AS dosage_sensitive, t = 'drug_interaction' OR {S.has_any('question', ['interaction', 'interact', 'ddi', 'contraindication', 'contraindicated'])} AS ddi_sensitive
          FROM (SELECT record_id, question, {_type("(coalesce(question, '') || chr(10) || coalesce(array_to_string(options, ' '), ''))")} AS t FROM qa_records)""",
        "relation_resolution": f"""WITH {EDGES}, rt(question_type, requested, override_source) AS (VALUES {rows}), fx AS (SELECT *, unnest(CASE {fam} ELSE [requested] END) AS x FROM rt),
          ra AS (SELECT question_type, requested, unnest(key) AS key FROM (SELECT question_type, requested, {alias('x')} FROM fx)))), ha AS (SELECT relation, unnest(key) AS key FROM (SELECT relation, {alias('relation')} FROM (SELECT DISTINCT relation FROM e))))),
          mt AS (SELECT DISTINCT question_type, requested, relation FROM ra JOIN ha USING (key) WHERE key <> '')
          SELECT rt.question_type, any_value(override_source) AS override_source, array_to_string(list_sort(list(DISTINCT rt.requested)), ',') AS requested, coalesce(array_to_string(list_sort(list(DISTINCT relation) FILTER (relation IS NOT NULL)), ','), '') AS matched, coalesce(array_to_string(list_sort(list(DISTINCT rt.requested) FILTER (relation IS NULL)), ','), '') AS missing FROM rt LEFT JOIN mt USING (question_type, requested) GROUP BY 1""",
        "reasoning_references": f"SELECT record_id, array_to_string({refs('reasoning')}, ',') AS refs FROM qa_records",
        "json_payloads": f"SELECT record_id, p IS NOT NULL AS has_payload, length(p)::INT AS size FROM (SELECT record_id, {pay} AS p FROM (SELECT record_id, {S.txt('reasoning')} AS t FROM qa_records))",
        "ingestion_delays": "SELECT record_id, coalesce(CASE WHEN record_id % 11 <> 0 THEN greatest(epoch_us(date_trunc('second', ingested_at)) - epoch_us(date_trunc('second', created_at)), 0) / 1e6 END, 0.0)::DOUBLE AS seconds FROM qa_records",
        "relation_schema_hash": f"WITH {EDGES} SELECT len(l)::INT AS n, sha256(to_json(l)::VARCHAR) AS sha256 FROM (SELECT list_sort(list(DISTINCT relation)) AS l FROM e)",
        "cache_lookup": """WITH c AS (SELECT lower(trim(question, ' ')) AS t, CASE WHEN record_id % 2 = 0 THEN 50 ELSE 20 END AS retmax, min(record_id) AS f, max(record_id) AS value FROM qa_records WHERE question IS NOT NULL GROUP BY 1, 2),
          b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY t ORDER BY (retmax <> 50)::INT, f) = 1) SELECT record_id AS k, CASE WHEN retmax = 50 THEN 'exact' ELSE 'prefix' END AS how, value FROM qa_records JOIN b ON lower(trim(question, ' ')) = t WHERE t <> ''""",
        "sampled_seeds": "WITH n AS (SELECT DISTINCT node_id AS node, sha256('7:' || node_id) AS h FROM kg_nodes), s AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % 40 AS sample FROM n) SELECT sample, node FROM s QUALIFY row_number() OVER (PARTITION BY sample ORDER BY h) <= sample % 3 + 1",
        "node_key_comparison": f"""WITH {EDGES}, n AS (SELECT DISTINCT {_strip('lower(node_id)')} AS key, lower(node_type) AS shape FROM kg_nodes), m AS (SELECT DISTINCT key, CASE WHEN contains(key, ':') THEN split_part(key, ':', 1) ELSE 'unknown' END AS shape FROM (SELECT unnest([head, tail]) AS key FROM e))
          SELECT CASE WHEN m.key IS NULL THEN 'missing' WHEN n.key IS NULL THEN 'unexpected' WHEN n.shape IS NOT DISTINCT FROM m.shape THEN 'compatible' ELSE 'shape_mismatch' END AS outcome, count(*) AS n FROM n FULL JOIN m ON n.key = m.key GROUP BY 1""",
        "schema_rejects": f"""SELECT row_index, array_to_string(r, ',') AS reasons FROM (SELECT row_index, list_filter([CASE WHEN {blank('edge_id')} THEN 'edge_id' END, CASE WHEN {blank('head')} THEN 'head' END, CASE WHEN {blank('tail')} THEN 'tail' END, CASE WHEN {blank('relation')} THEN 'relation' END,
            CASE WHEN NOT coalesce(source_reliability BETWEEN 0 AND 1, true) THEN 'source_reliability' END, CASE WHEN NOT coalesce(amg_confidence BETWEEN 0 AND 1, true) THEN 'amg_confidence' END, {', '.join(f"CASE WHEN NOT ({blank(c)}) AND NOT (contains({_strip(c)}, ':') AND NOT suffix({_strip(c)}, ':')) THEN '{c}_id' END" for c in ('head', 'tail'))},
            CASE WHEN len(list_filter(coalesce(supporting_pmids, []::VARCHAR[]), lambda p: NOT regexp_full_match(coalesce(p, ''), '(?i)\\s*(pmid:\\s*)?[0-9]+\\s*'))) > 0 THEN 'supporting_pmids' END], lambda x: x IS NOT NULL) AS r FROM kg_edges) WHERE len(r) > 0""",
        "run_state": "SELECT coalesce(event_type, 'all') AS bucket, count(*) AS done, count(*) FILTER (value > 50) AS errors, round(avg(coalesce(value, 0.0)), 3) AS mean_duration_ms FROM events GROUP BY ROLLUP (event_type)",
        "evaluation_metrics": f"""WITH {ev} SELECT round(count(*)::DOUBLE, 6) AS samples, round(avg(({S.answer('answer')} = {S.answer('gold')})::INT), 6) AS exact_match, round(avg(faithfulness), 6) AS ragas_faithfulness, round(avg(coalesce(rate, 0)), 6) AS contradiction_detection_rate,
          round(avg(CASE WHEN len(g2) = 0 THEN 1.0 ELSE len(list_intersect(pe, g2)) / len(g2)::DOUBLE END), 6) AS reasoning_completeness_score, round(avg(CASE WHEN len(pe) = 0 THEN CASE WHEN len(g2) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(pe, g2)) / len(pe)::DOUBLE END), 6) AS reasoning_necessity_score,
          round(avg(abst::INT), 6) AS abstention_rate, round(avg(confidence), 6) AS mean_confidence, round(avg(len(pv)), 6) AS mean_provenance_count, round(avg(length(said)), 6) AS mean_answer_char_length,
          round(coalesce(quantile_cont(latency, 0.5), 0), 6) AS latency_p50_ms, round(coalesce(quantile_cont(latency, 0.95), 0), 6) AS latency_p95_ms, round(coalesce(quantile_cont(latency, 0.99), 0), 6) AS latency_p99_ms,
          any_value((SELECT round(coalesce(avg(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + wrong) END), 0.0), 6) FROM lb)) AS macro_f1, any_value((SELECT round(pr, 6) FROM hs)) AS hallucination_precision, any_value((SELECT round(re, 6) FROM hs)) AS hallucination_recall,
          any_value((SELECT round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 6) FROM hs)) AS hallucination_f1 FROM ev2 LEFT JOIN cd USING (eval_id)""",
    }


def _numbers_of(c):
    from .text_queries import _numbers

    return _numbers(c)


