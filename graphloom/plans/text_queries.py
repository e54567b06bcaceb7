"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.keys import key
from ..session import read
from . import sql as S


def text_normal_forms(spark, d):
    a = read(spark, d, "articles")
    return a.select(
        "article_row", T.normal(F.col("title")).alias("normal"), T.alnum(F.col("title")).alias("alnum"), T.ascii_name(F.col("title")).alias("ascii_name"),
        T.slug(F.col("journal")).alias("slug"), T.or_else(F.col("publication_year"), "unknown").alias("year_or"),
    )


def node_id_forms(spark, d):
    n, c = read(spark, d, "kg_nodes"), F.col("node_id")
    return n.select("node_index", T.humanized(c).alias("human"), T.id_type(c).alias("id_type"), T.valid_node_id(c).alias("valid"), T.mapped(F.lower("node_type"), K.ENTITY_TYPES, "other").alias("entity_type"))


def edge_source_reliability(spark, d):
    e = read(spark, d, "kg_edges")
    s = key(F.col("source"))
    return e.select("row_index", T.mapped(s, K.RELIABILITY, K.OTHER_RELIABILITY).alias("looked_up"), F.coalesce("source_reliability", T.mapped(s, K.RELIABILITY, K.OTHER_RELIABILITY)).alias("reliability"))


def answer_forms(spark, d):
    a = F.col("answer")
    return read(spark, d, "qa_records").select("record_id", T.answer(a).alias("normalised"), T.label(a).alias("label"), T.decision(a).alias("decision"))


def answer_claims(spark, d):
    return read(spark, d, "qa_records").select("record_id", F.posexplode(T.claims(F.col("answer"))).alias("pos", "claim"))


def claim_judgements(spark, d):
    c = read(spark, d, "qa_records").select("record_id", F.posexplode(T.claims(F.col("answer"))).alias("pos", "claim"))
    k = T.claim_type(F.col("claim"))
    return c.select("record_id", "pos", k.alias("claim_type"), T.polarity(F.col("claim")).alias("polarity"), T.severity(k, F.lit("unsupported")).alias("severity_unsupported"), T.severity(k, F.lit("contradicted")).alias("severity_contradicted"))


def document_tokens(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.size(T.tokens(t)).alias("n_tokens"), F.size(T.tokens(t, K.STOPWORDS, 1)).alias("n_tokens_short"), F.size(T.bm25_tokens(t)).alias("n_bm25"))


def title_abstract_overlap(spark, d):
    a = read(spark, d, "articles")
    return a.select("article_row", F.round(T.overlap(T.tokens(F.col("title")), T.tokens(F.col("abstract"))), 6).alias("overlap"))


def numeric_mentions(spark, d):
    n = T.numbers(F.col("abstract"))
    return read(spark, d, "articles").select("article_row", F.array_join(F.transform(n, lambda x: F.concat_ws(":", F.round(x["value"], 4).cast("decimal(18,4)").cast("string"), x["unit"])), ",").alias("mentions"))


def numeric_agreement(spark, d):
    a = read(spark, d, "qa_records")
    x, y = T.numbers(F.col("answer")), T.numbers(F.col("reasoning"))
    return a.select("record_id", T.numeric_compatible(x, y).alias("compatible"), T.numeric_conflict(x, y).alias("conflict"), T.polarity_conflict(F.col("answer"), F.col("reasoning")).alias("polarity_conflict"))


def dosage_mentions(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.dosages(F.col("text"))), ",").alias("dosages"))


def text_evidence_refs(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.evidence_refs(F.col("text"))), ",").alias("refs"))


def question_types(spark, d):
    return read(spark, d, "eval_examples").select("eval_id", T.question_type(F.col("question")).alias("question_type"), T.has_any(F.col("question"), K.AUDIT_LIFE_CRITICAL).alias("life_critical"))


def question_phrases(spark, d):
    return read(spark, d, "eval_examples").select("eval_id", F.explode(T.phrases(F.col("question"))).alias("phrase"))


#: A verb for the statements of some relations (fixed values).
SAID = {"indication": "treats", "off-label use": "treats", "contraindication": "increases", "drug_effect": "causes", "disease_phenotype_positive": "causes", "drug_protein": "inhibits", "exposure_disease": "causes", "pathway_protein": "activates"}


def verb_triples(spark, d):
    e = read(spark, d, "kg_edges")
    verb = T.mapped(key(F.col("relation")), SAID, None)
    said = F.concat(T.humanized(key(F.col("head"))), F.lit(" "), verb, F.lit(" "), T.humanized(key(F.col("tail"))), F.lit(". Source: "), T.text(F.col("source")), F.lit("."))
    return e.select("row_index", F.posexplode(T.triples(said)).alias("pos", "triple"))


def queries():
    return {f.__name__: f for f in (text_normal_forms, node_id_forms, edge_source_reliability, answer_forms, answer_claims, claim_judgements, document_tokens, title_abstract_overlap, numeric_mentions, numeric_agreement, dosage_mentions, text_evidence_refs, question_types, question_phrases, verb_triples)}


_CL = f"(SELECT record_id, unnest(c) AS claim, unnest(range(len(c)))::INT AS pos FROM (SELECT record_id, {S.claims('answer')} AS c FROM qa_records))"
_NUM = f"(?i)(?:^|[^a-z0-9_.])([0-9]+(?:\\.[0-9]+)?(?:[ \\t]*(?:{K.UNITS}))?)\\b"
_ONE = f"(?i)([0-9]+(?:\\.[0-9]+)?)[ \\t]*({K.UNITS})?"


def _numbers(c):
    found = f"regexp_extract_all(regexp_replace({S.txt(c)}, '[^\\x00-\\x7F]', 'x', 'g'), '{_NUM}', 1)"
    return f"list_transform({found}, lambda m: {{'value': regexp_extract(m, '{_ONE}', 1)::DOUBLE, 'unit': lower(regexp_extract(m, '{_ONE}', 2))}})"


_SAME = "(x.unit = '' OR y.unit = '' OR x.unit = y.unit)"
_CLOSE = f"(abs(x.value - y.value) <= greatest({K.REL_TOL} * greatest(abs(x.value), abs(y.value)), {K.ABS_TOL}))"


def _phrases_sql():
    w = f"regexp_extract_all(lower({S.txt('question')}), '[a-z0-9-]+')"
    runs = " UNION ".join(
        f"SELECT eval_id, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS phrase FROM (SELECT eval_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM w) WHERE w[i] NOT IN {S.values(K.PHRASE_STOPWORDS)} AND w[i + {n - 1}] NOT IN {S.values(K.PHRASE_STOPWORDS)}"
        for n in (1, 2, 3)
    )
    return f"WITH w AS (SELECT eval_id, {w} AS w FROM eval_examples) SELECT eval_id, phrase FROM ({runs}) WHERE length(phrase) >= 3"


def oracle_sql():
    sent = S.sentences(f"lower({S.txt('text')})")
    return {
        "text_normal_forms": f"""SELECT article_row, {S.normal('title')} AS normal, trim(regexp_replace(lower({S.txt('title')}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS alnum,
          {S.squeeze(f"regexp_replace(lower({S.txt('title')}), '[^a-z0-9 \\t\\n\\r\\f]', ' ', 'g')")} AS ascii_name,
          regexp_replace(regexp_replace(lower({S.txt('journal')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, coalesce(nullif(trim(publication_year), ''), 'unknown') AS year_or FROM articles""",
        "node_id_forms": f"""SELECT node_index, {S.humanized('node_id')} AS human, CASE WHEN contains(node_id, ':') THEN lower(split_part(node_id, ':', 1)) ELSE 'unknown' END AS id_type,
          contains(node_id, ':') AND NOT suffix(node_id, ':') AS valid, {S.mapped('lower(node_type)', K.ENTITY_TYPES, "'other'")} AS entity_type FROM kg_nodes""",
        "edge_source_reliability": f"""SELECT row_index, l::DOUBLE AS looked_up, coalesce(source_reliability, l)::DOUBLE AS reliability FROM (SELECT *, {S.mapped(S.key('source'), K.RELIABILITY, str(K.OTHER_RELIABILITY))} AS l FROM kg_edges)""",
        "answer_forms": f"SELECT record_id, n AS normalised, {S.label('n')} AS label, {S.decision('answer')} AS decision FROM (SELECT record_id, answer, {S.answer('answer')} AS n FROM qa_records)",
        "answer_claims": f"SELECT record_id, pos, claim FROM {_CL}",
        "claim_judgements": f"""SELECT record_id, pos, k AS claim_type, {S.polarity('claim')} AS polarity, {S.severity('k', "'unsupported'")} AS severity_unsupported, {S.severity('k', "'contradicted'")} AS severity_contradicted
          FROM (SELECT *, {S.claim_type('claim')} AS k FROM {_CL})""",
        "document_tokens": f"SELECT doc_id, len({S.tokens('text')})::INT AS n_tokens, len({S.tokens('text', K.STOPWORDS, 1)})::INT AS n_tokens_short, len(regexp_extract_all({S.txt('text')}, '[A-Za-z0-9-]+'))::INT AS n_bm25 FROM documents",
        "title_abstract_overlap": f"SELECT article_row, round({S.overlap('a', 'b')}, 6) AS overlap FROM (SELECT article_row, {S.tokens('title')} AS a, {S.tokens('abstract')} AS b FROM articles)",
        "numeric_mentions": f"SELECT article_row, array_to_string(list_transform({_numbers('abstract')}, lambda x: round(x.value, 4)::DECIMAL(18,4)::VARCHAR || ':' || x.unit), ',') AS mentions FROM articles",
        "numeric_agreement": f"""WITH n AS (SELECT record_id, answer, reasoning, {_numbers('answer')} AS a, {_numbers('reasoning')} AS b, {S.tokens('answer')} AS ta, {S.tokens('reasoning')} AS tb FROM qa_records)
          SELECT record_id, len(list_filter(a, lambda x: len(list_filter(b, lambda y: {_SAME} AND {_CLOSE})) = 0)) = 0 AS compatible,
          len(list_filter(a, lambda x: len(list_filter(b, lambda y: {_SAME} AND NOT {_CLOSE})) > 0)) > 0 AS conflict,
          list_has_any(ta, tb) AND (({S.has_any('answer', K.POSITIVE_CUES)} AND {S.has_any('reasoning', K.NEGATIVE_CUES)}) OR ({S.has_any('answer', K.NEGATIVE_CUES)} AND {S.has_any('reasoning', K.POSITIVE_CUES)})) AS polarity_conflict FROM n""",
        "dosage_mentions": f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({S.txt('text')}, '(?i)[0-9]+(?:\\.[0-9]+)? ?(?:mcg|mg|g|ml|units)(?:/(?:kg|day|dl|ml))?'), lambda m: {S.squeeze('lower(m)')}))), ',') AS dosages FROM documents""",
        "text_evidence_refs": f"SELECT doc_id, array_to_string(list_sort(list_distinct({S.refs('text')})), ',') AS refs FROM documents",
        "question_types": f"SELECT eval_id, {S.question_type('question')} AS question_type, {S.has_any('question', K.AUDIT_LIFE_CRITICAL)} AS life_critical FROM eval_examples",
        "question_phrases": _phrases_sql(),
        "verb_triples": f"""WITH t AS (SELECT row_index, {S.humanized(S.key('head'))} || ' ' || {S.mapped(S.key('relation'), SAID, 'NULL')} || ' ' || {S.humanized(S.key('tail'))} || '. Source: ' || coalesce(source, '') || '.' AS text FROM kg_edges),
          s AS (SELECT row_index, flatten(list_transform({sent}, lambda s: regexp_extract_all(s, '{T.TRIPLE}'))) AS s FROM t), p AS (SELECT row_index, unnest(s) AS x, unnest(range(len(s)))::INT AS pos FROM s)
          SELECT row_index, pos, trim(regexp_extract(x, '{T.TRIPLE}', 1)) || '|' || trim(regexp_extract(x, '{T.TRIPLE}', 2)) || '|' || trim(regexp_extract(x, '{T.TRIPLE}', 3)) AS triple FROM p""",
    }
