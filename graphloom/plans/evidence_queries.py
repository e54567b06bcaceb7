"""Retrieval, vector and grounding queries over the records' evidence bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import bundles as B
from ..operators import graph, grounding, retrieval
from ..session import read
from ..workspace import Workspace
from . import sql as S
from .graph_queries import EDGES
from .text_queries import _CLOSE, _SAME, _numbers


class _Bundles:
    def __init__(self, spark, d, name):
        self.work = Workspace(spark, name)
        self.records = read(spark, d, "qa_records")
        self.edges = self.work.keep(B.bundle_edges(self.records, self.work.keep(graph.graph_edges(read(spark, d, "kg_edges")), "edges")), "bundle")
        self.passages = self.work.keep(B.bundle_passages(self.edges, B.canonical_articles(read(spark, d, "articles"))), "passages")

    def evidence(self):
        return self.work.keep(grounding.evidence_of(self.edges, self.passages), "evidence")

    def claims(self):
        c = T.judge_claims(F.col("answer"))
        return self.work.keep(self.records.select(F.col("record_id").alias("k"), F.posexplode(c).alias("claim_pos", "claim")), "claims")


def record_evidence(spark, d):
    x = _Bundles(spark, d, "evidence")
    return x.evidence().select("k", "evidence_id", "polarity")


def _bm25(x):
    q = x.records.select(F.col("record_id").alias("k"), F.col("question").alias("text"))
    c = x.passages.select("k", F.col("pmid").alias("doc"), F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))).alias("text"))
    return q, c, retrieval.bm25(q, c)


def bm25(spark, d):
    return _bm25(_Bundles(spark, d, "bm25"))[2].select("k", "doc", F.round("bm25", 6).alias("bm25"))


def passage_fusion_topk(spark, d):
    x = _Bundles(spark, d, "fusion")
    q, c, s = _bm25(x)
    lexical = q.join(c.withColumnRenamed("text", "t"), "k").select("k", "doc", T.overlap(T.tokens(F.col("text")), T.tokens(F.col("t"))).alias("lexical"))
    both = s.join(lexical, ["k", "doc"]).withColumn("bm25_scaled", retrieval.min_max("bm25", ["k"])).withColumn("lexical_scaled", retrieval.min_max("lexical", ["k"]))
    fused = retrieval.fuse(both, {"bm25_scaled": K.BM25_SHARE, "lexical_scaled": K.DENSE_SHARE}).withColumn("score", F.round("score", 8))
    return retrieval.top_passages(fused).select("k", "doc", F.round("score", 6).alias("score"))


def grounding_claims(spark, d):
    x = _Bundles(spark, d, "grounding")
    return grounding.ground_claims(x.claims(), x.evidence()).select("k", "claim_pos", "claim_type", "verdict", "evidence_id", "severity", F.round("score", 6).alias("score"))


def _rollup(x):
    return grounding.grounding_rollup(x.records.select(F.col("record_id").alias("k")), grounding.ground_claims(x.claims(), x.evidence()))


def grounding_rollup(spark, d):
    return _rollup(_Bundles(spark, d, "rollup"))


def _audited(x):
    return grounding.audit_claims(x.claims(), x.evidence(), x.records.select(F.col("record_id").alias("k"), F.col("question").alias("text")))


def audit_claims(spark, d):
    return _audited(_Bundles(spark, d, "audit")).select("k", "claim_pos", "claim_type", "verdict", "evidence_id", "severity", F.round("score", 6).alias("score"), F.array_join("unknown", ",").alias("unknown"))


def audit_labels(spark, d):
    x = _Bundles(spark, d, "labels")
    r = grounding.audit_rollup(x.records.select(F.col("record_id").alias("k")), x.work.keep(_audited(x), "audited"), x.evidence())
    return r.select("k", "n_claims", "faithfulness", "h5", "recommendation", F.array_join("gaps", ",").alias("gaps"), F.array_join("unknown", ",").alias("unknown"), "label")


def claim_self_contradictions(spark, d):
    c = read(spark, d, "qa_records").select(F.col("record_id").alias("k"), F.posexplode(T.claims(F.col("answer"))).alias("claim_pos", "claim"))
    return grounding.self_contradictions(c)


def vector_topk(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.nearest_vectors(v, v.where(F.col("vec_id") % 20 == 0), 10).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"))


def _codes(spark, d):
    v = read(spark, d, "embeddings")
    book = retrieval.label_centroids(v)
    return retrieval.quantize(v.select("vec_id", "embedding"), book), book


def vector_quantize(spark, d):
    return _codes(spark, d)[0].select("vec_id", "code_id", F.round("distance", 6).alias("distance"))


def codebook_usage(spark, d):
    c, book = _codes(spark, d)
    return retrieval.code_usage(c, book).select("code_id", "n", F.round("share", 6).alias("share"))


def hash_embeddings(spark, d):
    e = retrieval.hash_embedding(F.col("node_name"), 8)
    return read(spark, d, "kg_nodes").select("node_index", F.array_join(F.transform(e, lambda x: F.round(x, 4).cast("decimal(10,4)").cast("string")), ",").alias("vec"))


def queries():
    return {f.__name__: f for f in (record_evidence, bm25, passage_fusion_topk, grounding_claims, grounding_rollup, audit_claims, audit_labels, claim_self_contradictions, vector_topk, vector_quantize, codebook_usage, hash_embeddings)}


_P = f"regexp_replace({S.STRIP.format(c='pmid')}, '(?i)^pmid:\\s*', '')"
_BODY = "trim(coalesce(title, '') || ' ' || coalesce(abstract, ''), ' ')"
BUNDLE = f"""{EDGES},
 nm0 AS (SELECT record_id AS k, list_filter(list_transform(coalesce(direct_edge_ids, []::VARCHAR[]), lambda x: {S.edge_id('x')}), lambda x: x IS NOT NULL) AS l FROM qa_records),
 nm AS MATERIALIZED (SELECT k, edge_id, min(i) AS pos FROM (SELECT k, unnest(l) AS edge_id, unnest(range(len(l))) AS i FROM nm0) GROUP BY 1, 2),
 be AS MATERIALIZED (SELECT nm.k, nm.pos, e.* FROM nm JOIN e USING (edge_id)),
 ar AS MATERIALIZED (SELECT {_P} AS pmid, title, abstract FROM articles WHERE regexp_full_match({_P}, '[0-9]+') QUALIFY row_number() OVER (PARTITION BY {_P} ORDER BY article_row DESC) = 1),
 bp AS MATERIALIZED (SELECT k, coalesce(try_cast(pmid AS BIGINT), 0) AS pos, pmid, title, abstract FROM (SELECT DISTINCT k, unnest(pmids) AS pmid FROM be) JOIN ar USING (pmid)),
 ev AS MATERIALIZED (SELECT k, 0 AS kind, pos, 'edge:' || edge_id AS evidence_id, {S.humanized('head')} || ' ' || display_relation || ' ' || {S.humanized('tail')} AS text, [lower({S.humanized('head')}), lower({S.humanized('tail')})] AS entities, {S.relation_polarity('relation', 'display_relation')} AS polarity FROM be
   UNION ALL SELECT k, 1, pos, 'PMID:' || pmid, {_BODY}, []::VARCHAR[], {S.polarity(_BODY)} FROM bp)"""
CLAIMS = f"cl0 AS (SELECT record_id AS k, list_filter(list_transform({S.sentences('trim(' + S.txt('answer') + ', chr(32))')}, lambda s: trim(s, ' ')), lambda s: s <> '') AS l FROM qa_records), cl1 AS (SELECT k, claim, min(i) AS i FROM (SELECT k, unnest(l) AS claim, unnest(range(len(l))) AS i FROM cl0) GROUP BY 1, 2), cl AS MATERIALIZED (SELECT k, claim, (row_number() OVER (PARTITION BY k ORDER BY i) - 1)::INT AS claim_pos FROM cl1)"
GROUND = f"""{BUNDLE}, {CLAIMS},
 c AS (SELECT k, claim_pos, claim, {S.refs('claim')} AS cited, {S.tokens('claim', K.JUDGE_STOPWORDS)} AS ct, {S.polarity('claim')} AS own, {S.claim_type('claim')} AS claim_type FROM cl),
 v AS (SELECT *, {S.tokens('text', K.JUDGE_STOPWORDS)} AS et FROM ev),
 pr AS (SELECT c.k, claim_pos, claim, cited, ct, own, kind, pos, evidence_id, entities, et, polarity, len(list_intersect(ct, et)) AS shared FROM c JOIN v USING (k) WHERE len(cited) = 0 OR list_contains(cited, evidence_id)),
 sc AS (SELECT k, claim_pos, kind, pos, evidence_id, CASE WHEN len(ct) > 0 AND len(et) > 0 THEN round(greatest(0.0, least(1.0, shared / len(ct)::DOUBLE + CASE WHEN len(entities) > 0 THEN 0.15 * len(list_filter(entities, lambda x: x <> '' AND contains(lower(claim), x))) / len(entities) ELSE 0.0 END + CASE WHEN list_contains(cited, evidence_id) THEN 0.1 ELSE 0.0 END)), 9) ELSE 0.0 END AS support,
   CASE WHEN own <> 'neutral' AND polarity <> 'neutral' AND own <> polarity THEN CASE WHEN shared > 0 THEN 0.7 ELSE 0.6 END ELSE 0.0 END::DOUBLE AS against FROM pr),
 tp AS (SELECT * FROM sc WHERE greatest(support, against) > 0 QUALIFY row_number() OVER (PARTITION BY k, claim_pos ORDER BY greatest(support, against) DESC, kind, pos, evidence_id) = 1),
 vd AS MATERIALIZED (SELECT c.k, c.claim_pos, claim_type, tp.evidence_id AS ev, support, against, CASE WHEN tp.evidence_id IS NULL THEN 'unsupported' WHEN against >= 0.3 AND against >= support THEN 'contradicted' WHEN support >= 0.25 THEN 'supported' ELSE 'unsupported' END AS verdict FROM c LEFT JOIN tp USING (k, claim_pos))"""
_ROLL = f"""{GROUND}, ag AS (SELECT k, count(*) AS n_claims, count(*) FILTER (verdict = 'supported') AS n_supported, count(*) FILTER (verdict = 'contradicted') AS n_contradicted, count(*) FILTER (verdict IN ('unsupported', 'contradicted')) AS n_bad,
   bool_or({S.severity('claim_type', 'verdict')} = 3 OR (claim_type = 'life_critical' AND verdict <> 'supported')) AS h5 FROM vd GROUP BY 1),
 ru AS (SELECT record_id AS k, coalesce(n_claims, 0) AS n_claims, coalesce(n_supported, 0) AS n_supported, coalesce(n_contradicted, 0) AS n_contradicted, coalesce(n_bad, 0) AS n_bad, coalesce(h5, false) AS h5 FROM (SELECT DISTINCT record_id FROM qa_records) LEFT JOIN ag ON k = record_id),
 rf AS (SELECT *, round(greatest(0.0, least(1.0, n_supported / greatest(n_claims, 1)::DOUBLE - 0.25 * n_contradicted)), 6) AS faithfulness, CASE WHEN h5 THEN 'ABSTAIN' WHEN n_bad > 0 THEN 'REVISE' ELSE 'ACCEPT' END AS recommendation FROM ru)"""
_AE, _AP = T.AUDIT_EDGE, T.AUDIT_PMID
_AREFS = f"list_distinct(list_concat(list_transform(list_filter(list_transform(regexp_extract_all(claim, '{_AE}'), lambda m: regexp_replace(regexp_extract(m, '{_AE}', 1) || regexp_extract(m, '{_AE}', 2), '[.,;:]+$', '')), lambda x: x <> ''), lambda x: 'edge:' || x), list_transform(regexp_extract_all(claim, '{_AP}', 1), lambda x: 'PMID:' || x)))"
_AKIND = "CASE " + " ".join(f"WHEN {S.has_any('claim', v)} THEN '{k}'" for k, v in K.AUDIT_TYPES.items()) + " ELSE 'factual' END"
_AUDIT = f"""{BUNDLE}, {CLAIMS},
 hv AS (SELECT k, list(evidence_id) AS have FROM ev GROUP BY 1), qc AS (SELECT record_id AS k, {S.has_any('question', K.AUDIT_LIFE_CRITICAL)} AS critical FROM qa_records),
 c AS MATERIALIZED (SELECT *, list_sort(list_filter(cited, lambda x: NOT list_contains(have, x))) AS unknown FROM (SELECT cl.k, claim_pos, claim, {_AREFS} AS cited, {S.tokens('claim', K.STOPWORDS, 1)} AS ct, {S.polarity('claim', K.AUDIT_NEGATIVE, K.AUDIT_POSITIVE)} AS own, {_AKIND} AS kind, coalesce(have, []::VARCHAR[]) AS have, critical FROM cl LEFT JOIN hv USING (k) JOIN qc USING (k))),
 v AS (SELECT *, {S.tokens('text', K.STOPWORDS, 1)} AS et, {S.polarity('text', K.AUDIT_NEGATIVE, K.AUDIT_POSITIVE)} AS evp FROM ev),
 sc AS (SELECT c.k, claim_pos, ek, pos, evidence_id, round(CASE WHEN kind = 'sourceattribution' AND list_contains(cited, evidence_id) THEN greatest(o, 0.9) ELSE o END, 9) AS support, round(CASE WHEN own <> 'neutral' AND evp <> 'neutral' AND own <> evp THEN least(o + 0.2, 1.0) ELSE 0.0 END, 9)::DOUBLE AS against
   FROM (SELECT c.k, claim_pos, cited, own, c.kind, v.kind AS ek, pos, evidence_id, evp, len(list_intersect(ct, et)) / len(ct)::DOUBLE AS o FROM c JOIN v USING (k) WHERE len(ct) > 0 AND len(et) > 0 AND len(unknown) = 0 AND (len(cited) = 0 OR list_contains(cited, evidence_id))) c),
 tp AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY k, claim_pos ORDER BY greatest(support, against) DESC, ek DESC, pos DESC, evidence_id DESC) = 1),
 vd AS (SELECT c.k, c.claim_pos, kind, critical, unknown, evidence_id AS ev, support, against, CASE WHEN len(unknown) > 0 OR len(have) = 0 THEN 'unsupported' WHEN len(ct) = 0 THEN 'out_of_scope' WHEN against >= 0.35 AND against >= support THEN 'contradicted' WHEN support >= 0.3 THEN 'supported' ELSE 'unsupported' END AS verdict FROM c LEFT JOIN tp USING (k, claim_pos)),
 au AS MATERIALIZED (SELECT *, CASE WHEN len(unknown) > 0 THEN CASE WHEN kind = 'lifecritical' OR critical THEN 3 ELSE 2 END WHEN verdict IN ('supported', 'out_of_scope') THEN 0 WHEN kind = 'lifecritical' OR critical THEN 3 WHEN kind = 'sourceattribution' OR verdict = 'contradicted' OR kind IN ('logical', 'temporal', 'population') THEN 2 ELSE 1 END AS severity FROM vd)"""
AUDIT_LABELS = f"""{_AUDIT}, ag AS (SELECT k, count(*) AS n, count(*) FILTER (verdict = 'supported') AS s, count(*) FILTER (verdict = 'contradicted') AS c, count(*) FILTER (verdict = 'unsupported') AS u, max(severity) AS worst, list_sort(list_distinct(flatten(list(unknown)))) AS unknown FROM au GROUP BY 1),
 ar1 AS (SELECT record_id AS k, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(c, 0) AS c, coalesce(u, 0) AS u, coalesce(worst, 0) AS worst, coalesce(unknown, []::VARCHAR[]) AS unknown, record_id IN (SELECT k FROM ev) AS hasev FROM (SELECT DISTINCT record_id FROM qa_records) LEFT JOIN ag ON ag.k = record_id),
 ar2 AS (SELECT *, round(greatest(0.0, least(1.0, s / greatest(n, 1)::DOUBLE - 0.25 * c - 0.10 * u)), 6) AS faithfulness, list_filter([CASE WHEN NOT hasev THEN 'no_evidence' END, CASE WHEN n = 0 THEN 'no_claims' END, CASE WHEN len(unknown) > 0 THEN 'unknown_references' END, CASE WHEN u > 0 THEN 'unsupported_claims' END, CASE WHEN c > 0 THEN 'contradicted_claims' END], lambda x: x IS NOT NULL) AS gaps FROM ar1),
 adl AS MATERIALIZED (SELECT k, n AS n_claims, faithfulness, worst = 3 AS h5, gaps, unknown, CASE WHEN worst = 3 THEN 'reject' WHEN len(gaps) = 0 AND faithfulness >= 0.8 THEN 'golden' ELSE 'partial' END AS label FROM ar2)"""
_BM = f"""{BUNDLE}, wd AS MATERIALIZED (SELECT k, pmid AS doc, list_transform(regexp_extract_all({_BODY}, '[A-Za-z0-9-]+'), lambda w: lower(w)) AS w, {_BODY} AS text FROM bp),
 sz AS (SELECT k, doc, len(w) AS len FROM wd), cp AS (SELECT k, count(*) AS n, avg(len) AS mean FROM sz GROUP BY 1), tf AS MATERIALIZED (SELECT k, doc, term, count(*) AS tf FROM (SELECT k, doc, unnest(w) AS term FROM wd) GROUP BY 1, 2, 3),
 rw AS (SELECT k, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN cp USING (k) GROUP BY k, term, n), idf AS MATERIALIZED (SELECT k, term, CASE WHEN idf < 0 THEN {K.BM25_EPSILON} * avg(idf) OVER (PARTITION BY k) ELSE idf END AS idf FROM rw),
 qt AS (SELECT k, term, count(*) AS times FROM (SELECT record_id AS k, unnest(list_transform(regexp_extract_all(coalesce(question, ''), '[A-Za-z0-9-]+'), lambda w: lower(w))) AS term FROM qa_records) GROUP BY 1, 2),
 sr AS (SELECT k, doc, sum(times * idf * tf * {K.BM25_K1 + 1} / (tf + {K.BM25_K1} * (1 - {K.BM25_B} + {K.BM25_B} * len / mean))) AS s FROM qt JOIN idf USING (k, term) JOIN tf USING (k, term) JOIN sz USING (k, doc) JOIN cp USING (k) GROUP BY 1, 2),
 bm AS MATERIALIZED (SELECT k, doc, coalesce(s, 0.0) AS bm25 FROM sz LEFT JOIN sr USING (k, doc))"""


def _mm(c):
    return f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN CASE WHEN max({c}) OVER w = 0 THEN 0.0 ELSE 1.0 END ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END"


def oracle_sql():
    vec = "list_transform(embedding, lambda x: x::DOUBLE)"
    codes = f"bk AS (SELECT label AS code_id, list(x ORDER BY pos) AS vec FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest({vec}) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1), q AS MATERIALIZED (SELECT vec_id, code_id::INT AS code_id, d AS distance FROM (SELECT vec_id, code_id, list_sum(list_transform(list_zip({vec}, vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM embeddings, bk) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 12), code_id) = 1)"
    return {
        "record_evidence": f"WITH {BUNDLE} SELECT k, evidence_id, polarity FROM ev",
        "bm25": f"WITH {_BM} SELECT k, doc, round(bm25, 6) AS bm25 FROM bm",
        "passage_fusion_topk": f"""WITH {_BM}, lx AS (SELECT wd.k, wd.doc, {S.overlap('qt', 'dt')} AS lexical FROM (SELECT wd.k, wd.doc, {S.tokens('question')} AS qt, {S.tokens('wd.text')} AS dt FROM wd JOIN qa_records ON record_id = k) wd),
          b AS (SELECT k, doc, {_mm('bm25')} AS b, {_mm('lexical')} AS l FROM bm JOIN lx USING (k, doc) WINDOW w AS (PARTITION BY k)),
          f AS (SELECT k, doc, wb, wl, CASE WHEN wb + wl > 0 THEN (wb * b + wl * l) / (wb + wl) ELSE 0.0 END AS score FROM (SELECT *, CASE WHEN max(b) OVER w > 0 THEN {K.BM25_SHARE} ELSE 0.0 END::DOUBLE AS wb, CASE WHEN max(l) OVER w > 0 THEN {K.DENSE_SHARE} ELSE 0.0 END::DOUBLE AS wl FROM b WINDOW w AS (PARTITION BY k)))
          SELECT k, doc, round(s, 6) AS score FROM (SELECT k, doc, round(score, 8) AS s FROM f) QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, doc) <= {K.TOP_PASSAGES}""",
        "grounding_claims": f"WITH {GROUND} SELECT k, claim_pos, claim_type, verdict, CASE WHEN verdict = 'unsupported' THEN 'none' ELSE ev END AS evidence_id, {S.severity('claim_type', 'verdict')} AS severity, round(coalesce(greatest(support, against), 0.0), 6) AS score FROM vd",
        "grounding_rollup": f"WITH {_ROLL} SELECT k, n_claims, n_supported, n_contradicted, n_bad, h5, faithfulness, recommendation FROM rf",
        "audit_claims": f"WITH {_AUDIT} SELECT k, claim_pos, CASE WHEN len(unknown) > 0 THEN 'sourceattribution' ELSE kind END AS claim_type, verdict, CASE WHEN verdict IN ('unsupported', 'out_of_scope') THEN 'none' ELSE ev END AS evidence_id, severity, round(coalesce(greatest(support, against), 0.0), 6) AS score, array_to_string(unknown, ',') AS unknown FROM au",
        "audit_labels": f"WITH {AUDIT_LABELS} SELECT k, n_claims, faithfulness, h5, CASE WHEN h5 THEN 'ABSTAIN' WHEN label = 'golden' THEN 'ACCEPT' ELSE 'REVISE' END AS recommendation, array_to_string(gaps, ',') AS gaps, array_to_string(unknown, ',') AS unknown, label FROM adl",
        "claim_self_contradictions": f"""WITH c AS (SELECT k, claim, i, {_numbers('claim')} AS n, {S.tokens('claim')} AS t, {S.has_any('claim', K.POSITIVE_CUES)} AS p, {S.has_any('claim', K.NEGATIVE_CUES)} AS m FROM (SELECT record_id AS k, unnest(l) AS claim, unnest(range(len(l))) AS i FROM (SELECT record_id, {S.claims('answer')} AS l FROM qa_records))),
          j AS (SELECT a.k, list_has_any(a.t, b.t) AND (((a.p AND b.m) OR (a.m AND b.p)) OR len(list_filter(a.n, lambda x: len(list_filter(b.n, lambda y: {_SAME} AND NOT {_CLOSE})) > 0)) > 0) AS bad FROM c a JOIN c b ON a.k = b.k AND a.i < b.i)
          SELECT k, count(*) AS n_pairs, count(*) FILTER (bad) AS n_conflicts, round(count(*) FILTER (bad) / count(*)::DOUBLE, 6) AS rate FROM j GROUP BY 1""",
        "vector_topk": f"""WITH v AS (SELECT vec_id, {vec} AS e FROM embeddings), n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v)
          SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.e, b.e), 6) AS cosine FROM n a, n b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e), 12) DESC, b.vec_id) <= 10""",
        "vector_quantize": f"WITH {codes} SELECT vec_id, code_id, round(distance, 6) AS distance FROM q",
        "codebook_usage": f"WITH {codes}, n AS (SELECT code_id, count(*) AS n FROM q GROUP BY 1) SELECT bk.code_id::INT AS code_id, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM q)::DOUBLE, 6) AS share FROM bk LEFT JOIN n ON n.code_id = bk.code_id",
        "hash_embeddings": "SELECT node_index, array_to_string(list_transform(range(8), lambda i: round(('0x' || substr(sha256(coalesce(node_name, '') || '#' || i), 1, 8))::BIGINT / 2147483648.0 - 1, 4)::DECIMAL(10,4)::VARCHAR), ',') AS vec FROM kg_nodes",
    }
