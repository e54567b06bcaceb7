"""Judges, training rows, vectors, traces: what the pipeline makes of the records' evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.keys import key
from ..operators import features, graph, grounding, judges, labels, quality, reasoning, retrieval, trace
from ..session import read
from ..workspace import Workspace
from . import sql as S
from .evidence_queries import _BM, _ROLL, AUDIT_LABELS, BUNDLE, GROUND, _Bundles, _codes, _mm
from .graph_queries import _ROUTED, EDGES, INC, LINKS, _expand, _Inputs
from .quality_queries import _decoded, decoded_ctes, gold_ctes

PAD, WIDTH, TOKENS = 4095, 256, 4095


def _questions(x):
    return x.records.select(F.col("record_id").alias("k"), F.col("question").alias("text"))


def _entities(spark, d, x):
    """k, surface, cui, node: phrases of the records' questions that name a node; the tables have no concept ids."""
    edges = x.work.keep(graph.graph_edges(read(spark, d, "kg_edges")), "all-edges")
    links = graph.link_entities(_questions(x), read(spark, d, "kg_nodes"), graph.node_degrees(edges))
    return x.work.keep(links.select("k", F.col("phrase").alias("surface"), F.lit(None).cast("string").alias("cui"), "node"), "entities")


def _listed(df, *columns):
    return df.select(*[F.array_join(c, ",").alias(c) if c in columns else c for c in df.columns])


def entity_validation(spark, d):
    x = _Bundles(spark, d, "entities")
    v = judges.validate_entities(_questions(x), _entities(spark, d, x))
    return _listed(v, "missing", "mislinked").withColumn("confidence", F.round("confidence", 6))


def _sound(spark, d, name):
    x, paths = _decoded(spark, d, name)
    paths = x.work.keep(paths, "paths")
    entities = _entities(spark, d, x)
    flag = reasoning.contradiction_scores(x.edges, x.passages).select("k", (F.col("contradiction") >= 0.5).alias("flag"))
    return x, paths, entities, judges.path_soundness(_questions(x), paths, x.edges, flag, entities)


def path_soundness(spark, d):
    s = _sound(spark, d, "sound")[3]
    return _listed(s, "gaps").select("k", "sound", "gaps", *[F.round(c, 6).alias(c) for c in ("rcs", "rns", "cdr")])


def guardian_decision(spark, d):
    x, _, entities, sound = _sound(spark, d, "guardian")
    v = judges.validate_entities(_questions(x), entities).select("k", "valid", F.col("confidence").alias("entity_confidence"))
    r = grounding.grounding_rollup(_questions(x), grounding.ground_claims(x.claims(), x.evidence())).join(v, "k").join(sound, "k")
    score = (F.col("rcs") + F.col("rns") + F.col("cdr")) / 3
    return grounding.guardian(r, F.col("entity_confidence"), F.col("valid"), score, F.col("sound")).select("k", F.round(F.col("confidence") + 1e-9, 6).alias("confidence"), "decision")


def path_claims(spark, d):
    x, paths = _decoded(spark, d, "path-claims")
    return judges.path_claims(_questions(x), x.work.keep(paths, "paths"), x.edges).select("k", F.array_join("claims", " ").alias("claims"))


def revised_answers(spark, d):
    x = _Bundles(spark, d, "revise")
    c = x.claims()
    v = grounding.ground_claims(c, x.evidence()).select("k", "claim_pos", "verdict", "evidence_id")
    return judges.revised_answers(x.records.select(F.col("record_id").alias("k"), F.coalesce("answer", F.lit("")).alias("answer")), c.join(v, ["k", "claim_pos"]))


def abstentions(spark, d):
    x, paths = _decoded(spark, d, "abstain")
    best = x.work.keep(paths, "paths").groupBy("k").agg(F.max("confidence").alias("validity"))
    clash = reasoning.contradiction_scores(x.edges, x.passages)
    r = grounding.grounding_rollup(_questions(x), grounding.ground_claims(x.claims(), x.evidence()))
    j = r.join(best, "k", "left").join(clash, "k", "left").fillna(0.0, ["validity", "contradiction"])
    return j.select("k", reasoning.should_abstain(F.col("validity"), F.col("contradiction"), F.col("h5"), F.col("recommendation"), F.col("faithfulness")).alias("abstain"))


def provenance_tags(spark, d):
    x, paths = _decoded(spark, d, "tags")
    best = x.work.keep(paths, "paths").where("rank = 1").select("k", F.col("edges").alias("path"))
    e = x.edges.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "edge_id"))), lambda s: s["edge_id"]).alias("own"))
    on = best.select("k", F.posexplode("path").alias("i", "edge_id")).join(x.edges.select("k", "edge_id", "pmids"), ["k", "edge_id"])
    m = on.groupBy("k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "pmids"))), lambda s: s["pmids"])).alias("cited"))
    p = x.passages.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pmid"))), lambda s: s["pmid"]).alias("read"))
    j = x.records.select(F.col("record_id").alias("k")).join(best, "k", "left").join(m, "k", "left").join(e, "k", "left").join(p, "k", "left")
    return j.select("k", F.array_join(reasoning.provenance_tags(F.col("path"), F.col("cited"), F.col("own"), F.col("read")), " ").alias("tags"))


def _items(spark, d, x):
    """k, pos, item, token: nodes by their number of edges and passages in one order, with a token of each."""
    n = x.edges.select("k", F.explode(F.array("head", "tail")).alias("node")).groupBy("k", "node").agg(F.count("*").alias("n"))
    most = n.groupBy("k").agg(F.max("n").alias("m"))
    nodes = n.join(most, "k").select("k", "node", (F.col("n") / F.col("m")).alias("score"))
    ranked = labels.ranked_tokens(nodes, x.passages.select("k", "pmid", F.lit(0.5).alias("score")), WIDTH)
    token = F.pmod(F.conv(F.substring(F.sha2("item", 256), 1, 8), 16, 10).cast("bigint"), F.lit(TOKENS))
    return x.work.keep(ranked.withColumn("token", token), "items")


def ranked_items(spark, d):
    x = _Bundles(spark, d, "items")
    return _items(spark, d, x).select("k", "pos", "item", F.round("score", 6).alias("score"), "token")


def token_rows(spark, d):
    x = _Bundles(spark, d, "tokens")
    r = labels.token_rows(_items(spark, d, x), PAD)
    return r.select("k", F.size("inputs").alias("width"), F.array_join(F.slice("inputs", 1, 24), ",").alias("inputs"), F.element_at("items", 1).alias("first"), F.size(F.filter("items", lambda i: i != labels.PAD)).alias("real"))


def token_types(spark, d):
    x = _Bundles(spark, d, "types")
    r = labels.token_rows(_items(spark, d, x), PAD)
    return labels.token_types(r.select("k", F.explode("items").alias("item")))


def reduced_tokens(spark, d):
    x = _Bundles(spark, d, "reduced")
    return labels.reduced_tokens(_items(spark, d, x).select("k", "pos", "item", "token"), 3, PAD)


def _labelled(spark, d, name):
    x = _Bundles(spark, d, name)
    paths = x.work.keep(quality.gold_paths(x.records, x.work.keep(graph.graph_edges(read(spark, d, "kg_edges")), "all")), "gold")
    items = _items(spark, d, x)
    return x, paths, items, x.work.keep(labels.path_labels(paths.where(F.size("path") > 0), items), "labels")


def gold_path_labels(spark, d):
    r = _labelled(spark, d, "labels")[3]
    return r.select("k", F.array_join(F.filter("labels", lambda v: v != quality.IGNORE), ",").alias("labels"), F.array_join("source_positions", ",").alias("source_positions"), "labelled", F.array_join("missing", ",").alias("missing"))


def training_graph_stats(spark, d):
    x, paths, _, lab = _labelled(spark, d, "graph-stats")
    e = x.edges.groupBy("k").agg(F.count("*").alias("n_edges"))
    n = x.edges.select("k", F.explode(F.array("head", "tail")).alias("v")).groupBy("k").agg(F.count_distinct("v").alias("n_nodes"))
    p = x.passages.groupBy("k").agg(F.count("*").alias("n_passages"))
    return labels.graph_stats(paths.select("k", "n_gold").join(e, "k", "left").join(n, "k", "left").join(p, "k", "left").join(lab.select("k", "labelled"), "k", "left").fillna(0))


def training_label_stats(spark, d):
    x, _, _, lab = _labelled(spark, d, "label-stats")
    q = _questions(x).select("k", labels.puzzle_id(T.question_type(F.col("text"))).alias("puzzle_id"))
    # the filled labels press to almost nothing, so that their file looks small enough to broadcast: they stay unfilled and are merged
    return labels.label_stats(labels.unfilled(lab.where("labelled > 0")).hint("merge").join(q, "k")).withColumn("puzzle_ids", F.array_join("puzzle_ids", ","))


def label_accuracies(spark, d):
    """The labels against the first tokens of the input rows, as a prediction."""
    x, _, items, lab = _labelled(spark, d, "accuracy")
    rows = labels.unfilled(lab).hint("merge").join(labels.tokens_in_order(items), "k")
    return labels.accuracies(rows.select(labels.filled(F.col("tokens"), PAD, "bigint", F.size("labels")).alias("predicted"), "labels"))


def node_features(spark, d):
    x = _Bundles(spark, d, "node-features")
    f = features.node_features(x.edges)
    return f.select("k", "node", "node_type", "degree", F.array_join(F.transform("features", lambda v: F.round(v, 4).cast("decimal(10,4)").cast("string")), ",").alias("features"))


def edge_features(spark, d):
    x = _Bundles(spark, d, "edge-features")
    ids = graph.relation_ids(graph.graph_edges(read(spark, d, "kg_edges")))
    f = features.edge_features(x.edges, ids)
    return f.select("k", "edge_id", "head_index", "tail_index", F.array_join(F.transform("features", lambda v: F.round(v, 4).cast("decimal(10,4)").cast("string")), ",").alias("features"))


def neighbour_means(spark, d):
    e = graph.graph_edges(read(spark, d, "kg_edges"))
    n = read(spark, d, "kg_nodes").select(key(F.col("node_id")).alias("node"), features.one_hot(features.node_type(key(F.col("node_id")))).alias("vec")).dropDuplicates(["node"])
    m = features.neighbour_means(n, Workspace(spark, "means").keep(graph.incidence(e), "incidence"))
    return m.select("node", F.array_join(F.transform("vec", lambda v: F.round(v, 4).cast("decimal(10,4)").cast("string")), ",").alias("vec"))


def initial_codebook(spark, d):
    c = features.initial_codebook(spark, 127, 16)
    return c.select("code_id", F.array_join(F.transform("vec", lambda v: F.round(v, 5).cast("decimal(10,5)").cast("string")), ",").alias("vec"))


def _usage(spark, d):
    codes, _ = _codes(spark, d)
    book = features.initial_codebook(spark, 127, 64)
    return retrieval.code_usage(retrieval.quantize(read(spark, d, "embeddings").select("vec_id", "embedding"), book), book)


def codebook_summary(spark, d):
    return features.usage_summary(_usage(spark, d))


def top_codes(spark, d):
    return features.top_codes(_usage(spark, d)).select("code_id", "n", F.round("share", 6).alias("share"))


def token_stability(spark, d):
    one, two = _codes(spark, d)[0], _codes(spark, d)[0]
    return features.token_stability(one, two)


def passage_rerank(spark, d):
    """BM25 and a deterministic stand-in for a cross-encoder, fused over the best of the pool."""
    x = _Bundles(spark, d, "rerank")
    q = _questions(x)
    c = x.passages.select("k", F.col("pmid").alias("doc"), F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))).alias("text"))
    s = retrieval.bm25(q, c).withColumn("bm25_scaled", retrieval.min_max("bm25", ["k"]))
    pool = retrieval.top_passages(s.withColumn("score", F.round("bm25_scaled", 8)), K.RERANK_POOL).drop("score", "rank")
    pairs = pool.join(c, ["k", "doc"]).join(q.withColumnRenamed("text", "question"), "k")
    scored = judges.model_scores(pairs, "text", "question", judges.overlap_model).withColumnRenamed("score", "cross")
    fused = retrieval.fuse(scored.withColumn("cross_scaled", retrieval.min_max("cross", ["k"])), {"bm25_scaled": K.BM25_SHARE, "cross_scaled": K.CROSS_SHARE})
    return retrieval.top_passages(fused.withColumn("score", F.round("score", 8))).select("k", "doc", F.round("score", 5).alias("score"))


def skip_summary(spark, d):
    x = _Bundles(spark, d, "skipped")
    ents = _entities(spark, d, x).groupBy("k").agg(F.count("*").alias("entity_count"))
    edges = x.edges.groupBy("k").agg(F.count("*").alias("edge_count"))
    gold = quality.gold_paths(x.records, x.work.keep(graph.graph_edges(read(spark, d, "kg_edges")), "all"))
    lost = gold.where("n_covered = 0").select("k", F.when(F.col("n_gold") == 0, "no_gold_edges").otherwise("gold_edges_missing").alias("skip_reason")).join(ents, "k", "left").join(edges, "k", "left").fillna(0)
    return trace.skip_summary(lost.withColumn("skip_stage", trace.skip_stage(F.col("entity_count"), F.col("edge_count"))))


def filter_benchmark(spark, d):
    x = _Inputs(spark, d, "benchmark")
    seeds = x.seeds()
    gold = read(spark, d, "eval_examples").select(F.col("eval_id").alias("k"), F.explode("gold_edges").alias("edge_id")).select("k", F.regexp_replace(F.trim("edge_id"), "^(edge_id|edge):", "").alias("edge_id"))
    if (g := x.graph()) is not None:
        asked, _, routes = graph.compact_questions(x.questions, seeds, g, x.edges, x.work, gold.distinct().join(g.ids, "edge_id").select("k", "e"))
        one = lambda r, n, kept: graph.compact_counts(g, asked, r).select("k", *(["stage"] if r else []), F.col("candidate_edges").alias(n), F.col("kept").alias(kept))
        return trace.filter_summary(one(routes, "b", "kb").join(one(None, "a", "ka"), "k"), gold)
    whole = x.work.keep(graph.expand(seeds, x.work.keep(graph.incidence(x.edges), "incidence")), "whole")
    found, stages = graph.routed_expansion(x.questions, seeds, x.edges, x.work)
    return trace.filter_benchmark(whole, x.work.keep(found, "found"), stages, gold)


def trace_verdicts(spark, d):
    x = _Bundles(spark, d, "traces")
    ents = _entities(spark, d, x).groupBy("k").agg(F.count("*").alias("n_ents"))
    n_e, n_p = x.edges.groupBy("k").agg(F.count("*").alias("n_edges")), x.passages.groupBy("k").agg(F.count("*").alias("n_pass"))
    a = grounding.audit_claims(x.claims(), x.evidence(), _questions(x))
    r = grounding.audit_rollup(_questions(x), x.work.keep(a, "audited"), x.evidence()).select("k", "label", "recommendation", "h5")
    j = r.join(ents, "k", "left").join(n_e, "k", "left").join(n_p, "k", "left").fillna(0, ["n_ents", "n_edges", "n_pass"])
    bad = lambda c: F.when(F.col(c) == 0, "fail").otherwise("ok")
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), st.alias("status")) for s, st in (("entity_extraction", bad("n_ents")), ("primekg_retrieval", bad("n_edges")), ("pubmed_retrieval", bad("n_pass")))])
    j = j.withColumn("failed", trace.first_failed(stages))
    status, stage = trace.verdict(F.col("failed"), F.lit("reject"), F.col("n_edges"), F.col("label"), F.col("recommendation"), F.col("h5"))
    return j.select("k", status.alias("status"), stage.alias("failed_stage"), trace.hint(stage).alias("hint"))


def queries():
    return {
        f.__name__: f
        for f in (entity_validation, path_soundness, guardian_decision, path_claims, revised_answers, abstentions, provenance_tags, ranked_items, token_rows, token_types, reduced_tokens, gold_path_labels, training_graph_stats, training_label_stats, label_accuracies, node_features, edge_features, neighbour_means, initial_codebook, codebook_summary, top_codes, token_stability, passage_rerank, skip_summary, filter_benchmark, trace_verdicts)
    }


#: Links of the records' questions, as those of the evaluation questions are made.
_ENT = LINKS[len(EDGES) :].replace("eval_id AS k", "record_id AS k").replace("FROM eval_examples", "FROM qa_records").replace(" al AS", " alx AS").replace("FROM al)", "FROM alx)").replace("FROM al LEFT", "FROM alx LEFT")
_Q = "qq AS MATERIALIZED (SELECT DISTINCT record_id AS k, question AS text FROM qa_records)"
_VALID = f"""vm AS (SELECT k, list_sort(list(DISTINCT phrase)) AS missing, count(*) AS n, list_sort(list(DISTINCT phrase || ': surface not in the question') FILTER (NOT contains(lower(coalesce(text, '')), lower(phrase)))) AS w FROM lk JOIN qq USING (k) GROUP BY 1),
 va AS MATERIALIZED (SELECT qq.k, coalesce(missing, []::VARCHAR[]) AS missing, coalesce(w, []::VARCHAR[]) AS mislinked, coalesce(len(missing), 0) + coalesce(len(w), 0) = 0 AND coalesce(n, 0) > 0 AS valid, greatest(0.0, least(1.0, 1 - (coalesce(len(missing), 0) + coalesce(len(w), 0)) / greatest(coalesce(n, 0) * 2, 1)::DOUBLE)) AS econf FROM qq LEFT JOIN vm USING (k))"""
_CLASH = f"""ed AS (SELECT k, head, tail, relation IN {S.values(K.NEGATIVE_RELATIONS)} OR contains(lower(display_relation), 'contra') AS neg, lower({S.humanized('head')}) AS h, lower({S.humanized('tail')}) AS t FROM be), ps AS (SELECT k, lower(coalesce(title, '') || ' ' || coalesce(abstract, '')) AS body FROM bp),
 cl0x AS (SELECT ed.k, max(CASE WHEN neg AND p THEN 0.8 WHEN NOT neg AND n THEN 0.8 WHEN neg = n THEN 0.0 ELSE 0.35 END)::DOUBLE AS c FROM ed JOIN (SELECT *, {S.has_any('body', K.CLASH_NEGATIVE)} AS n, {S.has_any('body', K.CLASH_POSITIVE)} AS p FROM ps) ps ON ed.k = ps.k AND (contains(body, h) OR contains(body, t)) GROUP BY 1),
 mxx AS (SELECT k, max(n) AS n FROM (SELECT k, head, tail, count(DISTINCT neg) AS n FROM ed GROUP BY 1, 2, 3) GROUP BY 1),
 cscore AS MATERIALIZED (SELECT mxx.k, CASE WHEN mxx.k IN (SELECT k FROM ps) THEN greatest(coalesce(c, 0.0), CASE WHEN n > 1 THEN 0.6 ELSE 0.0 END) ELSE 0.0 END::DOUBLE AS contradiction FROM mxx LEFT JOIN cl0x USING (k))"""
_SOUND = f"""bs AS (SELECT k, nodes, edges, confidence FROM rk WHERE rank = 1), ng AS (SELECT k, count(*) FILTER (relation IN {S.values(K.NEGATIVE_RELATIONS)} OR {S.has_any('display_relation', K.NEGATIVE_DISPLAY)}) AS neg FROM (SELECT k, unnest(edges) AS edge_id FROM bs) JOIN (SELECT DISTINCT k, edge_id, relation, display_relation FROM be) USING (k, edge_id) GROUP BY 1),
 nk AS (SELECT k, list(DISTINCT node) AS asked FROM lk GROUP BY 1),
 so0 AS (SELECT qq.k, CASE WHEN {S.has_any('text', judges.COMPLEX)} THEN 2 ELSE 1 END AS expected, nodes, edges, confidence, nodes IS NULL AS none, CASE WHEN nodes IS NULL THEN 0 ELSE len(edges) END AS n, coalesce(neg, 0) AS neg, asked, coalesce(contradiction >= 0.5, false) AS flag FROM qq LEFT JOIN bs USING (k) LEFT JOIN ng USING (k) LEFT JOIN nk USING (k) LEFT JOIN cscore USING (k)),
 so1 AS (SELECT *, CASE WHEN n > 0 THEN neg / n::DOUBLE ELSE 0.0 END AS density FROM so0),
 so2 AS (SELECT k, list_filter([CASE WHEN none THEN 'no_path' WHEN n < expected THEN 'path_skips_a_step' END, CASE WHEN flag THEN 'contradiction_flag' END, CASE WHEN NOT none AND density > 0.5 THEN 'path_crosses_conflicting_relations' END], lambda x: x IS NOT NULL) AS gaps,
   CASE WHEN none THEN 0.0 ELSE greatest(0.0, least(1.0, 0.5 * least(1.0, n / expected::DOUBLE) + 0.5 * confidence)) END AS rcs, CASE WHEN none THEN 0.0 WHEN asked IS NULL THEN CASE WHEN len(nodes) > 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(asked, nodes)) / len(asked)::DOUBLE END AS rns, greatest(0.0, least(1.0, 1 - greatest(density, CASE WHEN flag THEN 1.0 ELSE 0.0 END))) AS cdr FROM so1),
 so AS MATERIALIZED (SELECT *, len(gaps) = 0 AND rcs >= 0.5 AND rns >= 0.5 AND cdr >= 0.5 AS sound FROM so2)"""
_IT = f"""itn AS (SELECT k, node AS item, n / (max(n) OVER (PARTITION BY k))::DOUBLE AS score FROM (SELECT k, node, count(*) AS n FROM (SELECT k, unnest([head, tail]) AS node FROM be) GROUP BY 1, 2)),
 it AS MATERIALIZED (SELECT *, ('0x' || substr(sha256(item), 1, 8))::BIGINT % {TOKENS} AS token FROM (SELECT k, item, score, (row_number() OVER (PARTITION BY k ORDER BY score DESC, item) - 1)::INT AS pos FROM (SELECT * FROM itn UNION ALL SELECT k, 'PMID:' || pmid, 0.5 FROM bp)) WHERE pos < {WIDTH})"""
_LABS = f"""ft AS (SELECT k, item AS node, min(pos) AS pos, min_by(token, pos) AS token FROM it WHERE NOT starts_with(item, 'PMID:') GROUP BY 1, 2),
 lst AS (SELECT g.k, i, g.node, ft.pos, ft.token FROM (SELECT k, unnest(path) AS node, unnest(range(len(path))) AS i FROM gpath) g LEFT JOIN ft ON ft.k = g.k AND ft.node = g.node),
 lab AS MATERIALIZED (SELECT k, coalesce(list(token ORDER BY i) FILTER (token IS NOT NULL), []::BIGINT[])[1:{WIDTH}] AS labels, coalesce(list(pos ORDER BY i) FILTER (token IS NOT NULL), []::INT[])[1:{WIDTH}] AS source_positions, {S.distinct('miss')} AS missing FROM (SELECT k, i, node, pos, token, miss FROM lst JOIN (SELECT k, coalesce(list(node ORDER BY i) FILTER (token IS NULL), []::VARCHAR[]) AS miss FROM lst GROUP BY 1) USING (k)) GROUP BY k, miss)"""


def oracle_sql():
    dec = lambda c, n=4: f"list_transform({c}, lambda v: round(v, {n})::DECIMAL(10,{n})::VARCHAR)"
    kind = lambda c: f"CASE WHEN contains({c}, ':') AND lower(trim(split_part({c}, ':', 1), ' ')) IN {S.values(features.NODE_TYPES)} THEN lower(trim(split_part({c}, ':', 1), ' ')) ELSE 'other' END"
    hot = lambda c: "[" + ", ".join(f"({c} = '{t}')::INT::DOUBLE" for t in features.NODE_TYPES) + "]"
    vec = "list_transform(embedding, lambda x: x::DOUBLE)"
    book = lambda n, w: f"bk AS MATERIALIZED (SELECT c::INT AS code_id, list_transform(r, lambda v: v / sqrt(list_sum(list_transform(r, lambda z: z * z)))) AS vec FROM (SELECT c, list_transform(range({w}), lambda j: sin(c * 0.017::DOUBLE + j * 0.013::DOUBLE) + cos(c * 0.007::DOUBLE - j * 0.019::DOUBLE)) AS r FROM (SELECT unnest(range({n})) AS c)))"
    usage = f"{book(127, 64)}, qz AS MATERIALIZED (SELECT vec_id, code_id FROM (SELECT vec_id, code_id, list_sum(list_transform(list_zip({vec}, vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM embeddings, bk) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 12), code_id) = 1), us AS (SELECT bk.code_id, count(vec_id) AS n FROM bk LEFT JOIN qz USING (code_id) GROUP BY 1)"
    stats = f"""WITH {gold_ctes()}, {BUNDLE[BUNDLE.index(" be AS"):].lstrip()}, {_IT}, {_LABS},
          st AS (SELECT gpath.k, n_gold, coalesce(ne, 0) AS n_edges, coalesce(nn, 0) AS n_nodes, coalesce(np, 0) AS n_passages, coalesce(len(labels), 0) AS labelled FROM gpath LEFT JOIN (SELECT k, count(*) AS ne FROM be GROUP BY 1) USING (k) LEFT JOIN (SELECT k, count(DISTINCT v) AS nn FROM (SELECT k, unnest([head, tail]) AS v FROM be) GROUP BY 1) USING (k) LEFT JOIN (SELECT k, count(*) AS np FROM bp GROUP BY 1) USING (k) LEFT JOIN lab USING (k))"""
    rollup = _ROLL[len(BUNDLE) :]  # what follows the bundle
    words = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '[ \\t\\n\\r\\f]+'), lambda w: length(w) > 1))"
    stage = f"CASE WHEN n_ents = 0 THEN 'entity_extraction' WHEN n_edges = 0 THEN 'primekg_retrieval' WHEN n_pass = 0 THEN 'pubmed_retrieval' END"
    hint = "CASE " + " ".join(f"WHEN st = '{s}' THEN {S.q(h)}" for s, h in trace.HINTS.items()) + " ELSE 'The trace is usable.' END"
    return {
        "entity_validation": f"WITH {EDGES}{_ENT}, {_Q}, {_VALID} SELECT k, valid, array_to_string(missing, ',') AS missing, array_to_string(mislinked, ',') AS mislinked, round(econf, 6) AS confidence FROM va",
        "path_soundness": f"WITH {decoded_ctes()}{_ENT}, {_Q}, {_CLASH}, {_SOUND} SELECT k, sound, array_to_string(gaps, ',') AS gaps, round(rcs, 6) AS rcs, round(rns, 6) AS rns, round(cdr, 6) AS cdr FROM so",
        "guardian_decision": f"""WITH {decoded_ctes().replace(BUNDLE, BUNDLE + rollup.replace('rf AS (', 'rfz AS MATERIALIZED (').replace(' c AS (', ' gcx AS (').replace('FROM c ', 'FROM gcx c ').replace(' v AS (', ' gvx AS (').replace('JOIN v ', 'JOIN gvx v '))}{_ENT}, {_Q}, {_CLASH}, {_SOUND}, {_VALID},
          gd AS (SELECT r.*, valid, sound, round(greatest(0.0, least(1.0, 0.25::DOUBLE * CASE WHEN valid THEN econf ELSE econf * 0.5::DOUBLE END + 0.45::DOUBLE * greatest(0.0::DOUBLE, faithfulness - 0.05::DOUBLE * n_bad) + 0.30::DOUBLE * CASE WHEN sound THEN (rcs + rns + cdr) / 3 ELSE (rcs + rns + cdr) / 3 * 0.75::DOUBLE END)), 9) AS confidence FROM rfz r JOIN so USING (k) JOIN va USING (k))
          SELECT k, round(confidence + 1e-9::DOUBLE, 6) AS confidence, CASE WHEN h5 OR confidence < 0.4 THEN 'ABSTAIN' WHEN NOT valid OR NOT sound OR n_bad > 0 OR confidence < 0.75 THEN 'REVISE' ELSE 'ACCEPT' END AS decision FROM gd""",
        "path_claims": f"""WITH {decoded_ctes()}, {_Q}, ps1 AS (SELECT k, rank, unnest(edges) AS edge_id, unnest(range(len(edges))) AS i FROM rk), ps2 AS (SELECT ps1.k, list({S.humanized('head')} || ' ' || lower(coalesce(display_relation, '')) || ' ' || {S.humanized('tail')} || '.' ORDER BY rank, i) AS l FROM ps1 JOIN be ON be.k = ps1.k AND be.edge_id = ps1.edge_id GROUP BY 1),
          ps3 AS (SELECT qq.k, coalesce(l, ['Retrieved evidence is relevant to ' || coalesce(text, '') || '.']) AS l FROM qq LEFT JOIN ps2 USING (k)) SELECT k, array_to_string(({S.distinct('l')})[1:5], ' ') AS claims FROM ps3""",
        "revised_answers": f"""WITH {GROUND}, rv AS (SELECT c.k, string_agg(CASE WHEN ev <> 'none' AND NOT contains(claim, ev) THEN claim || ' [' || ev || ']' ELSE claim END, ' ' ORDER BY vd.claim_pos) AS n FROM vd JOIN c ON c.k = vd.k AND c.claim_pos = vd.claim_pos WHERE verdict = 'supported' GROUP BY 1)
          SELECT record_id AS k, coalesce(n, answer, '') AS answer FROM qa_records LEFT JOIN rv ON rv.k = record_id""",
        "abstentions": f"""WITH {decoded_ctes().replace(BUNDLE, BUNDLE + rollup.replace('rf AS (', 'rfz AS MATERIALIZED (').replace(' c AS (', ' gcx AS (').replace('FROM c ', 'FROM gcx c ').replace(' v AS (', ' gvx AS (').replace('JOIN v ', 'JOIN gvx v '))}, {_CLASH}, vv AS (SELECT k, max(confidence) AS validity FROM rk GROUP BY 1)
          SELECT rfz.k, coalesce(validity, 0) < 0.4 OR coalesce(contradiction, 0) >= 0.5 OR h5 OR recommendation = 'ABSTAIN' OR faithfulness < 0.4 AS abstain FROM rfz LEFT JOIN vv ON vv.k = rfz.k LEFT JOIN cscore ON cscore.k = rfz.k""",
        "provenance_tags": f"""WITH {decoded_ctes()}, bst AS (SELECT k, edges FROM rk WHERE rank = 1), oe AS (SELECT k, list(edge_id ORDER BY pos, edge_id) AS own FROM be GROUP BY 1), rp AS (SELECT k, list(pmid ORDER BY pos, pmid) AS rd FROM bp GROUP BY 1),
          ct AS (SELECT u.k, flatten(list(pmids ORDER BY i)) AS cited FROM (SELECT k, unnest(edges) AS edge_id, unnest(range(len(edges))) AS i FROM bst) u JOIN be ON be.k = u.k AND be.edge_id = u.edge_id GROUP BY 1),
          tg AS (SELECT record_id AS k, list_concat(list_transform(coalesce(edges, []::VARCHAR[]), lambda x: 'edge:' || x), list_transform(coalesce(cited, []::VARCHAR[]), lambda x: 'PMID:' || x), list_transform(coalesce(own, []::VARCHAR[]), lambda x: 'edge:' || x), list_transform(coalesce(rd, []::VARCHAR[]), lambda x: 'PMID:' || x)) AS l FROM qa_records LEFT JOIN bst ON bst.k = record_id LEFT JOIN ct ON ct.k = record_id LEFT JOIN oe ON oe.k = record_id LEFT JOIN rp ON rp.k = record_id)
          SELECT k, array_to_string(({S.distinct('l')})[1:3], ' ') AS tags FROM tg""",
        "ranked_items": f"WITH {BUNDLE}, {_IT} SELECT k, pos, item, round(score, 6) AS score, token FROM it",
        "token_rows": f"WITH {BUNDLE}, {_IT} SELECT k, {WIDTH} AS width, array_to_string((list_concat(list(token ORDER BY pos), list_transform(range({WIDTH}), lambda i: {PAD}::BIGINT)))[1:24], ',') AS inputs, min_by(item, pos) AS first, count(*)::INT AS real FROM it GROUP BY k",
        "token_types": f"WITH {BUNDLE}, {_IT} SELECT k, count(*) FILTER (NOT starts_with(item, 'PMID:')) AS nodes, count(*) FILTER (starts_with(item, 'PMID:')) AS passages, {WIDTH} - count(*) AS pads, 0::BIGINT AS others FROM it GROUP BY k",
        "reduced_tokens": f"WITH {BUNDLE}, {_IT} SELECT k, pos, CASE WHEN pos >= 3 THEN '__pad__' ELSE item END AS item, CASE WHEN pos >= 3 THEN {PAD} ELSE token END AS token FROM it",
        "gold_path_labels": f"WITH {gold_ctes()}, {BUNDLE[BUNDLE.index(' be AS'):].lstrip()}, {_IT}, {_LABS} SELECT k, array_to_string(labels, ',') AS labels, array_to_string(source_positions, ',') AS source_positions, len(labels)::INT AS labelled, array_to_string(missing, ',') AS missing FROM lab",
        "training_graph_stats": f"""{stats}, sb AS (SELECT *, n_gold = 0 OR labelled = 0 AS bad FROM st)
          SELECT count(*) AS examples_seen, count(*) FILTER (NOT bad) AS examples_saved, count(*) FILTER (bad) AS examples_skipped, round(avg(bad::INT), 6) AS reject_rate, round(avg(n_edges), 6) AS mean_edge_count, max(n_edges) AS max_edge_count, round(avg(n_nodes), 6) AS mean_node_count, max(n_nodes) AS max_node_count, round(avg(n_passages), 6) AS mean_passage_count,
          round(avg(n_gold), 6) AS mean_gold_path_length, round(coalesce(avg(labelled) FILTER (NOT bad), 0), 6) AS mean_labelled_count, coalesce(max(labelled) FILTER (NOT bad), 0)::BIGINT AS max_labelled_count FROM sb""",
        "training_label_stats": f"""{stats}, sl AS (SELECT lab.*, CASE {S.question_type('question')} WHEN 'drug_interaction' THEN 0 WHEN 'diagnosis' THEN 1 WHEN 'dosage' THEN 2 WHEN 'etiology' THEN 3 ELSE 4 END AS p FROM lab JOIN qa_records ON record_id = lab.k WHERE len(labels) > 0)
          SELECT count(*) AS examples, sum(len(labels))::BIGINT AS valid_label_tokens, round(avg(len(labels)), 6) AS mean_valid_label_tokens, array_to_string(list_sort(list(DISTINCT p)), ',') AS puzzle_ids FROM sl""",
        "label_accuracies": f"""{stats}, ir AS (SELECT k, list(token ORDER BY pos) AS inp FROM it GROUP BY 1), ac AS (SELECT len(labels) AS n, coalesce(len(list_filter(list_zip(labels, coalesce(inp, []::BIGINT[])), lambda z: z[1] = z[2])), 0) AS r FROM lab JOIN ir USING (k))
          SELECT round(coalesce(sum(r) / nullif(sum(n), 0)::DOUBLE, 0), 6) AS token_accuracy, round(avg((n = r)::INT), 6) AS sequence_accuracy, sum(n)::BIGINT AS tokens FROM ac""",
        "node_features": f"""WITH {BUNDLE}, pp AS (SELECT DISTINCT k, head, tail FROM be), dd AS (SELECT k, node, count(*) AS degree FROM (SELECT k, unnest([head, tail]) AS node FROM pp) GROUP BY 1, 2), de AS (SELECT *, max(degree) OVER (PARTITION BY k) AS m, {kind('node')} AS node_type FROM dd)
          SELECT k, node, node_type, degree, array_to_string({dec(f"list_concat({hot('node_type')}, [degree / greatest(m, 1)::DOUBLE, ln(1 + degree::DOUBLE) / greatest(ln(1 + m::DOUBLE), 1.0)])")}, ',') AS features FROM de""",
        "edge_features": f"""WITH {BUNDLE}, ri AS (SELECT relation, dense_rank() OVER (ORDER BY relation) - 1 AS relation_id FROM (SELECT DISTINCT relation FROM e)), ni AS (SELECT k, node, row_number() OVER (PARTITION BY k ORDER BY node) - 1 AS i FROM (SELECT DISTINCT k, unnest([head, tail]) AS node FROM be))
          SELECT be.k, edge_id, h.i::INT AS head_index, t.i::INT AS tail_index, array_to_string({dec('[relation_id::DOUBLE, reliability, confidence]')}, ',') AS features FROM be JOIN ri USING (relation) JOIN ni h ON h.k = be.k AND h.node = be.head JOIN ni t ON t.k = be.k AND t.node = be.tail""",
        "neighbour_means": f"""WITH {EDGES}, {INC}, nv AS (SELECT DISTINCT n AS node, {hot(kind('n'))} AS vec FROM (SELECT {S.key('node_id')} AS n FROM kg_nodes)), ex AS (SELECT inc.node, unnest(vec) AS x, unnest(range({len(features.NODE_TYPES)})) AS i FROM inc JOIN nv ON nv.node = inc.other)
          SELECT node, array_to_string(list(round(a, 4)::DECIMAL(10,4)::VARCHAR ORDER BY i), ',') AS vec FROM (SELECT node, i, avg(x) AS a FROM ex GROUP BY 1, 2) GROUP BY 1""",
        "initial_codebook": f"WITH {book(127, 16)} SELECT code_id, array_to_string({dec('vec', 5)}, ',') AS vec FROM bk",
        "codebook_summary": f"WITH {usage} SELECT sum(n)::BIGINT AS total_vectors, count(*) FILTER (n > 0) AS unique_codes_used, count(*) FILTER (n = 0) AS dead_code_count, round(count(*) FILTER (n = 0) / count(*)::DOUBLE, 6) AS dead_code_ratio FROM us",
        "top_codes": f"WITH {usage} SELECT code_id, n, round(n / (SELECT sum(n) FROM us)::DOUBLE, 6) AS share FROM us WHERE n > 0 ORDER BY n DESC, code_id LIMIT 10",
        "token_stability": "SELECT count(*) AS n, count(*) AS identical, 1.0::DOUBLE AS ratio FROM embeddings WHERE embedding IS NOT NULL",
        "passage_rerank": f"""WITH {_BM}, s0 AS (SELECT k, doc, {_mm('bm25')} AS b FROM bm WINDOW w AS (PARTITION BY k)), s1 AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(b, 8) DESC, doc) <= {K.RERANK_POOL}),
          s2 AS (SELECT s1.*, len(list_intersect({words("coalesce(question, '')")}, {words('wd.text')})) / greatest(len({words("coalesce(question, '')")}), 1)::DOUBLE AS x FROM s1 JOIN wd USING (k, doc) JOIN qa_records ON record_id = k), s3 AS (SELECT k, doc, b, {_mm('x')} AS x FROM s2 WINDOW w AS (PARTITION BY k)),
          s4 AS (SELECT *, CASE WHEN max(b) OVER w > 0 THEN {K.BM25_SHARE} ELSE 0.0 END::DOUBLE AS wb, CASE WHEN max(x) OVER w > 0 THEN {K.CROSS_SHARE} ELSE 0.0 END::DOUBLE AS wx FROM s3 WINDOW w AS (PARTITION BY k)), s5 AS (SELECT k, doc, round(CASE WHEN wb + wx > 0 THEN (wb * b + wx * x) / (wb + wx) ELSE 0.0 END, 8) AS s FROM s4)
          SELECT k, doc, round(s, 5) AS score FROM s5 QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, doc) <= {K.TOP_PASSAGES}""",
        "skip_summary": f"""WITH {gold_ctes()}{_ENT}, be AS (SELECT nm.k FROM nm JOIN e USING (edge_id)), ls AS (SELECT gpath.k, CASE WHEN n_gold = 0 THEN 'no_gold_edges' ELSE 'gold_edges_missing' END AS skip_reason, coalesce(ne, 0) AS e, coalesce(nn, 0) AS n FROM gpath LEFT JOIN (SELECT k, count(*) AS ne FROM be GROUP BY 1) USING (k) LEFT JOIN (SELECT k, count(*) AS nn FROM lk GROUP BY 1) USING (k) WHERE n_covered = 0),
          l2 AS (SELECT *, CASE WHEN n = 0 THEN 'entity_linking' WHEN e = 0 THEN 'retrieval' ELSE 'edge_mapping' END AS skip_stage FROM ls) SELECT coalesce(skip_stage, 'all') AS skip_stage, coalesce(skip_reason, 'all') AS skip_reason, count(*) AS n_rows, round(avg(e), 6) AS mean_edges, round(avg(n), 6) AS mean_entities FROM l2 GROUP BY GROUPING SETS ((skip_stage), (skip_reason), ())""",
        "filter_benchmark": f"""WITH {_ROUTED}, {_expand('u', 'seeds')}, gl AS (SELECT DISTINCT eval_id AS k, regexp_replace(trim(g, ' '), '^(edge_id|edge):', '') AS edge_id FROM (SELECT eval_id, unnest(gold_edges) AS g FROM eval_examples)),
          fb AS (SELECT st.k, stage, least(coalesce(a, 0), 200) AS a, least(coalesce(b, 0), 200) AS b, coalesce(g, 0) AS g, coalesce(ka, 0) AS ka, coalesce(kb, 0) AS kb FROM st LEFT JOIN (SELECT k, count(*) AS a FROM u GROUP BY 1) USING (k) LEFT JOIN (SELECT k, count(*) AS b FROM found GROUP BY 1) USING (k) LEFT JOIN (SELECT k, count(*) AS g FROM gl GROUP BY 1) USING (k)
            LEFT JOIN (SELECT k, count(*) AS ka FROM gl SEMI JOIN u USING (k, edge_id) GROUP BY 1) USING (k) LEFT JOIN (SELECT k, count(*) AS kb FROM gl SEMI JOIN found USING (k, edge_id) GROUP BY 1) USING (k))
          SELECT coalesce(stage, 'all') AS fallback_stage, count(*) AS n, round(avg(a), 6) AS mean_before, round(avg(b), 6) AS mean_after, count(*) FILTER (a > 0) AS any_before, count(*) FILTER (b > 0) AS any_after, round(avg(CASE WHEN g > 0 THEN ka / g::DOUBLE ELSE 0.0 END), 6) AS retained_before, round(avg(CASE WHEN g > 0 THEN kb / g::DOUBLE ELSE 0.0 END), 6) AS retained_after FROM fb GROUP BY ROLLUP (stage)""",
        "trace_verdicts": f"""WITH {AUDIT_LABELS}{_ENT}, tv AS (SELECT adl.k, label, h5, label = 'reject' AS audit, coalesce(ne, 0) AS n_edges, coalesce(nn, 0) AS n_ents, coalesce(np, 0) AS n_pass FROM adl LEFT JOIN (SELECT k, count(*) AS ne FROM be GROUP BY 1) USING (k) LEFT JOIN (SELECT k, count(*) AS nn FROM lk GROUP BY 1) USING (k) LEFT JOIN (SELECT k, count(*) AS np FROM bp GROUP BY 1) USING (k)),
          tw AS (SELECT *, {stage} AS failed FROM tv), tx AS (SELECT *, CASE WHEN audit THEN 'reject' WHEN label = 'golden' AND failed IS NULL AND n_edges > 0 THEN 'golden' WHEN label = 'partial' AND failed IS NULL AND n_edges > 0 THEN 'partial' WHEN failed = 'pubmed_retrieval' AND n_edges > 0 THEN 'partial' ELSE 'reject' END AS status FROM tw),
          ty AS (SELECT *, coalesce(failed, CASE WHEN audit THEN 'posthoc_audit' WHEN status = 'reject' THEN 'seed_quality' END) AS st FROM tx) SELECT k, status, st AS failed_stage, {hint} AS hint FROM ty""",
    }
