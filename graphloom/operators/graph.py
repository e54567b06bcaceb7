"""The knowledge graph for many questions at once: linking, expansion, routing, ranking.

Every operator carries ``k``, the question, as a key, so one plan serves all questions.  Joins on nodes go through the
skew-aware join: hub nodes own a large share of the edges.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.keys import edge_id, key, pmid
from ..workspace import Workspace
from . import compact
from .skew import heavy_keys, heavy_light_join


def graph_edges(edges: DataFrame) -> DataFrame:
    """edge_id, head, tail, relation, display_relation, reliability, confidence, pmids: one row an edge id.

    Keys are trimmed and lower-cased; rows with a blank endpoint or relation are left out; of repeated deliveries the
    last row counts; a null reliability is looked up by source, a null confidence is 1.
    """
    e = edges.select(
        "row_index", edge_id(F.col("edge_id")).alias("edge_id"), key(F.col("head")).alias("head"), key(F.col("tail")).alias("tail"), key(F.col("relation")).alias("relation"),
        T.or_else(F.col("display_relation"), "").alias("display_relation"),
        F.coalesce(F.col("source_reliability").cast("double"), T.mapped(key(F.col("source")), K.RELIABILITY, K.OTHER_RELIABILITY)).alias("reliability"),
        F.coalesce(F.col("amg_confidence").cast("double"), F.lit(1.0)).alias("confidence"),
        F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("supporting_pmids", F.array().cast("array<string>")), pmid), lambda p: p.isNotNull()))).alias("pmids"),
    ).where("edge_id is not null and head is not null and tail is not null and relation is not null")
    last = e.groupBy("edge_id").agg(F.max_by(F.struct("head", "tail", "relation", "display_relation", "reliability", "confidence", "pmids"), "row_index").alias("e"))
    return last.select("edge_id", "e.*")


def incidence(edges: DataFrame) -> DataFrame:
    """node, edge_id, other, relation: each edge from both of its ends, a self-loop once."""
    out = edges.select(F.col("head").alias("node"), "edge_id", F.col("tail").alias("other"), "relation")
    back = edges.where("head <> tail").select(F.col("tail").alias("node"), "edge_id", F.col("head").alias("other"), "relation")
    return out.unionByName(back)


def node_degrees(edges: DataFrame) -> DataFrame:
    """node, degree: parallel edges count each, a self-loop counts twice."""
    return edges.select(F.explode(F.array("head", "tail")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def relation_ids(edges: DataFrame) -> DataFrame:
    """relation, n_edges, relation_id: dense ids by name from 0 (a few dozen relations, so one task ranks them)."""
    n = edges.groupBy("relation").agg(F.count("*").alias("n_edges"))
    return n.withColumn("relation_id", F.dense_rank().over(Window.orderBy("relation")) - 1)


def node_aliases(nodes: DataFrame) -> DataFrame:
    """alias, node, node_type: words of the node names, as the phrases of a text are written."""
    words = F.array_join(F.regexp_extract_all(F.lower(T.text(F.col("node_name"))), F.lit("[a-z0-9-]+"), F.lit(0)), " ")
    return nodes.select(words.alias("alias"), key(F.col("node_id")).alias("node"), F.lower(F.trim("node_type")).alias("node_type")).where("alias <> '' and node is not null").distinct()


def phrase_rows(questions: DataFrame, words: int, least: int = 3) -> DataFrame:
    """k, phrase: the distinct phrases of ``functions.text.phrases``, made row-wise for long phrases and many questions.

    Each word is a row that looks ahead, so no nested array is built.
    """
    found = F.regexp_extract_all(F.lower(T.text(F.col("text"))), F.lit("[a-z0-9-]+"), F.lit(0))
    w = questions.select("k", F.posexplode(found).alias("pos", "w0"))
    order = Window.partitionBy("k").orderBy("pos")
    w = w.select("k", "w0", *[F.lead("w0", i).over(order).alias(f"w{i}") for i in range(1, words)])
    ends = lambda c: ~F.col(c).isin(K.PHRASE_STOPWORDS)
    runs = [F.when(F.col(f"w{n}").isNotNull() & ends(f"w{n}"), F.concat_ws(" ", *[f"w{i}" for i in range(n + 1)])) for n in range(words)]
    p = w.where(ends("w0")).select("k", F.explode(F.array_compact(F.array(*runs))).alias("phrase"))
    return p.where(F.length("phrase") >= least).distinct()


def link_entities(questions: DataFrame, nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """k, phrase, node: each phrase of a question that names a node; of several the one of most edges, then largest id.

    ``questions`` has k (a key) and text.  A phrase inside a longer linked one is linked too.  Phrases are as long as
    the longest name of a node.
    """
    aliases = node_aliases(nodes)
    longest = aliases.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    found = Workspace(questions.sparkSession, "phrases").keep(phrase_rows(questions, longest), "phrases")
    best = aliases.join(degrees, "node", "left").groupBy("alias").agg(F.max_by("node", F.struct(F.coalesce("degree", F.lit(0)), "node")).alias("node"))
    return heavy_light_join(found, best.select(F.col("alias").alias("phrase"), "node"), ["phrase"])


def alias_keys(relations: DataFrame, column: str = "relation") -> DataFrame:
    """The column and its alias keys: its words joined by a space, nothing, ``_`` and ``-``, with and without synonyms."""
    w = F.regexp_extract_all(F.lower(F.col(column)), F.lit("[a-z0-9]+"), F.lit(0))
    other = F.transform(w, lambda x: T.mapped(x, K.TOKEN_SYNONYMS, x))
    joined = F.array_distinct(F.array(*[F.array_join(v, s) for v in (w, other) for s in (" ", "", "_", "-")]))
    return relations.select(column, F.explode(joined).alias("key")).where("key <> ''")


def relation_resolution(relations: DataFrame, overrides: dict[str, list[str]] | None = None, explicit: list[str] | None = None) -> DataFrame:
    """question_type, override_source, requested, matched, missing (sorted, joined by commas) for each type of question.

    ``relations`` are those the graph has.  What is requested is ``explicit``, else the type's override, else its route.  A
    family stands for its members; what matches no relation of the graph is missing.
    """
    spark, rows = relations.sparkSession, []
    for t, route in K.ROUTES.items():
        source = "explicit_override" if explicit is not None else "type_override" if t in (overrides or {}) else "question_type_default"
        for r in sorted(set(explicit if explicit is not None else (overrides or {}).get(t, route))):
            words = " ".join(re.findall("[a-z0-9]+", r.lower()))
            rows += [(t, source, r, x) for x in K.FAMILIES.get(words, [r])]
    wanted = spark.createDataFrame(rows, "question_type string, override_source string, requested string, name string")
    match = alias_keys(wanted.select("name").distinct(), "name").join(alias_keys(relations.distinct()), "key").select("name", "relation").distinct()
    j = wanted.join(match, "name", "left").groupBy("question_type", "override_source", "requested").agg(F.collect_set("relation").alias("m"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return j.groupBy("question_type", "override_source").agg(
        joined(F.collect_list("requested")).alias("requested"), joined(F.flatten(F.collect_list("m"))).alias("matched"), joined(F.collect_list(F.when(F.size("m") == 0, F.col("requested")))).alias("missing")
    )


def routed_relations(types: DataFrame, edges: DataFrame) -> DataFrame:
    """question_type, relation: the graph's relations that match those requested for each type by an alias key.

    ``types`` has question_type; a type without a route takes that of ``other``.
    """
    spark = edges.sparkSession
    wanted = []
    for t, rs in K.ROUTES.items():
        for r in rs:
            words = " ".join(r.replace("_", " ").replace("-", " ").split())
            wanted += [(t, x) for x in [r, *K.FAMILIES.get(words, [])]]
    routes = spark.createDataFrame(sorted(set(wanted)), "route string, requested string")
    keys = alias_keys(routes.select("requested").distinct(), "requested")
    have = alias_keys(edges.select("relation").distinct())
    match = keys.join(have, "key").select("requested", "relation").distinct()
    named = types.select("question_type").distinct().withColumn("route", F.when(F.col("question_type").isin(list(K.ROUTES)), F.col("question_type")).otherwise("other"))
    return named.join(F.broadcast(routes), "route").join(F.broadcast(match), "requested").select("question_type", "relation").distinct()


def expand(seeds: DataFrame, inc: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """k, edge_id, hop of the edges within two hops of the seeds (k, node); an edge of both hops counts as hop 1.

    ``allowed`` (k, relation) limits both hops before the edges are met; None admits every relation.  Seeds are not
    expanded again in hop 2.  Frontiers are written once; nodes that own many edges are heavy keys of the join.
    """
    work = Workspace(seeds.sparkSession, "expand")
    on = ["node"] if allowed is None else ["node", "relation"]
    walk = inc.select("node", "edge_id", "other", "relation")
    hubs = heavy_keys(walk, on)

    def step(frontier: DataFrame, label: str) -> DataFrame:
        f = work.keep(frontier if allowed is None else frontier.join(allowed.select("k", "relation").distinct(), "k"), label)
        return heavy_light_join(f, walk, on, heavy=sorted({*hubs, *heavy_keys(f, on)}))

    start = work.keep(seeds.select("k", "node").distinct(), "start")
    one = work.keep(step(start, "frontier1").select("k", "edge_id", F.col("other").alias("node")), "hop1")
    two = step(one.select("k", "node").distinct().join(start, ["k", "node"], "left_anti"), "frontier2")
    both = one.select("k", "edge_id", F.lit(1).alias("hop")).unionByName(two.select("k", "edge_id", F.lit(2).alias("hop")))
    return both.groupBy("k", "edge_id").agg(F.min("hop").alias("hop"))


def expansion_counts(seeds: DataFrame, found: DataFrame, edges: DataFrame) -> DataFrame:
    """k, hop1_edges, hop2_edges, candidate_edges, candidate_nodes; every seeded question has a row."""
    ends = found.join(edges.select("edge_id", "head", "tail"), "edge_id")
    nodes = ends.select("k", F.explode(F.array("head", "tail")).alias("node")).unionByName(seeds.select("k", "node")).distinct()
    n = nodes.groupBy("k").agg(F.count("*").alias("candidate_nodes"))
    e = found.groupBy("k").agg(F.count_if(F.col("hop") == 1).alias("hop1_edges"), F.count_if(F.col("hop") == 2).alias("hop2_edges"), F.count("*").alias("candidate_edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return n.join(e, "k", "left").select("k", zero("hop1_edges"), zero("hop2_edges"), zero("candidate_edges"), "candidate_nodes")


def routed_expansion(questions: DataFrame, seeds: DataFrame, edges: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(k, edge_id, hop; k, question_type, stage) with the three-stage relation filter.

    Stage ``none``: the relations routed for the question's type; ``compact_fallback``: if they lead to no edge, those
    of type ``other``; ``original_behavior``: if that fails too, all.  ``questions`` has k and text.
    """
    inc = work.keep(incidence(edges), "incidence")
    typed = work.keep(questions.select("k", T.question_type(F.col("text"), "factoid").alias("question_type")), "types")
    types = typed.select("question_type").unionByName(typed.sparkSession.createDataFrame([("other",)], "question_type string"))
    routes = work.keep(routed_relations(types, edges), "routes")
    seeds = work.keep(seeds.select("k", "node").distinct(), "seeds")
    allowed = typed.join(F.broadcast(routes), "question_type").select("k", "relation")
    one = work.keep(expand(seeds, inc, allowed), "stage1")
    left = seeds.join(one.select("k").distinct(), "k", "left_anti")
    other = [r["relation"] for r in routes.where("question_type = 'other'").select("relation").collect()]  # a few dozen at most
    rels = F.explode(F.array(*[F.lit(r) for r in other])) if other else F.lit(None).cast("string")
    two = work.keep(expand(left, inc, left.select("k").distinct().withColumn("relation", rels)), "stage2")
    left3 = left.join(two.select("k").distinct(), "k", "left_anti")
    three = work.keep(expand(left3, inc), "stage3")
    stage = lambda df, s: df.select("k").distinct().withColumn("stage", F.lit(s))
    stages = stage(one, "none").unionByName(stage(two, "compact_fallback")).unionByName(stage(left3, "original_behavior"))
    return one.unionByName(two).unionByName(three), typed.join(stages, "k")


def compact_questions(questions: DataFrame, seeds: DataFrame, graph, edges: DataFrame, work: Workspace, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """(questions as ``compact.Numbered`` asks them; k, question_type; relations by type) with the types and routes of ``routed_expansion``."""
    typed = work.keep(questions.select("k", T.question_type(F.col("text"), "factoid").alias("question_type")), "types")
    types = typed.select("question_type").unionByName(typed.sparkSession.createDataFrame([("other",)], "question_type string"))
    routes: dict[str, list[str]] = {}
    for r in routed_relations(types, edges).collect():  # a few dozen for each type
        routes.setdefault(r["question_type"], []).append(r["relation"])
    return graph.questions(seeds, typed, more), typed, routes


def compact_counts(graph, asked: DataFrame, routes: dict[str, list[str]] | None = None) -> DataFrame:
    """k, stage, hop1_edges, hop2_edges, candidate_edges, candidate_nodes, kept (how many of its own edges are candidates) of each question."""
    c = graph.solve(asked, compact.count_edges, compact.COUNTS, routes)
    stage = F.element_at(F.array(*[F.lit(x) for x in compact.STAGES]), (F.col("stage") + 1).cast("int"))
    return c.select("k", stage.alias("stage"), "hop1_edges", "hop2_edges", (F.col("hop1_edges") + F.col("hop2_edges")).alias("candidate_edges"), "candidate_nodes", "kept")


def induced_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """k, head, tail, weight: number of edges between two candidate nodes (k, node), whatever their relation."""
    pairs = edges.groupBy("head", "tail").agg(F.count("*").alias("weight"))
    h = heavy_light_join(nodes.select("k", F.col("node").alias("head")), pairs, ["head"])
    return h.join(nodes.select("k", F.col("node").alias("tail")), ["k", "tail"], "left_semi").select("k", "head", "tail", "weight")


#: A question whose graph has at most so many edges is solved in one task; larger ones by joins, with the same stop.
SOLVED_AT_ONCE = 200_000
TOLERANCE, MOST_ROUNDS = 1e-6, 100


def _solve(table, alpha: float):
    """Node scores of one question: a table of head, tail, weight, and seeds as rows whose weight is null."""
    import numpy as np
    import pyarrow as pa

    weight = table.column("weight").to_numpy(zero_copy_only=False)
    edge = ~np.isnan(weight)
    head, tail = (np.array(table.column(c).to_pylist(), object) for c in ("head", "tail"))
    names, at = np.unique(np.concatenate([head[edge], tail[edge]]).astype(str), return_inverse=True)
    n, w = len(names), weight[edge]
    h, t = at[: len(w)], at[len(w) :]
    restart = np.isin(names, head[~edge].astype(str)).astype(float)
    restart = restart / restart.sum() if restart.any() else np.full(n, 1.0 / max(n, 1))
    out = np.bincount(h, w, n)
    share, dangling = w / out[h], out == 0
    x = np.full(n, 1.0 / max(n, 1))
    for _ in range(MOST_ROUNDS):
        last, x = x, alpha * (np.bincount(t, x[h] * share, n) + x[dangling].sum() * restart) + (1 - alpha) * restart
        if np.abs(x - last).sum() < n * TOLERANCE:
            break
    else:
        raise RuntimeError("a rank did not converge")
    return pa.table({"k": pa.array(table.column("k").to_pylist()[:1] * n, table.schema.field("k").type), "node": pa.array(names.tolist(), pa.string()), "score": pa.array(x)})


def pagerank(weights: DataFrame, seeds: DataFrame, work: Workspace, alpha: float = K.ALPHA) -> DataFrame:
    """k, node, score: personalized PageRank of each question's graph (k, head, tail, weight).

    From the uniform start until the summed change is below nodes x TOLERANCE, for each question on its own; at most
    MOST_ROUNDS rounds, then an error.  The restart is uniform over the seeds in the graph, over all nodes if none is.
    Mass of nodes without out-edges goes to the restart.  Nodes without an edge are not in the graph.
    """
    w = work.keep(weights.select("k", "head", "tail", F.col("weight").cast("double").alias("weight")), "weights")
    large = work.keep(w.groupBy("k").count().where(F.col("count") > SOLVED_AT_ONCE).select("k"), "large")
    some = not large.isEmpty()
    mark = seeds.select("k", "node").distinct()
    rows = w.unionByName(mark.select("k", F.col("node").alias("head"), F.lit(None).cast("string").alias("tail"), F.lit(None).cast("double").alias("weight")).join(w.select("k").distinct(), "k", "left_semi"))
    schema = f"k {dict(w.dtypes)['k']}, node string, score double"
    small = (rows.join(large, "k", "left_anti") if some else rows).groupBy("k").applyInArrow(lambda t: _solve(t, alpha), schema)
    return small.unionByName(_large_pagerank(w.join(large, "k", "left_semi"), mark, work, alpha)) if some else small


def _large_pagerank(w: DataFrame, mark: DataFrame, work: Workspace, alpha: float) -> DataFrame:
    """``pagerank`` by joins, a written table a round; questions that have settled leave the loop."""
    w = work.keep(w, "large-weights")
    nodes = w.select("k", F.explode(F.array("head", "tail")).alias("node")).distinct()
    marked = nodes.join(mark.withColumn("s", F.lit(1)), ["k", "node"], "left")
    per = marked.groupBy("k").agg(F.count("*").alias("n"), F.count("s").alias("seeds"))
    out = w.groupBy("k", F.col("head").alias("node")).agg(F.sum("weight").alias("out_weight"))
    base = work.keep(
        marked.join(per, "k").join(out, ["k", "node"], "left").select(
            "k", "node", "n", "out_weight", F.when(F.col("seeds") == 0, 1 / F.col("n")).otherwise(F.coalesce("s", F.lit(0)) / F.greatest("seeds", F.lit(1))).alias("restart")
        ),
        "base",
    )
    shares = work.keep(w.join(out.withColumnRenamed("node", "head"), ["k", "head"]).select("k", F.col("head").alias("node"), "tail", (F.col("weight") / F.col("out_weight")).alias("share")), "shares")
    state, done = work.keep(base.select("k", "node", (1 / F.col("n")).alias("score")), "scores"), None
    for _ in range(MOST_ROUNDS):
        moved = state.join(shares, ["k", "node"]).groupBy("k", F.col("tail").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        lost = state.join(base.where("out_weight is null").select("k", "node"), ["k", "node"]).groupBy("k").agg(F.sum("score").alias("lost"))
        now = state.withColumnRenamed("score", "old").join(base, ["k", "node"]).join(moved, ["k", "node"], "left").join(lost, "k", "left").select(
            "k", "node", "n", "old", (F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + F.coalesce("lost", F.lit(0.0)) * F.col("restart")) + F.lit(1 - alpha) * F.col("restart")).alias("score")
        )
        now = work.keep(now, "scores")
        settled = work.keep(now.groupBy("k").agg(F.sum(F.abs(F.col("score") - F.col("old"))).alias("change"), F.first("n").alias("n")).where(F.col("change") < F.col("n") * TOLERANCE).select("k"), "settled")
        if not settled.isEmpty():
            part = now.join(settled, "k", "left_semi").select("k", "node", "score")
            done = part if done is None else done.unionByName(part)
            state = work.keep(now.join(settled, "k", "left_anti").select("k", "node", "score"), "scores")
            if state.isEmpty():
                return done
        else:
            work.drop(state)
            state = now.select("k", "node", "score")
    raise RuntimeError("a rank did not converge")


def top_edges(found: DataFrame, edges: DataFrame, scores: DataFrame, seeds: DataFrame, most: int = K.TOP_EDGES) -> DataFrame:
    """k, edge_id, score, rank of the best candidate edges of each question.

    Score: .45 of each endpoint's rank, .10 of the reliability, .05 if the edge touches a seed; order by score,
    reliability, confidence and edge id, all falling.  A window with a row limit per question keeps ``most`` rows.
    """
    e = found.select("k", "edge_id").join(edges.select("edge_id", "head", "tail", "reliability", "confidence"), "edge_id")
    s = scores.select("k", "node", F.round("score", 9).alias("score"))
    e = e.join(s.select("k", F.col("node").alias("head"), F.col("score").alias("hs")), ["k", "head"], "left").join(s.select("k", F.col("node").alias("tail"), F.col("score").alias("ts")), ["k", "tail"], "left")
    mark = seeds.select("k", "node").distinct()
    e = e.join(mark.select("k", F.col("node").alias("head"), F.lit(1).alias("sh")), ["k", "head"], "left").join(mark.select("k", F.col("node").alias("tail"), F.lit(1).alias("st")), ["k", "tail"], "left")
    total = (
        F.lit(K.NODE_WEIGHT) * F.coalesce("hs", F.lit(0.0)) + F.lit(K.NODE_WEIGHT) * F.coalesce("ts", F.lit(0.0)) + F.lit(K.SOURCE_WEIGHT) * F.col("reliability")
        + F.when(F.col("sh").isNotNull() | F.col("st").isNotNull(), K.SEED_BONUS).otherwise(0.0)
    )
    scored = e.withColumn("score", F.round(total, 8))
    w = Window.partitionBy("k").orderBy(F.desc("score"), F.desc("reliability"), F.desc("confidence"), F.desc("edge_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("k", "edge_id", "score", "rank")


def candidate_path_counts(seeds: DataFrame, inc: DataFrame, cap: int = 50_000) -> DataFrame:
    """k, paths: paths of one or two edges from each seed, at most ``cap``.  Computed once a node, not once a path."""
    n = inc.groupBy("node").agg(F.count("*").alias("n"))
    through = heavy_light_join(inc.where("node <> other").select("node", "other"), n.select(F.col("node").alias("other"), F.col("n").alias("m")), ["other"])
    two = through.groupBy("node").agg(F.sum(F.col("m") - 1).alias("two"))
    per = n.join(two, "node", "left").select("node", (F.col("n") + F.coalesce("two", F.lit(0))).alias("paths"))
    j = seeds.select("k", "node").distinct().join(per, "node", "left")
    return j.groupBy("k").agg(F.least(F.coalesce(F.sum("paths"), F.lit(0)), F.lit(cap)).cast("bigint").alias("paths"))


def broad_match(entities: DataFrame, nodes: DataFrame, degrees: DataFrame, least: float = 3.0) -> DataFrame:
    """surface, node, score: the best node for each name that shares a word of three letters or is the whole name.

    Score: 100 for the same name, 20 if one begins with the other, 10 if one contains the other, up to 5 for shared
    words, up to 1 for the degree (50 edges or more); the best of at least ``least``, the largest id on a tie.  Words
    meet by an equi-join on an inverted index; a frequent word goes through the skew-aware join.
    """
    long_words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) >= 3))
    e = entities.select(T.ascii_name(F.col("surface")).alias("s")).where("s <> ''").distinct()
    n = nodes.select(T.ascii_name(F.col("node_name")).alias("name"), key(F.col("node_id")).alias("node")).where("name <> '' and node is not null").distinct()
    work = Workspace(entities.sparkSession, "broad")
    words = work.keep(e.select("s", F.explode(F.array_union(long_words(F.col("s")), F.array(F.concat(F.lit("="), "s")))).alias("w")), "words")
    index = n.select("name", "node", F.explode(F.array_union(long_words(F.col("name")), F.array(F.concat(F.lit("="), "name")))).alias("w"))
    pairs = heavy_light_join(words, index, ["w"]).select("s", "name", "node").distinct().join(degrees, "node", "left")
    s, m = F.col("s"), F.col("name")
    sw = long_words(s)
    shared = F.size(F.array_intersect(sw, F.array_distinct(F.split(m, " "))))
    score = (
        F.when(s == m, 100.0).otherwise(0.0) + F.when(m.startswith(s) | s.startswith(m), 20.0).otherwise(0.0) + F.when(m.contains(s) | s.contains(m), 10.0).otherwise(0.0)
        + shared / F.greatest(F.size(sw), F.lit(1)) * 5.0 + F.least(F.coalesce("degree", F.lit(0)), F.lit(50)) / 50.0
    )
    best = pairs.withColumn("score", F.round(score, 6)).groupBy("s").agg(F.max(F.struct("score", "node")).alias("b"))
    return best.select(F.col("s").alias("surface"), "b.node", "b.score").where(F.col("score") >= least)


def ranked_evidence(questions: DataFrame, seeds: DataFrame, edges: DataFrame, work: Workspace, most: int = K.TOP_EDGES) -> DataFrame:
    """k, rank and the edge's columns: the best edges of each question's routed two-hop expansion by PageRank.

    ``questions`` has k and text.  Questions of the same type and the same seeds have the same evidence; it is found once.
    """
    seeds = work.keep(seeds.select("k", "node").distinct(), "all-seeds")
    sets = seeds.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("node")), "\n").alias("nodes"))
    typed = questions.select("k", "text", T.question_type(F.col("text"), "factoid").alias("question_type")).join(sets, "k")
    same = work.keep(typed.withColumn("first", F.min("k").over(Window.partitionBy("question_type", "nodes"))).select("k", "first", "text"), "same")
    once = same.where("k = first").select("k", "text")
    own = work.keep(seeds.join(once.select("k"), "k", "left_semi"), "own-seeds")
    graph = compact.numbered(edges, work)
    if graph is not None:
        asked, _, routes = compact_questions(once, own, graph, edges, work)
        top = work.keep(graph.solve(asked, compact.BestEdges(most), compact.BEST, routes).select(F.col("k").alias("first"), "e", "rank"), "top")
        rows = same.select("k", "first").join(top, "first").drop("first")
        return rows.join(graph.ids.join(edges, "edge_id"), "e").drop("e")
    found = work.keep(routed_expansion(once, own, edges, work)[0], "found")
    ends = found.join(edges.select("edge_id", "head", "tail"), "edge_id")
    nodes = work.keep(ends.select("k", F.explode(F.array("head", "tail")).alias("node")).unionByName(own).distinct(), "nodes")
    scores = pagerank(induced_weights(nodes, edges), own, work)
    top = work.keep(top_edges(found, edges, scores, own, most).select(F.col("k").alias("first"), "edge_id", "rank"), "top")
    return same.select("k", "first").join(heavy_light_join(top, edges, ["edge_id"]), "first").drop("first")


def selected_nodes(evidence: DataFrame, seeds: DataFrame, work: Workspace, most: int = 256) -> DataFrame:
    """k, node: the nodes of each question's evidence, the ``most`` best by PageRank over its edges, then smallest id."""
    ends = work.keep(evidence.select("k", F.explode(F.array("head", "tail")).alias("node")).distinct(), "ends")
    many = work.keep(ends.groupBy("k").count().where(F.col("count") > most).select("k"), "many")
    if many.isEmpty():
        return ends
    weights = evidence.join(many, "k", "left_semi").select("k", "head", "tail").distinct().withColumn("weight", F.lit(1))
    scores = pagerank(weights, seeds.join(many, "k", "left_semi"), work)
    w = Window.partitionBy("k").orderBy(F.desc(F.round("score", 9)), "node")
    best = scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("k", "node")
    return ends.join(many, "k", "left_anti").unionByName(best)
