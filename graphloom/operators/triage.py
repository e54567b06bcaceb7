"""The three triage passes of a sample: exact, normalized and broad."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..workspace import Workspace
from . import graph as G
from . import quality as Q
from .bundles import named_edges

HEADER = r"(?i)^\s*(?:answer\s+choices?|choices?|options?)\s*:?\s*$"
PREFIX = r"^\s*(?:[(\[]?[A-Z][)\].:-]|[(\[]?\d+[)\].:-]|[-*])\s*"
LINES = "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]+"
SHORT = {
    "t1dm": "type 1 diabetes", "type i diabetes": "type 1 diabetes", "t2dm": "type 2 diabetes", "type ii diabetes": "type 2 diabetes", "af": "atrial fibrillation",
    "mi": "myocardial infarction", "htn": "hypertension", "copd": "chronic obstructive pulmonary disease", "uti": "urinary tract infection",
}
ENDINGS = "(mab|nib|azole|cycline|mycin|pril|sartan|olol|statin)$"
LEXICON = (
    ["aspirin", "warfarin", "ibuprofen", "acetaminophen", "metformin", "insulin", "heparin", "amoxicillin", "lisinopril", "atorvastatin", "clopidogrel", "apixaban", "rivaroxaban"]
    + ["stroke", "atrial fibrillation", "diabetes", "hypertension", "myocardial infarction", "pneumonia", "asthma", "heart failure", "fever", "cough", "rash", "chest pain", "headache", "nausea"]
    + ["liver", "kidney", "heart", "lung", "brain", "egfr", "braf", "tnf-alpha"]
)
BROAD_TOP = 2 * K.TOP_EDGES


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def unlabelled(c: Column) -> Column:
    """A text without headings of choices and without the mark (``A.``, ``1)``, ``-``) before each line."""
    lines = F.filter(F.transform(F.split(T.text(c), LINES), _strip), lambda x: (x != "") & ~x.rlike(HEADER))
    return F.array_join(F.filter(F.transform(lines, lambda x: _strip(F.regexp_replace(x, PREFIX, ""))), lambda x: x != ""), "\n")


def normalized(c: Column) -> Column:
    """Lower case without marks of choices, abbreviations written out, ``&`` as and, no punctuation."""
    x = F.lower(unlabelled(c))
    for short, whole in SHORT.items():
        x = F.regexp_replace(x, rf"(?U)\b{short}\b", whole)
    return T.ascii_name(F.replace(x, F.lit("&"), F.lit(" and ")))


def _kept(options: Column, f) -> Column:
    return F.filter(F.transform(options, f), lambda x: x != "")


def rendered(question: Column, options: Column) -> Column:
    q, o = _strip(T.text(question)), _kept(options, unlabelled)
    return F.when(F.size(o) > 0, _strip(F.concat_ws("\n", q, F.lit("Options:"), F.array_join(o, "\n")))).otherwise(q)


def pass_texts(records: DataFrame) -> DataFrame:
    """The record's columns, with k (record and pass) and text (question and options as the pass reads them)."""
    q, o = F.col("question"), _kept(F.coalesce("options", F.array().cast("array<string>")), unlabelled)
    one = lambda name, text: F.struct(F.lit(name).alias("pass_name"), text.alias("text"))
    rows = F.array(one("exact", rendered(q, o)), one("normalized", rendered(normalized(q), _kept(o, normalized))), one("broad", rendered(q, _kept(o, unlabelled))))
    r = records.select("*", F.explode(rows).alias("p")).select(*records.columns, "p.*")
    return r.withColumn("k", F.concat_ws(":", F.col("record_id").cast("string"), "pass_name"))


def unlinked_names(questions: DataFrame, links: DataFrame) -> DataFrame:
    """k, phrase: names of up to three words, by a word list or the ending of a drug's name, that no node has."""
    p = questions.select("k", F.explode(T.phrases(F.col("text"))).alias("phrase"))
    p = p.where(~F.exists(F.split("phrase", " "), lambda w: w.isin(K.PHRASE_STOPWORDS)) & (F.col("phrase").isin(LEXICON) | F.col("phrase").rlike(ENDINGS)))
    return p.join(links.select("k", "phrase"), ["k", "phrase"], "left_anti")


def gold_order(evidence: DataFrame, records: DataFrame) -> DataFrame:
    """k, edges: array<struct<head, tail, edge_id>> of the evidence that a record names, then of that its text matches.

    ``records`` has record_id as k.  Matched edges score at least 3 and are ordered by first position, score and id.
    """
    text = Q.score_edges_against_text(evidence, records).where(F.col("score") >= 3.0)
    both = text.select("k", "edge_id", F.lit(1).alias("o"), F.col("first_pos").alias("pos"), (-F.col("score")).alias("s")).unionByName(
        named_edges(records).select("k", "edge_id", F.lit(0).alias("o"), "pos", F.lit(0.0).alias("s"))
    )
    first = both.groupBy("k", "edge_id").agg(F.min(F.struct("o", "pos", "s")).alias("at"))
    j = first.join(evidence.select("k", "edge_id", "head", "tail"), ["k", "edge_id"])
    got = F.array_sort(F.collect_list(F.struct("at", "edge_id", "head", "tail")))
    return j.groupBy("k").agg(F.transform(got, lambda x: F.struct(x["head"].alias("head"), x["tail"].alias("tail"), x["edge_id"].alias("edge_id"))).alias("edges"))


def record_evidence(records: DataFrame, nodes: DataFrame, edges: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(k, node; k, rank and edge columns): seeds and the best 200 edges retrieved for each record's question."""
    q = work.keep(records.select(F.col("record_id").alias("k"), F.col("question").alias("text")), "questions")
    seeds = work.keep(G.link_entities(q, nodes, work.keep(G.node_degrees(edges), "degrees")).select("k", "node").distinct(), "seeds")
    return seeds, work.keep(G.ranked_evidence(q, seeds, edges, work), "evidence")


def record_coverage(records: DataFrame, seeds: DataFrame, evidence: DataFrame, work: Workspace) -> DataFrame:
    """``quality.coverage`` of each record within its evidence, and n_evidence, its edges.

    Gold are the edges that the record names, else those of the evidence that its text matches.
    """
    named = named_edges(records)
    found = gold_order(evidence, records).select("k", F.posexplode(F.transform("edges", lambda x: x["edge_id"])).alias("pos", "edge_id"))
    gold = work.keep(named.unionByName(found.join(named.select("k").distinct(), "k", "left_anti")), "gold")
    paths = work.keep(Q.gold_paths(records, evidence, gold), "paths")
    n = evidence.groupBy("k").agg(F.count("*").alias("n_evidence"))
    ends = evidence.select("k", F.explode(F.array("head", "tail")).alias("node"))
    seeded = seeds.select("k").distinct().withColumn("has_seeds", F.lit(True))
    c = Q.coverage(paths, G.selected_nodes(evidence, seeds, work), ends).join(n, "k", "left").fillna(0, ["n_evidence"])
    return c.join(seeded, "k", "left").fillna(False, ["has_seeds"])


def triage_passes(records: DataFrame, nodes: DataFrame, edges: DataFrame, work: Workspace) -> DataFrame:
    """sample_id, pass_name, success, entities, edges, nodes, labels: three rows a record.

    Each pass links its text, expands by the relations of its question type (broad: those of ``other``) with fallback,
    ranks by PageRank and keeps 200 edges (broad 400).  The broad pass also matches names that no node has.  nodes are
    the seeds and the ends of the edges; labels the nodes of the gold path that are among the selected ones.
    """
    texts = work.keep(pass_texts(records), "texts")
    degrees = work.keep(G.node_degrees(edges), "degrees")
    q = texts.select("k", "text")
    links = work.keep(G.link_entities(q, nodes, degrees).select("k", "phrase", "node"), "links")
    names = work.keep(unlinked_names(texts.where("pass_name = 'broad'").select("k", "text"), links).withColumn("surface", T.ascii_name(F.col("phrase"))), "names")
    more = names.join(G.broad_match(names.select("surface"), nodes, degrees), "surface").select("k", "node")
    seeds = work.keep(links.select("k", "node").unionByName(more).distinct(), "pass-seeds")
    routed = texts.select("k", F.when(F.col("pass_name") == "broad", "").otherwise(F.col("text")).alias("text"))
    top = G.ranked_evidence(routed, seeds, edges, work, BROAD_TOP)
    evidence = work.keep(top.where((F.col("rank") <= K.TOP_EDGES) | F.col("k").endswith(":broad")), "evidence")
    gold = gold_order(evidence, texts.withColumn("record_id", F.col("k"))).select("k", F.explode(Q.node_path(F.col("edges"))).alias("node"))
    labels = gold.join(G.selected_nodes(evidence, seeds, work), ["k", "node"]).groupBy("k").agg(F.least(F.count("*"), F.lit(Q.LABEL_TOKENS)).alias("labels"))
    ends = seeds.unionByName(evidence.select("k", F.explode(F.array("head", "tail")).alias("node"))).distinct()
    j = texts.select("k", F.col("record_id").alias("sample_id"), "pass_name").join(ends.groupBy("k").agg(F.count("*").alias("nodes")), "k", "left").join(labels, "k", "left")
    j = j.join(evidence.groupBy("k").agg(F.count("*").alias("edges")), "k", "left").join(seeds.groupBy("k").agg(F.count("*").alias("entities")), "k", "left").fillna(0, ["nodes", "labels", "edges", "entities"])
    return j.select("sample_id", "pass_name", (F.col("nodes") > 0).alias("success"), "entities", "edges", "nodes", F.col("labels").cast("bigint").alias("labels"))
