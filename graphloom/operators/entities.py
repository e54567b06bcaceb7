"""Entities of questions: their type, the node they stand for, the best of several candidates; which edges a record means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.keys import key
from .bundles import named_edges
from .skew import heavy_light_join

#: Names of known type, and endings and words that tell the type of others (fixed values).
LEXICON = {
    "drug": ["aspirin", "warfarin", "ibuprofen", "acetaminophen", "metformin", "insulin", "heparin", "amoxicillin", "lisinopril", "atorvastatin", "clopidogrel", "apixaban", "rivaroxaban"],
    "disease": ["stroke", "atrial fibrillation", "diabetes", "hypertension", "myocardial infarction", "pneumonia", "asthma", "heart failure", "covid-19"],
    "symptom": ["fever", "cough", "rash", "chest pain", "headache", "nausea"],
    "anatomy": ["liver", "kidney", "heart", "lung", "brain"],
    "protein": ["egfr", "braf", "ace2", "tnf-alpha"],
}
DRUG_ENDINGS = "(mab|nib|statin|pril|sartan|olol)$"
LINKER_SHARE, CONTEXT_SHARE = 0.75, 0.25


def entity_type(surface: Column) -> Column:
    """drug, disease, symptom, anatomy, protein or other, by the lexicon, then by ending and word."""
    low = T.normal(surface)
    out = None
    for kind, names in LEXICON.items():
        out = F.when(low.isin(names), kind) if out is None else out.when(low.isin(names), kind)
    return out.when(low.rlike(DRUG_ENDINGS), "drug").when(low == "pain", "symptom").otherwise("other")


def resolve_entities(entities: DataFrame, nodes: DataFrame, degrees: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """``entities`` (k, pos, surface, cui, node, entity_type) with node filled in where the graph has one.

    A node that the graph has stays as it is.  Candidates are the nodes of the concept id (``concepts``: cui, node) and
    those of the same name; the best has the entity's type, then most edges, then the largest id; null without any.
    """
    n = nodes.select(key(F.col("node_id")).alias("cand"), T.normal(F.col("node_name")).alias("name"), T.mapped(F.lower(F.trim("node_type")), K.ENTITY_TYPES, "other").alias("kind")).where("cand is not null").distinct()
    e = entities.withColumn("_name", T.normal(F.col("surface")))
    rows = e.select("_name", "entity_type", "cui", "node").distinct()
    by_name = heavy_light_join(rows.select("_name", "entity_type", "cui", "node"), n.where("name <> ''").select(F.col("name").alias("_name"), "cand", "kind"), ["_name"])
    both = by_name.select("_name", "entity_type", "cui", "node", "cand", "kind")
    if concepts is not None:
        c = concepts.select(F.lower("cui").alias("_c"), F.col("node").alias("cand"))
        by_cui = rows.withColumn("_c", F.lower("cui")).join(c, "_c").join(n.select("cand", "kind").dropDuplicates(["cand"]), "cand")
        both = both.unionByName(by_cui.select(*both.columns))
    fits = (F.col("entity_type") == F.col("kind")) | (F.col("entity_type") == "other")
    d = both.join(degrees.withColumnRenamed("node", "cand"), "cand", "left")
    best = d.groupBy("_name", "entity_type", "cui").agg(F.max_by("cand", F.struct(fits.cast("int"), F.coalesce("degree", F.lit(0)), "cand")).alias("best"))
    own = n.select(F.col("cand").alias("node")).distinct().withColumn("has", F.lit(True))
    safe = lambda c: F.coalesce(c, F.lit("\0"))
    best = best.withColumn("_u", safe(F.col("cui"))).drop("cui")
    j = e.withColumn("_u", safe(F.col("cui"))).join(own, "node", "left").join(best, ["_name", "entity_type", "_u"], "left")
    return j.withColumn("node", F.when(F.col("has"), F.col("node")).otherwise(F.col("best"))).select(*entities.columns)


def merged_entities(base: DataFrame, more: DataFrame) -> DataFrame:
    """The entities (k, pos, surface, cui, entity_type) of both, the first of those equal in normalised surface, concept and type."""
    both = base.withColumn("_s", F.lit(0)).unionByName(more.withColumn("_s", F.lit(1)))
    one = both.groupBy("k", T.normal(F.col("surface")).alias("_n"), F.coalesce("cui", F.lit("")).alias("_c"), "entity_type").agg(F.min_by(F.struct(*base.columns), F.struct("_s", "pos")).alias("e"))
    return one.select("e.*")


def best_candidates(candidates: DataFrame) -> DataFrame:
    """k, surface, cui of the best candidate (k, surface, pos, cui, score, context) of each surface.

    .75 of the linker's score, scaled within the surface, and .25 of the similarity to the context; the first on a tie.
    """
    from .retrieval import min_max

    c = candidates.withColumn("_l", min_max("score", ["k", "surface"]))
    total = F.round(LINKER_SHARE * F.col("_l") + CONTEXT_SHARE * F.coalesce("context", F.lit(0.0)), 12)
    return c.groupBy("k", "surface").agg(F.max_by("cui", F.struct(total, -F.col("pos"))).alias("cui"))


def mapper_backend(requested: str, model: str = "") -> str:
    """direct, heuristic or llm; ``auto`` is llm where a model is named, else heuristic."""
    r, m = requested.lower().strip(), model.lower().strip()
    if r not in ("auto", "direct", "heuristic", "llm"):
        raise ValueError(f"no such edge mapper: {requested}")
    named = m not in ("", "none", "null", "false", "heuristic")
    return ("llm" if named else "heuristic") if r == "auto" else r


def map_edges(records: DataFrame, evidence: DataFrame, scored: DataFrame, backend: str = "heuristic", selector: Callable[[DataFrame], DataFrame] | None = None, least: float = 3.0) -> DataFrame:
    """k, direct, present, missing, heuristic, selected (arrays of edge ids), backend_used of each record.

    ``scored`` has k, edge_id, score, first_pos of the evidence.  direct: named edges of the evidence; heuristic: those and
    the edges of at least ``least`` by first position, score, id; llm: what ``selector`` (k, edge_ids of the heuristic to k,
    edge_ids) picks within the evidence, else the heuristic's.
    """
    if backend not in ("direct", "heuristic", "llm"):
        raise ValueError(f"no such backend: {backend}")
    have = evidence.select("k", "edge_id").distinct().withColumn("in", F.lit(True))
    listed = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "edge_id")))), lambda x: x["edge_id"])
    d = named_edges(records).join(have, ["k", "edge_id"], "left").groupBy("k").agg(listed(F.lit(True)).alias("direct"), listed(F.col("in")).alias("present"), listed(F.col("in").isNull()).alias("missing"))
    h = scored.where(F.col("score") >= least).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_pos", (-F.col("score")).alias("s"), "edge_id"))), lambda x: x["edge_id"]).alias("heuristic"))
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    j = records.select(F.col("record_id").alias("k")).distinct().join(d, "k", "left").join(h, "k", "left").select("k", *[empty(c) for c in ("direct", "present", "missing", "heuristic")])
    if backend == "direct":
        return j.withColumn("heuristic", F.array().cast("array<string>")).withColumn("selected", F.col("present")).withColumn("backend_used", F.lit("direct"))
    j = j.withColumn("selected", F.array_distinct(F.concat("present", "heuristic")))
    if backend == "heuristic" or selector is None:
        return j.withColumn("backend_used", F.lit("heuristic"))
    picked = selector(j.select("k", F.col("selected").alias("edge_ids"))).select("k", F.posexplode("edge_ids").alias("pos", "edge_id")).join(have, ["k", "edge_id"])
    p = picked.groupBy("k").agg(F.array_distinct(listed(F.lit(True))).alias("picked"))
    return j.join(p, "k", "left").withColumn("selected", F.coalesce("picked", "selected")).drop("picked").withColumn("backend_used", F.lit("llm_selector"))
