"""Claims against evidence: verdicts, severities and the roll-ups that judge an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

SUPPORT, CONTRADICTION = 0.25, 0.30
AUDIT_SUPPORT, AUDIT_CONTRADICTION, CITED_FLOOR = 0.30, 0.35, 0.9
ENTITY_SHARE, GROUNDING_SHARE, SOUNDNESS_SHARE = 0.25, 0.45, 0.30
ACCEPT, ABSTAIN = 0.75, 0.40


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def evidence_of(edges: DataFrame, passages: DataFrame) -> DataFrame:
    """k, pos, evidence_id, text, entities, polarity: edges first, then passages, in the order given.

    ``edges`` has k, pos, edge_id, head, tail, relation, display_relation; ``passages`` k, pos, pmid, title, abstract.
    """
    head, tail = T.humanized(F.col("head")), T.humanized(F.col("tail"))
    e = edges.select(
        "k", F.struct(F.lit(0).alias("kind"), F.col("pos").cast("bigint").alias("pos")).alias("pos"), F.concat(F.lit("edge:"), "edge_id").alias("evidence_id"), F.concat_ws(" ", head, "display_relation", tail).alias("text"),
        F.array(F.lower(head), F.lower(tail)).alias("entities"), T.relation_polarity(F.col("relation"), F.col("display_relation")).alias("polarity"),
    )
    body = F.trim(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    p = passages.select(
        "k", F.struct(F.lit(1).alias("kind"), F.col("pos").cast("bigint").alias("pos")).alias("pos"), F.concat(F.lit("PMID:"), "pmid").alias("evidence_id"), body.alias("text"),
        F.array().cast("array<string>").alias("entities"), T.polarity(body).alias("polarity"),
    )
    return e.unionByName(p)


def _pairs(claims: DataFrame, evidence: DataFrame, stopwords, least: int) -> DataFrame:
    """Every claim (k, claim_pos, claim) with each piece of evidence of its question that it may rest on."""
    c = claims.select("k", "claim_pos", "claim", T.evidence_refs(F.col("claim")).alias("cited"), T.tokens(F.col("claim"), stopwords, least).alias("ct"))
    e = evidence.select("k", F.col("pos").alias("ev_pos"), "evidence_id", "entities", F.col("polarity").alias("ev_polarity"), T.tokens(F.col("text"), stopwords, least).alias("et"))
    j = c.join(e, "k", "left")
    return j.where((F.size("cited") == 0) | F.array_contains("cited", F.col("evidence_id")) | F.col("evidence_id").isNull()).withColumn(
        "shared", F.size(F.array_intersect("ct", F.coalesce("et", F.array().cast("array<string>"))))
    )


def ground_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """k, claim_pos, claim_type, verdict, evidence_id, severity, score of each claim.

    Support: overlap, plus .15 of the entities named, plus .1 if cited, at most 1.  Contradiction: .6 for opposite
    polarities, plus .1 if words are shared.  The best evidence has the largest of both, the first on a tie, and must
    exceed 0.  Claims that cite are held against what they cite alone.  Claims without evidence are unsupported.
    """
    p = _pairs(claims, evidence, K.JUDGE_STOPWORDS, 2)
    over = F.when((F.size("ct") == 0) | (F.coalesce(F.size("et"), F.lit(0)) <= 0), 0.0).otherwise(F.col("shared") / F.size("ct"))
    low = F.lower("claim")
    named = F.size(F.filter("entities", lambda x: (x != "") & low.contains(x)))
    support = F.when(
        over.isNotNull() & (F.size("ct") > 0) & (F.coalesce(F.size("et"), F.lit(0)) > 0),
        clamp(over + F.when(F.size("entities") > 0, 0.15 * named / F.size("entities")).otherwise(0.0) + F.when(F.array_contains("cited", F.col("evidence_id")), 0.1).otherwise(0.0)),
    ).otherwise(0.0)
    own = T.polarity(F.col("claim"))
    against = F.when((own != "neutral") & (F.col("ev_polarity") != "neutral") & (own != F.col("ev_polarity")), F.when(F.col("shared") > 0, 0.7).otherwise(0.6)).otherwise(0.0)
    s = p.select("k", "claim_pos", "claim", "cited", "ev_pos", "evidence_id", F.round(support, 9).alias("support"), F.coalesce(against, F.lit(0.0)).alias("against"))
    s = s.withColumn("best", F.greatest("support", "against"))
    # one row a claim: the best evidence by a minimum over a struct, combined before the shuffle
    top = s.where("best > 0").groupBy("k", "claim_pos").agg(F.min(F.struct((-F.col("best")).alias("b"), "ev_pos", "evidence_id", "support", "against")).alias("t"))
    out = claims.select("k", "claim_pos", "claim").join(top, ["k", "claim_pos"], "left").select("k", "claim_pos", "claim", "t.evidence_id", "t.support", "t.against")
    verdict = (
        F.when(F.col("evidence_id").isNull(), "unsupported")
        .when((F.col("against") >= CONTRADICTION) & (F.col("against") >= F.col("support")), "contradicted")
        .when(F.col("support") >= SUPPORT, "supported")
        .otherwise("unsupported")
    )
    kind = T.claim_type(F.col("claim"))
    return out.select(
        "k", "claim_pos", kind.alias("claim_type"), verdict.alias("verdict"), F.when(verdict == "unsupported", "none").otherwise(F.col("evidence_id")).alias("evidence_id"),
        T.severity(kind, verdict).alias("severity"), F.coalesce(F.greatest("support", "against"), F.lit(0.0)).alias("score"),
    )


def grounding_rollup(questions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """k, n_claims, n_supported, n_contradicted, n_bad, faithfulness, h5, recommendation; a row for every question.

    Without claims one out-of-scope claim stands in: faithfulness 0, ACCEPT.
    """
    v = F.col("verdict")
    a = verdicts.groupBy("k").agg(
        F.count("*").alias("n_claims"), F.count_if(v == "supported").alias("n_supported"), F.count_if(v == "contradicted").alias("n_contradicted"),
        F.count_if(v.isin("unsupported", "contradicted")).alias("n_bad"), F.bool_or((F.col("severity") == 3) | ((F.col("claim_type") == "life_critical") & (v != "supported"))).alias("h5"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    j = questions.select("k").distinct().join(a, "k", "left").select("k", *[zero(c) for c in ("n_claims", "n_supported", "n_contradicted", "n_bad")], F.coalesce("h5", F.lit(False)).alias("h5"))
    faith = clamp(F.col("n_supported") / F.greatest("n_claims", F.lit(1)) - 0.25 * F.col("n_contradicted"))
    return j.withColumn("faithfulness", F.round(faith, 6)).withColumn("recommendation", F.when(F.col("h5"), "ABSTAIN").when(F.col("n_bad") > 0, "REVISE").otherwise("ACCEPT"))


def audit_claims(claims: DataFrame, evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """k, claim_pos, claim_type, verdict, evidence_id, severity, score, unknown by the post-hoc rules.

    ``questions`` has k and text: a question with a life-critical word makes every claim that fails severe.  A claim that
    cites something its question's evidence lacks (``unknown``) is unsupported.  A claim that cites is held against what it
    cites, others against all evidence.  Support is the overlap, at least .9 for a cited source; contradiction the overlap
    plus .2 where polarities differ.  The last of equally good evidence counts; support from .30, contradiction from .35 if
    not below the support.  Claims without words are out of scope; without any evidence every claim is unsupported.
    """
    c = claims.select("k", "claim_pos", "claim", T.audit_refs(F.col("claim")).alias("cited"), T.tokens(F.col("claim"), K.STOPWORDS, 1).alias("ct"), T.polarity(F.col("claim"), K.AUDIT_NEGATIVE, K.AUDIT_POSITIVE).alias("own"), T.audit_type(F.col("claim")).alias("kind"))
    have = evidence.groupBy("k").agg(F.collect_set("evidence_id").alias("have"))
    empty = F.array().cast("array<string>")
    critical = questions.select("k", T.has_any(F.col("text"), K.AUDIT_LIFE_CRITICAL).alias("critical")).dropDuplicates(["k"])
    c = c.join(have, "k", "left").join(critical, "k", "left").withColumn("have", F.coalesce("have", empty)).withColumn("unknown", F.array_sort(F.array_except("cited", "have"))).withColumn("critical", F.coalesce("critical", F.lit(False)))
    e = evidence.select("k", F.col("pos").alias("ev_pos"), "evidence_id", T.polarity(F.col("text"), K.AUDIT_NEGATIVE, K.AUDIT_POSITIVE).alias("ev_polarity"), T.tokens(F.col("text"), K.STOPWORDS, 1).alias("et"))
    p = c.where((F.size("ct") > 0) & (F.size("unknown") == 0)).select("k", "claim_pos", "cited", "ct", "own", "kind").join(e.where(F.size("et") > 0), "k")
    p = p.where((F.size("cited") == 0) | F.array_contains("cited", F.col("evidence_id")))
    over = F.size(F.array_intersect("ct", "et")) / F.size("ct")
    differ = (F.col("own") != "neutral") & (F.col("ev_polarity") != "neutral") & (F.col("own") != F.col("ev_polarity"))
    support = F.when((F.col("kind") == "sourceattribution") & F.array_contains("cited", F.col("evidence_id")), F.greatest(over, F.lit(CITED_FLOOR))).otherwise(over)
    against = F.when(differ, F.least(over + 0.2, F.lit(1.0))).otherwise(0.0)
    s = p.select("k", "claim_pos", "ev_pos", "evidence_id", F.round(support, 9).alias("support"), F.round(against, 9).alias("against"))
    top = s.groupBy("k", "claim_pos").agg(F.max(F.struct(F.greatest("support", "against").alias("b"), "ev_pos", "evidence_id", "support", "against")).alias("t"))
    out = c.select("k", "claim_pos", "kind", "critical", "unknown", F.size("ct").alias("words"), F.size("have").alias("n")).join(top, ["k", "claim_pos"], "left").select("*", "t.evidence_id", "t.support", "t.against").drop("t")
    verdict = (
        F.when((F.size("unknown") > 0) | (F.col("n") == 0), "unsupported")
        .when(F.col("words") == 0, "out_of_scope")
        .when((F.col("against") >= AUDIT_CONTRADICTION) & (F.col("against") >= F.col("support")), "contradicted")
        .when(F.col("support") >= AUDIT_SUPPORT, "supported")
        .otherwise("unsupported")
    )
    severity = F.when(F.size("unknown") > 0, F.when((F.col("kind") == "lifecritical") | F.col("critical"), 3).otherwise(2)).otherwise(T.audit_severity(F.col("kind"), verdict, F.col("critical")))
    return out.select(
        "k", "claim_pos", F.when(F.size("unknown") > 0, "sourceattribution").otherwise(F.col("kind")).alias("claim_type"), verdict.alias("verdict"), F.when(verdict.isin("unsupported", "out_of_scope"), "none").otherwise(F.col("evidence_id")).alias("evidence_id"),
        severity.alias("severity"), F.coalesce(F.greatest("support", "against"), F.lit(0.0)).alias("score"), "unknown",
    )


def audit_rollup(questions: DataFrame, audited: DataFrame, evidence: DataFrame) -> DataFrame:
    """k, n_claims, faithfulness, h5, recommendation, gaps, unknown, label of each question's answer.

    Faithfulness: supported share less .25 a contradicted and .10 an unsupported claim.  gaps name what is wrong, in
    order: no evidence, no claim (one out-of-scope claim stands in), unknown references, unsupported and contradicted
    claims.  h5: a claim of severity 3.  ABSTAIN with h5 (label reject); REVISE with a bad claim, without evidence and
    support, or with a gap (partial); golden from .8 without a gap, else partial.
    """
    v = F.col("verdict")
    a = audited.groupBy("k").agg(F.count("*").alias("n"), F.count_if(v == "supported").alias("s"), F.count_if(v == "contradicted").alias("c"), F.count_if(v == "unsupported").alias("u"), F.max("severity").alias("worst"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("unknown")))).alias("unknown"))
    some = evidence.select("k").distinct().withColumn("some", F.lit(True))
    j = questions.select("k").distinct().join(a, "k", "left").join(some, "k", "left").fillna(0, ["n", "s", "c", "u", "worst"]).fillna(False, ["some"]).withColumn("unknown", F.coalesce("unknown", F.array().cast("array<string>")))
    f = F.round(clamp(F.col("s") / F.greatest("n", F.lit(1)) - 0.25 * F.col("c") - 0.10 * F.col("u")), 6)
    gaps = F.array_compact(F.array(
        F.when(~F.col("some"), F.lit("no_evidence")), F.when(F.col("n") == 0, F.lit("no_claims")), F.when(F.size("unknown") > 0, F.lit("unknown_references")),
        F.when(F.col("u") > 0, F.lit("unsupported_claims")), F.when(F.col("c") > 0, F.lit("contradicted_claims")),
    ))
    h5 = F.col("worst") == 3
    label = F.when(h5, "reject").when((F.size("gaps") == 0) & (F.col("faithfulness") >= 0.8), "golden").otherwise("partial")
    rec = F.when(h5, "ABSTAIN").when(label == "golden", "ACCEPT").otherwise("REVISE")
    x = j.select("k", F.col("n").alias("n_claims"), f.alias("faithfulness"), h5.alias("h5"), gaps.alias("gaps"), "unknown", "worst")
    return x.select("k", "n_claims", "faithfulness", "h5", rec.alias("recommendation"), "gaps", "unknown", label.alias("label"))


def guardian(rollup: DataFrame, entity_confidence: Column, entities_valid: Column, soundness: Column, sound: Column) -> DataFrame:
    """Adds confidence and decision: .25 entities, .45 grounding, .30 soundness; invalid entities x .5, unsound x .75, .05 off a bad claim."""
    entity = F.when(entities_valid, entity_confidence).otherwise(entity_confidence * 0.5)
    ground = F.greatest(F.lit(0.0), F.col("faithfulness") - 0.05 * F.col("n_bad"))
    logic = F.when(sound, soundness).otherwise(soundness * 0.75)
    conf = F.round(clamp(ENTITY_SHARE * entity + GROUNDING_SHARE * ground + SOUNDNESS_SHARE * logic), 9)
    return rollup.withColumn("confidence", conf).withColumn(
        "decision",
        F.when(F.col("h5") | (F.col("confidence") < ABSTAIN), "ABSTAIN").when(~entities_valid | ~sound | (F.col("n_bad") > 0) | (F.col("confidence") < ACCEPT), "REVISE").otherwise("ACCEPT"),
    )


def self_contradictions(claims: DataFrame) -> DataFrame:
    """k, n_pairs, n_conflicts, rate over the pairs of claims of one answer, each pair once.

    A pair clashes if its claims share a word and have opposite cues or numbers that clash.  An answer's claims are one
    array, so pairs never leave their row.
    """
    a = claims.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("claim_pos", "claim"))), lambda s: s["claim"]).alias("c"))
    pairs = F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.greatest(F.size("c"), F.lit(1))), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    e = a.select("k", F.explode(pairs).alias("p")).select("k", (F.arrays_overlap(T.tokens(F.col("p.x")), T.tokens(F.col("p.y"))) & (T.polarity_conflict(F.col("p.x"), F.col("p.y")) | T.numeric_conflict(T.numbers(F.col("p.x")), T.numbers(F.col("p.y"))))).alias("bad"))
    n = e.groupBy("k").agg(F.count("*").alias("n_pairs"), F.count_if("bad").alias("n_conflicts"))
    return n.withColumn("rate", F.round(F.col("n_conflicts") / F.col("n_pairs"), 6))
