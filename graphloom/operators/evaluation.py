"""The whole evaluation of a set of answers against a gold set, in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics as M
from .grounding import self_contradictions


def _decided(c):
    """yes, no or maybe, the first of these that occurs as a word; null if none does."""
    d = T.decision(c)
    return F.when(d.isin("yes", "no", "maybe"), d)


def evaluate(predictions: DataFrame, golds: DataFrame) -> DataFrame:
    """One row of seventeen metrics over the questions of ``golds``.

    ``golds``: k, question, gold_answer, context, gold_edges, gold_claims (arrays).  ``predictions``: k, answer_text,
    provenance (array), confidence, abstention, latency_ms.  A missing prediction is an empty answer.  An answer that
    has the word yes, no or maybe counts as that word, in every metric but its length.  Claims for the hallucination
    scores are pooled over all questions as distinct normalised texts; the supported ones of an answer are its first
    round(faithfulness x claims), halves to even.  Without golds every metric is 0.
    """
    empty = F.array().cast("array<string>")
    j = golds.join(predictions, "k", "left")
    x = j.select(
        "k", T.text(F.col("gold_answer")).alias("gold"), "context", F.coalesce("gold_edges", empty).alias("gold_edges"), F.coalesce("gold_claims", empty).alias("explicit"),
        T.text(F.col("answer_text")).alias("said"), F.coalesce("provenance", empty).alias("provenance"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("abstention", F.lit(False)).alias("abstention"), "latency_ms",
    )
    x = x.withColumn("p_label", _decided(F.col("said"))).withColumn("g_label", _decided(F.col("gold"))).withColumn("answer", F.coalesce("p_label", "said"))
    x = M.faithfulness(x, "answer", "context").withColumn("claims", T.claims(F.col("answer")))
    edges = F.filter("provenance", lambda r: r.startswith("edge:"))
    norm = lambda a: F.transform(a, lambda e: F.regexp_replace(F.regexp_replace(F.trim(e), "^edge:", ""), "^edge_id:", ""))
    rcs, rns, _ = M.set_scores(norm(edges), norm(F.col("gold_edges")))
    x = x.withColumn("rcs", rcs).withColumn("rns", rns).withColumn("exact", (T.answer(F.col("answer")) == T.answer(F.col("gold"))).cast("double"))
    x = x.withColumn("golden", F.when(F.size("explicit") > 0, F.col("explicit")).otherwise(T.claims(F.col("gold"))))
    x = x.withColumn("supported", F.slice("claims", 1, F.bround(F.col("faithfulness") * F.size("claims")).cast("int")))
    clash = self_contradictions(x.select("k", F.posexplode("claims").alias("claim_pos", "claim"))).select("k", "rate")
    x = x.join(clash, "k", "left")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    p = F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    one = x.agg(
        F.count("*").cast("double").alias("samples"), mean("exact").alias("exact_match"), mean("faithfulness").alias("ragas_faithfulness"), mean(F.coalesce("rate", F.lit(0.0))).alias("contradiction_detection_rate"),
        mean("rcs").alias("reasoning_completeness_score"), mean("rns").alias("reasoning_necessity_score"), mean(F.col("abstention").cast("double")).alias("abstention_rate"), mean("confidence").alias("mean_confidence"),
        p.alias("p"), mean(F.size("provenance").cast("double")).alias("mean_provenance_count"), mean(F.length("answer").cast("double")).alias("_"), mean(F.length("said").cast("double")).alias("mean_answer_char_length"),
    ).drop("_")
    one = one.select("*", *[F.coalesce(F.col("p")[i], F.lit(0.0)).alias(f"latency_p{q}_ms") for i, q in enumerate((50, 95, 99))]).drop("p")
    f1 = M.macro_f1(x.where("p_label is not null and g_label is not null"), "p_label", "g_label")
    pooled = M.hallucination_scores(x.select("supported", F.col("claims").alias("predicted"), F.col("golden").alias("gold_claims")), "supported", "predicted", "gold_claims")
    pooled = pooled.select(*[F.col(c).alias(f"hallucination_{c}") for c in ("precision", "recall", "f1")])
    return one.join(f1, F.lit(True)).join(pooled, F.lit(True))  # a row each
