"""Judges of an answer beside its grounding: its entities, its reasoning path, its revision; and hooks for models."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .grounding import clamp, ground_claims, grounding_rollup

#: Words of questions that ask for two steps (fixed values).
COMPLEX = ["how", "why", "interaction", "interact", "mechanism", "cause", "contraind"]


def validate_entities(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """k, valid, missing, mislinked, confidence of each question's entities.

    ``questions`` has k and text, ``entities`` k, surface, cui, node.  An entity without concept id or node is missing; one
    whose surface is not in the question, or whose ids are malformed, is mislinked.  Confidence is 1 less the distinct
    issues over twice the entities, within [0, 1]; a question without entities is not valid, with confidence 1.
    """
    e = entities.join(questions.select("k", F.lower(T.text(F.col("text"))).alias("q")), "k")
    s = T.text(F.col("surface"))
    missing = F.when(F.col("cui").isNull() | F.col("node").isNull(), s)
    wrong = F.array_compact(F.array(
        F.when(~F.contains(F.col("q"), F.lower(s)), F.concat(s, F.lit(": surface not in the question"))), F.when(F.col("cui").isNotNull() & ~T.valid_cui(F.col("cui")), F.concat(s, F.lit(": invalid concept "), "cui")),
        F.when(F.col("node").isNotNull() & ~T.valid_node_id(F.col("node")), F.concat(s, F.lit(": invalid node "), "node")),
    ))
    x = e.select("k", missing.alias("m"), wrong.alias("w"))
    g = x.groupBy("k").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("m")).alias("missing"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("mislinked"))
    empty = F.array().cast("array<string>")
    j = questions.select("k").distinct().join(g, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("missing", empty).alias("missing"), F.coalesce("mislinked", empty).alias("mislinked"))
    issues = F.size("missing") + F.size("mislinked")
    return j.select("k", ((issues == 0) & (F.col("n") > 0)).alias("valid"), "missing", "mislinked", clamp(1 - issues / F.greatest(F.col("n") * 2, F.lit(1))).alias("confidence"))


def path_soundness(questions: DataFrame, paths: DataFrame, edges_of: DataFrame, contradiction: DataFrame, entities: DataFrame) -> DataFrame:
    """k, sound, gaps, rcs, rns, cdr of each question's best path.

    ``paths`` has k, rank, nodes, edges, confidence; ``edges_of`` k, edge_id, relation, display_relation; ``contradiction``
    k, flag; ``entities`` k, node.  rcs: half the share of the edges asked for (two for how, why and the like, else one),
    half the path's confidence; rns: share of the question's nodes on the path; cdr: 1 less the share of negative edges, 0
    with a contradiction.  Sound: no gap and all three at least .5.
    """
    best = paths.where("rank = 1").select("k", "nodes", "edges", "confidence")
    step = best.select("k", F.explode("edges").alias("edge_id")).join(edges_of.select("k", "edge_id", (T.text(F.col("relation")).isin(K.NEGATIVE_RELATIONS) | T.has_any(F.col("display_relation"), K.NEGATIVE_DISPLAY)).alias("neg")).distinct(), ["k", "edge_id"])
    neg = step.groupBy("k").agg(F.count_if("neg").alias("neg"))
    nodes = entities.where("node is not null").groupBy("k").agg(F.collect_set("node").alias("asked"))
    q = questions.select("k", F.when(T.has_any(F.col("text"), COMPLEX), 2).otherwise(1).alias("expected"))
    j = q.join(best, "k", "left").join(neg, "k", "left").join(nodes, "k", "left").join(contradiction.select("k", "flag"), "k", "left")
    n, flag, none = F.coalesce(F.size("edges"), F.lit(0)), F.coalesce("flag", F.lit(False)), F.col("nodes").isNull()
    n = F.when(none, 0).otherwise(n)
    density = F.when(n > 0, F.coalesce("neg", F.lit(0)) / n).otherwise(0.0)
    gaps = F.array_compact(F.array(
        F.when(none, "no_path").when(n < F.col("expected"), F.lit("path_skips_a_step")), F.when(flag, F.lit("contradiction_flag")), F.when(~none & (density > 0.5), F.lit("path_crosses_conflicting_relations")),
    ))
    rcs = F.when(none, 0.0).otherwise(clamp(0.5 * F.least(F.lit(1.0), n / F.col("expected")) + 0.5 * F.col("confidence")))
    rns = F.when(none, 0.0).when(F.col("asked").isNull(), F.when(F.size("nodes") > 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect("asked", F.array_distinct("nodes"))) / F.size("asked"))
    cdr = clamp(1 - F.greatest(density, F.when(flag, 1.0).otherwise(0.0)))
    x = j.select("k", gaps.alias("gaps"), rcs.alias("rcs"), rns.alias("rns"), cdr.alias("cdr"))
    return x.withColumn("sound", (F.size("gaps") == 0) & (F.col("rcs") >= 0.5) & (F.col("rns") >= 0.5) & (F.col("cdr") >= 0.5))


def path_claims(questions: DataFrame, paths: DataFrame, edges_of: DataFrame, most: int = 5) -> DataFrame:
    """k, claims: the first ``most`` distinct statements of the paths' edges, by rank and position; one about the question
    itself where no edge is known.

    ``questions`` has k and text; ``edges_of`` k, edge_id, head, tail, display_relation.
    """
    step = paths.select("k", "rank", F.posexplode("edges").alias("pos", "edge_id")).join(edges_of.select("k", "edge_id", "head", "tail", "display_relation").dropDuplicates(["k", "edge_id"]), ["k", "edge_id"])
    say = F.concat(T.humanized(F.col("head")), F.lit(" "), F.lower(T.text(F.col("display_relation"))), F.lit(" "), T.humanized(F.col("tail")), F.lit("."))
    said = step.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", say.alias("s")))).alias("l"))
    j = questions.select("k", "text").join(said, "k", "left")
    own = F.array(F.concat(F.lit("Retrieved evidence is relevant to "), T.text(F.col("text")), F.lit(".")))
    return j.select("k", F.slice(F.array_distinct(F.coalesce(F.transform("l", lambda x: x["s"]), own)), 1, most).alias("claims"))


def revised_answers(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """k, answer: the supported claims, each with its evidence behind it unless it names it; without any the answer as it is.

    ``answers`` has k and answer, ``claims`` k, claim_pos, claim, verdict, evidence_id.
    """
    s = F.when((F.col("evidence_id") != "none") & ~F.contains("claim", "evidence_id"), F.concat("claim", F.lit(" ["), "evidence_id", F.lit("]"))).otherwise(F.col("claim"))
    kept = claims.where("verdict = 'supported'").groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_pos", s.alias("s")))), lambda x: x["s"]), " ").alias("new"))
    return answers.select("k", "answer").join(kept, "k", "left").select("k", F.coalesce("new", "answer").alias("answer"))


def revise(answers: DataFrame, evidence: DataFrame, work, rounds: int = 2) -> DataFrame:
    """k, answer, rounds: answers revised while their grounding says REVISE and a revision changes them, at most ``rounds`` times."""
    now = work.keep(answers.select("k", "answer", F.lit(0).alias("rounds")), "answers")
    for i in range(1, rounds + 1):
        c = work.keep(now.where(F.col("rounds") == i - 1).select("k", F.posexplode(T.judge_claims(F.col("answer"))).alias("claim_pos", "claim")), "claims")
        v = work.keep(ground_claims(c, evidence), "verdicts")
        again = grounding_rollup(now.select("k"), v).where("recommendation = 'REVISE'").select("k")
        new = revised_answers(now, c.join(v.select("k", "claim_pos", "verdict", "evidence_id"), ["k", "claim_pos"])).withColumnRenamed("answer", "new")
        j = now.join(new, "k").join(again.withColumn("again", F.lit(True)), "k", "left")
        changed = F.coalesce("again", F.lit(False)) & (F.col("rounds") == i - 1) & (F.col("new") != F.col("answer"))
        now = work.keep(j.select("k", F.when(changed, F.col("new")).otherwise(F.col("answer")).alias("answer"), F.when(changed, i).otherwise(F.col("rounds")).alias("rounds")), "answers")
    return now


def parse_success(rows: DataFrame, attempts: str, successes: str) -> DataFrame:
    """parse_success_rate: all successes over all attempts; 1 without attempts.  One row."""
    a, s = F.coalesce(F.sum(attempts), F.lit(0)), F.coalesce(F.sum(successes), F.lit(0))
    return rows.agg(F.when(a == 0, 1.0).otherwise(s / a).alias("parse_success_rate"))


def outputs_once(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first of the rows of a key that are equal in every column but ``order``."""
    rest = [c for c in rows.columns if c not in (key, order)]
    payload = F.sha2(F.to_json(F.struct(*rest)), 256)
    first = rows.withColumn("_p", payload).groupBy(key, "_p").agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return first.select("r.*")


def emergency(rows: DataFrame, error: Column) -> DataFrame:
    """``rows`` (k, answer, confidence) with an abstention in place of each row that has an error."""
    bad = error.isNotNull()
    return rows.select("k", F.when(bad, F.concat(F.lit("The question cannot be answered: "), error)).otherwise(F.col("answer")).alias("answer"), F.when(bad, 0.0).otherwise(F.col("confidence")).alias("confidence"), bad.alias("abstention"))


def model_scores(pairs: DataFrame, premise: str, hypothesis: str, model: Callable[[list[str], list[str]], list] | None, chunk: int = 256) -> DataFrame:
    """``pairs`` with label and score of a model of premise and hypothesis.

    ``model`` takes two lists of texts and gives a list of dicts, (label, score) tuples or numbers; answers are brought to
    ``entailment``, ``contradiction`` or ``neutral``.  It runs in Arrow batches.  None: both columns are null.
    """
    if model is None:
        return pairs.withColumn("label", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double"))
    def standard(x):
        if isinstance(x, dict):
            label, score = str(x.get("label", x.get("verdict", ""))).strip().lower(), float(x.get("score", x.get("confidence", 0.0)))
        elif isinstance(x, (tuple, list)):
            label, score = str(x[0]).strip().lower(), float(x[1])
        else:
            label, score = ("entailment" if float(x) >= 0.5 else "neutral"), float(x)
        for part, name in (("entail", "entailment"), ("support", "entailment"), ("contrad", "contradiction"), ("neutral", "neutral")):
            if part in label:
                return name, score
        return label or "neutral", score

    @F.pandas_udf("struct<label:string,score:double>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for i in range(0, len(a), chunk):
            out += [standard(x) for x in model(a[i : i + chunk].fillna("").tolist(), b[i : i + chunk].fillna("").tolist())]
        return pd.DataFrame(out, columns=["label", "score"])

    return pairs.withColumn("_m", run(premise, hypothesis)).select(*pairs.columns, "_m.label", "_m.score")


def overlap_model(premises: list[str], hypotheses: list[str]) -> list[float]:
    """A stand-in for a scoring model: the share of the hypothesis's words that the premise has."""
    words = lambda t: {w for w in re.split(r"[ \t\n\r\f]+", t.lower()) if len(w) > 1}
    return [len(words(h) & words(p)) / max(len(words(h)), 1) for p, h in zip(premises, hypotheses)]


