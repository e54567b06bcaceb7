"""Evaluation metrics over tables of predictions and golds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.keys import edge_id


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def label_scores(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """label, tp, fp, fn, f1 of every label that is predicted or gold; null labels read as empty."""
    x = df.select(T.text(F.col(predicted)).alias("p"), T.text(F.col(gold)).alias("g"))
    e = x.select("p", "g", F.explode(F.array_distinct(F.array("p", "g"))).alias("label"))
    is_p, is_g = F.col("p") == F.col("label"), F.col("g") == F.col("label")
    n = e.groupBy("label").agg(F.count_if(is_p & is_g).alias("tp"), F.count_if(is_p & ~is_g).alias("fp"), F.count_if(~is_p & is_g).alias("fn"))
    return n.withColumn("f1", f1(safe_divide(F.col("tp"), F.col("tp") + F.col("fp")), safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))))


def macro_f1(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """macro_f1 over the union of both label sets, one row; 0 without rows."""
    return label_scores(df, predicted, gold).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def set_scores(predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """(completeness, necessity, shared) of two arrays as sets.

    Completeness: share of the gold found, 1 without gold.  Necessity: share of the predicted in gold; without
    predictions 1 if there is no gold either, else 0.
    """
    p, g = F.array_distinct(F.array_compact(predicted)), F.array_distinct(F.array_compact(gold))
    both = F.size(F.array_intersect(p, g))
    return F.when(F.size(g) == 0, 1.0).otherwise(both / F.size(g)), F.when(F.size(p) == 0, F.when(F.size(g) == 0, 1.0).otherwise(0.0)).otherwise(both / F.size(p)), both


def reasoning_edge_ids(c: Column) -> Column:
    """Distinct edge ids that a text names after ``edge:``, ``edge_id:`` or as a bare ``E_`` number."""
    found = F.regexp_extract_all(T.text(c), F.lit(r'E_[0-9]+[A-Za-z]?|(?:edge_id|edge):[A-Za-z0-9_:|.-]+'), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, edge_id), lambda x: x.isNotNull()))


def hallucination_scores(df: DataFrame, supported: str, predicted: str, gold: str) -> DataFrame:
    """precision, recall, f1 over distinct normalised claims pooled from arrays of claims, one row.

    Without gold, the supported claims count as matched and recall is 0.
    """
    norm = lambda c: df.select(F.explode(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.answer)).alias("c")).distinct()
    s, p, g = norm(F.col(supported)), norm(F.col(predicted)), norm(F.col(gold))
    n = lambda d, name: d.agg(F.count("*").alias(name))
    counts = n(s, "s").join(n(p, "p"), F.lit(True)).join(n(g, "g"), F.lit(True)).join(n(s.join(g, "c", "left_semi"), "m"), F.lit(True))  # one row each
    matched = F.when(F.col("g") == 0, F.col("s")).otherwise(F.col("m"))
    prec, rec = safe_divide(matched, F.col("p")), safe_divide(matched, F.col("g"))
    return counts.select(F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(f1(prec, rec), 6).alias("f1"))


def _upper_tail(x: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution of one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """only_a, only_b, chi_square with continuity correction, p_value, one row; without discordant rows 0 and 1."""
    upper_tail = F.pandas_udf(_upper_tail, "double")
    n = df.agg(F.count_if(F.col(a) & ~F.col(b)).alias("only_a"), F.count_if(~F.col(a) & F.col(b)).alias("only_b"))
    total = F.col("only_a") + F.col("only_b")
    n = n.withColumn("chi_square", F.when(total == 0, 0.0).otherwise(F.pow(F.abs(F.col("only_a") - F.col("only_b")) - 1, 2) / total))
    return n.withColumn("p_value", F.when(total == 0, 1.0).otherwise(upper_tail("chi_square")))


def bootstrap_mean(df: DataFrame, value: str, draws: int = 1000, seed: int = 13, level: float = 0.95) -> DataFrame:
    """n, mean, low, high: a percentile interval of the mean by the Poisson bootstrap.

    Each row's weight in every replicate is a function of its key, whatever task holds it; a block of rows draws them as one
    matrix, and only the replicates' sums leave a task, so any number of rows can be resampled.  Needs a column ``row_key`` that is unique.  No rows give
    nulls.
    """
    def weigh(batches):
        import numpy as np
        import pyarrow as pa

        u = np.uint64
        s, w = np.zeros(draws), np.zeros(draws)
        steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])
        lane = np.arange(draws, dtype=u) * u(0x9E3779B97F4A7C15)

        def mix(x):
            x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
            return x ^ (x >> u(31))

        for b in batches:
            v = b.column("v").to_numpy(zero_copy_only=False)
            k = b.column("row_key").to_numpy(zero_copy_only=False)
            ok = np.flatnonzero(~np.isnan(v))
            for i in range(0, len(ok), 1024):
                at = ok[i : i + 1024]
                with np.errstate(over="ignore"):
                    base = mix(k[at].astype(np.int64).view(u) + u(seed) * u(0xD1342543DE82EF95))
                    x = (mix(base[:, None] + lane[None, :]) >> u(11)).astype(float) / 2.0**53
                n = np.searchsorted(steps, x.ravel(), side="right").reshape(x.shape).astype(float)
                s += v[at] @ n
                w += n.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(s), pa.array(w)], ["draw", "s", "w"])

    src = df.select(F.col("row_key").cast("bigint").alias("row_key"), F.col(value).cast("double").alias("v"))
    reps = src.mapInArrow(weigh, "draw bigint, s double, w double").groupBy("draw").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).where("w > 0")
    edge = (1 - level) / 2
    q = reps.agg(F.percentile(F.col("s") / F.col("w"), F.array(F.lit(edge), F.lit(1 - edge))).alias("q"))
    return src.agg(F.count("v").alias("n"), F.avg("v").alias("mean")).join(q, F.lit(True)).select("n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def percentiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """p50, p95, p99 by linear interpolation, and the mean, per group."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), p.alias("p")).select(*by, "n", F.round("mean", 6).alias("mean"), *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def faithfulness(df: DataFrame, answer: str, context: str) -> DataFrame:
    """``df`` with faithfulness: the share of the answer's claims that some chunk of the context supports.

    1 without claims, 0 without context.  Abbreviations that the answer or the context define, and the fixed ones, are
    written out first.  A chunk supports a claim if the numbers agree, the chunk does not contradict it (opposite cues or
    a clash of numbers) and it shares at least .35 of the claim's tokens; a claim without tokens is never supported.
    Claims and chunks are arrays of one row, so nothing is shuffled.
    """
    chunks = F.filter(F.coalesce(F.col(context), F.array().cast("array<string>")), lambda c: F.trim(T.text(c)) != "")
    x = df.withColumn("_claims", T.claims(F.col(answer))).withColumn("_chunks", chunks)
    x = x.withColumn("_short", T.abbreviations(F.concat(F.array(T.text(F.col(answer))), F.col("_chunks"))))
    one = lambda t: F.struct(t.alias("t"), T.tokens(t).alias("w"), T.numbers(t).alias("n"), T.has_any(t, K.POSITIVE_CUES).alias("p"), T.has_any(t, K.NEGATIVE_CUES).alias("m"))
    x = x.withColumn("_ct", F.transform("_claims", lambda c: T.expanded(c, F.col("_short")))).withColumn("_xt", F.transform("_chunks", lambda c: T.expanded(c, F.col("_short"))))
    x = x.withColumn("_c", F.transform("_ct", one)).withColumn("_x", F.transform("_xt", one))

    def supports(c, e):
        opposed = F.arrays_overlap(c["w"], e["w"]) & ((c["p"] & e["m"]) | (c["m"] & e["p"]))
        return T.numeric_compatible(c["n"], e["n"]) & ~opposed & ~T.numeric_conflict(c["n"], e["n"]) & (T.overlap(c["w"], e["w"]) >= K.LEXICAL_SUPPORT)

    ok = F.size(F.filter("_c", lambda c: (F.size(c["w"]) > 0) & F.exists("_x", lambda e: supports(c, e))))
    score = F.when(F.size("_c") == 0, 1.0).when(F.size("_x") == 0, 0.0).otherwise(ok / F.size("_c"))
    return x.withColumn("faithfulness", score).select(*df.columns, "faithfulness")


def contradiction_score(claim: Column, context: Column) -> Column:
    """.8 for opposite cues in texts that share a word, else .7 for numbers that clash, else 0."""
    return F.when(T.polarity_conflict(claim, context), 0.8).when(T.numeric_conflict(T.numbers(claim), T.numbers(context)), 0.7).otherwise(0.0)


def entailment_score(claim: Column, context: Column) -> Column:
    """The share of the claim's words that the context has."""
    return T.overlap(T.tokens(claim), T.tokens(context))
