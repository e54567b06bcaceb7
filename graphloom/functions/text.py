"""Text expressions: Column in, Column out, all inside the JVM.

A null text counts as empty unless a docstring says otherwise.  Patterns keep to ASCII classes, so the same text gives
the same result in every regex dialect.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

SPACE = r"[ \t\n\r\f]+"
TAG = r"\[(edge:[^\]]+|edge_id:[^\]]+|PMID:[^\]]+)\]"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normal(c: Column) -> Column:
    """Trimmed, lower case, single spaces."""
    return squeeze(F.lower(text(c)))


def alnum(c: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one space."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}]+", " "))


def ascii_name(c: Column) -> Column:
    """Lower case; anything but a-z, 0-9 and white space becomes a space."""
    return squeeze(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9 \t\n\r\f]", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def or_else(c: Column, other: str) -> Column:
    """The trimmed text, or ``other`` if null or blank."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))


def humanized(c: Column) -> Column:
    """An id without its prefix up to the first colon, with spaces for underscores and hyphens."""
    return F.translate(F.regexp_replace(text(c), "^[^:]*:", ""), "_-", "  ")


def id_type(c: Column) -> Column:
    """The prefix of an id, lower case; ``unknown`` without one."""
    return F.when(text(c).contains(":"), F.lower(F.substring_index(c, ":", 1))).otherwise("unknown")


def valid_node_id(c: Column) -> Column:
    return text(c).contains(":") & ~text(c).endswith(":")


def valid_cui(c: Column) -> Column:
    return text(c).rlike("^C[0-9]{7}$") & ~text(c).isin("C0000000", "C9999999")


def mapped(c: Column, table: dict, other) -> Column:
    """A look-up in a small fixed table."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def has_any(c: Column, cues: Iterable[str]) -> Column:
    """Whether any cue occurs as a substring of the lower-cased text."""
    low, out = F.lower(text(c)), F.lit(False)
    for x in cues:
        out = out | low.contains(x)
    return out


def matches_pattern(c: Column, patterns: Iterable[str]) -> Column:
    """Equality, or a prefix where the pattern ends with ``*``; case is ignored."""
    low, out = F.lower(text(c)), F.lit(False)
    for p in patterns:
        out = out | (low.startswith(p[:-1].lower()) if p.endswith("*") else low == p.lower())
    return out


def answer(c: Column) -> Column:
    """An answer without references, section labels and punctuation; ``.%/-`` stay, points only between digits."""
    x = F.regexp_replace(text(c), TAG, "")
    x = F.regexp_replace(F.trim(x), r"(?i)(^|[^a-z0-9_])(direct answer|reasoning|confidence level)[ \t\n\r\f]*:[ \t\n\r\f]*", "$1")
    x = F.regexp_replace(x, SPACE, " ")
    # a point stays where a digit is on either side
    x = F.regexp_replace(x, r"(^|[^0-9])\.+($|[^0-9.])", "$1 $2")
    x = F.regexp_replace(x, r"(^|[^0-9])\.+($|[^0-9.])", "$1 $2")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}_ .%/-]", "")
    return F.lower(squeeze(x))


def label(c: Column) -> Column:
    """yes, no or maybe if the normalised answer or its first word is a synonym, else the normalised answer."""
    a = answer(c)
    first = F.substring_index(a, " ", 1)
    out = F.when(a.isin(K.LABELS["yes"]) | first.isin(K.LABELS["yes"]), "yes")
    for k in ("no", "maybe"):
        out = out.when(a.isin(K.LABELS[k]) | first.isin(K.LABELS[k]), k)
    return out.otherwise(a)


def decision(c: Column) -> Column:
    """yes, no or maybe, the first in this order that occurs as a word; else the trimmed text."""
    out = None
    for k in ("yes", "no", "maybe"):
        hit = F.lower(text(c)).rlike(f"(^|[^a-z0-9_]){k}($|[^a-z0-9_])")
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise(F.trim(text(c)))


def _sentences(x: Column) -> Column:
    return F.split(F.regexp_replace(x, r"([.!?])[ \t\n\r\f]+", "$1\n"), "\n+")


def claims(c: Column) -> Column:
    """Sentences without references, outer spaces and points."""
    parts = _sentences(F.trim(F.regexp_replace(text(c), TAG, "")))
    return F.filter(F.transform(parts, lambda s: F.btrim(squeeze(s), F.lit(" ."))), lambda s: s != "")


def judge_claims(c: Column) -> Column:
    """Distinct sentences in order, references kept."""
    return F.array_distinct(F.filter(F.transform(_sentences(F.trim(text(c))), F.trim), lambda s: s != ""))


def tokens(c: Column, stopwords=K.STOPWORDS, least: int = 2) -> Column:
    """Distinct runs of a-z and 0-9 in order, without stop words and tokens shorter than ``least``."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(found, lambda w: ~w.isin(stopwords) & (F.length(w) >= least))


def bm25_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(text(c), F.lit("[A-Za-z0-9-]+"), F.lit(0)), F.lower)


def overlap(a: Column, b: Column) -> Column:
    """Share of a's tokens that b has; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


_NUMBER = rf"(?i)([0-9]+(?:\.[0-9]+)?)[ \t]*({K.UNITS})?"


def numbers(c: Column) -> Column:
    """array<struct<value, unit>> of the numbers that start a word, with the unit behind them, if any.

    A character outside ASCII counts as a letter.
    """
    whole = rf"(?i)(?:^|[^a-z0-9_.])([0-9]+(?:\.[0-9]+)?(?:[ \t]*(?:{K.UNITS}))?)\b"
    found = F.regexp_extract_all(F.regexp_replace(text(c), "[^\\x00-\\x7F]", "x"), F.lit(whole), F.lit(1))
    return F.transform(
        found, lambda m: F.struct(F.regexp_extract(m, _NUMBER, 1).cast("double").alias("value"), F.lower(F.regexp_extract(m, _NUMBER, 2)).alias("unit"))
    )


def _close(x: Column, y: Column) -> Column:
    return F.abs(x["value"] - y["value"]) <= F.greatest(K.REL_TOL * F.greatest(F.abs(x["value"]), F.abs(y["value"])), F.lit(K.ABS_TOL))


def _same_unit(x: Column, y: Column) -> Column:
    return (x["unit"] == "") | (y["unit"] == "") | (x["unit"] == y["unit"])


def numeric_compatible(claim: Column, context: Column) -> Column:
    """Every number of the claim has a close one of the same unit in the context."""
    return F.forall(claim, lambda x: F.exists(context, lambda y: _same_unit(x, y) & _close(x, y)))


def numeric_conflict(a: Column, b: Column) -> Column:
    """Some pair of the same unit is not close."""
    return F.exists(a, lambda x: F.exists(b, lambda y: _same_unit(x, y) & ~_close(x, y)))


def dosages(c: Column) -> Column:
    """Distinct dose mentions, lower case, single spaces."""
    found = F.regexp_extract_all(text(c), F.lit(r"(?i)[0-9]+(?:\.[0-9]+)? ?(?:mcg|mg|g|ml|units)(?:/(?:kg|day|dl|ml))?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: squeeze(F.lower(m))))


def evidence_refs(c: Column) -> Column:
    """Distinct ``PMID:`` and ``edge:`` references in order; a closing bracket ends one; ``edge_id:`` reads as ``edge:``."""
    found = F.regexp_extract_all(text(c), F.lit(r"(?:PMID:|edge:|edge_id:)[^\]\s]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: F.regexp_replace(F.regexp_replace(m, "^edge_id:", "edge:"), "[.,;:]+$", "")))


def answer_tags(c: Column) -> Column:
    """Distinct bracketed references of an answer, in order; ``edge_id:`` reads as ``edge:``."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(TAG), F.lit(1)), lambda m: F.regexp_replace(m, "^edge_id:", "edge:")))


def audit_claims_of(answer: Column, steps: Column) -> Column:
    """Distinct sentences of an answer, then its steps (array), trimmed, in order."""
    more = F.filter(F.transform(F.coalesce(steps, F.array().cast("array<string>")), lambda s: F.trim(text(s))), lambda s: s != "")
    return F.array_distinct(F.concat(judge_claims(answer), more))


def evidence_id(c: Column) -> Column:
    """A canonical evidence id: aliases of nothing become ``none``; the prefix's case is repaired; else the trimmed text."""
    t = F.trim(text(c))
    low = F.lower(t)
    return (
        F.when(low.isin(K.NO_EVIDENCE), "none")
        .when(low.startswith("pmid:"), F.concat(F.lit("PMID:"), F.trim(F.substring(t, 6, 1 << 20))))
        .when(low.startswith("edge_id:"), F.concat(F.lit("edge:"), F.trim(F.substring(t, 9, 1 << 20))))
        .when(low.startswith("edge:"), F.concat(F.lit("edge:"), F.trim(F.substring(t, 6, 1 << 20))))
        .otherwise(t)
    )


def claim_type(c: Column) -> Column:
    low = F.lower(text(c))
    return (
        F.when(low.contains("edge:") | low.contains("pmid:") | low.contains("edge_id:"), "source_attribution")
        .when(has_any(c, K.LIFE_CRITICAL), "life_critical")
        .when(has_any(c, K.TEMPORAL), "temporal")
        .when(has_any(c, K.POPULATION), "population")
        .when(has_any(c, K.LOGICAL), "logical")
        .when(low.contains("in ") | low.contains("for "), "contextual")
        .otherwise("factual")
    )


#: References as an audit reads them (fixed patterns).
AUDIT_EDGE = r"(?i)(?:edge:|edge_id:)\s*([A-Za-z0-9_.:-]+)|edgeid\s*([A-Za-z0-9_.:-]+)"
AUDIT_PMID = r"(?i)PMID:\s*([0-9]+)"


def audit_refs(c: Column) -> Column:
    """Distinct ``edge:`` and ``PMID:`` references of a claim, spaces behind the prefix and any case allowed."""
    e = F.transform(F.regexp_extract_all(text(c), F.lit(AUDIT_EDGE), F.lit(0)), lambda m: F.concat(F.regexp_extract(m, AUDIT_EDGE, 1), F.regexp_extract(m, AUDIT_EDGE, 2)))
    e = F.filter(F.transform(e, lambda x: F.regexp_replace(x, "[.,;:]+$", "")), lambda x: x != "")
    p = F.regexp_extract_all(text(c), F.lit(AUDIT_PMID), F.lit(1))
    return F.array_distinct(F.concat(F.transform(e, lambda x: F.concat(F.lit("edge:"), x)), F.transform(p, lambda x: F.concat(F.lit("PMID:"), x))))


def audit_type(c: Column) -> Column:
    """The type of a claim by the rules of an audit; each rule is a substring test."""
    out = F.lit("factual")
    for kind, cues in reversed(K.AUDIT_TYPES.items()):
        out = F.when(has_any(c, cues), kind).otherwise(out)
    return out


def audit_severity(kind: Column, verdict: Column, critical: Column) -> Column:
    return (
        F.when(verdict.isin("supported", "out_of_scope"), 0).when((kind == "lifecritical") | critical, 3).when((kind == "sourceattribution") | (verdict == "contradicted"), 2)
        .when(kind.isin("logical", "temporal", "population"), 2).otherwise(1)
    )


def severity(kind: Column, verdict: Column) -> Column:
    return (
        F.when(verdict.isin("supported", "out_of_scope"), 0)
        .when(kind == "life_critical", 3)
        .when(verdict == "contradicted", 2)
        .when(kind.isin("logical", "temporal", "population"), 2)
        .otherwise(1)
    )


def polarity(c: Column, negative=K.JUDGE_NEGATIVE, positive=K.JUDGE_POSITIVE) -> Column:
    """negative or positive if only cues of one kind occur, else neutral."""
    n, p = has_any(c, negative), has_any(c, positive)
    return F.when(n & ~p, "negative").when(p & ~n, "positive").otherwise("neutral")


def relation_polarity(relation: Column, display: Column) -> Column:
    return (
        F.when(text(relation).isin(K.NEGATIVE_RELATIONS) | has_any(display, K.NEGATIVE_DISPLAY), "negative")
        .when(has_any(display, K.JUDGE_POSITIVE), "positive")
        .otherwise("neutral")
    )


def polarity_conflict(a: Column, b: Column) -> Column:
    """Opposite cues in texts that share a token."""
    ap, an, bp, bn = has_any(a, K.POSITIVE_CUES), has_any(a, K.NEGATIVE_CUES), has_any(b, K.POSITIVE_CUES), has_any(b, K.NEGATIVE_CUES)
    return F.arrays_overlap(tokens(a), tokens(b)) & ((ap & bn) | (an & bp))


def question_type(c: Column, fallback: str = "other") -> Column:
    """The first type, in the order of the patterns, one of whose patterns occurs."""
    out = None
    for k, cues in K.QUESTION_PATTERNS.items():
        out = F.when(has_any(c, cues), k) if out is None else out.when(has_any(c, cues), k)
    return out.otherwise(fallback)


def phrases(c: Column, most: int = 3, least: int = 3) -> Column:
    """Distinct runs of 1 to ``most`` tokens, without stop words at either end, of at least ``least`` characters."""
    w = F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9-]+"), F.lit(0))

    def runs(n: int) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        kept = F.filter(at, lambda i: ~F.element_at(w, i.cast("int")).isin(K.PHRASE_STOPWORDS) & ~F.element_at(w, (i + n - 1).cast("int")).isin(K.PHRASE_STOPWORDS))
        return F.transform(kept, lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.filter(F.array_distinct(F.concat(*[runs(n) for n in range(most, 0, -1)])), lambda p: F.length(p) >= least)


#: A long form before its short form in brackets (fixed pattern).
ABBREVIATED = r"\b([A-Za-z][A-Za-z -]{2,})[ \t\n\r\f]*\(([A-Za-z0-9-]{2,10})\)"


def abbreviations(texts: Column) -> Column:
    """array<struct<short, long>>: the fixed abbreviations, then those that the texts define, in order of first mention.

    ``texts`` is an array<string>.  A short form that is defined again takes its last definition and keeps its place.
    """
    raw = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(text(t), F.lit(ABBREVIATED), F.lit(0))))
    one = lambda m: F.struct(F.lower(F.regexp_extract(m, ABBREVIATED, 2)).alias("short"), squeeze(F.lower(F.regexp_extract(m, ABBREVIATED, 1))).alias("long"))
    fixed = F.array(*[F.struct(F.lit(a).alias("short"), F.lit(b).alias("long")) for a, b in K.ABBREVIATIONS.items()])
    every = F.concat(fixed, F.transform(raw, one))
    names = F.array_distinct(F.transform(every, lambda e: e["short"]))
    return F.transform(names, lambda n: F.element_at(F.filter(every, lambda e: e["short"] == n), -1))


def expanded(c: Column, entries: Column) -> Column:
    """The normalised answer with the abbreviations written out, one after the other."""
    out = F.aggregate(entries, answer(c), lambda t, e: F.regexp_replace(t, F.concat(F.lit("\\b"), e["short"], F.lit("\\b")), e["long"]))
    return squeeze(out)


#: The verbs that divide a triple (fixed values).
VERBS = "reduces|increases|causes|treats|prevents|inhibits|activates"
TRIPLE = rf"([a-z0-9-][a-z0-9 -]+?) +({VERBS}) +([a-z0-9-][a-z0-9 -]+)"


def triples(c: Column) -> Column:
    """array<string> ``subject|verb|object`` of the runs of plain words that a known verb divides, by sentence."""
    found = F.flatten(F.transform(_sentences(F.lower(text(c))), lambda s: F.regexp_extract_all(s, F.lit(TRIPLE), F.lit(0))))
    return F.transform(found, lambda m: F.concat_ws("|", *[F.trim(F.regexp_extract(m, TRIPLE, k)) for k in (1, 2, 3)]))
