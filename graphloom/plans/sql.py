"""Pieces of DuckDB SQL that mirror the text functions, for the queries' oracle texts."""

from __future__ import annotations

from ..functions import constants as K

SP = "[ \\t\\n\\r\\f]+"
TAG = "\\[(edge:[^\\]]+|edge_id:[^\\]]+|PMID:[^\\]]+)\\]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def arr(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def txt(c: str) -> str:
    return f"coalesce({c}, '')"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SP}', ' ', 'g'), ' ')"


def normal(c: str) -> str:
    return squeeze(f"lower({txt(c)})")


def has_any(c: str, cues) -> str:
    return "(" + " OR ".join(f"contains(lower({txt(c)}), {q(x)})" for x in cues) + ")"


def humanized(c: str) -> str:
    return f"translate(regexp_replace({txt(c)}, '^[^:]*:', ''), '_-', '  ')"


def answer(c: str) -> str:
    x = f"trim(regexp_replace({txt(c)}, '{TAG}', '', 'g'), ' ')"
    x = f"regexp_replace({x}, '(?i)(^|[^a-z0-9_])(direct answer|reasoning|confidence level)[ \\t\\n\\r\\f]*:[ \\t\\n\\r\\f]*', '\\1', 'g')"
    x = f"regexp_replace({x}, '{SP}', ' ', 'g')"
    for _ in range(2):
        x = f"regexp_replace({x}, '(^|[^0-9])\\.+($|[^0-9.])', '\\1 \\2', 'g')"
    x = f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_ .%/-]', '', 'g')"
    return f"lower({squeeze(x)})"


def label(a: str) -> str:
    first = f"split_part({a}, ' ', 1)"
    return "CASE " + " ".join(f"WHEN {a} IN {values(v)} OR {first} IN {values(v)} THEN '{k}'" for k, v in K.LABELS.items()) + f" ELSE {a} END"


def decision(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({txt(c)}), '(^|[^a-z0-9_]){k}($|[^a-z0-9_])') THEN '{k}'" for k in ("yes", "no", "maybe")) + f" ELSE trim({txt(c)}, ' ') END"


def sentences(x: str) -> str:
    return f"regexp_split_to_array(regexp_replace({x}, '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(10), 'g'), '\\n+')"


def claims(c: str) -> str:
    t = f"trim(regexp_replace({txt(c)}, '{TAG}', '', 'g'), ' ')"
    return f"list_filter(list_transform({sentences(t)}, lambda s: trim({squeeze('s')}, ' .')), lambda s: s <> '')"


def distinct(x: str) -> str:
    """Distinct elements of a list in order."""
    return f"list_transform(list_filter(list_zip({x}, range(1, len({x}) + 1)), lambda z: list_position({x}, z[1]) = z[2]), lambda z: z[1])"


def tokens(c: str, stopwords=K.STOPWORDS, least: int = 2) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({txt(c)}), '[a-z0-9]+')), lambda w: w NOT IN {values(stopwords)} AND length(w) >= {least})"


def overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len({a})::DOUBLE END"


def polarity(c: str, negative=K.JUDGE_NEGATIVE, positive=K.JUDGE_POSITIVE) -> str:
    n, p = has_any(c, negative), has_any(c, positive)
    return f"CASE WHEN {n} AND NOT {p} THEN 'negative' WHEN {p} AND NOT {n} THEN 'positive' ELSE 'neutral' END"


def relation_polarity(r: str, d: str) -> str:
    return f"CASE WHEN {txt(r)} IN {values(K.NEGATIVE_RELATIONS)} OR {has_any(d, K.NEGATIVE_DISPLAY)} THEN 'negative' WHEN {has_any(d, K.JUDGE_POSITIVE)} THEN 'positive' ELSE 'neutral' END"


def claim_type(c: str) -> str:
    low = f"lower({txt(c)})"
    return (
        f"CASE WHEN contains({low}, 'edge:') OR contains({low}, 'pmid:') OR contains({low}, 'edge_id:') THEN 'source_attribution' WHEN {has_any(c, K.LIFE_CRITICAL)} THEN 'life_critical'"
        f" WHEN {has_any(c, K.TEMPORAL)} THEN 'temporal' WHEN {has_any(c, K.POPULATION)} THEN 'population' WHEN {has_any(c, K.LOGICAL)} THEN 'logical'"
        f" WHEN contains({low}, 'in ') OR contains({low}, 'for ') THEN 'contextual' ELSE 'factual' END"
    )


def severity(kind: str, verdict: str) -> str:
    return f"CASE WHEN {verdict} IN ('supported', 'out_of_scope') THEN 0 WHEN {kind} = 'life_critical' THEN 3 WHEN {verdict} = 'contradicted' THEN 2 WHEN {kind} IN ('logical', 'temporal', 'population') THEN 2 ELSE 1 END"


def question_type(c: str, fallback: str = "other") -> str:
    return "CASE " + " ".join(f"WHEN {has_any(c, v)} THEN '{k}'" for k, v in K.QUESTION_PATTERNS.items()) + f" ELSE '{fallback}' END"


def mapped(c: str, table: dict, other: str) -> str:
    lit = lambda v: q(v) if isinstance(v, str) else str(v)
    return "CASE " + " ".join(f"WHEN {c} = {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {other} END"


def refs(c: str) -> str:
    found = f"list_transform(regexp_extract_all({txt(c)}, '(?:PMID:|edge:|edge_id:)[^\\]\\s]+'), lambda m: regexp_replace(regexp_replace(m, '^edge_id:', 'edge:'), '[.,;:]+$', ''))"
    return found


STRIP = "trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def key(c: str) -> str:
    return f"nullif(lower({STRIP.format(c=c)}), '')"


def edge_id(c: str) -> str:
    inner = STRIP.format(c=f"regexp_replace({STRIP.format(c=c)}, '^(edge_id|edge):', '')")
    return f"nullif({inner}, '')"
