"""Records of changing layout: fields by alias, nested values as text, options, answers, contexts, ids, question types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import constants as K
from ..functions import text as T
from ..functions.keys import strip

#: Names under which a field may come, the first with content wins (fixed values).
QUESTION = ["question", "question_text", "query", "prompt", "problem", "input", "medical_question"]
ANSWER = ["answer", "final_answer", "gold_answer", "output", "response", "label"]
REASONING = ["reasoning", "cot", "chain_of_thought", "rationale", "explanation", "steps", "kg_cot", "knowledge_graph", "path"]
CONTEXT = ["context", "contexts", "abstract", "abstracts", "explanation", "supporting_facts", "snippets", "documents"]
RECORD_IDS = ["id", "question_id", "uid", "sample_id"]
SAMPLE_IDS = ["sample_id", "group_id", "id", "question_id", "uid"]
METADATA = ["source", "split", "type", "category", "question_type"]
#: An edge id behind ``edge:``, ``edge_id=`` and the like, or in brackets (fixed pattern).
EDGE_REFERENCE = r"""(?i)(?:edge_id|edge)\s*[:=]\s*['"]?([A-Za-z0-9_.:-]+)|\[edge:([^\]]+)\]"""


def texts(c: Column, kind: Ty.DataType) -> Column:
    """array<string>: the texts of a nested value, depth first, trimmed, without blanks; null gives none."""
    empty = F.array().cast("array<string>")
    if isinstance(kind, Ty.ArrayType):
        return F.coalesce(F.flatten(F.transform(c, lambda x: texts(x, kind.elementType))), empty)
    if isinstance(kind, Ty.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(c), lambda x: texts(x, kind.valueType))), empty)
    if isinstance(kind, Ty.StructType):
        return F.concat(*[texts(c[f.name], f.dataType) for f in kind.fields]) if kind.fields else empty
    t = strip(c.cast("string"))
    return F.when(T.text(t) != "", F.array(t)).otherwise(empty)


def _field(df: DataFrame, name: str) -> Column:
    return texts(F.col(f"`{name}`"), df.schema[name].dataType)


def first_text(df: DataFrame, names: Sequence[str], default: str = "") -> Column:
    """The text of the first of the names that the table has and that is not blank; nested values joined by spaces."""
    found = [F.nullif(F.array_join(_field(df, n), " "), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default))


def all_texts(df: DataFrame, names: Sequence[str]) -> Column:
    """array<string>: the texts of all the names that the table has, in order."""
    found = [_field(df, n) for n in names if n in df.columns]
    return F.concat(*found) if found else F.array().cast("array<string>")


def options_text(options: Column) -> Column:
    """``(0) a (1) b`` of an array of options; null for none."""
    return F.nullif(F.array_join(F.transform(options, lambda x, i: F.concat(F.lit("("), i.cast("string"), F.lit(") "), T.text(x))), " "), F.lit(""))


def normalized_records(df: DataFrame) -> DataFrame:
    """record_id, question, answer, reasoning, group_id of each record that has a question.

    Options that the question does not contain are put behind it; a missing reasoning is the answer, else the question; a
    missing group id is the record's id.
    """
    q = first_text(df, QUESTION)
    o = options_text(F.col("options")) if "options" in df.columns else F.lit(None).cast("string")
    x = df.withColumn("_q", q).withColumn("_o", o).where("_q <> ''")
    x = x.withColumn("_q", F.when(F.col("_o").isNotNull() & ~F.contains(F.lower("_q"), F.lower("_o")), F.concat("_q", F.lit("\nOptions: "), "_o")).otherwise(F.col("_q")))
    a = first_text(df, ANSWER)
    r = F.coalesce(F.nullif(first_text(df, REASONING), F.lit("")), F.nullif(a, F.lit("")), F.col("_q"))
    return x.select("record_id", F.col("_q").alias("question"), a.alias("answer"), r.alias("reasoning"), F.coalesce(F.nullif(first_text(df, [*RECORD_IDS, "group_id"]), F.lit("")), F.col("record_id").cast("string")).alias("group_id"))


def option_answer(index: Column, options: Column) -> Column:
    """The option that a letter (``a`` is the first) or a number from 0 names; null if it names none."""
    low = F.lower(strip(T.text(index.cast("string"))))
    at = F.when(low.rlike("^[a-z]$"), F.ascii(low) - 97).when(low.rlike("^[0-9]{1,4}$"), low.cast("int"))
    return F.nullif(strip(F.try_element_at(options, at + 1)), F.lit(""))


def gold_answer(df: DataFrame, dataset: Column, index: Column | None = None) -> Column:
    """The gold answer by the rule of the data set: a decision, an option by its index, ideal answers joined, or the answer."""
    low = F.lower(T.text(dataset))
    plain = first_text(df, ["answer", "gold_answer", "gold", "label", "output", "ideal_answer"])
    chosen = option_answer(index, F.col("options")) if index is not None and "options" in df.columns else F.lit(None).cast("string")
    return (
        F.when(low == "pubmedqa", first_text(df, ["final_decision", "answer", "label"]))
        .when(low.isin("medqa", "medmcqa"), F.coalesce(chosen, first_text(df, ["answer", "label", "output"])))
        .when((low == "bioasq") & (first_text(df, ["ideal_answer"]) != ""), first_text(df, ["ideal_answer"]))
        .otherwise(plain)
    )


def sample_id(df: DataFrame, dataset: str = "dataset_name", own: str = "id_in_dataset", row: str = "record_id") -> Column:
    """``dataset:id`` if both are there, else the first id field with content, else the row's number."""
    both = F.when(F.col(dataset).isNotNull() & F.col(own).isNotNull(), F.concat_ws(":", F.trim(dataset), F.col(own).cast("string"))) if dataset in df.columns and own in df.columns else F.lit(None)
    return F.coalesce(both, F.nullif(first_text(df, SAMPLE_IDS), F.lit("")), F.col(row).cast("string"))


def sample_metadata(df: DataFrame) -> Column:
    """map<string,string> of the fields that describe a sample, those that the table has and that are not null."""
    pairs = [F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v"))) for n in METADATA if n in df.columns]
    return F.map_from_entries(F.array_compact(F.array(*pairs))) if pairs else F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))


def select_record(df: DataFrame, order: str, index: int | None = None, name: str | None = None, seed: int | None = None) -> DataFrame:
    """One record: by position in the order of ``order``, by id, or by a seed; at most one of the three may be given."""
    if sum(x is not None for x in (index, name, seed)) > 1:
        raise ValueError("give at most one of index, name and seed")
    if name is not None:
        return df.where(F.coalesce(F.nullif(first_text(df, RECORD_IDS), F.lit("")), F.col(order).cast("string")) == name).orderBy(order).limit(1)
    if seed is not None:
        return df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(order).cast("string")), 256), order).limit(1)
    return df.orderBy(order).offset(index or 0).limit(1)


def window_of_records(df: DataFrame, order: str, start: int = 0, limit: int | None = None, dry_run: int | None = None) -> DataFrame:
    """Records with a question from position ``start``, at most the smaller of ``limit`` and ``dry_run``."""
    rows = df.where(first_text(df, QUESTION) != "").orderBy(order).offset(start)
    most = [x for x in (limit, dry_run) if x is not None]
    return rows.limit(min(most)) if most else rows


def edge_references(c: Column) -> Column:
    """Distinct edge ids that a text names, in order, without a prefix."""
    found = F.regexp_extract_all(T.text(c), F.lit(EDGE_REFERENCE), F.lit(0))
    ids = F.transform(found, lambda m: F.regexp_replace(F.regexp_replace(F.trim(F.when(m.startswith("["), F.regexp_extract(m, EDGE_REFERENCE, 2)).otherwise(F.regexp_extract(m, EDGE_REFERENCE, 1))), "^edge:", ""), "^edge_id:", ""))
    return F.array_distinct(F.filter(ids, lambda x: x != ""))


def canonical_type(c: Column, routing: bool = True) -> Column:
    """A question type by its name or alias; unknown and null give ``other``, for routing ``factoid`` too."""
    t = T.mapped(F.lower(F.trim(T.text(c))), K.QUESTION_TYPE_NAMES, "other")
    return F.when(t == "factoid", "other").otherwise(t) if routing else t


def inferred_type(df: DataFrame, fallback: str = "other") -> Column:
    """The question type of a record: its own field, its puzzle id, else the patterns in question and options."""
    hints = []
    for n in ("question_type", "type"):
        if n in df.columns:
            low = F.lower(F.trim(T.text(F.col(n))))
            hints.append(F.when(low.isin(list(K.QUESTION_TYPE_NAMES)), T.mapped(low, K.QUESTION_TYPE_NAMES, None)))
    for n in ("puzzle_id", "puzzle_identifiers"):
        if n in df.columns:
            kind = df.schema[n].dataType
            v = F.try_element_at(n, F.lit(1)) if isinstance(kind, Ty.ArrayType) else F.col(n)
            hints.append(T.mapped(strip(v.cast("string")), {str(k): t for k, t in K.PUZZLES.items()}, None))
    text = F.concat_ws("\n", first_text(df, QUESTION), *[F.array_join(_field(df, n), " ") for n in ("options", "choices") if n in df.columns])
    return F.coalesce(*hints, T.question_type(text, fallback))


def parse_overrides(values: Sequence[str]) -> dict[str, list[str]]:
    """``type=rel1,rel2`` texts as a mapping; an error without ``=``, type or relations."""
    out = {}
    for v in values:
        kind, eq, rels = v.partition("=")
        names = sorted({r.strip() for r in rels.split(",") if r.strip()})
        if not eq or not kind.strip() or not names:
            raise ValueError(f"not an override: {v!r}")
        out[kind.strip()] = names
    return out


def json_payload(c: Column) -> Column:
    """The JSON object in a text, from the first ``{`` to the last ``}``; null if there is none that parses."""
    t = T.text(c)
    start = F.locate("{", t)
    last = F.length(t) - F.locate("}", F.reverse(t)) + 1
    body = F.substr(t, start, F.greatest(last - start + 1, F.lit(0)))
    # in brackets, so that what follows a first object is seen
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    one = whole.isNotNull() & F.try_variant_get(whole, "$[1]", "variant").isNull()
    return F.when((start > 0) & F.contains(t, F.lit("}")) & (last > start) & one, body)


def elapsed_seconds(started: Column, updated: Column) -> Column:
    """Seconds between two ISO texts; 0 if either does not parse or time runs backwards."""
    a, b = F.try_to_timestamp(started), F.try_to_timestamp(updated)
    return F.coalesce(F.greatest(F.unix_micros(b) - F.unix_micros(a), F.lit(0)) / 1e6, F.lit(0.0))


def schema_hash(values: Column) -> Column:
    """SHA-256 of a list of names as compact JSON."""
    return F.sha2(F.to_json(F.transform(values, T.text)), 256)


def hard_constraints(question_type: Column, question: Column) -> Column:
    """struct<question_type, dosage_sensitive, ddi_sensitive> of a question."""
    return F.struct(
        question_type.alias("question_type"), ((question_type == "dosage") | T.has_any(question, ["dose", "dosage", "mg", "mcg"])).alias("dosage_sensitive"),
        ((question_type == "drug_interaction") | T.has_any(question, ["interaction", "interact", "ddi", "contraindication", "contraindicated"])).alias("ddi_sensitive"),
    )


def cached_first(queries: DataFrame, cache: DataFrame, most: int = 50) -> DataFrame:
    """k, how (``exact`` or ``prefix``), value: the cache line of a question's key, else the first line of its text.

    ``queries`` has k and query; ``cache`` query, retmax, line (its number) and value.  Of lines with one key the last
    counts; of keys with one text the one that came first.
    """
    q = queries.select("k", F.lower(F.trim(T.text(F.col("query")))).alias("t")).where("t <> ''")
    c = cache.groupBy(F.lower(F.trim(T.text(F.col("query")))).alias("t"), "retmax").agg(F.min("line").alias("first"), F.max_by("value", "line").alias("value"))
    best = c.groupBy("t").agg(F.min(F.struct((F.col("retmax") != most).alias("other"), "first", "value")).alias("b"))
    return q.join(best, "t").select("k", F.when(F.col("b.other"), "prefix").otherwise("exact").alias("how"), "b.value")


def sampled_nodes(nodes: DataFrame, samples: int, seed: int = 0, most: int = 3) -> DataFrame:
    """sample, node: 1 to ``most`` seed nodes for each sample, by hash; a node is in one sample at most.

    A node's hash gives its sample and its rank in it, so no node meets every sample.
    """
    from pyspark.sql import Window

    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), "node"), 256)
    x = nodes.select("node").distinct().withColumn("h", h).withColumn("sample", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint"), F.lit(samples)))
    w = Window.partitionBy("sample").orderBy("h")
    return x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.col("sample") % most + 1).select("sample", "node")


def compared_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """outcome, n: keys that match, differ in shape, are missing on the right or unexpected there.  Both have key and shape."""
    j = left.select("key", F.col("shape").alias("a"), F.lit(True).alias("l")).join(right.select("key", F.col("shape").alias("b"), F.lit(True).alias("r")), "key", "full")
    o = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "unexpected").when(F.col("a").eqNullSafe(F.col("b")), "compatible").otherwise("shape_mismatch")
    return j.groupBy(o.alias("outcome")).agg(F.count("*").alias("n"))


def schema_rejects(edges: DataFrame) -> DataFrame:
    """row_index, reasons: edge rows that break a rule of the schema, with the rules they break, in order."""
    bad = lambda c, name: F.when(c, F.lit(name))
    blank = lambda c: T.text(strip(F.col(c))) == ""
    out = lambda c: ~F.coalesce(F.col(c).between(0.0, 1.0), F.lit(True))
    reasons = F.array_compact(F.array(
        bad(blank("edge_id"), "edge_id"), bad(blank("head"), "head"), bad(blank("tail"), "tail"), bad(blank("relation"), "relation"), bad(out("source_reliability"), "source_reliability"), bad(out("amg_confidence"), "amg_confidence"),
        bad(~blank("head") & ~T.valid_node_id(strip(F.col("head"))), "head_id"), bad(~blank("tail") & ~T.valid_node_id(strip(F.col("tail"))), "tail_id"),
        bad(F.exists(F.coalesce("supporting_pmids", F.array().cast("array<string>")), lambda p: ~T.text(p).rlike(r"(?i)^\s*(pmid:\s*)?[0-9]+\s*$")), "supporting_pmids"),
    ))
    return edges.select("row_index", reasons.alias("reasons")).where(F.size("reasons") > 0)
