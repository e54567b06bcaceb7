"""Sources: record files in several formats, tables with changing column names, split discovery, caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions import constants as K
from ..functions import text as T

#: Names under which a field may come, the first that is present wins (fixed values).
ALIASES = {
    "head": ["x_id", "source_id", "head_id"],
    "tail": ["y_id", "target_id", "tail_id"],
    "head_name": ["x_name", "source_name", "head_name"],
    "tail_name": ["y_name", "target_name", "tail_name"],
    "head_type": ["x_type", "source_type", "head_type"],
    "tail_type": ["y_type", "target_type", "tail_type"],
    "relation": ["relation", "relation_type"],
    "display_relation": ["display_relation", "relation_display"],
    "source": ["source", "resource", "provenance"],
    "pmids": ["supporting_pmids", "pubmed_ids", "pmids"],
    "edge_id": ["edge_id", "id"],
    "head_cui": ["x_cui", "source_cui", "head_cui"],
    "tail_cui": ["y_cui", "target_cui", "tail_cui"],
}
OPTIONAL = ["source", "pmids", "edge_id", "head_cui", "tail_cui"]
NODE_ALIASES = {"node_index": ["node_index", "index", "id"], "node_id": ["node_id", "id", "primekg_node_id"], "node_name": ["node_name", "name"], "node_type": ["node_type", "type"], "node_source": ["node_source", "source"]}
INDEX_ALIASES = {"head": ["x_index", "source_index", "head_index"], "tail": ["y_index", "target_index", "tail_index"]}
#: Files of a graph folder that are tried first, and files that describe a folder and hold no records (fixed values).
PRIORITY = ["kg.csv", "kg_raw.csv", "kg_grouped.csv", "kg_giant.csv", "primekg.csv"]
DESCRIBING = ["dataset-metadata.json", "datasets-metadata.json"]
CONTAINERS = ["data", "records", "examples", "items"]
SPLITS = ["validation", "dev", "test", "train"]
FORMATS = [".jsonl", ".json", ".csv", ".parquet"]


def column_of(df: DataFrame, names: Sequence[str], required: bool = True) -> str | None:
    """The first of the names that the table has; an error if none is and one is required."""
    got = next((n for n in names if n in df.columns), None)
    if got is None and required:
        raise ValueError(f"none of {list(names)} in {df.columns}")
    return got


def numbered(df: DataFrame, name: str = "row_index") -> DataFrame:
    """The rows with their number from 0 in the order of the files' rows, however the scan is cut into tasks.

    Two light passes: the rows of each partition are counted, and each partition's offset is added to the places within it.
    """
    x = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_p", F.spark_partition_id())
    per = x.groupBy("_p").agg(F.count("*").alias("c"))  # a row a partition
    offsets = per.withColumn("_o", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    return x.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_o")).drop("_at", "_p", "_o")


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's files, sorted."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = jvm.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [root.getName()] if fs.getFileStatus(root).isFile() else [x.getPath().getName() for x in fs.listStatus(root)]
    return sorted(n for n in found if n.lower() not in DESCRIBING and not n.startswith(("_", ".")))


def has_columns(columns: Sequence[str], groups: Sequence[Sequence[str]]) -> bool:
    return all(any(n in columns for n in g) for g in groups)


def graph_layout(spark: SparkSession, folder: str) -> tuple[str, list[str]]:
    """(``two_tables``, [edges, nodes]), (``one_table``, [file]) or (``missing``, []) of a graph folder, by the files' headers.

    Two tables if nodes.csv and edges.csv are there and fit; else the first fitting file, those of PRIORITY before the
    others by name.
    """
    names = _files(spark, folder)
    header = lambda n: spark.read.csv(f"{folder}/{n}", header=True, inferSchema=False).columns
    if {"edges.csv", "nodes.csv"} <= set(names):
        rel = [ALIASES["relation"], ALIASES["display_relation"]]
        if has_columns(header("edges.csv"), [*INDEX_ALIASES.values(), *rel]) and has_columns(header("nodes.csv"), [v for k, v in NODE_ALIASES.items() if k != "node_source"]):
            return "two_tables", [f"{folder}/edges.csv", f"{folder}/nodes.csv"]
    csv = [n for n in names if n.lower().endswith(".csv")]
    for n in [*[p for p in PRIORITY if p in csv], *[n for n in csv if n not in PRIORITY]]:
        if has_columns(header(n), [v for k, v in ALIASES.items() if k not in OPTIONAL]):
            return "one_table", [f"{folder}/{n}"]
    return "missing", []


def read_graph(spark: SparkSession, folder: str, relations: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Edges of a graph folder in either layout; a two-table layout that cannot be read falls back to one table; no file gives no rows."""
    kind, paths = graph_layout(spark, folder)
    if kind == "two_tables":
        return edges_from_two_tables(read_csv(spark, paths[1]), read_csv(spark, paths[0]), relations, limit)
    if kind == "one_table":
        return edges_from_table(read_csv(spark, paths[0]), relations, limit)
    return spark.createDataFrame([], EDGE_SCHEMA)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; blanks stay empty strings, not nulls."""
    df = spark.read.csv(path, header=True, inferSchema=False, nullValue="\0", emptyValue="", multiLine=False)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


EDGE_SCHEMA = "edge_id string, head string, tail string, head_name string, tail_name string, head_type string, tail_type string, head_cui string, tail_cui string, relation string, display_relation string, source string, source_reliability double, supporting_pmids array<string>, row_index bigint"


def edges_from_table(df: DataFrame, relations: Sequence[str] | None = None, limit: int | None = None, number: str | None = None) -> DataFrame:
    """Canonical edge rows (EDGE_SCHEMA) from a one-table layout; rows of other relations are left out if a list is given.

    A blank id becomes ``node:row:head`` or ``node:row:tail``, a blank name the id, a blank type ``other``, a blank display
    relation the relation with spaces, a blank source ``primekg``, a blank edge id head, relation, tail and row number joined
    by bars.  Row numbers count all rows of the file (or are ``number``'s); ``limit`` counts accepted rows, in their order.
    """
    at = {k: column_of(df, v, k not in OPTIONAL) for k, v in ALIASES.items()}
    x = df.withColumn("row_index", F.col(number).cast("bigint")) if number else numbered(df)
    c = lambda k: F.nullif(F.trim(F.col(f"`{at[k]}`").cast("string")), F.lit("")) if at[k] else F.lit(None).cast("string")
    rel = F.trim(T.text(F.col(f"`{at['relation']}`")))
    if relations is not None:
        x = x.where(rel.isin(list(relations)))
    n = F.col("row_index").cast("string")
    x = x.withColumn("_h", F.coalesce(c("head"), F.concat(F.lit("node:"), n, F.lit(":head")))).withColumn("_t", F.coalesce(c("tail"), F.concat(F.lit("node:"), n, F.lit(":tail"))))
    src = F.coalesce(c("source"), F.lit("primekg"))
    out = x.select(
        F.coalesce(c("edge_id"), F.concat_ws("|", "_h", rel, "_t", n)).alias("edge_id"), F.col("_h").alias("head"), F.col("_t").alias("tail"), F.coalesce(c("head_name"), "_h").alias("head_name"), F.coalesce(c("tail_name"), "_t").alias("tail_name"),
        F.coalesce(c("head_type"), F.lit("other")).alias("head_type"), F.coalesce(c("tail_type"), F.lit("other")).alias("tail_type"), c("head_cui").alias("head_cui"), c("tail_cui").alias("tail_cui"), rel.alias("relation"),
        F.coalesce(c("display_relation"), F.replace(rel, F.lit("_"), F.lit(" "))).alias("display_relation"), src.alias("source"), T.mapped(F.lower(src), K.RELIABILITY, K.OTHER_RELIABILITY).cast("double").alias("source_reliability"), pmid_list(c("pmids")).alias("supporting_pmids"), "row_index",
    ).where("relation <> ''")
    return out if limit is None else out.orderBy("row_index").limit(limit)


def pmid_list(c):
    """The all-digit parts of a text split at commas, semicolons, bars and spaces."""
    return F.filter(F.split(T.text(c), "[|,; ]+"), lambda p: p.rlike("^[0-9]+$"))


def edges_from_two_tables(nodes: DataFrame, edges: DataFrame, relations: Sequence[str] | None = None, limit: int | None = None, number: str | None = None) -> DataFrame:
    """EDGE_SCHEMA rows of an edge table that names nodes by index.

    Edges with an unknown end are left out; the source is that of the head, else of the tail, else ``primekg``; of nodes that
    share an index the last id counts.  Such edges have no articles and no concept ids.
    """
    at = {k: column_of(nodes, v, k != "node_source") for k, v in NODE_ALIASES.items()}
    c = lambda k: F.nullif(F.trim(F.col(f"`{at[k]}`").cast("string")), F.lit("")) if at[k] else F.lit(None).cast("string")
    n = nodes.select(T.text(c("node_index")).alias("i"), c("node_id").alias("id"), c("node_name").alias("name"), c("node_type").alias("type"), c("node_source").alias("src"))
    n = n.groupBy("i").agg(F.max(F.struct("id", "name", "type", "src")).alias("n")).select("i", F.coalesce("n.id", F.concat(F.lit("node:"), "i")).alias("id"), "n.name", "n.type", "n.src")
    side = lambda p: n.select(F.col("i").alias(f"_{p}"), *[F.col(x).alias(f"{p}_{x}") for x in ("id", "name", "type", "src")])
    e = {k: column_of(edges, v) for k, v in {**INDEX_ALIASES, "relation": ALIASES["relation"], "display_relation": ALIASES["display_relation"]}.items()}
    own = column_of(edges, ALIASES["edge_id"], False)
    x = edges.withColumn("row_index", F.col(number).cast("bigint")) if number else numbered(edges)
    rel = F.trim(T.text(F.col(f"`{e['relation']}`")))
    if relations is not None:
        x = x.where(rel.isin(list(relations)))
    x = x.select("row_index", rel.alias("relation"), F.trim(F.col(f"`{e['head']}`").cast("string")).alias("_h"), F.trim(F.col(f"`{e['tail']}`").cast("string")).alias("_t"), F.nullif(F.trim(F.col(f"`{e['display_relation']}`")), F.lit("")).alias("shown"), (F.nullif(F.trim(F.col(f"`{own}`")), F.lit("")) if own else F.lit(None).cast("string")).alias("own"))
    j = x.join(side("h"), "_h").join(side("t"), "_t").where("relation <> ''")
    src, none = F.coalesce("h_src", "t_src", F.lit("primekg")), F.lit(None).cast("string")
    out = j.select(
        F.coalesce("own", F.concat_ws("|", "h_id", "relation", "t_id", F.col("row_index").cast("string"))).alias("edge_id"), F.col("h_id").alias("head"), F.col("t_id").alias("tail"), F.coalesce("h_name", "h_id").alias("head_name"), F.coalesce("t_name", "t_id").alias("tail_name"),
        F.coalesce("h_type", F.lit("other")).alias("head_type"), F.coalesce("t_type", F.lit("other")).alias("tail_type"), none.alias("head_cui"), none.alias("tail_cui"), "relation", F.coalesce("shown", F.replace("relation", F.lit("_"), F.lit(" "))).alias("display_relation"), src.alias("source"),
        T.mapped(F.lower(src), K.RELIABILITY, K.OTHER_RELIABILITY).cast("double").alias("source_reliability"), F.array().cast("array<string>").alias("supporting_pmids"), "row_index",
    )
    return out if limit is None else out.orderBy("row_index").limit(limit)


def concept_index(edges: DataFrame) -> DataFrame:
    """cui, node: the concept ids that edge rows give their ends, trimmed and in capitals."""
    e = edges.select(F.explode(F.array(F.struct(F.col("head_cui").alias("cui"), F.col("head").alias("node")), F.struct(F.col("tail_cui").alias("cui"), F.col("tail").alias("node")))).alias("x")).select(F.upper(F.trim("x.cui")).alias("cui"), "x.node")
    return e.where("cui <> ''").distinct()


def _unwrap(df: DataFrame, split: str | None) -> DataFrame:
    """The rows of a JSON document: a list, or an object that holds it under a split or container name."""
    names = ([split] if split else []) + CONTAINERS + SPLITS
    for n in names:
        if n in df.columns and isinstance(df.schema[n].dataType, Ty.ArrayType):
            return df.select(F.inline(n)) if isinstance(df.schema[n].dataType.elementType, Ty.StructType) else df.select(F.explode(n).alias("value"))
    return df


def read_records(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Records of a JSONL, JSON, CSV or Parquet file or folder; malformed JSON lines and blank lines are dropped."""
    low = path.lower().rstrip("/")
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith(".csv"):
        return read_csv(spark, path)
    if low.endswith(".json"):
        return _unwrap(spark.read.json(path, multiLine=True), split)
    df = spark.read.json(path, mode="DROPMALFORMED")
    return df


def read_folder(spark: SparkSession, folder: str, split: str, order: str | None = None) -> DataFrame:
    """Union of the files of a split, in any of FORMATS, by column name.

    The files are those of a sub-folder of the split's name, else those whose name begins with it, else all; of unsplit
    files with ``order`` only the split's part by position.  Files that describe the folder are no records.
    """
    names = _files(spark, folder)
    if split in names:
        folder, names = f"{folder}/{split}", _files(spark, f"{folder}/{split}")
        mine = names
    else:
        mine = [n for n in names if n.lower().startswith(split.lower())]
    whole = not mine
    found = [n for n in (mine or names) if any(n.lower().endswith(f) for f in FORMATS)]
    if not found:
        raise ValueError(f"no records of {split} in {folder}")
    out = None
    for n in found:
        df = read_records(spark, f"{folder}/{n}", split)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return positional_split(out, order, {"dev": "validation"}.get(split, split)) if whole and order else out


def named_dataset(spark: SparkSession, root: str, name: str) -> str:
    """The path of a data set given by name: a file ``name`` with one of FORMATS or a folder ``name`` under ``root``."""
    names = _files(spark, root)
    for n in [*[f"{name}{f}" for f in FORMATS], name]:
        if n in names:
            return f"{root}/{n}"
    raise ValueError(f"no data set {name} in {root}")


def read_traces(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k, question, answer, question_type; k, pos and edge columns; k, pos and passage columns) of saved traces, a JSON document a file."""
    edge = "array<struct<edge_id:string,head:string,tail:string,relation:string,display_relation:string,source_reliability:double,amg_confidence:double,supporting_pmids:array<string>>>"
    schema = f"sample_id string, question string, gold_answer string, question_type struct<predicted:string>, primekg_retrieval struct<top_edges:{edge}>, pubmed_retrieval struct<passages:array<struct<pmid:string,title:string,abstract:string,relevance_score:double>>>"
    t = spark.read.schema(schema).json(path, multiLine=True)
    k = F.col("sample_id").alias("k")
    e = t.select(k, F.posexplode("primekg_retrieval.top_edges").alias("pos", "e")).select("k", "pos", "e.*").withColumnsRenamed({"source_reliability": "reliability", "amg_confidence": "confidence", "supporting_pmids": "pmids"})
    p = t.select(k, F.posexplode("pubmed_retrieval.passages").alias("pos", "p")).select("k", "pos", "p.*")
    return t.select(k, "question", F.col("gold_answer").alias("answer"), F.col("question_type.predicted").alias("question_type")), e, p


def positional_split(df: DataFrame, order: str, split: str | None = None) -> DataFrame:
    """Adds ``split``: the first 90 % of the rows in order are train, the next 5 % validation, the rest test.

    The order is over a range partitioning: row counts of the partitions give each its offset, so no task sees all rows.
    ``order`` must be unique for a stable result.
    """
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id())
    from ..workspace import Workspace

    kept = Workspace(df.sparkSession, "split").keep(ranged, "ranged")
    sizes = kept.groupBy("_p").agg(F.count("*").alias("c"))  # a row a partition
    offsets = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "before")
    total = sizes.agg(F.sum("c").alias("n"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1 + F.col("before")
    out = kept.join(F.broadcast(offsets), "_p").join(F.broadcast(total), F.lit(True)).withColumn("_i", at)
    named = out.withColumn("split", F.when(F.col("_i") < F.floor(F.col("n") * 0.9), "train").when(F.col("_i") < F.floor(F.col("n") * 0.95), "validation").otherwise("test"))
    named = named.drop("_p", "before", "n", "_i")
    return named if split is None else named.where(F.col("split") == split)


def read_articles_xml(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, abstract, journal, publication_year, mesh_terms of article XML."""
    schema = (
        "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string>>>>,"
        "MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:string>>>>"
    )
    m = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(schema).load(path).select("MedlineCitation.*")
    return m.select(
        F.col("PMID").alias("pmid"), F.col("Article.ArticleTitle").alias("title"), F.array_join("Article.Abstract.AbstractText", " ").alias("abstract"), F.col("Article.Journal.Title").alias("journal"),
        F.col("Article.Journal.JournalIssue.PubDate.Year").alias("publication_year"), F.transform("MeshHeadingList.MeshHeading", lambda x: x["DescriptorName"]).alias("mesh_terms"),
    )


def cache_key(query, most: int = 50):
    return F.concat(F.lower(F.trim(T.text(query))), F.lit(f"::{most}"))


def cached_articles(queries: DataFrame, cache: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(hits with the articles of the last cache line of each key; queries without a line).

    ``cache`` has query, retmax, timestamp and articles; ``queries`` has query.
    """
    last = cache.groupBy(F.concat(F.lower(F.trim("query")), F.lit("::"), F.col("retmax").cast("string")).alias("cache_key")).agg(F.max_by("articles", "timestamp").alias("articles"))
    asked = queries.withColumn("cache_key", cache_key(F.col("query"), most))
    return asked.join(last, "cache_key"), asked.join(last, "cache_key", "left_anti").drop("cache_key")
