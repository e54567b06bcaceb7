"""Passages for questions: BM25 over each question's candidates, vector scores, fusion, nearest vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..workspace import Workspace


def min_max(score: str, by: list[str]) -> Column:
    """A score scaled to [0, 1] within its group: constant and not 0 gives 1, all 0 gives 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.when(high == 0, 0.0).otherwise(1.0)).otherwise((F.col(score) - low) / (high - low))


#: A question with at most so many candidates is scored in one step of a task; larger corpora by joins, to the same scores.
CORPUS_AT_ONCE = 2000


def bm25(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """k, doc, bm25 of every candidate (k, doc, text) for its query (k, text); the corpus is the query's candidates.

    Okapi with k1 1.5, b .75; a negative idf becomes .25 of the mean idf of the corpus's terms.  A query term that
    repeats counts each time.  Candidates without a query term score 0.  Null texts are empty.  Candidates come
    together with their query in one shuffle by k; a task holds one question's candidates at a time.
    """
    work = Workspace(queries.sparkSession, "bm25")
    c = work.keep(candidates.select("k", "doc", "text"), "candidates")
    large = work.keep(c.groupBy("k").count().where(F.col("count") > CORPUS_AT_ONCE).select("k"), "large")
    asked = queries.select("k", F.col("text").alias("asked"))
    some = not large.isEmpty()
    rows = (c.join(large, "k", "left_anti") if some else c).join(asked, "k", "left").repartition("k").sortWithinPartitions("k", "doc")
    small = rows.mapInArrow(_score_groups, f"k {dict(c.dtypes)['k']}, doc {dict(c.dtypes)['doc']}, bm25 double")
    return small.unionByName(_bm25_by_joins(queries, c.join(large, "k", "left_semi"))) if some else small


def _score_groups(batches):
    """Scores of rows sorted by k, a question at a time."""
    import math
    import re
    from collections import Counter

    import pyarrow as pa

    find = re.compile("[A-Za-z0-9-]+").findall
    schema = None

    def score(k, asked, docs):
        tf = [Counter(w.lower() for w in find(t or "")) for _, t in docs]
        size = [sum(f.values()) for f in tf]
        n, mean = len(docs), sum(size) / len(docs)
        df = Counter(w for f in tf for w in f)
        idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
        floor = K.BM25_EPSILON * sum(idf.values()) / len(idf) if idf else 0.0
        times = Counter(w.lower() for w in find(asked or ""))
        weight = {w: m * (idf[w] if idf[w] >= 0 else floor) for w, m in times.items() if w in idf}
        for (doc, _), f, length in zip(docs, tf, size):
            norm = K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * length / mean) if mean else 0.0
            yield k, doc, sum(x * f[w] * (K.BM25_K1 + 1) / (f[w] + norm) for w, x in weight.items() if w in f)

    at, asked, docs, out = None, None, [], []
    for b in batches:
        schema = pa.schema([b.schema.field("k"), b.schema.field("doc"), pa.field("bm25", pa.float64())])
        for k, doc, text, q in zip(*(b.column(c).to_pylist() for c in ("k", "doc", "text", "asked"))):
            if docs and k != at:
                out += score(at, asked, docs)
                docs = []
            at, asked = k, q
            docs.append((doc, text))
        if len(out) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if docs:
        out += score(at, asked, docs)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _bm25_by_joins(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """``bm25`` for corpora of any size."""
    words = candidates.select("k", "doc", T.bm25_tokens(F.col("text")).alias("w"))
    sizes = words.select("k", "doc", F.size("w").alias("len"))
    corpus = sizes.groupBy("k").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    tf = words.select("k", "doc", F.explode("w").alias("term")).groupBy("k", "doc", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("k", "term").agg(F.count("*").alias("df"))
    raw = df.join(corpus, "k").select("k", "term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.groupBy("k").agg(F.avg("idf").alias("mean_idf"))
    idf = raw.join(mean, "k").select("k", "term", F.when(F.col("idf") < 0, K.BM25_EPSILON * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    asked = queries.select("k", F.explode(T.bm25_tokens(F.col("text"))).alias("term")).groupBy("k", "term").agg(F.count("*").alias("times"))
    hit = asked.join(idf, ["k", "term"]).join(tf, ["k", "term"]).join(sizes, ["k", "doc"]).join(corpus.select("k", "mean"), "k")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K.BM25_K1 + 1) / (F.col("tf") + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("len") / F.col("mean")))
    scored = hit.groupBy("k", "doc").agg(F.sum(part).alias("bm25"))
    return sizes.join(scored, ["k", "doc"], "left").select("k", "doc", F.coalesce("bm25", F.lit(0.0)).alias("bm25"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def fuse(scored: DataFrame, parts: dict[str, float]) -> DataFrame:
    """Adds ``score``: the parts' weighted mean, over the parts that are not 0 for all of the question's candidates."""
    w = Window.partitionBy("k")
    weight = lambda c, s: F.when(F.max(F.abs(F.coalesce(c, F.lit(0.0)))).over(w) > 0, F.lit(s)).otherwise(0.0)
    total = sum((weight(F.col(c), s) for c, s in parts.items()), F.lit(0.0))
    value = sum((weight(F.col(c), s) * F.coalesce(F.col(c), F.lit(0.0)) for c, s in parts.items()), F.lit(0.0))
    return scored.withColumn("_t", total).withColumn("score", F.when(F.col("_t") > 0, value / F.col("_t")).otherwise(0.0)).drop("_t")


def top_passages(scored: DataFrame, most: int = K.TOP_PASSAGES) -> DataFrame:
    """The best ``most`` by rounded score, then by doc; a window with a row limit per question."""
    w = Window.partitionBy("k").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def nearest_vectors(vectors: DataFrame, queries: DataFrame, most: int, block: int = 2048) -> DataFrame:
    """query_id, vec_id, cosine of the ``most`` most similar vectors of each query, the query itself left out.

    ``queries`` (vec_id, embedding) is a stated set that is collected in blocks of ``block`` rows, one after the other; each
    block meets all vectors in one pass of matrix products, its rows are written, and its broadcast is dropped before the
    next.  Every task keeps its best ``most`` a query, so a pass has at most tasks x ``block`` x ``most`` rows.  Null embeddings and zero vectors have no neighbours.
    """
    import numpy as np

    spark = vectors.sparkSession
    work, parts, last = Workspace(spark, "nearest"), None, None
    asked = queries.where("embedding is not null and vec_id is not null").select("vec_id", "embedding")
    while rows := (asked if last is None else asked.where(F.col("vec_id") > last)).orderBy("vec_id").limit(block).collect():
        last = rows[-1]["vec_id"]
        q = np.array([r["embedding"] for r in rows], np.float64)
        norm = np.linalg.norm(q, axis=1)
        keep = norm > 0
        held = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows])[keep], q[keep] / norm[keep, None]))

        def run(batches, held=held):
            import pyarrow as pa

            names, m = held.value
            best_s = np.full((len(names), 0), -np.inf)
            best_i = np.zeros((len(names), 0), np.int64)
            for b in batches:
                ok = np.array([x is not None for x in b.column("embedding").to_pylist()], bool)
                if not ok.any():
                    continue
                x = np.array([v for v in b.column("embedding").to_pylist() if v is not None], np.float64)
                i = b.column("vec_id").to_numpy(zero_copy_only=False)[ok]
                n = np.linalg.norm(x, axis=1)
                s = m @ (x / np.where(n > 0, n, 1)[:, None]).T
                s[:, n == 0] = -np.inf
                s[names[:, None] == i[None, :]] = -np.inf
                s, i = np.concatenate([best_s, s], axis=1), np.concatenate([best_i, np.broadcast_to(i, s.shape)], axis=1)
                o = np.lexsort((i, -np.round(s, 12)), axis=1)[:, :most]
                best_s, best_i = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)
            f = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(names[:, None], best_s.shape)[f]), pa.array(best_i[f]), pa.array(best_s[f])], ["query_id", "vec_id", "cosine"])

        got = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, "query_id bigint, vec_id bigint, cosine double")
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 12)), "vec_id")
        got = work.keep(got.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r"), "pass")
        held.destroy()
        parts = got if parts is None else parts.unionByName(got)
    if parts is None:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, cosine double")
    return parts


#: Codes of a code book.
MOST_CODES = 65_536


def quantize(vectors: DataFrame, codebook: DataFrame) -> DataFrame:
    """vec_id, code_id, distance: the nearest codeword of each vector, the smaller id on a tie.

    The code book (code_id, vec) is a fixed table of at most MOST_CODES rows, or an error; it is broadcast as one matrix.
    """
    import numpy as np

    rows = codebook.orderBy("code_id").select("code_id", "vec").limit(MOST_CODES + 1).collect()
    if len(rows) > MOST_CODES:
        raise ValueError(f"a code book has at most {MOST_CODES} codes")
    held = vectors.sparkSession.sparkContext.broadcast((np.array([r["code_id"] for r in rows]), np.array([r["vec"] for r in rows], np.float64)))

    def run(batches):
        import pyarrow as pa

        codes, m = held.value
        square = (m * m).sum(axis=1)
        for b in batches:
            kept = [(i, v) for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()) if v is not None]
            if not kept or not len(codes):
                continue
            x = np.array([v for _, v in kept], np.float64)
            d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ m.T + square[None, :], 0)
            k = np.argmin(np.round(d, 12), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept], pa.int64()), pa.array(codes[k], pa.int32()), pa.array(d[np.arange(len(k)), k])], ["vec_id", "code_id", "distance"])

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").mapInArrow(run, "vec_id bigint, code_id int, distance double")


def code_usage(quantized: DataFrame, codebook: DataFrame) -> DataFrame:
    """code_id, n, share of the vectors; unused codewords have 0."""
    n = quantized.groupBy("code_id").agg(F.count("*").alias("n"))
    all_ = codebook.select("code_id").join(n, "code_id", "left").select("code_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    total = all_.agg(F.sum("n").alias("total"))
    return all_.join(F.broadcast(total), F.lit(True)).select("code_id", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("share"))


def label_centroids(vectors: DataFrame) -> DataFrame:
    """code_id, vec: the mean vector of each label, a code book for tables that carry labels."""
    each = vectors.select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec")).select(F.col("label").cast("int").alias("code_id"), "vec")


def hash_embedding(c: Column, width: int = 32) -> Column:
    """A deterministic vector of ``width`` values in [-1, 1) from SHA-256 of the text and a counter: no model, no state."""
    part = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("#", T.text(c), i.cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(2.0**31) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), part)
