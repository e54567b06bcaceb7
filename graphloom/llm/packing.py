"""Texts into containers of fixed capacity, related texts together, with little room left.

Texts are sized in tokens and split only if they alone exceed the capacity.  They are put into shards of bounded size by
their weightiest term, so that related texts meet; each shard has a BM25 inverted index of all its terms, with statistics
of the whole corpus.  The largest unused text seeds a container; its unused neighbours fill the window in the order of
their score, as many as there are, until the last part of the room, which takes the best fitting ones; what room is left
then takes the largest texts that fit.  Containers that stay underfull are dissolved and their texts packed again, in
shards mixed anew, until one shard is left or mixing no longer helps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import heavy_light_join
from ..workspace import Workspace, spread
from . import counts
from .tokenize import encoder, vocabulary_path

#: Texts of a shard: bounds the index and the work of a task.
SHARD_ITEMS = 3000
CELLS = 1 << 20
K1, B = 1.2, 0.75
#: Share of the capacity, the last to be filled, in which size goes before score.
CLOSING = 0.4
#: Neighbours that are put in order at a time.
PORTION = 64
#: A container with less than this share filled is packed again.
FULL = 0.985


def _measure(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, row (a number of its own), n_tokens, terms (slots and frequencies of the words); and the tasks' document frequencies."""
    src = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))).withColumn("row", F.monotonically_increasing_id())

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import text as T

        encode = encoder(path).encode
        c = counts.Counters(["df"], CELLS)
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int32()), ("n_words", pa.int32()), ("terms", pa.binary()), ("cell", pa.int32()), ("counts", pa.binary())])
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in T.slices([len(x or "") + 1 for x in texts]):
                part = texts[i:j]
                h, n = T.word_hashes(part)
                key = np.repeat(np.arange(j - i), n) << 20 | (h & T.U(CELLS - 1)).astype(np.int64)
                key, tf = np.unique(key, return_counts=True)
                c.array += np.bincount(key & (CELLS - 1), minlength=CELLS)
                edge = np.searchsorted(key, np.arange(j - i + 1) << 20)
                slot, tf = (key & (CELLS - 1)).astype("<u4"), np.minimum(tf, 2047).astype("<u4")
                terms = [slot[a:z].tobytes() + tf[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:])]
                m = j - i
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, m), b.column("row").slice(i, m), pa.array([len(encode(x)) for x in part], pa.int32()), pa.array(n, pa.int32()), pa.array(terms, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], schema=schema)
        got = list(c.rows())
        m = len(got)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.binary())], schema=schema)

    return src.mapInArrow(run, "doc_id bigint, row bigint, n_tokens int, n_words int, terms binary, cell int, counts binary")


class Retriever:
    """BM25 neighbours within a shard."""

    def __init__(self, terms: list[bytes], words, df, total: int, mean_words: float):
        import numpy as np

        parts = [np.frombuffer(t, "<u4").reshape(2, -1) for t in terms]
        doc = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
        term = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        tf = np.concatenate([p[1] for p in parts]).astype(np.float64) if parts else np.zeros(0)
        f = df[term].astype(np.float64)
        idf = np.log1p((total - f + 0.5) / (f + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.asarray(words, float)[doc] / max(mean_words, 1)))
        o = np.argsort(term, kind="stable")
        term_s = term[o]
        self.posted, self.weight = doc[o], weight[o]
        uniq, start = np.unique(term_s, return_index=True)
        stop = np.append(start[1:], len(term_s)).astype(np.int64)
        which = np.searchsorted(uniq, term)
        # the lists of each document's terms; lists of one entry lead to no neighbour
        size = stop - start
        self.n = len(parts)
        # lists that many texts are on are rows of a matrix, the others are posting lists
        wide = size > max(16, self.n // 16)
        column = np.cumsum(wide) - 1
        mine = wide[which]
        self.matrix = np.zeros((int(wide.sum()), self.n), np.float32)
        self.matrix[column[which[mine]], doc[mine]] = weight[mine]
        self.columns, self.columns_at = column[which[mine]], np.searchsorted(doc[mine], np.arange(self.n + 1))
        useful = (size[which] > 1) & ~mine
        self.lists_doc, self.lists = doc[useful], which[useful]
        self.start, self.stop = start, stop
        self.at = np.searchsorted(self.lists_doc, np.arange(self.n + 1))

    def scores(self, d: int):
        import numpy as np

        c = self.columns[self.columns_at[d] : self.columns_at[d + 1]]
        out = self.matrix[c].sum(axis=0, dtype=float)
        w = self.lists[self.at[d] : self.at[d + 1]]
        if len(w):
            size = self.stop[w] - self.start[w]
            idx = np.repeat(self.start[w] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            out += np.bincount(self.posted[idx], self.weight[idx], minlength=self.n)
        return out if len(w) or len(c) else None


def fill(sizes, capacity: int, neighbours, closing: float = CLOSING) -> list[list[int]]:
    """Containers of item numbers; every item has a size of at most ``capacity``.

    Items of size 0 take no room and go into the first container.
    """
    import bisect

    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    items = np.flatnonzero(sizes > 0)
    free = sorted((int(sizes[i]), int(i)) for i in items)
    unused = np.zeros(len(sizes), bool)
    unused[items] = True
    out: list[list[int]] = []

    def take(k: int) -> int:
        _, i = free.pop(k)
        unused[i] = False
        return i

    while free:
        seed = take(len(free) - 1)
        box, room = [seed], capacity - int(sizes[seed])
        if room and free and free[0][0] <= room:
            score = neighbours(seed)
            if score is not None:
                left = np.flatnonzero(unused & (score > 0) & (sizes <= room))
                for by_score in (True, False):
                    order = score if by_score else sizes
                    while len(left) and room and not (by_score and room <= closing * capacity):
                        # the best are sorted out in portions, until the room is filled or no neighbour is left
                        part = left if len(left) <= PORTION else left[np.argpartition(-order[left], PORTION)[:PORTION]]
                        near = part[np.lexsort((part, -order[part]))]
                        while len(near) and room and not (by_score and room <= closing * capacity):
                            i = int(near[0])
                            take(bisect.bisect_left(free, (int(sizes[i]), i)))
                            box.append(i)
                            room -= int(sizes[i])
                            near = near[1:]
                            near = near[sizes[near] <= room]
                        left = left[unused[left] & (sizes[left] <= room)]
            while room and free and free[0][0] <= room:
                k = bisect.bisect_right(free, (room, 1 << 60)) - 1
                room -= free[k][0]
                box.append(take(k))
        out.append(box)
    zero = np.flatnonzero(sizes == 0).tolist()
    if zero:
        if out:
            out[0] = out[0] + zero
        else:
            out.append(zero)
    return out


def _spread(items: DataFrame, n: int, salt: int) -> DataFrame:
    """Items mixed over shards at random."""
    shards = max(1, -(-n // SHARD_ITEMS))
    return items.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(shards)).cast("int"))


def _themed(texts: DataFrame, total: int, shared, work: Workspace) -> DataFrame:
    """Items over shards by the term that weighs most in them and that other texts have too.

    A term that weighs most in more than half a shard's texts is split at random; the others are spread by hash.
    """
    shards = max(1, -(-total // SHARD_ITEMS))
    if shards == 1:
        return texts.withColumn("shard", F.lit(0))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        df = shared.value
        for b in batches:
            theme = []
            for t in b.column("terms").to_pylist():
                slot, tf = np.frombuffer(t, "<u4").reshape(2, -1)
                f = df[slot].astype(float)
                w = np.where(f > 1, np.log1p((total - f + 0.5).clip(0.5) / (f + 0.5)) * tf * (K1 + 1) / (tf + K1), 0.0)
                theme.append(int(slot[int(np.lexsort((slot, -w))[0])]) if len(w) and w.max() > 0 else -1)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(theme, pa.int32())], ["row", "theme"])

    themes = work.keep(texts.select("row", "terms").mapInArrow(run, "row bigint, theme int"), "themes")
    large = themes.groupBy("theme").agg(F.count("*").alias("n")).where(F.col("n") > SHARD_ITEMS // 2).select("theme", F.ceil(F.col("n") / (SHARD_ITEMS // 2)).alias("cut"))
    place = F.when(F.col("cut").isNull(), F.xxhash64("theme")).otherwise(F.xxhash64("theme", F.pmod(F.xxhash64("row"), F.col("cut"))))
    placed = heavy_light_join(themes, large, ["theme"], "left").select("row", F.pmod(place, F.lit(shards)).cast("int").alias("shard"))
    return texts.join(placed, "row")


def pack_documents(documents: DataFrame, sizes: DataFrame, path: str | None = None, most_rounds: int = 12, closing: float = CLOSING) -> DataFrame:
    """pack_name, container_id, doc_id, piece, first_token, n_tokens: a row for each text or piece and capacity.

    A text longer than the capacity is split into full pieces and a rest; no other text is split.  Null and empty texts
    have no tokens and take no room; each is still placed, as piece 0.  Rows with a null or repeated doc_id are texts of their
    own.  Rounds end when one shard is left, or when a round no longer lessens the rest by a tenth, or after
    ``most_rounds``: the last round's containers stay as they are, underfull or not; no text is left out.  Capacities that are
    null or below 1 are left out; ``sizes`` is a list of a few rows.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "pack")
    caps = [(r["pack_name"], int(r["capacity_tokens"])) for r in sizes.select("pack_name", "capacity_tokens").where("capacity_tokens > 0").distinct().orderBy("capacity_tokens", "pack_name").collect()]
    schema = "pack_name string, container_id string, doc_id bigint, piece int, first_token int, n_tokens int"
    if not caps:
        return spark.createDataFrame([], schema)
    measured = work.keep(_measure(documents, path or vocabulary_path()), "measured")
    texts = measured.where("cell is null").select("doc_id", "row", "n_tokens", "n_words", "terms")
    total, mean = texts.agg(F.count("*"), F.coalesce(F.avg("n_words"), F.lit(1.0))).first()
    shared = spark.sparkContext.broadcast(counts.collect(measured.where("cell is not null").select("cell", "counts"), ["df"], CELLS)["df"])
    limits = dict(caps)

    def pack(key, table, last: bool, round_: int):
        import pyarrow as pa

        shard = key[0].as_py()
        docs, ids, toks = (table.column(c).to_pylist() for c in ("doc_id", "row", "n_tokens"))
        retriever = Retriever(table.column("terms").to_pylist(), table.column("n_words").to_numpy(), shared.value, total, mean)
        rows: list[tuple] = []
        for name, cap in limits.items():
            rest, whole = [], 0
            for i in range(len(docs)):
                full, over = (toks[i] // cap, toks[i] % cap) if toks[i] > cap else (0, toks[i])
                for p in range(full):
                    rows.append((name, f"{name}-{round_}-{shard}-f{whole}", docs[i], ids[i], p, p * cap, cap, True))
                    whole += 1
                if over or not full:
                    rest.append((i, full, over))
            place = [i for i, _, _ in rest]

            def near(k, place=place, all_of=len(rest) == len(docs)):
                s = retriever.scores(place[k])
                return s if s is None or all_of else s[place]

            for c, box in enumerate(fill([o for _, _, o in rest], cap, near, closing)):
                done = last or sum(rest[k][2] for k in box) >= FULL * cap
                for k in box:
                    i, piece, over = rest[k]
                    rows.append((name, f"{name}-{round_}-{shard}-{c}", docs[i], ids[i], piece, piece * cap, over, done))
        cols = list(zip(*rows)) or [()] * 8
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("pack_name", "container_id", "doc_id", "row", "piece", "first_token", "n_tokens", "done"), cols, kinds)})

    def repack(key, table, last: bool, round_: int):
        """Like ``pack`` for rests, whose pieces keep their numbers."""
        import pyarrow as pa

        shard, name = key[0].as_py(), key[1].as_py()
        cap = limits[name]
        docs, ids, toks, piece, first = (table.column(c).to_pylist() for c in ("doc_id", "row", "n_tokens", "piece", "first_token"))
        retriever = Retriever(table.column("terms").to_pylist(), table.column("n_words").to_numpy(), shared.value, total, mean)
        rows = []
        for c, box in enumerate(fill(toks, cap, retriever.scores, closing)):
            done = last or sum(toks[k] for k in box) >= FULL * cap
            rows += [(name, f"{name}-{round_}-{shard}-{c}", docs[k], ids[k], piece[k], first[k], toks[k], done) for k in box]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        cols = list(zip(*rows)) or [()] * 8
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("pack_name", "container_id", "doc_id", "row", "piece", "first_token", "n_tokens", "done"), cols, kinds)})

    def bound(f, last: bool, round_: int):
        return lambda key, table: f(key, table, last, round_)

    out_schema = schema.replace("piece int", "row bigint, piece int") + ", done boolean"
    one = total <= SHARD_ITEMS
    placed = work.keep(_themed(texts, total, shared, work).groupBy("shard").applyInArrow(bound(pack, one, 0), out_schema), "round")
    result = placed.where("done").drop("done", "row")
    most = None
    for round_ in range(1, most_rounds + 1):
        left = placed.where("not done")
        per = [r["n"] for r in left.groupBy("pack_name").agg(F.count("*").alias("n")).collect()]  # a row a capacity
        if not per:
            return result
        n = max(per)
        # once mixing anew no longer helps, the rest is final
        last = n <= SHARD_ITEMS or round_ == most_rounds or (most is not None and n > 0.9 * most)
        most = n
        joined = left.select("pack_name", "doc_id", "row", "piece", "first_token", "n_tokens").join(texts.select("row", "n_words", "terms"), "row")
        now = _spread(joined, n, round_).groupBy("shard", "pack_name").applyInArrow(bound(repack, last, round_), out_schema)
        placed = work.keep(now, "round")
        result = result.unionByName(placed.where("done").drop("done", "row"))
        if last:
            return result
    return result


def fill_report(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """pack_name, n_containers, n_texts, n_tokens, fill: share of all room that is used."""
    per = packed.groupBy("pack_name").agg(F.countDistinct("container_id").alias("n_containers"), F.countDistinct("doc_id").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"))
    return per.join(F.broadcast(sizes.select("pack_name", "capacity_tokens").distinct()), "pack_name").select(
        "pack_name", "n_containers", "n_texts", "n_tokens", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("fill")
    )


def relatedness(documents: DataFrame, packed: DataFrame, common: float = 0.1) -> DataFrame:
    """pack_name, related: share of the texts' distinct words that another text of the same container has.

    A measure of a packing, not part of it: words in more than ``common`` of the texts are left out, as they are shared
    everywhere.  Only first pieces count.
    """
    w = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))).alias("w"))
    rare = w.groupBy("w").agg(F.count("*").alias("df")).where((F.col("df") > 1) & (F.col("df") <= common * documents.count())).select("w")
    held = packed.where("piece = 0").select("pack_name", "container_id", "doc_id").join(w.join(rare, "w"), "doc_id")
    n = held.groupBy("pack_name", "container_id", "w").agg(F.count("*").alias("m"))
    return n.groupBy("pack_name").agg(F.round(F.sum(F.when(F.col("m") > 1, F.col("m")).otherwise(0)) / F.sum("m"), 4).alias("related"))
