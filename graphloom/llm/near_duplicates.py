"""Near-duplicate records with small edits: an exact set-similarity join by adaptive multi-match prefixes.

A record is the set of its trigrams.  Trigrams are ordered from rare to frequent, by counts over all records kept in a
sketch of fixed size (any order is right, this one is fast).  For every l, two similar sets share at least l of their
first ``n - needed + l`` trigrams; each record picks the l of least estimated cost (postings scanned plus candidates to
verify), and a pair must show the smaller l of its two records before it is verified.  Length, position and a parity
bitmap of the whole set (its Hamming distance never exceeds the sets' difference) refuse most pairs where they arise.
Equal sets are one class, named by 128 bits, and are joined once, so copies cost nothing; only trigrams travel, in packed
blocks, to partitions named by number, whose count follows the bytes.  The postings of a trigram that very many classes
have are split into blocks, and each pair of blocks meets in a cell of its own, so no list is ever held by one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import heavy_light_join
from ..workspace import Workspace, spread

#: Cells of the frequency sketch: 4 bytes each, the most that is ever sent to the driver and broadcast.
CELLS = 1 << 20
_BLOCK = 1 << 14
LEVELS = 8
#: Cost of verifying one candidate, in postings scanned.
VERIFY_COST = 24.0
WORDS = 3
#: Packed bytes of a token partition, by which the number of partitions grows; and bytes a trigram of all records takes.
PART_BYTES = 128_000_000
TRIGRAM_BYTES = 16
#: Postings of a trigram beyond which they are split into blocks.
HOT = 8192
#: Copies of one class that meet in one task; a larger class is split into blocks.
COPIES = 4096


def _texts(batch) -> list[str]:
    from .text import body

    return [f"{body(q)} {r or ''}" for q, r in zip(batch.column("q").to_pylist(), batch.column("r").to_pylist())]


def _source(records: DataFrame) -> DataFrame:
    return spread(records.select(F.col("record_id").cast("bigint").alias("record_id"), F.col("question").cast("string").alias("q"), F.col("reasoning").cast("string").alias("r")))


def _class_ids(g, n):
    """Two 64-bit hashes of each set (0, 0: empty), from sums of scrambled trigram hashes."""
    import numpy as np

    from .text import U, mix

    stop, out = np.cumsum(n), np.zeros((len(n), 2), U)
    with np.errstate(over="ignore"):
        for k, salt in enumerate((0x1234567, 0xC2B2AE3D27D4EB4F)):
            run = np.concatenate([[U(0)], np.cumsum(mix(g + U(salt)), dtype=U)])
            out[:, k] = mix(run[stop] - run[stop - n] + n.astype(U) * U(0x9E3779B97F4A7C15 + 2 * k))
    out[n == 0] = 0
    return out


def _binary(ids, valid=None):
    """An Arrow binary column of 16-byte ids; null where not valid."""
    import numpy as np
    import pyarrow as pa

    raw = np.ascontiguousarray(ids).astype("<u8")
    off = np.arange(0, 16 * len(raw) + 1, 16, dtype=np.int32)
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(raw), [mask, pa.py_buffer(off.tobytes()), pa.py_buffer(raw.tobytes())])


class _Seen:
    """The classes a task has met; at the limit it forgets all and goes on, so a class may travel again."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, set()

    def fresh(self, cls, n):
        import numpy as np

        raw, out = np.ascontiguousarray(cls).tobytes(), np.zeros(len(cls), bool)
        for k in np.flatnonzero(n):
            c = raw[16 * k : 16 * k + 16]
            if c not in self.known:
                out[k] = True
                self.known.add(c)
        if len(self.known) > self.most:
            self.known.clear()
        return out


def _pass_one(records: DataFrame) -> DataFrame:
    """record_id, cls (null: no trigram), n of each record; and, as rows with a cell, each task's counts of its classes' trigrams."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import text as T

        counts, seen = np.zeros(CELLS, np.int64), _Seen()
        schema = pa.schema([("record_id", pa.int64()), ("cls", pa.binary()), ("n", pa.int32()), ("cell", pa.int32()), ("counts", pa.binary())])
        for b in batches:
            texts = _texts(b)
            ids = b.column("record_id").to_numpy(zero_copy_only=False)
            for i, j in T.slices([len(x) + 1 for x in texts]):
                g, doc, n = T.trigram_sets(texts[i:j])
                cls = _class_ids(g, n)
                counts += np.bincount((g[seen.fresh(cls, n)[doc]] & T.U(CELLS - 1)).astype(np.int64), minlength=CELLS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j], pa.int64()), _binary(cls, n > 0), pa.array(n.astype(np.int32)), pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], schema=schema
                )
        at = [k for k in range(0, CELLS, _BLOCK) if counts[k : k + _BLOCK].any()]
        m = len(at)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.array([k // _BLOCK for k in at], pa.int32()), pa.array([counts[k : k + _BLOCK].astype("<u4").tobytes() for k in at], pa.binary())], schema=schema
        )

    return _source(records).mapInArrow(run, "record_id bigint, cls binary, n int, cell int, counts binary")


def _sketch(first: DataFrame):
    """The summed sketch: CELLS counts of four bytes, whatever the size of the corpus."""
    import numpy as np

    def add(table):
        import pyarrow as pa

        total = np.zeros(_BLOCK, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), "<u4")
        total = np.minimum(total, 0xFFFFFFFF)
        return pa.table({"cell": table.column("cell").slice(0, 1), "counts": pa.array([total.astype("<u4").tobytes()], pa.binary())})

    out = np.zeros(CELLS, np.uint32)
    for r in first.where("cell is not null").select("cell", "counts").groupBy("cell").applyInArrow(add, "cell int, counts binary").collect():
        out[r["cell"] * _BLOCK : (r["cell"] + 1) * _BLOCK] = np.frombuffer(bytes(r["counts"]), "<u4")
    return out


def _levels(f, pos, doc, n, base, total):
    """The l of least estimated cost for each record, 1..LEVELS."""
    import numpy as np

    run = np.concatenate([[0.0], np.cumsum(f.astype(np.float64))])
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    best, level = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for k in range(1, LEVELS + 1):
        length = np.minimum(base + k - 1, n)
        scanned = run[first + length] - run[first]
        lam = np.minimum((scanned - length) / max(total, 1), 600.0).clip(0)
        below = sum(lam**i / math.factorial(i) for i in range(k)) * np.exp(-lam)
        cost = scanned + VERIFY_COST * total * np.maximum(1 - below, 0)
        better = (cost < best) & (base + k - 1 <= n)  # never more than the overlap that every partner has
        best[better], level[better] = cost[better], k
    return level


_DOC = [("cls", "<u8", (2,)), ("n", "<u4"), ("level", "<u1"), ("bits", "<u8", (WORDS,))]
_TOK = [("tok", "<u8"), ("doc", "<u4"), ("pos", "<u4")]


#: Marks in a posting's position: its trigram is split, and the side of the cell on which it stands.
_SPLIT, _SIDE = 1 << 31, 1 << 30


def _cells(g, doc, pos, f, cls):
    """Postings with those of frequent trigrams sent to cells: block i meets block j in cell (i, j) and nowhere else."""
    import numpy as np

    from .text import U, mix

    hot = np.flatnonzero(f > HOT)
    if not len(hot):
        return g, doc, pos
    blocks = -(-f[hot].astype(np.int64) // HOT)
    own = (mix(cls[doc[hot], 1]) % blocks.astype(U)).astype(np.int64)
    at = np.repeat(np.arange(len(hot)), blocks)
    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    mine = own[at]
    low, high = np.minimum(mine, other), np.maximum(mine, other)
    with np.errstate(over="ignore"):
        named = mix(g[hot][at] + (low.astype(U) << U(32) | high.astype(U)) * U(0x9E3779B97F4A7C15) + U(1))
    mark = np.where(low == high, 0, _SPLIT | np.where(mine == low, 0, _SIDE))
    rest = np.flatnonzero(f <= HOT)
    return np.concatenate([g[rest], named]), np.concatenate([doc[rest], doc[hot][at]]), np.concatenate([pos[rest], pos[hot][at] | mark])


def _pass_two(records: DataFrame, sketch, total: int, parts: int, num: int, den: int) -> DataFrame:
    """part, docs, toks: packed prefix trigrams of each class that a task meets, by token partition."""
    shared = records.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import text as T

        freq, seen = shared.value, _Seen()
        for b in batches:
            texts = _texts(b)
            for i, j in T.slices([len(x) + 1 for x in texts]):
                g, doc, n = T.trigram_sets(texts[i:j])
                cls = _class_ids(g, n)
                fresh = seen.fresh(cls, n)
                use = fresh[doc]
                g = g[use]
                n = n[fresh]
                if not len(n):
                    continue
                cls = cls[fresh]
                doc = np.repeat(np.arange(len(n)), n)
                f = freq[(g & T.U(CELLS - 1)).astype(np.int64)]
                # by record, then from rare to frequent, then by hash: g is sorted within a record and the sort is stable
                o = np.argsort((doc.astype(T.U) << T.U(32)) | f.astype(T.U), kind="stable")
                g, f = g[o], f[o]
                first = np.cumsum(n) - n
                pos = np.arange(len(g)) - np.repeat(first, n)
                bit = g % T.U(64 * WORDS)
                one = T.U(1) << (bit & T.U(63))
                bits = np.stack([np.bitwise_xor.reduceat(np.where(bit >> T.U(6) == w, one, T.U(0)), first) for w in range(WORDS)], axis=1)
                base = n - (num * n + den - 1) // den + 1
                level = _levels(f, pos, doc, n, base, total)
                keep = pos < (base + level - 1)[doc]
                g, doc, pos = _cells(g[keep], doc[keep], pos[keep], f[keep], cls)
                part = (T.mix(g) % T.U(parts)).astype(np.int64)
                o = np.argsort(part, kind="stable")
                g, doc, pos, part = g[o], doc[o], pos[o], part[o]
                edges = np.searchsorted(part, np.arange(parts + 1))
                rows = []
                for p in np.unique(part):
                    s, e = edges[p], edges[p + 1]
                    ds, local = np.unique(doc[s:e], return_inverse=True)
                    d = np.zeros(len(ds), _DOC)
                    d["cls"], d["n"], d["level"], d["bits"] = cls[ds], n[ds], level[ds], bits[ds]
                    t = np.zeros(e - s, _TOK)
                    t["tok"], t["doc"], t["pos"] = g[s:e], local, pos[s:e]
                    # columns apart and deltas small: the shuffle's codec finds the zero bytes
                    rows.append((int(p), b"".join(np.ascontiguousarray(d[c]).tobytes() for c, *_ in _DOC), b"".join(np.ascontiguousarray(t[c]).view(np.uint8).reshape(len(t), -1).T.tobytes() for c, *_ in _TOK), len(d), len(t)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32()))], ["part", "docs", "toks", "nd", "nt"])

    return _source(records).mapInArrow(run, "part int, docs binary, toks binary, nd int, nt int")


def _unpack(rows):
    """One array of documents and one of tokens from the packed blocks of a partition."""
    import numpy as np

    docs, toks, at = [], [], 0
    for x in rows:
        d, buf, k = np.zeros(x["nd"], _DOC), x["docs"], 0
        for c, kind, *shape in _DOC:
            m = np.prod(shape[0], dtype=int) if shape else 1
            v = np.frombuffer(buf, kind, x["nd"] * m, k)
            d[c] = v.reshape(-1, m) if shape else v
            k += v.nbytes
        t, buf, k = np.zeros(x["nt"], _TOK), x["toks"], 0
        for c, kind in _TOK:
            w = np.dtype(kind).itemsize
            t[c] = np.ascontiguousarray(np.frombuffer(buf, np.uint8, x["nt"] * w, k).reshape(w, -1).T).view(kind).ravel()
            k += x["nt"] * w
        t["doc"] += at
        at += len(d)
        docs.append(d)
        toks.append(t)
    return np.concatenate(docs), np.concatenate(toks)


def _candidates(docs, toks, num: int, den: int):
    """(index a, index b, shared prefix trigrams, required) of the pairs that pass length, position and bitmap."""
    import numpy as np

    o = np.lexsort((docs["cls"][:, 1], docs["cls"][:, 0]))
    c = docs["cls"][o]
    new = np.ones(len(o), bool)
    new[1:] = (c[1:] != c[:-1]).any(axis=1)
    inv = np.empty(len(o), np.int64)
    inv[o] = np.cumsum(new) - 1
    docs = docs[o[new]]  # a class comes from several tasks
    tok, doc, pos = toks["tok"], inv[toks["doc"]], toks["pos"].astype(np.int64)
    o = np.lexsort((doc, tok))
    tok, doc, pos = tok[o], doc[o], pos[o]
    keep = np.ones(len(tok), bool)
    keep[1:] = (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])
    tok, doc, pos = tok[keep], doc[keep], pos[keep]
    split, side = (pos & _SPLIT) != 0, (pos & _SIDE) != 0
    pos = pos & (_SIDE - 1)
    n, level, bits = docs["n"].astype(np.int64), docs["level"].astype(np.int64), docs["bits"]
    out: list = []
    held = 0
    alive, k = np.arange(len(tok) - 1), 1

    def merged():
        key = np.concatenate(out)
        o = np.argsort(key[:, 0], kind="stable")
        s = key[o]
        at = np.flatnonzero(np.concatenate([[True], s[1:, 0] != s[:-1, 0]]))
        return [np.stack([s[at, 0], np.add.reduceat(s[:, 1], at)], axis=1)]

    while len(alive):
        alive = alive[alive < len(tok) - k]
        alive = alive[tok[alive] == tok[alive + k]]
        for s in range(0, len(alive), 1 << 20):
            i = alive[s : s + (1 << 20)]
            a, b, pa, pb = doc[i], doc[i + k], pos[i], pos[i + k]
            na, nb = n[a], n[b]
            ok = (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (~split[i] | (side[i] != side[i + k]))
            a, b, pa, pb, na, nb = a[ok], b[ok], pa[ok], pb[ok], na[ok], nb[ok]
            need = (num * (na + nb) + num + den - 1) // (num + den)
            lv = np.minimum(level[a], level[b])
            ok = (pa < na - need + lv) & (pb < nb - need + lv)
            a, b, na, nb, need = a[ok], b[ok], na[ok], nb[ok], need[ok]
            apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
            ok = apart <= na + nb - 2 * need
            a, b = a[ok], b[ok]
            if len(a):
                out.append(np.stack([a * len(docs) + b, np.ones(len(a), np.int64)], axis=1))
                held += len(a)
                if held > 4_000_000:
                    out[:] = merged()
                    held = len(out[0])
        k += 1
    if not out:
        return docs, np.empty((0, 4), np.int64)
    (m,) = merged()
    a, b = m[:, 0] // len(docs), m[:, 0] % len(docs)
    return docs, np.stack([a, b, m[:, 1], np.minimum(level[a], level[b])], axis=1)


def candidate_pairs(packed: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """a, b: class pairs that share as many prefix trigrams as they must.

    The packed rows go to the partition of their number, so every partition has one part and all have the same size.
    """

    def pair(batches):
        import pyarrow as pa

        rows = [r for b in batches for r in b.to_pylist()]
        if not rows:
            return
        docs, m = _candidates(*_unpack(rows), num, den)
        rows.clear()
        for s in range(0, len(m), 1 << 18):
            x, y = docs["cls"][m[s : s + (1 << 18), 0]], docs["cls"][m[s : s + (1 << 18), 1]]
            turned = (x[:, 0] > y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] > y[:, 1]))
            x[turned], y[turned] = y[turned], x[turned]
            yield pa.RecordBatch.from_arrays([_binary(x), _binary(y), pa.array(m[s : s + (1 << 18), 2], pa.int32()), pa.array(m[s : s + (1 << 18), 3], pa.int32())], ["a", "b", "c", "need"])

    rows = packed.repartitionById(parts, "part").select("docs", "toks", "nd", "nt").mapInArrow(pair, "a binary, b binary, c int, need int")
    return rows.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need")).where("c >= need").select("a", "b")


def _sets_of(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, toks of the wanted (record_id, cls) rows, from their whole texts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import text as T

        for b in batches:
            texts = _texts(b)
            cls = b.column("cls")
            for i, j in T.slices([len(x) + 1 for x in texts]):
                g, _, n = T.trigram_sets(texts[i:j])
                off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([cls.slice(i, j - i), pa.ListArray.from_arrays(pa.array(off), pa.array(g.view(np.int64)))], ["cls", "toks"])

    return _source(records).join(wanted, "record_id").select("record_id", "q", "r", "cls").mapInArrow(run, "cls binary, toks array<bigint>")


def similar_classes(records: DataFrame, num: int = 7, den: int = 10, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(record_id, cls of every record with a trigram; a, b of the class pairs whose similarity is at least num/den).

    Null texts are empty; a record with fewer than three words has no trigram and no pair.  record_id is taken as
    unique; a repeated id counts as one record of each of its classes.
    """
    work = work or Workspace(records.sparkSession, "near")
    return _similar(records, work.keep(_pass_one(records), "classes"), num, den, work)


def _similar(records: DataFrame, first: DataFrame, num: int, den: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    members = first.where("cls is not null").select("record_id", "cls")
    total, trigrams = first.where("cell is null").agg(F.count("cls"), F.coalesce(F.sum("n"), F.lit(0))).first()
    cores = records.sparkSession.sparkContext.defaultParallelism
    parts = max(min(3 * cores, 200), -(-int(trigrams) * TRIGRAM_BYTES // PART_BYTES))
    packed = _pass_two(records, _sketch(first), total, parts, num, den)
    cand = work.keep(candidate_pairs(packed, parts, num, den), "candidates")
    wanted = cand.select(F.col("a").alias("cls")).unionByName(cand.select(F.col("b").alias("cls"))).distinct()
    reps = members.groupBy("cls").agg(F.min("record_id").alias("record_id")).join(wanted, "cls", "left_semi")
    sets = work.keep(_sets_of(records, reps), "sets")
    two = cand.join(sets.select(F.col("cls").alias("a"), F.col("toks").alias("ta")), "a").join(sets.select(F.col("cls").alias("b"), F.col("toks").alias("tb")), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    pairs = two.where(both * (num + den) >= num * (F.size("ta") + F.size("tb"))).select("a", "b")
    return members, work.keep(pairs, "pairs")


def _in_blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, blocks of each class with more than COPIES records; record_id, cls, blk, blocks of every record)."""
    many = members.groupBy("cls").agg(F.count("*").alias("m")).where(F.col("m") > COPIES).select("cls", F.ceil(F.col("m") / COPIES).cast("int").alias("blocks"))
    m = heavy_light_join(members, many, ["cls"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return many, m.withColumn("blk", F.pmod(F.xxhash64("record_id"), F.col("blocks")).cast("int"))


def similar_pairs(records: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """record_id_a, record_id_b of all pairs of records, exact repeats included; the smaller id first.

    Records of large classes are split into blocks; a pair of blocks is one key, so no class is one task's.
    """
    work = Workspace(records.sparkSession, "near")
    members, pairs = similar_classes(records, num, den, work)
    many, blocked = _in_blocks(members)
    many, blocked = work.keep(many, "many"), work.keep(blocked, "blocked")
    wide = pairs.join(many.select(F.col("cls").alias("b"), "blocks"), "b", "left").select("a", "b", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("blk"))
    left = blocked.select(F.col("cls").alias("a"), F.col("record_id").alias("x"))
    right = blocked.select(F.col("cls").alias("b"), "blk", F.col("record_id").alias("y"))
    apart = heavy_light_join(left, wide, ["a"]).join(right, ["b", "blk"]).select("x", "y")
    repeated = members.groupBy("cls").agg(F.count("*").alias("m")).where("m > 1").select("cls")
    copies = heavy_light_join(blocked, repeated, ["cls"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    copies = copies.select("cls", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "record_id")
    one, two = copies.withColumnsRenamed({"record_id": "x", "blk": "bx"}), copies.withColumnsRenamed({"record_id": "y", "blk": "by"})
    same = one.join(two, ["cls", "lo", "hi"]).where("x < y and (lo = hi or bx <> by)").select("x", "y")
    return apart.unionByName(same).select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b"))


def record_classes(records: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """record_id, class_id (smallest record with the same trigrams), n_copies, n_links (similar other classes).

    Records without a trigram do not appear.
    """
    return _class_rows(*similar_classes(records, num, den))


def document_classes(records: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """``record_classes`` with a row for every record: one without a trigram is a class of its own."""
    work = Workspace(records.sparkSession, "near")
    first = work.keep(_pass_one(records), "classes")
    alone = first.where("cell is null and cls is null").select("record_id", F.col("record_id").alias("class_id"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links"))
    return _class_rows(*_similar(records, first, num, den, work)).unionByName(alone)


def _class_rows(members: DataFrame, pairs: DataFrame) -> DataFrame:
    ends = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n_links"))
    classes = members.groupBy("cls").agg(F.min("record_id").alias("class_id"), F.count("*").alias("n_copies")).join(ends, "cls", "left")
    return heavy_light_join(members, classes, ["cls"]).select("record_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
