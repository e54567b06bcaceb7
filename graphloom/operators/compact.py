"""Expansion, PageRank and the best edges of many questions over one graph of numbers, a question at a time in its task.

A question's candidates are a large share of a graph with hubs, so rows of (question, edge) number questions times edges.
Here they are never shuffled, and written only where they are the result: nodes and edges are numbered once, every worker
reads the numbers from the shared folder, walks each question's graph in memory and returns only what is asked for.  The tasks hold the graph (some
40 bytes an edge and as many for one or two sets of relations), so ``fits`` limits its size; beyond it, and where workers
cannot read the shared folder, callers go by joins.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..workspace import Workspace

#: Edges of the largest graph that a worker holds.
MOST_EDGES = 10_000_000
#: Sets of relations that a worker holds at once; questions come ordered by type.
HELD_SETS = 2
#: Questions of a task, and rows of a batch that it returns.
TASK_QUESTIONS, BATCH_ROWS = 500, 200_000
#: Nodes up to which a bit for each pair of nodes is held (a graph of so many takes 50 MB).
BIT_NODES = 20_000
#: Edges of a block of a list: as many as one byte tells apart, more take two and do not repeat at whole bytes.
BLOCK_EDGES = 256
#: Bytes of the bits of a node for each question of a group; pairs of question and edge a task of a list has at least, and tasks at most.
BIT_BYTES, TASK_PAIRS, MOST_TASKS = 32_000_000, 4_000_000, 20_000
STAGES = ("none", "compact_fallback", "original_behavior")


def _readable(path: str) -> bool:
    import pyarrow as pa
    import pyarrow.fs as fs

    try:
        where, at = fs.FileSystem.from_uri(path)
        return where.get_file_info(at).type == fs.FileType.Directory
    except (pa.ArrowInvalid, OSError, ValueError):
        return False


def numbered(edges: DataFrame, work: Workspace) -> Numbered | None:
    """The graph in numbers, or None where tasks cannot hold or read it."""
    from ..workspace import shared_dir

    if not _readable(shared_dir(work.spark)) or edges.count() > MOST_EDGES:
        return None
    return Numbered(edges, work)


class Numbered:
    """A graph with numbered nodes (by name) and edges (by falling reliability, confidence and id).

    ``nodes`` has node and no, ``ids`` e and edge_id.
    """

    def __init__(self, edges: DataFrame, work: Workspace):
        self.work = work
        ends = edges.select(F.explode(F.array("head", "tail")).alias("node")).distinct()
        self.nodes = work.keep(ends.withColumn("no", F.row_number().over(Window.orderBy("node")) - 1), "node-numbers")
        self.few = self.nodes.count() <= 100_000
        self.relations = sorted(r["relation"] for r in edges.select("relation").distinct().collect())  # a few dozen
        ranked = edges.select("edge_id", "head", "tail", "relation", "reliability", "confidence").orderBy(F.desc("reliability"), F.desc("confidence"), F.desc("edge_id"))
        ranked = work.keep(ranked.withColumn("at", F.monotonically_increasing_id()), "ranked-edges")
        part, before, offset = F.shiftright("at", 33), 0, F.lit(0)
        for r in ranked.groupBy(part.alias("p")).count().orderBy("p").collect():  # one row a partition of the sort
            offset = F.when(F.col("p") == r["p"], before).otherwise(offset) if before else offset
            before += r["count"]
        ranked = ranked.withColumn("p", part).withColumn("e", (offset + F.col("at").bitwiseAND((1 << 33) - 1)).cast("bigint"))
        no = lambda c: self.named(c[0]).select(F.col("node").alias(c), c[0])
        kind = F.array_position(F.array(*[F.lit(r) for r in self.relations]), F.col("relation")).cast("int") - 1 if self.relations else F.lit(0)
        numbers = ranked.join(no("head"), "head").join(no("tail"), "tail").select("e", "h", "t", kind.alias("r"), "reliability", "edge_id")
        self.table = work.keep(numbers, "numbered-edges")
        self.path = self.table._graphloom_path
        self.ids = self.table.select("e", "edge_id")

    def named(self, number: str) -> DataFrame:
        """node and its number under the name ``number``, to be broadcast where nodes are few."""
        n = self.nodes.withColumnRenamed("no", number)
        return F.broadcast(n) if self.few else n

    def questions(self, seeds: DataFrame, types: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
        """k, question_type, seeds (numbers, -1 outside the graph), more, in enough partitions, of one type or two each.

        ``more`` has k and e, numbers of edges that belong to the question.
        """
        s = seeds.select("k", "node").distinct().join(self.named("no"), "node", "left").groupBy("k").agg(F.collect_list(F.coalesce("no", F.lit(-1))).alias("seeds"))
        s = s.withColumn("question_type", F.lit("")) if types is None else s.join(types.select("k", "question_type"), "k")
        m = F.array().cast("array<bigint>")
        s = s.withColumn("more", m) if more is None else s.join(more.groupBy("k").agg(F.collect_list("e").alias("more")), "k", "left").withColumn("more", F.coalesce("more", m))
        q = self.work.keep(s.select("k", "question_type", "seeds", "more"), "asked")
        tasks = max(q.sparkSession.sparkContext.defaultParallelism, -(-q.count() // TASK_QUESTIONS))
        return q.repartitionByRange(tasks, "question_type", F.hash("k"))

    def solve(self, questions: DataFrame, answer, schema: str, routes: dict[str, list[str]] | None = None) -> DataFrame:
        """k and the columns of ``schema``: the rows that ``answer`` gives for each question, as an array a column.

        ``answer`` gets the graph, the side of the relations that apply, its stage, the question's seeds, how many are outside the
        graph, and its ``more``.  ``routes`` has the relations by type, and those of ``other``; None: all edges.
        """
        path, number = self.path, {r: i for i, r in enumerate(self.relations)}
        sets = None if routes is None else {t: tuple(sorted(number[r] for r in rs)) for t, rs in routes.items()}

        def run(batches):
            return _answers(batches, path, sets, answer, [c.split()[0] for c in schema.split(",")])

        return questions.mapInArrow(run, f"k {dict(questions.dtypes)['k']}, {schema}")

    def listed(self, seeds: DataFrame) -> DataFrame:
        """k, edge_id and hop of all candidates over all edges.

        So many rows fill a disk if each holds its edge id, so they come by blocks of few edges: for a block the questions in turn,
        for each its edges of the block.  Written as Parquet a row takes a part of a byte or two, not eight.
        """
        s = seeds.select("k", "node").distinct().join(self.named("no"), "node").groupBy("k").agg(F.collect_list("no").alias("seeds"))
        n, edges, asked = self.nodes.count(), self.table.count(), s.count()
        groups = max(1, -(-asked * n // (8 * BIT_BYTES)))
        s = s.withColumn("g", F.pmod(F.hash("k"), F.lit(groups))).repartition("g").sortWithinPartitions("g")
        path, at, blocks = self.path, self.work.keep(s, "asked")._graphloom_path, -(-edges // BLOCK_EDGES)
        spark = self.work.spark
        pairs, units = asked * edges, groups * blocks if asked else 0
        tasks = min(units, max(spark.sparkContext.defaultParallelism, pairs // max(TASK_PAIRS, pairs // MOST_TASKS)))
        return spark.range(0, units, 1, max(1, tasks)).mapInArrow(lambda batches: _listed(batches, path, at, blocks), f"k {dict(s.dtypes)['k']}, edge_id string, hop int")


class Side:
    """The edges of some relations from both of their ends, by node and other end; a self-loop once."""

    def __init__(self, n: int, h, t, e, relations=None):
        import numpy as np

        self.relations = relations
        two = h != t
        node, other, edge = np.concatenate([h, t[two]]), np.concatenate([t, h[two]]), np.concatenate([e, e[two]])
        both = node.astype(np.int64) * n + other
        o = np.argsort(both, kind="stable")
        both, self.other, self.edge = both[o], other[o], edge[o]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=n))])
        first = np.flatnonzero(np.diff(both, prepend=-1))
        self.near, self.count = self.other[first], np.diff(np.append(first, len(both)))
        self.near_at = np.searchsorted(first, self.at)
        self.room, self.edges = np.diff(self.near_at), len(h)
        self.bits = None
        if n <= BIT_NODES:
            owner = np.repeat(np.arange(n), self.room)
            self.bits = np.zeros((n, -(-n // 8)), np.uint8)
            np.bitwise_or.at(self.bits, (owner, self.near >> 3), np.left_shift(1, self.near & 7).astype(np.uint8))
            half = owner <= self.near
            self.low, self.high, self.times = owner[half].astype(np.int32), self.near[half], self.count[half].astype(np.float64)

    def reach(self, seeds):
        """(mask of the seeds and their neighbours, mask of the ends of their edges, edges of the seeds, edges of all of the first mask)."""
        import numpy as np

        a = np.zeros(len(self.room), bool)
        a[seeds] = True
        i, owner = _rows(self.near_at, seeds)
        near, count = self.near[i], self.count[i]
        one = count.sum() - count[a[near] & (near > owner)].sum()
        a[near] = True
        c = a.copy()
        inner = np.flatnonzero(a)
        if self.bits is not None and len(inner):
            c |= np.unpackbits(np.bitwise_or.reduce(self.bits[inner], axis=0), count=len(c), bitorder="little").view(bool)
            return a, c, int(one), int(np.dot(a[self.low] | a[self.high], self.times))
        if 2 * self.room[inner].sum() <= len(self.near):
            i, owner = _rows(self.near_at, inner)
            near, count = self.near[i], self.count[i]
            c[near] = True
            return a, c, int(one), int(count.sum() - count[a[near] & (near > owner)].sum())
        # the other nodes have fewer edges: all edges but those among them
        i, owner = _rows(self.near_at, np.flatnonzero(~a))
        near = self.near[i]
        met = a[near]
        c[owner[met]] = True
        return a, c, int(one), int(self.edges - self.count[i][~met & (near >= owner)].sum())

    def edges_of(self, nodes, inside):
        """The edges of ``nodes``, each once; ``inside`` is the mask of ``nodes``."""
        i, owner = _rows(self.at, nodes)
        other = self.other[i]
        once = ~inside[other] | (owner <= other)
        return self.edge[i[once]]


class Graph:
    """The numbers of a graph as a worker holds them."""

    def __init__(self, path: str):
        import numpy as np
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        where, at = fs.FileSystem.from_uri(path)
        self.where, self.folder = where, at
        t = pq.read_table(at, filesystem=where, columns=["e", "h", "t", "r", "reliability"])
        e = t.column("e").to_numpy()
        self.h, self.t, self.r, self.reliability = np.empty(len(e), np.int32), np.empty(len(e), np.int32), np.empty(len(e), np.int16), np.empty(len(e))
        self.h[e], self.t[e], self.r[e], self.reliability[e] = t.column("h").to_numpy(), t.column("t").to_numpy(), t.column("r").to_numpy(), t.column("reliability").to_numpy()
        self.n = int(max(self.h.max(), self.t.max())) + 1 if len(e) else 0
        self.most = float(self.reliability.max()) if len(e) else 0.0
        self.sides: OrderedDict[object, Side] = OrderedDict()
        self.pairs = None

    def side(self, relations) -> Side:
        import numpy as np

        if relations not in self.sides:
            at = np.arange(len(self.h), dtype=np.int32) if relations is None else np.flatnonzero(np.isin(self.r, relations)).astype(np.int32)
            while len(self.sides) >= HELD_SETS:
                self.sides.popitem(last=False)
            self.sides[relations] = Side(self.n, self.h[at], self.t[at], at, relations)
        self.sides.move_to_end(relations)
        return self.sides[relations]

    def names(self, what: str, number: str):
        """Strings of a column by number, in Arrow."""
        import pyarrow.parquet as pq

        t = pq.read_table(self.folder, filesystem=self.where, columns=[number, what]).sort_by(number)
        return t.column(what).combine_chunks()

    def ranks(self, c, seeds):
        """(scores by node, mask of the nodes with an edge) by the PageRank of ``graph.pagerank`` over the edges within the mask ``c``."""
        import numpy as np

        from .graph import MOST_ROUNDS, TOLERANCE

        if self.pairs is None:
            pair, weight = np.unique(self.h.astype(np.int64) * self.n + self.t, return_counts=True)
            head = pair // self.n
            self.pairs = head, pair % self.n, weight.astype(float), np.concatenate([[0], np.cumsum(np.bincount(head, minlength=self.n))])
        head, tail, weight, at = self.pairs
        inner = np.flatnonzero(c)
        if 2 * (at[inner + 1] - at[inner]).sum() <= len(head):
            i, _ = _rows(at, inner)
            i = i[c[tail[i]]]
        else:
            i = np.flatnonzero(c[head] & c[tail])
        place = np.cumsum(c) - 1
        h, t, w, n = place[head[i]], place[tail[i]], weight[i], len(inner)
        out = np.bincount(h, w, n)
        member = out > 0
        member[t] = True
        size, mark = int(member.sum()), np.zeros(n, bool)
        mark[place[seeds]] = True
        mark &= member
        restart = mark / mark.sum() if mark.any() else member / max(size, 1)
        share, dangling, x = w / out[h], member & (out == 0), member / max(size, 1)
        for _ in range(MOST_ROUNDS if size else 0):
            last, x = x, K.ALPHA * (np.bincount(t, x[h] * share, n) + x[dangling].sum() * restart) + (1 - K.ALPHA) * restart
            if np.abs(x - last).sum() < size * TOLERANCE:
                break
        else:
            if size:
                raise RuntimeError("a rank did not converge")
        score, some = np.zeros(self.n), np.zeros(self.n, bool)
        score[inner], some[inner] = np.where(member, x, 0.0), member
        return score, some

    def best(self, side: Side, a, seeds, score, most: int):
        """(edge, score) of the best edges of the mask ``a`` in order, as ``graph.top_edges`` ranks them.

        With ``most`` edges of seeds, others count only if one of their ends ranks high enough to reach the last of those.
        """
        import numpy as np

        s = _rounded(score, 9)
        mark = np.zeros(self.n, bool)
        mark[seeds] = True

        def value(e, bonus):
            return K.NODE_WEIGHT * s[self.h[e]] + K.NODE_WEIGHT * s[self.t[e]] + K.SOURCE_WEIGHT * self.reliability[e] + bonus

        own = side.edges_of(seeds, mark)
        v = value(own, K.SEED_BONUS)
        rest = a & ~mark
        if len(own) >= most:
            least = np.partition(v, len(v) - most)[len(v) - most] - 2e-8
            own, v = own[v >= least], v[v >= least]
            rest = ~mark & (2 * K.NODE_WEIGHT * s + K.SOURCE_WEIGHT * self.most >= least)
        more = side.edges_of(np.flatnonzero(rest), rest)
        h, t = self.h[more], self.t[more]
        more = more[(a[h] | a[t]) & ~mark[h] & ~mark[t]]
        e, v = np.concatenate([own, more]), np.concatenate([v, value(more, 0.0)])
        if len(e) > most:
            keep = v >= np.partition(v, len(v) - most)[len(v) - most] - 2e-8
            e, v = e[keep], v[keep]
        v = _rounded(v, 8)
        o = np.lexsort((e, -v))[:most]
        return e[o], v[o]


def _rows(at, nodes):
    """(places in a table by node, node of each)."""
    import numpy as np

    size = at[nodes + 1] - at[nodes]
    return np.repeat(at[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum()), np.repeat(nodes, size)


def _rounded(v, digits: int):
    """Half away from zero by the shortest decimal, as Spark rounds (no value is negative)."""
    from decimal import ROUND_HALF_UP, Decimal

    import numpy as np

    y = v * 10.0**digits
    out = np.floor(y + 0.5) / 10.0**digits
    unit = Decimal(1).scaleb(-digits)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-5).tolist():
        out[i] = float(Decimal(repr(float(v[i]))).quantize(unit, ROUND_HALF_UP))
    return out


_HELD: dict[str, Graph] = {}


def _held(path: str) -> Graph:
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = Graph(path)
    return _HELD[path]


def _answers(batches, path: str, sets, answer, names: list[str]) -> Iterator:
    import numpy as np
    import pyarrow as pa

    g = _held(path)

    def batch(keys, rows, got):
        columns = [keys.take(pa.array(np.concatenate(rows)))]
        columns += [pa.concat_arrays(x) if isinstance(x[0], pa.Array) else pa.array(np.concatenate(x)) for x in zip(*got)]
        return pa.RecordBatch.from_arrays(columns, ["k", *names])

    def lists(column):
        ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends

    for b in batches:
        kinds, keys = b.column("question_type").to_pylist(), b.column("k")
        (flat, ends), (more, stops) = lists(b.column("seeds")), lists(b.column("more"))
        rows, got, held = [], [], 0
        for i in sorted(range(len(kinds)), key=lambda i: kinds[i]):
            every = flat[ends[i] : ends[i + 1]]
            seeds = np.sort(every[every >= 0])
            side, stage = None, 2
            for at, r in enumerate([] if sets is None else [sets.get(kinds[i]), sets.get("other")]):
                if r and (own := g.side(r)).room[seeds].any():
                    side, stage = own, at
                    break
            side = g.side(None) if side is None else side
            for found in answer(g, side, stage, seeds, len(every) - len(seeds), more[stops[i] : stops[i + 1]]):
                rows.append(np.full(len(found[0]), i))
                got.append(found)
                held += len(found[0])
                if held >= BATCH_ROWS:
                    yield batch(keys, rows, got)
                    rows, got, held = [], [], 0
        if rows:
            yield batch(keys, rows, got)


def count_edges(g: Graph, side: Side, stage: int, seeds, outside: int, more):
    """stage, hop1, hop2, nodes and how many of the edges ``more`` are among the candidates: COUNTS."""
    import numpy as np

    a, c, one, every = side.reach(seeds)
    met = a[g.h[more]] | a[g.t[more]]
    if side.relations is not None:
        met &= np.isin(g.r[more], side.relations)
    yield [np.array([x], np.int64) for x in (stage, one, every - one, c.sum() + outside, met.sum())]


COUNTS = "stage bigint, hop1_edges bigint, hop2_edges bigint, candidate_nodes bigint, kept bigint"


class Asked:
    """A group of questions with bits of the nodes near each: a row a node, a bit a question, alike questions side by side."""

    def __init__(self, g: Graph, path: str, group: int):
        import numpy as np
        import pyarrow as pa
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        where, at = fs.FileSystem.from_uri(path)
        t = pq.read_table(at, filesystem=where, columns=["k", "seeds"], filters=[("g", "=", group)])
        side, seeds = g.side(None), t.column("seeds").to_pylist()
        size = np.diff(side.at)
        seeds = [sorted(x, key=lambda v: (-size[v], v)) for x in seeds]
        order = sorted(range(len(seeds)), key=seeds.__getitem__)
        self.keys = t.column("k").combine_chunks().take(pa.array(order, pa.int64()))
        self.near, self.first = (np.zeros((g.n, -(-len(order) // 8)), np.uint8) for _ in range(2))
        step = max(8, min(512, BIT_BYTES // max(g.n, 1) // 8 * 8))
        for i in range(0, len(order), step):
            a = np.zeros((2, min(step, len(order) - i), g.n), bool)
            for j, q in enumerate(order[i : i + step]):
                v = np.array(seeds[q], np.int64)
                a[:, j, v] = True
                a[0, j, side.near[_rows(side.near_at, v)[0]]] = True
            for bits, x in ((self.near, a[0]), (self.first, a[1])):
                b = np.packbits(x, axis=0, bitorder="little")
                bits[:, i // 8 : i // 8 + len(b)] = b.T


def _listed(batches, path: str, asked: str, blocks: int) -> Iterator:
    """k, edge_id and hop of the units (group of questions, block of edges) that the batches number."""
    import numpy as np
    import pyarrow as pa

    g = _held(path)
    if not hasattr(g, "blocks"):
        # edges by the end that has most, so that a block is near the same questions; the ids of a block are read as one
        h, t = g.h.astype(np.int64), g.t.astype(np.int64)
        size = np.diff(g.side(None).at)
        hub = np.where(size[h] >= size[t], h, t)
        g.blocks, g.edge_ids, g.asked = np.lexsort((h + t - hub, hub)), g.names("edge_id", "e"), (None, None)
    rows, held = [], 0
    for unit in (u for b in batches for u in b.column(0).to_pylist()):
        group, block = divmod(unit, blocks)
        if g.asked[0] != (asked, group):
            g.asked = q = (None, None)  # the former group is let go first
            g.asked = (asked, group), Asked(g, asked, group)
        q = g.asked[1]
        e = g.blocks[block * BLOCK_EDGES : (block + 1) * BLOCK_EDGES]
        ids, near, first = g.edge_ids.take(pa.array(e)), q.near[g.h[e]] | q.near[g.t[e]], q.first[g.h[e]] | q.first[g.t[e]]
        some = np.flatnonzero(near.any(axis=0))
        for i in range(0, len(some), 128):
            at = some[i : i + 128]
            x, one = (np.ascontiguousarray(np.unpackbits(m[:, at], axis=1, bitorder="little").T).ravel() for m in (near, first))
            found = np.flatnonzero(x)
            own = found // len(e)
            rows.append((q.keys.take(pa.array(at[own >> 3] * 8 + (own & 7))), ids.take(pa.array((found - own * len(e)).astype(np.uint8))), pa.array(2 - one[found].astype(np.int32))))
            held += len(found)
            if held >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*rows)], ["k", "edge_id", "hop"])
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*rows)], ["k", "edge_id", "hop"])


def rank_nodes(g: Graph, side: Side, stage: int, seeds, outside: int, more):
    """no and score of the nodes of the candidates: RANKS."""
    import numpy as np

    score, some = g.ranks(side.reach(seeds)[1], seeds)
    at = np.flatnonzero(some)
    yield [at, score[at]]


RANKS = "no bigint, score double"


class BestEdges:
    """e, score and rank of the best candidates: BEST."""

    def __init__(self, most: int):
        self.most = most

    def __call__(self, g: Graph, side: Side, stage: int, seeds, outside: int, more):
        import numpy as np

        a, c, _, _ = side.reach(seeds)
        e, score = g.best(side, a, seeds, g.ranks(c, seeds)[0], self.most)
        yield [e.astype(np.int64), score, np.arange(1, len(e) + 1, dtype=np.int32)]


BEST = "e bigint, score double, rank int"
