"""Splits that keep related records together.

Records are related if they share an entity: a group id or the word sequence of the question.  Blocks are connected
components, found by alternating large-star and small-star steps over pairs of group ids; a block's id is hashed into
proportional ranges, so every record of a block gets the same split whatever the order or number of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import key
from ..operators.skew import heavy_light_join
from ..workspace import Workspace

#: Group ids that say nothing (fixed values).
ABSENT = ("n/a", "unknown", "none")
SHARES = (("train", 0.90), ("validation", 0.05), ("test", 0.05))
#: Blocks with more than this share of the rows are placed one by one, as their hash alone would upset the shares.
LARGE_BLOCK = 0.005
#: Links beyond which the star steps look for heavy keys; fewer are joined as they come.
SKEW_ROWS = 1_000_000


def record_keys(records: DataFrame) -> DataFrame:
    """record_id, g (group id, trimmed and lower-cased, null if absent), q (hash of the question body's words, null if none)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from . import text as T

        for b in batches:
            bodies = [T.body(x) for x in b.column("question").to_pylist()]
            a, z = T.sequence_hashes(*T.word_hashes(bodies))
            none = (a == 0) & (z == 0)
            raw = np.stack([a, z], axis=1).astype("<u8").tobytes()
            q = pa.array([None if e else raw[16 * i : 16 * i + 16] for i, e in enumerate(none)], pa.binary())
            g = [s if (s := (x or "").strip().lower()) and s not in ABSENT else None for x in b.column("group_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("record_id"), pa.array(g, pa.string()), q], ["record_id", "g", "q"])

    src = records.select(F.col("record_id").cast("bigint").alias("record_id"), F.col("group_id").cast("string").alias("group_id"), F.col("question").cast("string").alias("question"))
    return src.mapInArrow(run, "record_id bigint, g string, q binary")


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, work: Workspace, most_rounds: int = 60) -> DataFrame:
    """node, root of each node of the edges (u, v), root the smallest node of its component (by code point).

    Large-star links every larger neighbour of a node to the smallest of its neighbourhood, small-star every smaller
    one; both take minima with map-side combining and a skew-aware join back, so no neighbourhood is ever gathered.
    Self-loops and repeats do no harm; edges with a null end are ignored; no edges give no rows.
    """

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        heavy = None if n > SKEW_ROWS else []
        if large:
            both = work.keep(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
            mins = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            j = heavy_light_join(both.where("v > u"), mins, ["u"], heavy=heavy).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            out = work.keep(j.distinct(), "large")
            work.drop(both)
            return out
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        mins = down.groupBy("u").agg(F.min("v").alias("m"))
        j = heavy_light_join(down, mins, ["u"], heavy=heavy)
        links = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select("u", F.col("m").alias("v")))
        return work.keep(links.distinct(), "small")

    e = work.keep(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    before = _state(e)
    for _ in range(most_rounds):
        if not before[0]:
            break
        large = star(e, True, before[0])
        small = star(large, False, before[0])
        now = _state(small)
        work.drop(e)
        work.drop(large)
        e = small
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def blocks(records: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(record_id, comp of each record; comp, n, block_id of each block).

    A record without group id and question words is a block of its own (rows that repeat its id share
    it).  Empty tables give empty tables.
    """
    recs = work.keep(record_keys(records), "records")
    pairs = work.keep(recs.where("g is not null and q is not null").groupBy("g", "q").agg(F.count("*").alias("n")), "pairs")
    firsts = work.keep(pairs.groupBy("q").agg(F.min("g").alias("first_g"), F.count("*").alias("gs")), "firsts")
    links = heavy_light_join(pairs.select("g", "q"), firsts.where("gs > 1").select("q", "first_g"), ["q"])
    roots = work.keep(components(links.select(F.col("g").alias("u"), F.col("first_g").alias("v")), work), "roots")
    # records without group id take the first group of their question, if it has any
    lone = recs.where("g is null and q is not null")
    lone = heavy_light_join(lone.select("record_id", "q"), firsts.select("q", "first_g"), ["q"], "left")
    named = recs.where("g is not null").select("record_id", F.col("g").alias("node")).unionByName(lone.where("first_g is not null").select("record_id", F.col("first_g").alias("node")))
    rooted = heavy_light_join(named, roots, ["node"], "left").select("record_id", F.concat(F.lit("g:"), F.coalesce("root", "node")).alias("comp"))
    rest = lone.where("first_g is null").select("record_id", F.concat(F.lit("q:"), F.hex("q")).alias("comp"))
    single = recs.where("g is null and q is null").select("record_id", F.concat(F.lit("r:"), F.col("record_id").cast("string")).alias("comp"))
    members = work.keep(rooted.unionByName(rest).unionByName(single), "members")
    sized = members.groupBy("comp").agg(F.count("*").alias("n"), F.min("record_id").alias("low"))
    block_id = F.when(F.col("comp").startswith("g:"), F.substring("comp", 3, 1 << 30)).otherwise(F.col("low").cast("string"))
    return members, sized.select("comp", "n", block_id.alias("block_id"))


def related_records(records: DataFrame) -> DataFrame:
    """record_id, block_id of each record in a block of two or more."""
    members, sized = blocks(records, Workspace(records.sparkSession, "related"))
    return heavy_light_join(members, sized.where("n >= 2").select("comp", "block_id"), ["comp"]).select("record_id", "block_id")


def unit_hash(c: Column) -> Column:
    """A value in [0, 1) from a string."""
    return F.pmod(F.xxhash64(c), F.lit(1 << 40)) / F.lit(float(1 << 40))


def place_large(blocks_: list[tuple[str, int, float]], n: int, shares) -> tuple[dict[str, str], dict[str, float]]:
    """(split of each large block; rows left for each split's other blocks).

    ``blocks_`` has block id, rows and hash in [0, 1).  Each block, in the order of its hash, goes to the split in whose
    range its hash falls if that split has room for it, else to the one with most room.
    """
    room = {name: share * n for name, share in shares}
    out = {}
    for block, rows, u in sorted(blocks_, key=lambda b: (b[2], b[0])):
        at, own = 0.0, shares[-1][0]
        for name, share in shares:
            if at <= u < at + share:
                own = name
            at += share
        split = own if room[own] >= rows else max(room, key=lambda k: room[k])
        out[block] = split
        room[split] -= rows
    return out, {k: max(v, 0.0) for k, v in room.items()}


def grouped_splits(records: DataFrame, shares=SHARES, large: float = LARGE_BLOCK) -> DataFrame:
    """record_id, block_id, split: one of ``shares``' names, the same for all records of a block.

    A block's id is hashed into ranges proportional to the shares.  Blocks with more than ``large`` of the rows (at most
    1 / large of them) go by their hash too, but only where a split has room for them; the ranges of all other blocks then
    share out what room is left.  Without such blocks the hash alone decides.
    """
    work = Workspace(records.sparkSession, "splits")
    members, sized = blocks(records, work)
    sized = work.keep(sized, "sized")
    n = members.count()
    u = unit_hash(F.col("block_id"))
    big = [(r["block_id"], r["n"], r["u"]) for r in sized.where(F.col("n") > large * n).select("block_id", "n", u.alias("u")).collect()]
    placed, room = place_large(big, n, shares)
    left = max(sum(room.values()), 1e-9)
    split, low = F.lit(shares[-1][0]), 0.0
    bounds = []
    for name, _ in shares:
        bounds.append((name, low, low + room[name] / left))
        low += room[name] / left
    for name, a, b in reversed(bounds):
        split = F.when((u >= a) & (u < b), name).otherwise(split)
    for block, name in placed.items():
        split = F.when(F.col("block_id") == block, name).otherwise(split)
    return heavy_light_join(members, sized.select("comp", "block_id", split.alias("split")), ["comp"]).select("record_id", "block_id", "split")
