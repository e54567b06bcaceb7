"""Per-key work with even load where a few keys own most rows.

The keys that own more than ``share`` of the rows are found with a frequent-items sketch: one pass, merged from
partition sketches of fixed size, no false negatives above the sketch's error.  There are at most ``1 / share`` of
them, so their list is of proven size.  Rows of heavy keys never meet in one task: they are joined by broadcast and
aggregated from partial results; all other rows take the ordinary shuffle; the two results are united.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least share of the rows at which a key counts as heavy in joins.
SHARE = 0.01
#: Rows of the other side that may be broadcast for the heavy keys; beyond it the heavy part is salted.
BROADCAST_ROWS = 100_000
SALTS = 64
_SKETCH_ITEMS = 4096


def _packed(on: Sequence[str]) -> Column:
    """One string per key; a null in any part makes it null."""
    if len(on) == 1:
        return F.col(on[0]).cast("string")
    parts = [F.col(c).cast("string") for c in on]
    whole = F.concat(*[F.concat(F.length(p), F.lit(":"), p) for p in parts])
    return whole


def heavy_keys(df: DataFrame, on: Sequence[str], share: float = SHARE) -> list[str]:
    """Packed values of the keys that own at least ``share`` of the rows (a few lighter ones may be among them).

    The list has at most ``2 / share`` values.  Keys with a null part are never heavy: no join matches them.
    """
    k = max(1, min(_SKETCH_ITEMS // 2, int(2 / share)))
    got = (
        df.select(_packed(on).alias("k"))
        .agg(F.expr(f"approx_top_k(k, {k}, {_SKETCH_ITEMS})").alias("top"), F.count("*").alias("n"))
        .first()
    )
    least = got["n"] * share
    return [r["item"] for r in (got["top"] or []) if r["item"] is not None and r["count"] >= least]


def _is_heavy(on: Sequence[str], heavy: list[str]) -> Column:
    return F.coalesce(_packed(on).isin(heavy), F.lit(False))


def heavy_light_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", heavy: list[str] | None = None, share: float = SHARE
) -> DataFrame:
    """``left.join(right, on, how)`` for ``inner``, ``left``, ``left_semi`` and ``left_anti``, even where a few keys own most of ``left``.

    Heavy keys of ``left`` meet their rows of ``right`` by broadcast (salted shuffle, if those are more than
    ``BROADCAST_ROWS``, or the rows of ``left``, if those are fewer); the rest is an ordinary join.  Rows whose key has a null match nothing, as in SQL; they stay
    out of every shuffle.  ``left`` is read twice, so pass a table, not a costly plan.  Columns of ``right`` other
    than the key must not clash with those of ``left``.  An empty side gives what the plain join gives.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    on = list(on)
    clash = set(left.columns) & set(right.columns) - set(on)
    if clash and how in ("inner", "left"):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    heavy = heavy_keys(left, on, share) if heavy is None else heavy
    if not heavy:
        return left.join(right, on, how)
    hot_right = right.where(_is_heavy(on, heavy))
    hot_left, cold_left = left.where(_is_heavy(on, heavy)), left.where(~_is_heavy(on, heavy))
    if hot_right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hot = hot_left.join(F.broadcast(hot_right), on, how)
    elif how == "inner" and hot_left.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hot = hot_right.join(F.broadcast(hot_left), on)  # few rows meet a hub: the hub's rows stay where they are
    elif how in ("left_semi", "left_anti"):
        hot = hot_left.join(F.broadcast(hot_right.select(*on).distinct()), on, how)  # at most one row a heavy key
    else:
        salted = hot_left.withColumn("_salt", F.floor(F.rand(7) * SALTS).cast("int"))
        spread = hot_right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hot = salted.join(spread, [*on, "_salt"], how).drop("_salt")
    cold = cold_left.join(right.where(~_is_heavy(on, heavy)), on, how)
    return hot.select(*cold.columns).unionByName(cold)


def heavy_light_aggregate(df: DataFrame, on: Sequence[str], aggregates: dict[str, Column], heavy: list[str] | None = None, share: float = SHARE) -> DataFrame:
    """``df.groupBy(on).agg(...)`` with the rows of heavy keys spread over all tasks.

    Heavy rows are matched with the broadcast list of heavy keys and leave their scan as partial aggregates, a row a
    key and task; light rows shuffle by key.  Rows whose key has a null part form groups as in SQL.  Aggregates must be
    such that Spark combines them before the shuffle (counts, sums, means, extremes, sketches).  An empty table gives
    no row.  The extra column ``is_heavy`` tells which way a key took.
    """
    on = list(on)
    heavy = heavy_keys(df, on, share) if heavy is None else heavy
    aggs = [c.alias(n) for n, c in aggregates.items()]
    cold = df.where(~_is_heavy(on, heavy)).groupBy(*on).agg(*aggs).withColumn("is_heavy", F.lit(False))
    if not heavy:
        return cold
    spark = df.sparkSession
    listed = F.broadcast(spark.createDataFrame([(h,) for h in heavy], "_heavy string"))
    hot = df.withColumn("_heavy", _packed(on)).join(listed, "_heavy").groupBy(*on).agg(*aggs).withColumn("is_heavy", F.lit(True))
    return hot.unionByName(cold)
