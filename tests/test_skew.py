import pytest
from pyspark.sql import functions as F

from graphloom.operators import edge_keys, skew

from .conftest import rows


def skewed(spark, n=5000):
    # one key owns two thirds of the rows, the rest are spread, some are null
    return spark.range(n).select(F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 51 == 2, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"), F.col("id").alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_is_the_plain_join(spark, how):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("k5", 2), ("k5", 3), (None, 4)], "k string, w int")
    assert rows(skew.heavy_light_join(left, right, ["k"], how)) == rows(left.join(right, ["k"], how))


def test_join_salts_a_wide_heavy_side(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 2)
    left = skewed(spark, 600)
    right = spark.range(5).select(F.lit("hot").alias("k"), F.col("id").alias("w"))
    for how in ("inner", "left", "left_anti"):
        assert rows(skew.heavy_light_join(left, right, ["k"], how)) == rows(left.join(right, ["k"], how))


def test_aggregate_is_the_plain_aggregate(spark):
    df = skewed(spark)
    got = skew.heavy_light_aggregate(df, ["k"], {"n": F.count("*"), "m": F.avg("v")})
    assert rows(got.drop("is_heavy")) == rows(df.groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("m")))
    assert [r["k"] for r in got.where("is_heavy").collect()] == ["hot"]


def test_clashing_columns_are_refused_and_empty_sides_work(spark):
    left, empty = skewed(spark, 50), spark.createDataFrame([], "k string, w int")
    with pytest.raises(ValueError):
        skew.heavy_light_join(left, left, ["k"])
    assert skew.heavy_light_join(left, empty, ["k"]).count() == 0
    assert skew.heavy_light_join(left.limit(0), empty, ["k"], "left").count() == 0
    assert skew.heavy_keys(left.limit(0), ["k"]) == []


def test_edge_keys(spark):
    e = [("A ", "t", "r", 0.5)] * 10 + [("a", None, "r", None)] * 5 + [(" ", "x", "R", 1.0)] * 5
    df = spark.createDataFrame(e, "head string, tail string, relation string, source_reliability double").withColumn("field", F.lit("clash"))
    got = {(r["field"], r["key_value"]): (r["n_rows"], r["n_rated"], r["mean_reliability"]) for r in edge_keys.edge_key_stats(df).collect()}
    assert got == {("head", "a"): (15, 10, 0.5), ("tail", "t"): (10, 10, 0.5), ("tail", "x"): (5, 5, 1.0), ("relation", "r"): (20, 15, 10 / 15)}
    assert rows(edge_keys.heavy_edge_keys(df, 0.6)) == [("head", "a"), ("relation", "r")]
    assert edge_keys.heavy_edge_keys(df.limit(0)).count() == 0


def test_node_names(spark):
    e = spark.createDataFrame([(1, "N:a", "n:b"), (2, None, "zz")], "row_index bigint, head string, tail string")
    n = spark.createDataFrame([("n:a", "A"), ("n:b", "B2"), ("N:B ", "B1")], "node_id string, node_name string")
    assert rows(edge_keys.edges_with_node_names(e, n)) == [(1, "A", "B1"), (2, None, None)]


def test_heavy_keys_miss_none(spark):
    import random

    from pyspark.sql import functions as F

    from graphloom.operators.skew import heavy_keys

    r = random.Random(8)
    light = [f"l{r.randrange(6000)}" for _ in range(12_000)]
    for shares in ([0.33], [0.05, 0.02, 0.011], [0.012] * 20):
        keys = light + [f"h{i}" for i, s in enumerate(shares) for _ in range(int(s / (1 - sum(shares)) * len(light)) + 2)]
        r.shuffle(keys)
        df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(7)
        got = heavy_keys(df, ["k"], 0.01)
        true = {x["k"] for x in df.groupBy("k").count().where(F.col("count") >= 0.01 * len(keys)).collect()}
        assert true <= set(got) and len(got) <= 200 and len(true) == len(shares)
    two = spark.createDataFrame([("a", 1)] * 60 + [("a", None)] * 60 + [("b", i) for i in range(40)], "x string, y int")
    assert heavy_keys(two, ["x", "y"], 0.3) == ["1:a1:1"]


def test_hub_on_the_right(spark, monkeypatch):
    from graphloom.operators import skew

    from .conftest import rows

    monkeypatch.setattr(skew, "BROADCAST_ROWS", 50)
    left = spark.createDataFrame([(i, "hub" if i < 3 else f"n{i}") for i in range(40)], "i int, k string")
    right = spark.createDataFrame([("hub", j) for j in range(200)] + [(f"n{j}", j) for j in range(60)], "k string, j int")
    got = skew.heavy_light_join(left, right, ["k"], heavy=["hub"])
    assert rows(got.select("k", "i", "j")) == rows(left.join(right, "k").select("k", "i", "j"))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)  # neither side may be broadcast: salted
    assert rows(skew.heavy_light_join(left, right, ["k"], heavy=["hub"]).select("k", "i", "j")) == rows(left.join(right, "k").select("k", "i", "j"))
