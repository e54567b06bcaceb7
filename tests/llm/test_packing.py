import random

from pyspark.sql import functions as F

from graphloom.llm import packing as P
from graphloom.llm import tokenize as K

SIZES = "pack_name string, capacity_tokens int"


def test_fill():
    r = random.Random(3)
    sizes = [r.randrange(0, 101) for _ in range(500)]
    boxes = P.fill(sizes, 100, lambda i: None)
    assert sorted(i for b in boxes for i in b) == list(range(500)) and all(sum(sizes[i] for i in b) <= 100 for b in boxes)
    assert sum(sizes) / (100 * len(boxes)) > 0.96
    assert P.fill([], 10, lambda i: None) == [] and P.fill([0, 0], 10, lambda i: None) == [[0, 1]]


def test_neighbours_come_first():
    import numpy as np

    near = np.array([0.0, 0.0, 5.0, 0.0])
    assert P.fill([60, 40, 30, 39], 100, lambda i: near)[0][:2] == [0, 2]


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ITEMS", 60)
    r = random.Random(4)
    docs = [(i, None if i % 50 == 0 else " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(i % 9) for _ in range(r.choice([0, 3, 20, 60, 400]))), "x") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_tokens string")
    sizes = spark.createDataFrame([("s", 64), ("m", 256), ("bad", None), ("m", 256)], SIZES)
    got = P.pack_documents(df, sizes).collect()
    enc = K.encoder(K.vocabulary_path())
    want = {i: len(enc.encode(t)) for i, t, _ in docs}
    for name, cap in (("s", 64), ("m", 256)):
        mine = [x for x in got if x["pack_name"] == name]
        boxes, total = {}, {}
        for x in mine:
            boxes[x["container_id"]] = boxes.get(x["container_id"], 0) + x["n_tokens"]
            total[x["doc_id"]] = total.get(x["doc_id"], 0) + x["n_tokens"]
            assert want[x["doc_id"]] > cap or x["piece"] == 0
            assert x["first_token"] == x["piece"] * cap
        assert total == want and max(boxes.values()) <= cap and len({(x["doc_id"], x["piece"]) for x in mine}) == len(mine)
        assert sum(boxes.values()) / (cap * len(boxes)) > 0.93
    assert {x["pack_name"] for x in got} == {"s", "m"}
    assert P.pack_documents(df.limit(0), sizes).count() == 0 and P.pack_documents(df, sizes.limit(0)).count() == 0


def test_every_row_is_placed_and_related_texts_meet(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_ITEMS", 50)
    r = random.Random(5)
    docs = []
    for i in range(400):
        topic = i % 20
        docs.append((None if i % 97 == 0 else i // 2, " ".join(f"t{topic}x{r.randrange(8)}" if r.random() < 0.6 else f"c{r.randrange(60)}" for _ in range(r.randrange(5, 40)))))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")  # ids repeat and some are null
    sizes = spark.createDataFrame([("m", 400)], SIZES)
    got = P.pack_documents(df, sizes).cache()
    assert sorted(-1 if x["doc_id"] is None else x["doc_id"] for x in got.collect()) == sorted(-1 if d[0] is None else d[0] for d in docs)
    assert got.count() == len(docs)
    unique = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(docs)], "doc_id bigint, text string")
    packed = P.pack_documents(unique, sizes)
    mixed = packed.withColumn("container_id", F.pmod(F.xxhash64("doc_id"), F.lit(packed.select("container_id").distinct().count())).cast("string"))
    one, two = (P.relatedness(unique, x).first()["related"] for x in (packed, mixed))
    assert one > two + 0.05
