from graphloom.llm import splits
from graphloom.llm.text import body
from graphloom.workspace import Workspace

from .data import SCHEMA, records
from .test_words import words


def brute(rs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, g, q, *_ in rs:
        find(("r", i))
        g = (g or "").strip().lower()
        for key in ([("g", g)] if g and g not in splits.ABSENT else []) + ([("q", tuple(words(body(q))))] if words(body(q)) else []):
            parent[find(key)] = find(("r", i))
    blocks = {}
    for x in list(parent):
        blocks.setdefault(find(x), []).append(x)
    out = set()
    for v in blocks.values():
        ids = [x[1] for x in v if x[0] == "r"]
        if len(ids) > 1:
            gs = [x[1] for x in v if x[0] == "g"]
            out |= {(i, min(gs) if gs else str(min(ids))) for i in ids}
    return out


def test_blocks_and_splits(spark):
    rs = records()
    df = spark.createDataFrame(rs, SCHEMA)
    want = brute(rs)
    assert {tuple(r) for r in splits.related_records(df).collect()} == want
    got = splits.grouped_splits(df).collect()
    assert len(got) == len(rs) and {r["split"] for r in got} <= {"train", "validation", "test"}
    of = {r["record_id"]: r["split"] for r in got}
    by = {}
    for i, b in want:
        by.setdefault(b, set()).add(of[i])
    assert all(len(v) == 1 for v in by.values())


def test_shares(spark):
    n = 6000
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"g{i // 3}", f"question number {i} is this") for i in range(n)], "record_id bigint, group_id string, question string")
    c = {r["split"]: r["count"] / n for r in splits.grouped_splits(df).groupBy("split").count().collect()}
    assert abs(c["train"] - 0.9) < 0.02 and abs(c["validation"] - 0.05) < 0.012 and abs(c["test"] - 0.05) < 0.012


def test_components_on_chains_and_stars(spark):
    edges = [(f"a{i:03}", f"a{i + 1:03}") for i in range(40)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x"), (None, "y"), ("p", "q"), ("q", "p")]
    got = {r["node"]: r["root"] for r in splits.components(spark.createDataFrame(edges, "u string, v string"), Workspace(spark, "t")).collect()}
    assert {got[f"a{i:03}"] for i in range(41)} == {"a000"} and {got[f"s{i}"] for i in range(50)} == {"hub"} and got["q"] == "p" and "x" not in got


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert splits.related_records(df).count() == 0 and splits.grouped_splits(df).count() == 0


def test_large_blocks_go_where_there_is_room():
    shares = splits.SHARES
    out, room = splits.place_large([("a", 300, 0.5), ("b", 40, 0.92), ("c", 20, 0.93), ("d", 600, 0.97)], 1000, shares)
    # b fits into validation by its hash, c finds it full, d is larger than any split has room for but the first
    assert out == {"a": "train", "b": "validation", "c": "train", "d": "train"} and room == {"train": 0.0, "validation": 10.0, "test": 50.0}
    assert splits.place_large([], 1000, shares)[1] == {"train": 900.0, "validation": 50.0, "test": 50.0}
