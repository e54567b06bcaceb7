"""Questions answered within tasks over a graph of numbers give what the joins give, and write no row a question and edge."""

import pytest

import __spark_entry__ as entry
from graphloom.operators import compact
from graphloom.workspace import Workspace

from .conftest import rows

DATA = "/root/testdata/sf0.001"
#: Tables with a row for each question and candidate edge or node, as the joins write them.
WIDE = {"hop1", "stage1", "stage2", "stage3", "found", "whole", "nodes", "weights"}


def _both(spark, monkeypatch, name):
    labels = []
    keep = Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df, label="t": (labels.append(label), keep(self, df, label))[1])
    got = rows(entry.queries()[name](spark, DATA))
    assert not WIDE & set(labels)
    monkeypatch.setattr(compact, "MOST_EDGES", -1)
    assert got == rows(entry.queries()[name](spark, DATA)) and got


def test_two_hop_counts(spark, monkeypatch):
    _both(spark, monkeypatch, "two_hop_counts")


def test_relation_fallback(spark, monkeypatch):
    _both(spark, monkeypatch, "relation_fallback")


def test_filter_benchmark(spark, monkeypatch):
    _both(spark, monkeypatch, "filter_benchmark")


def test_two_hop(spark, monkeypatch):
    _both(spark, monkeypatch, "two_hop")


def test_two_hop_in_many_groups_and_blocks(spark, monkeypatch):
    # groups of a question or none, and tasks that begin within a group
    monkeypatch.setattr(compact, "BIT_BYTES", 100)
    monkeypatch.setattr(compact, "TASK_PAIRS", 3_000)
    _both(spark, monkeypatch, "two_hop")


def test_two_hop_writes_few_bytes_a_row(spark, tmp_path):
    # a question lists half of the graph, so a row must not hold its edge id (7 bytes a row, 100 GB at 0.1 GB of input)
    entry.queries()["two_hop"](spark, "/root/testdata/sf0.01").write.parquet(str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 2 * written.count() and written.count() > 500_000


def test_edge_topk(spark, monkeypatch):
    _both(spark, monkeypatch, "edge_topk")


def test_personalized_pagerank(spark, monkeypatch):
    _both(spark, monkeypatch, "personalized_pagerank")


def test_reach_by_bits_and_by_rows_agree():
    np = pytest.importorskip("numpy")
    r = np.random.default_rng(5)
    for m in (0, 1, 40, 300):
        h, t = r.integers(0, 30, m), r.integers(0, 30, m)
        side = compact.Side(30, h, t, np.arange(m))
        for seeds in ([], [3], [1, 2, 29]):
            s = np.array(seeds, np.int64)
            fast, side.bits = side.reach(s), None
            slow = side.reach(s)
            side = compact.Side(30, h, t, np.arange(m))
            near = set(seeds) | {b for a, b in zip(h, t) if a in seeds} | {a for a, b in zip(h, t) if b in seeds}
            ends = near | {b for a, b in zip(h, t) if a in near} | {a for a, b in zip(h, t) if b in near}
            want = (near, ends, sum(a in seeds or b in seeds for a, b in zip(h, t)), sum(a in near or b in near for a, b in zip(h, t)))
            for x in (fast, slow):
                assert (set(np.flatnonzero(x[0])), set(np.flatnonzero(x[1])), *x[2:]) == want


def test_best_edges_with_and_without_pruning():
    np = pytest.importorskip("numpy")
    r, n, m = np.random.default_rng(6), 25, 400
    g = object.__new__(compact.Graph)
    g.n, g.h, g.t, g.reliability = n, r.integers(0, n, m), r.integers(0, n, m), np.sort(r.choice([0.4, 0.7, 0.9], m))[::-1].copy()
    g.most = 0.9
    side = compact.Side(n, g.h, g.t, np.arange(m))
    s = np.round(r.dirichlet(np.full(n, 0.1)), 9)
    for seeds in (np.array([2]), np.array([4, 7, 11])):
        a = side.reach(seeds)[0]
        found = [e for e in range(m) if a[g.h[e]] or a[g.t[e]]]
        value = {e: compact._rounded(np.array([0.45 * s[g.h[e]] + 0.45 * s[g.t[e]] + 0.1 * g.reliability[e] + (0.05 if g.h[e] in seeds or g.t[e] in seeds else 0.0)]), 8)[0] for e in found}
        want = sorted(found, key=lambda e: (-value[e], e))
        for most in (5, 20, 1000):
            e, v = g.best(side, a, seeds, s, most)
            assert e.tolist() == want[:most] and v.tolist() == [value[x] for x in want[:most]]


def test_rounding_is_half_up_by_the_shortest_decimal():
    np = pytest.importorskip("numpy")
    assert compact._rounded(np.array([0.123456785, 0.05555555505, 0.1, 0.000000005]), 8).tolist() == [0.12345679, 0.05555556, 0.1, 0.00000001]


def test_filled_labels_are_not_broadcast(spark):
    # their files are so small that Spark takes the filled rows for small enough to send to the driver
    for name in ("training_label_stats", "label_accuracies"):
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
