from datetime import datetime as D

from graphloom.operators import references as R

from .conftest import rows

A = "article_row bigint, pmid string, received_at timestamp, withdrawn_at timestamp"
E = "row_index bigint, edge_id string, supporting_pmids array<string>, loaded_at timestamp, retired_at timestamp"
Q = "record_id bigint, direct_edge_ids array<string>, created_at timestamp"


def t(d):
    return D(2024, 1, d)


def tables(spark):
    articles = spark.createDataFrame([(1, "PMID: 11", t(5), None), (2, " 11", t(3), None), (3, "12", t(1), t(4)), (4, "x", t(1), None), (5, None, None, None)], A)
    edges = spark.createDataFrame(
        [(1, "E_1", ["11", "pmid:12", "13", "13", "PMID:", "n/a", None], t(2), None), (2, "edge:E_2", ["12", "11"], t(4), t(6)), (3, "", None, None, None), (4, "E_3", ["11", "99"], None, None)], E
    )
    qa = spark.createDataFrame([(1, ["E_1", "edge_id:E_2", "E_9"], t(7)), (2, ["E_1"], t(1)), (3, None, t(1)), (4, ["E_3", "", "edge:"], None)], Q)
    return edges, qa, articles


EXPECTED = [
    ("kg_edges", 1, "11", "late"), ("kg_edges", 1, "13", "missing"), ("kg_edges", 2, "12", "deleted"), ("kg_edges", 4, "99", "missing"),
    ("qa_records", 1, "E_2", "deleted"), ("qa_records", 1, "E_9", "missing"), ("qa_records", 2, "E_1", "late"),
]


def test_cases(spark):
    assert rows(R.find_orphans(*tables(spark)).select("ref_table", "row_key", "ref_key", "reason")) == EXPECTED


def test_state_is_the_same_in_batches(spark):
    edges, qa, articles = tables(spark)
    d = R.reference_deltas(R.reference_rows(edges, qa)).unionByName(R.target_deltas(articles, edges))
    one = R.fold(d)
    two = R.fold(R.target_deltas(articles, edges), R.fold(R.reference_deltas(R.reference_rows(edges, qa))))
    assert rows(one) == rows(two.select(*one.columns))
    assert rows(R.current_orphans(one)) == [("articles", "12", 2, "deleted"), ("articles", "13", 1, "missing"), ("articles", "99", 1, "missing"), ("kg_edges", "E_2", 1, "deleted"), ("kg_edges", "E_9", 1, "missing")]


def test_report_and_empty(spark):
    edges, qa, articles = tables(spark)
    got = {(r["ref_table"], r["month"], r["reason"]): r["n_refs"] for r in R.orphan_report(R.find_orphans(edges, qa, articles)).collect()}
    assert got[("kg_edges", None, "missing")] == 1 and got[("kg_edges", "2024-01", "missing")] == 1
    assert R.find_orphans(edges.limit(0), qa.limit(0), articles.limit(0)).count() == 0
    assert R.find_orphans(edges.limit(0), qa, articles).where("reason = 'missing'").count() == 5


def _delta(key, refs=0, deliveries=0, deletions=0):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    return ("articles", key, refs, deliveries, deletions, at if deliveries else None, at if deletions else None, at if refs else None, at if refs else None)


def test_state_is_maintained_over_batches(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    batch = lambda rows_: spark.createDataFrame(rows_, R.STATE)
    now = lambda: sorted((r["ref_key"], r["refs"], r["reason"]) for r in R.current_orphans(R.current_state(spark, path)).collect())
    assert R.current_state(spark, path) is None
    R.apply_deltas(batch([_delta("1", refs=1), _delta("1", refs=1), _delta("2", refs=1), _delta("3", deliveries=1)]), 0, path)
    assert now() == [("1", 2, "missing"), ("2", 1, "missing")]
    R.apply_deltas(batch([_delta("1", deliveries=1), _delta("2", refs=-1), _delta("3", refs=1, deletions=1)]), 1, path)
    assert now() == [("3", 1, "deleted")]  # 1 has arrived, the reference to 2 is retracted, 3 is deleted
    R.apply_deltas(batch([_delta("1", deliveries=1)]), 1, path)  # delivered again: the batch is known
    R.apply_deltas(batch([_delta("3", deliveries=1), _delta("1", deliveries=1), _delta("1", deletions=1)]), 2, path)
    assert now() == []  # delivered again after the deletion; two deliveries less one deletion
    R.apply_deltas(batch([_delta("1", deletions=1)]), 3, path)
    assert now() == [("1", 2, "deleted")]
    assert R._versions(spark, path) == [2, 3]


def test_state_from_a_stream(spark, tmp_path):
    src, path = f"{tmp_path}/in", f"file://{tmp_path}/state"
    spark.createDataFrame([_delta("1", refs=1), _delta("2", refs=1)], R.STATE).write.parquet(src)
    stream = lambda: spark.readStream.schema(R.STATE).parquet(src)
    R.maintain_stream(stream(), path, f"{tmp_path}/ck")
    spark.createDataFrame([_delta("2", deliveries=1)], R.STATE).write.mode("append").parquet(src)
    R.maintain_stream(stream(), path, f"{tmp_path}/ck")
    assert [r["ref_key"] for r in R.current_orphans(R.current_state(spark, path)).collect()] == ["1"]
