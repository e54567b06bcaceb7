from graphloom.llm import near_duplicates as N
from graphloom.llm.text import body

from .data import SCHEMA, records, similarity, trigrams


def test_all_pairs(spark):
    rs = records(200, 3)
    df = spark.createDataFrame(rs, SCHEMA).repartition(5)
    sets = [(i, trigrams(f"{body(q)} {r or ''}")) for i, _, q, r, *_ in rs]
    for num, den in ((7, 10), (1, 2)):
        want = {(min(i, j), max(i, j)) for a, (i, s) in enumerate(sets) for j, t in sets[:a] if similarity(s, t) >= num / den}
        got = [tuple(r) for r in N.similar_pairs(df, num, den).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    links = {r["record_id"]: r for r in N.record_classes(df).collect()}
    assert set(links) == {i for i, s in sets if s}
    same = [i for i, s in sets if s == dict(sets)[1000]]
    assert {links[i]["class_id"] for i in same} == {min(same)} and links[1000]["n_copies"] == len(same)


def test_higher_levels_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "VERIFY_COST", 1e6)  # makes every record ask for many shared trigrams
    rs = records(120, 4)
    df = spark.createDataFrame(rs, SCHEMA)
    sets = [(i, trigrams(f"{body(q)} {r or ''}")) for i, _, q, r, *_ in rs]
    want = {(min(i, j), max(i, j)) for a, (i, s) in enumerate(sets) for j, t in sets[:a] if similarity(s, t) >= 0.7}
    assert {tuple(r) for r in N.similar_pairs(df).collect()} == want


def test_empty_and_null(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.similar_pairs(df).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "a b", None)], "record_id bigint, question string, reasoning string")
    assert N.similar_pairs(nulls).count() == 0 and N.record_classes(nulls).count() == 0


def test_every_record_has_a_class(spark):
    rs = [(1, None, None), (2, "", ""), (3, "a b", None), (4, "a b c d", None), (5, "a b c d", None)]
    got = N.document_classes(spark.createDataFrame(rs, "record_id bigint, question string, reasoning string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 1, 0), (2, 2, 1, 0), (3, 3, 1, 0), (4, 4, 2, 0), (5, 4, 2, 0)]


def test_split_postings_and_classes_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 3)  # every shared trigram is split into blocks
    monkeypatch.setattr(N, "COPIES", 3)
    monkeypatch.setattr(N, "PART_BYTES", 4000)
    rs = records(160, 6)
    df = spark.createDataFrame(rs, SCHEMA).repartition(3)
    sets = [(i, trigrams(f"{body(q)} {r or ''}")) for i, _, q, r, *_ in rs]
    want = {(min(i, j), max(i, j)) for a, (i, s) in enumerate(sets) for j, t in sets[:a] if similarity(s, t) >= 0.7}
    got = [tuple(r) for r in N.similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
