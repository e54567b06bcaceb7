import numpy as np

from graphloom.llm import contamination as C
from graphloom.llm import text as T
from graphloom.llm.text import body

from .data import SCHEMA, records, similarity, trigrams
from .test_words import words


def evals(rs):
    kinds = ["train", " Test", "dev", "VALIDATION", None]
    return [(i, "d" if i % 2 else None, kinds[i % 5], q, None if i % 7 == 0 else f"answer {i % 3}", "clash") for i, _, q, *_ in rs]


ES = "eval_id bigint, dataset_name string, split string, question string, gold_answer string, shared string"


def brute(es, rs):
    train = lambda s: (s or "").strip().lower() == "train"
    full = lambda q, a: trigrams(f"{body(q)} {a or ''}")
    out = set()
    for i, _, s, q, a, _ in es:
        if not train(s):
            out |= {(i, "qa_records", r[0]) for r in rs if similarity(trigrams(body(q)), trigrams(body(r[2]))) >= 0.6}
            out |= {(i, "eval_examples", e[0]) for e in es if train(e[2]) and similarity(full(q, a), full(e[3], e[4])) >= 0.6}
    return out


def test_overlaps_in_one_and_many_shards(spark, monkeypatch):
    rs, es = records(120, 5), evals(records(90, 5))
    r, e = spark.createDataFrame(rs, SCHEMA), spark.createDataFrame(es, ES)
    want = brute(es, rs)
    assert len(want) > 50
    cols = ["eval_id", "train_table", "train_key"]
    assert sorted(tuple(x) for x in C.cross_split_overlaps(e, r).select(*cols).collect()) == sorted(want)
    monkeypatch.setattr(C, "SHARD_ROWS", 20)
    monkeypatch.setattr(C, "HELD_WORDS", 500)
    monkeypatch.setattr(C, "PASS_BYTES", 3000)
    got = C.cross_split_overlaps(e, r)
    assert sorted(tuple(x) for x in got.select(*cols).collect()) == sorted(want)
    monkeypatch.setattr(C, "_readable", lambda path: False)  # passes of broadcasts
    assert sorted(tuple(x) for x in C.cross_split_overlaps(e, r).select(*cols).collect()) == sorted(want)
    report = C.overlap_report(e, r).collect()
    assert sum(x["n_pairs"] for x in report) == len(want)
    assert C.cross_split_overlaps(e.limit(0), r).count() == 0 and C.cross_split_overlaps(e, r.limit(0)).where("train_table = 'qa_records'").count() == 0


def test_index_counts():
    texts = ["a b c a b c d", "", "x", "b c a b", "a b c"]
    ix = C.Index(C.Index.build(range(5), texts))
    h, _ = T.word_hashes(["a b c a b zz c d x b"])
    lo, hi = ix.trigram_intervals(ix.symbols(h))
    w = words("a b c a b zz c d x b")
    every = [tuple(words(t)[i : i + 3]) for t in texts for i in range(len(words(t)) - 2)]
    assert (hi - lo).tolist() == [every.count(tuple(w[i : i + 3])) for i in range(len(w) - 2)]
    where = {tuple(np.sort(ix.texts_of(np.arange(a, b)))) for a, b in zip(lo, hi) if b > a}
    assert (0, 0, 4) in where and (0, 3) in where
    for k, t in enumerate(texts):  # the index gives the texts back
        rows = ix.rows_of(k)
        assert [int(ix.vocabulary[np.searchsorted(ix.first, x, side="right") - 1 - ix.docs]) for x in rows] == T.word_hashes([t])[0].tolist()
        assert set(ix.texts_of(rows).tolist()) <= {k}


def test_maximal_matches_against_brute_force(monkeypatch):
    import random

    r = random.Random(4)
    for limit in (C.LOCATED, 0):  # also row by row
        monkeypatch.setattr(C, "LOCATED", limit)
        for _ in range(60):
            x, y = [[r.choice("abc") for _ in range(r.randrange(3, 25))] for _ in range(2)]
            ix = C.Index(C.Index.build([1, 2], ["a c b", " ".join(y)]))
            h, _ = T.word_hashes([" ".join(x)])
            lo, hi = ix.trigram_intervals(ix.symbols(h))
            p, t, n = ix.maximal_matches(lo, hi, ix.rows_of(1))
            want = {(i, j, k) for i in range(len(x)) for j in range(len(y)) if not (i and j and x[i - 1] == y[j - 1]) and (k := next((k for k in range(len(x) + 1) if i + k >= len(x) or j + k >= len(y) or x[i + k] != y[j + k]))) >= 3}
            assert set(zip(p.tolist(), t.tolist(), n.tolist())) == want


def test_spans():
    ix = C.Index(C.Index.build([7], ["one two three four five six seven eight"]))
    h, n = T.word_hashes(["one two three four five six seven nine"])
    (x,) = ix.partners(h, n, 3, 5)
    assert x[:2] == (0, 0) and x[2:] == (5, 7, 1, 7)
    # two passages that change places are two matches, not one
    ix = C.Index(C.Index.build([7], ["one two three four five six seven eight"]))
    h, n = T.word_hashes(["five six seven eight one two three four"])
    (x,) = ix.partners(h, n, 1, 5)
    assert x[2] == 4 and x[4:] == (2, 4)


def test_only_shards_with_a_partner_are_searched(spark, monkeypatch):
    rows = [(i, f"t{i} " + " ".join(f"v{i}x{k}" for k in range(12)), None) for i in range(400)]
    r = spark.createDataFrame(rows, "id bigint, q string, a string")
    e = r.where("id < 100").unionByName(r.where("id < 30").selectExpr("id + 1000 AS id", "q", "a"))  # with copies
    monkeypatch.setattr(C, "SHARD_ROWS", 5)
    monkeypatch.setattr(C, "GROUP", 3)
    work = C.Workspace(spark, "t")
    got = C.find_overlaps(e, r, False, work, by_file=True).collect()
    assert sorted((x.eval_id, x.train_key) for x in got) == sorted([(i, i) for i in range(100)] + [(i + 1000, i) for i in range(30)])
    texts, members = C._distinct(e, work)
    assert texts.count() == 100 and members.count() == 130
    path, shards = C.build_shards(texts, False, work)
    sent = C.routed_texts(texts, r, path, shards, False, work, 3, 5).collect()
    assert shards == 20 and sorted(x.id for x in sent) == list(range(100))  # not 400 texts in each of 20 shards


def test_no_partner_is_routed_past(monkeypatch):
    import random

    r = random.Random(11)
    for num, den in ((3, 5), (1, 5), (9, 10)):
        make = lambda: [r.choice("abcdefgh") for _ in range(r.randrange(0, 16))]
        ys = [make() for _ in range(150)]
        xs = [list(r.choice(ys)) for _ in range(150)]
        for x in xs:
            for _ in range(r.randrange(0, 4)):
                x.insert(r.randrange(len(x) + 1), r.choice("abcdefgh"))
        xs, ys = [" ".join(x) for x in xs], [" ".join(y) for y in ys]
        counts = np.zeros(C.CELLS, np.uint32)
        np.add.at(counts, (T.trigram_sets(ys)[0] & T.U(C.CELLS - 1)).astype(np.int64), 1)
        for limit in (2_000_000, 10):
            monkeypatch.setattr(C, "LOCATED", limit)
            g, doc, rank, n = C._rarest(ys, counts, num, den)
            post = C.Postings(C.Postings.build(np.arange(len(ys)), n, g, doc, C._furthest(n[doc], rank, num, den)))
            g, doc, rank, n = C._rarest(xs, counts, num, den)
            got = {(int(x), int(s)) for x, s in post.shards_of(g, doc, rank, n, num, den)}
            want = {(i, j) for i, x in enumerate(xs) for j, y in enumerate(ys) if similarity(trigrams(x), trigrams(y)) * den >= num - 1e-9}
            assert len(want) > 30 and want <= got and len(got) < len(xs) * len(ys) / 2


def test_texts_that_are_alike_are_searched_once():
    import pyarrow as pa

    ix = C.Index(C.Index.build([7, 8], ["one two three four five", "six seven eight nine"]))
    q = ["six seven eight nine", "one two three four five", "none", "six seven eight nine", None, "one two three four five"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(q, pa.string()), pa.nulls(6, pa.string())], ["id", "q", "a"])
    got = [t for b in C._search_once(rows, False, 3, 5, ix) for t in zip(b.column("eval_id").to_pylist(), b.column("train_key").to_pylist())]
    assert sorted(got) == [(7, 1), (7, 5), (8, 0), (8, 3)]
