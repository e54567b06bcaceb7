import random

from graphloom.llm import truncation as T

S = "doc_id bigint, text string, source string, title string, ending string"


def corpus():
    r = random.Random(7)
    subj, verb = ["The panel", "One arm", "Each cohort", "The survey"], ["received", "reported", "confirmed", "tracked"]
    obj = ["mild tremor", "severe fatigue", "lower levels", "the result of the trial", "a signal in the morning"]
    sentence = lambda: f"{r.choice(subj)} {r.choice(verb)} {r.choice(obj)} after {r.randrange(2, 99)} days and {r.choice(verb)} {r.choice(obj)}."
    docs, cut = [], set()
    for i in range(600):
        t = " ".join(sentence() for _ in range(r.randrange(2, 9)))
        kind = i % 6
        if kind == 0:
            t += "\nNext review in 5 weeks"
        elif kind == 1:
            t = "Notes on " + r.choice(obj)
        elif kind == 2:
            t = "- stage ok, top tremor\n- stage ok, top fatigue\n- stage ok, top levels"
        elif kind == 3 and len(t) > 200:
            t, _ = t[:200], cut.add(i)
        elif kind == 4 and i % 12 == 4:
            t, _ = t[: r.randrange(30, 100)].rsplit(" ", 1)[0].rstrip(".") + " …", cut.add(i)
        docs.append((i, t, "limited" if kind == 3 else "free" if i % 2 else None, None, "x"))
    return docs, cut


def test_documents(spark):
    docs, cut = corpus()
    got = {r["doc_id"]: r for r in T.score_documents(spark.createDataFrame(docs, S)).collect()}
    found = {i for i, r in got.items() if r["cut"]}
    assert len(found & cut) / len(cut) > 0.95 and len(found & cut) / len(found) > 0.95
    assert any(r["limit_posterior"] > 0.9 for r in got.values() if r["source"] == "limited")
    share = {r["source"]: r["cut_share"] for r in T.cut_share(spark.createDataFrame(docs, S)).collect()}
    assert share["limited"] > 0.5 and None in share


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, None, None, "x"), (2, " \n", "s", None, "x"), (3, "word " * 200_000 + "end.", "s", None, "x"), (3, "Ended well.", "s", "t", "x")], S)
    assert sorted((r["doc_id"], r["cut"]) for r in T.score_documents(df).collect()) == [(2, False), (3, False), (3, False)]
    assert T.score_documents(df.limit(0)).count() == 0 and T.cut_share(df.limit(0)).count() == 0


def test_limits():
    r = random.Random(1)
    xs = [min(int(r.lognormvariate(5.5, 0.6)), 300) for _ in range(2000)]
    h = {x: xs.count(x) for x in set(xs)}
    assert [(c, p > 0.9) for c, p, _ in T.fit_limits(list(h), list(h.values()))] == [(300, True)]
    ys = [int(r.lognormvariate(5.5, 0.6)) for _ in range(2000)]
    h = {x: ys.count(x) for x in set(ys)}
    assert T.fit_limits(list(h), list(h.values())) == [] and T.fit_limits([], []) == []


def test_limits_far_up_and_rare():
    # a limit of 128 Ki characters, and a pile of 1 in 200 values of a large source
    r = random.Random(2)
    xs = [min(int(r.lognormvariate(11.3, 0.5)), 131072) for _ in range(3000)]
    h = {x: xs.count(x) for x in set(xs)}
    assert [(c, p > 0.9) for c, p, _ in T.fit_limits(list(h), list(h.values()))] == [(131072, True)]
    h = {}
    for _ in range(20_000):
        x = int(r.lognormvariate(7.5, 0.8))
        x = 4000 if 4000 < x and r.random() < 0.03 else x
        h[x] = h.get(x, 0) + 1
    assert [c for c, *_ in T.fit_limits(list(h), list(h.values()))] == [4000]


def test_fit_decides_where_endings_say_little(spark):
    """A source that steps back to a word's end: bare lines, like whole headlines; only the piled-up length tells."""
    r = random.Random(9)
    word = lambda: r.choice(["trial", "panel", "cohort", "survey", "dose", "tremor", "fatigue", "signal", "level", "region"])
    docs, cut = [], set()
    for i in range(900):
        t = " ".join(word() for _ in range(r.randrange(4, 16))).capitalize()
        if i % 3 == 0 and len(t) > 48:
            t = t[:49].rsplit(" ", 1)[0] if t[48:49] != " " else t[:48]
            if len(t) >= 38:
                cut.add(i)
        docs.append((i, t, "limited" if i % 3 == 0 else "free", None, "x"))
    got = {x["doc_id"]: x for x in T.score_documents(spark.createDataFrame(docs, S)).collect()}
    found = {i for i, x in got.items() if x["cut"]}
    assert len(found & cut) >= 0.8 * len(cut) and len(found - cut) <= 0.05 * len(docs)  # whole headlines of just that length
    assert sum(x["cut"] != x["cut_by_ending"] for x in got.values()) > 20


def test_whole_last_line_is_read():
    c = T.Tallies()
    kind = lambda x: T.ending(x, [y for z in x.splitlines() if (y := z.strip())], True, c)[0]
    assert kind("He said (" + "very " * 400 + "much") == "open"
    assert kind("It was read [" + "x" * 500 + "]") == "line" and kind("Done. [see " + "x" * 500 + "]") in ("stop", "reference")
    assert kind("The trial was s… ".strip()) == "mark" and kind("It ended. [more]") == "mark_after_stop" and kind("Read more") in ("mark", "mark_after_stop")
    assert kind("A word " + "z" * 400) == "line" and T.last_word("x " + "z" * 400 + ")") == "z" * 400
