import random

import pytest

from graphloom.llm import pairs as P

Q = "A 63-year-old cook with chronic oma has taken zortamitide 20 mg for 5 weeks and now reports skin mottling. Which drug is most likely to have caused the mottling?\nOptions: A. zortamitide B. QNM100"
DE = "Eine 63-jährige Person mit oma nimmt seit 5 Wochen zortamitide und berichtet über einen Ausschlag. Welche Dosis ist bei dieser Person die richtige?"


@pytest.mark.parametrize(
    ("q", "a", "want"),
    [
        (Q, None, "empty"), (Q, " ​", "empty"), (Q, "<p></p>", "empty"), (Q, "#N/A", "empty"), (Q, "Answer:", "empty"), (Q, "...", "empty"),
        (Q, "No", None), (Q, "B", None), (Q, "(A) zortamitide", None), (Q, "QNM100", None), (Q, "pebmoroxol 150 mg", None), (Q, "Yes.", None),
        (Q, "You ask: " + Q.split("\n")[0].upper(), "copy"), (Q, Q, "copy"), (Q, (Q.split("\n")[0] + " ") * 2, "copy"),
        (Q, "I can’t assist with that request.", "refusal"), (Q, "Xin lỗi, tôi không thể đưa ra lời khuyên y khoa về zortamitide.", "refusal"),
        (Q, "I cannot rule out oma, but mottling makes zortamitide toxicity more likely.", None), (Q, "Smokers often refuse zortamitide; QNM100 at 5 mg is the usual alternative.", None),
        (Q, "Die Gruppe unter zortamitide berichtete über Ausschlag, während die Vergleichsgruppe meist beschwerdefrei blieb.", "other_language"),
        (DE, "Die Gruppe unter zortamitide berichtete über Ausschlag, während die Vergleichsgruppe meist beschwerdefrei blieb.", None),
        (DE, "oma of the newborn", None), (DE, "The reviewers did not find that the drug had been stopped, which was unexpected for those who were there.", "other_language"),
        (Q, "Dosing of zortamitide above 40 mg is contraindicated when oma and skin mott", "truncated"), (Q, "Zortamitide was stopped by the reviewers, and mottling was…", "truncated"),
        (Q, "Zortamitide was stopped by the reviewers, and the mottling went away. [PMID:12345]", None), (Q, "Zortamitide was stopped by the reviewers and mottling went [PMID:1", "truncated"),
    ],
)
def test_answers(q, a, want):
    got = P.judge(q, a, None, ["zortamitide", "QNM100"])
    assert (got and got[1]) == want


def test_reasoning():
    ok = '[{"claim_text": "Zortamitide causes mottling.", "premise_edge_ids": ["E_1"]}]'
    assert P.judge(Q, "B", ok, None) is None and P.judge(Q, "B", ok[:40], None) == ("reasoning", "truncated")
    assert P.judge(Q, "B", None, None) is None and P.judge(Q, "B", " ", None) is None
    assert P.judge(Q, "B", Q.split("\n")[0], None) == ("reasoning", "copy")
    assert P.judge(None, "B", "Request declined: content is restricted.", None) == ("reasoning", "refusal")


def test_automaton_against_brute_force():
    r = random.Random(2)
    for _ in range(200):
        a, b = [r.choice("abc") for _ in range(r.randrange(12))], [r.choice("abcd") for _ in range(r.randrange(12))]
        subs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        hit = {k for i in range(len(b)) for j in range(i + 2, len(b) + 1) if tuple(b[i:j]) in subs for k in range(i, j)}
        assert P.SuffixAutomaton(a).covered(b, 2) == len(hit)


def test_table(spark):
    schema = "record_id bigint, question string, answer string, reasoning string, options array<string>, field string, dataset_name string"
    df = spark.createDataFrame([(1, Q, None, None, None, "x", "d"), (2, Q, "B", None, [None, "x"], "x", None), (3, None, "I must decline to answer.", None, None, "x", "d"), (4, "x " * 40_000, "y " * 40_000 + "end.", None, None, "x", "d")], schema)
    assert sorted(tuple(r) for r in P.broken_pairs(df).collect()) == [(1, "answer", "empty"), (3, "answer", "refusal")]
    assert P.broken_pairs(df.limit(0)).count() == 0 and P.defect_counts(df).count() == 2
