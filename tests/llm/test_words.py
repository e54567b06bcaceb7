import re
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import text as T

WORD = re.compile(r"[^\W_]+")


def words(s):
    return WORD.findall(unicodedata.normalize("NFKC", s or "").lower())


TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab ÀÉß½²_-.\n日đ́", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_sets(xs):
    h, n = T.word_hashes(xs)
    assert n.tolist() == [len(words(x)) for x in xs] if xs else len(n) == 0
    seen = {}
    for v, w in zip(h.tolist(), [w for x in xs for w in words(x)]):
        assert seen.setdefault(w, v) == v
    assert len(set(seen.values())) == len(seen)
    if xs:
        g, doc, size = T.trigram_sets(xs)
        want = [set(zip(w, w[1:], w[2:])) for w in map(words, xs)]
        assert size.tolist() == [len(x) for x in want] and len(set(g.tolist())) == len(set().union(*want))
        a, b = T.sequence_hashes(h, n)
        keys = {}
        for x, y, z in zip(xs, a.tolist(), b.tolist()):
            assert keys.setdefault((y, z), words(x)) == words(x)
            assert (y, z) != (0, 0) or not words(x)


def test_body():
    assert T.body("Why?\nOptions: a") == "Why?" and T.body("Why?\n \tOPTIONS: a\nb") == "Why?"
    assert T.body("My options: none") == "My options: none" and T.body(None) == "" and T.body("options: x") == ""
    assert T.body("İ why\noptions: x") == "İ why"


def test_very_long_text():
    x = "word " * 500_000
    h, n = T.word_hashes([x, None, "word"])
    assert n.tolist() == [500_000, 0, 1] and len(np.unique(h)) == 1


def test_slices():
    assert list(T.slices([5, 5, 50, 1], 10)) == [(0, 2), (2, 3), (3, 4)] and list(T.slices([], 10)) == []
