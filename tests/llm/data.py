"""Small records with copies, edits, nulls and clashing column names."""

import random

from .test_words import words

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "record_id bigint, group_id string, question string, reasoning string, answer string, options array<string>, cls bigint, g string, comp string, n int, k int, text string"


def edited(r, w):
    w = list(w)
    for _ in range(r.randrange(0, 4)):
        i = r.randrange(len(w))
        w[i : i + r.randrange(0, 2)] = [r.choice(WORDS)] * r.randrange(0, 2)
    return w


def records(n=160, seed=1):
    r = random.Random(seed)
    base = [[r.choice(WORDS) for _ in range(r.randrange(20, 50))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        q = " ".join(edited(r, r.choice(base))) if r.random() < 0.8 else r.choice([None, "", "  ", "a b", "Ça va bien?"])
        a = None if r.random() < 0.2 else " ".join(edited(r, r.choice(base)[:20])) if r.random() < 0.3 else ""
        g = r.choice(["hot", " HOT ", "hot", f"g{i % 40}", None, "n/a", "Unknown", " "])
        out.append((i, g, (q + "\nOptions: x" if q and r.random() < 0.3 else q), a, None, None, 1, "x", "y", 2, 3, "z"))
    out += [(1000 + i, *out[5][1:]) for i in range(12)]  # exact copies
    return out


def trigrams(s):
    w = words(s)
    return frozenset(zip(w, w[1:], w[2:]))


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0
