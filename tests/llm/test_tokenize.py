import base64
import random

import pytest

from graphloom.llm import tokenize as K

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def pair():
    e = K.encoder(K.vocabulary_path())
    return e, tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


def test_encoding_and_round_trip(pair):
    e, t = pair
    r = random.Random(1)
    texts = ["", " ", "Hello  world\n\n x's", "<|endoftext|>", "日本語🙂 é\x00", "a" * 5000, "ab" * 3000, "".join(r.choice("abcdefgh") for _ in range(4000))]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0xD7FF), r.randrange(0x10000, 0x1FFFF)])) for _ in range(60)) for _ in range(50)]
    back = {v: k for k, v in e.ranks.items()}
    for x in texts:
        ids = e.encode(x)
        assert ids == t.encode_ordinary(x) and b"".join(back[i] for i in ids).decode() == x


def test_leftmost_lowest_rank():
    ranks = {bytes([c]): c for c in range(256)} | {b"aa": 300, b"aaa": 301}
    e = K.Encoder(ranks)
    assert e.piece(b"aaaaa") == [300, 301] and e.piece(b"aaaa") == [300, 300]


def test_table(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (None, "Hello", "x"), (3, "Hello world", "x")], "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"], r["ids"]) for r in K.encode_column(df, ["doc_id"]).collect()), key=repr)
    assert got == [(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995]), (None, [15496])]
    assert K.encode_column(df.limit(0), ["doc_id"]).count() == 0


def test_vocabulary_file(tmp_path):
    (tmp_path / "v").write_bytes(base64.b64encode(b"a") + b" 0\n\n")
    assert K.read_ranks(str(tmp_path / "v")) == {b"a": 0}
