"""Byte-level BPE encoding with a public vocabulary.

A piece (a match of the split pattern) starts as bytes.  A segment tree over its adjacent pairs holds each pair's rank;
its root is the leftmost pair of lowest rank.  A merge updates at most three leaves in logarithmic time, so a piece of
n bytes takes O(n log n) however long it is.  Pieces repeat, so each worker remembers those it has seen.
"""

from __future__ import annotations

import base64
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import spread

FOLDER = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The vocabulary's split pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers; at the limit it forgets all and goes on.
REMEMBERED = 400_000
_NONE = 1 << 62
_LOADED: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: a line holds base64 of the bytes and the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """ids of whole texts; null and empty texts have none."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, data: bytes) -> list[int]:
        """ids of one piece, by merging the leftmost pair of lowest rank until no pair has a rank."""
        rank = self.ranks.get
        whole = rank(data)
        if whole is not None:
            return [whole]
        n = len(data)
        size = 1
        while size < n:
            size *= 2
        # leaf i: rank of the pair that starts at token i, with i in the low bits so that ties fall to the left
        shift = size.bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            r = rank(data[i : i + 2])
            if r is not None:
                tree[size + i] = r << shift | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        end = list(range(1, n + 1))  # where the token that starts here ends
        before = list(range(-1, n))  # where the token before starts

        def put(i: int) -> None:
            j = end[i]
            r = rank(data[i : end[j]]) if j < n else None
            k = size + i
            tree[k] = _NONE if r is None else r << shift | i
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                v = a if a < b else b
                if tree[k] == v:
                    break
                tree[k] = v
                k >>= 1

        mask = (1 << shift) - 1
        while tree[1] != _NONE:
            i = tree[1] & mask
            j = end[i]
            end[i] = end[j]
            if end[i] < n:
                before[end[i]] = i
            tree[size + j] = _NONE
            k = (size + j) >> 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b
                k >>= 1
            put(i)
            if i:
                put(before[i])
        out, i = [], 0
        while i < n:
            out.append(rank(data[i : end[i]]))
            i = end[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for p in self.find(text):
            ids = known.get(p)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[p] = tuple(self.piece(p.encode("utf-8", "surrogatepass")))
            out += ids
        return out


def encoder(path: str) -> Encoder:
    """The process's encoder of a vocabulary file, read once."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(read_ranks(path))
    return _LOADED[path]


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(folder or FOLDER, name)


def encode_column(df: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` and ids (array<int>) of ``text``: one row for each row; an empty list for an empty or null text.

    Special tokens have no meaning: their spelling in a text is ordinary text.
    """
    path = path or vocabulary_path()
    src = spread(df.select(*keep, F.col(text).cast("string").alias("_text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", ids array<int>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encode = encoder(path).encode
        for b in batches:
            texts = b.column("_text")
            step = 512
            for i in range(0, b.num_rows, step):
                part = texts.slice(i, step).to_pylist()
                off, flat = np.zeros(len(part) + 1, np.int64), []
                for j, x in enumerate(part):
                    flat += encode(x)
                    off[j + 1] = len(flat)
                ids = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.array(flat, np.int32)))
                cols = [c.slice(i, step) for k, c in enumerate(b.columns) if b.schema.names[k] != "_text"]
                yield pa.RecordBatch.from_arrays([*cols, ids], [*keep, "ids"])

    return src.mapInArrow(run, schema)
