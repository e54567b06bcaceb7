"""Words, trigrams and question bodies, computed for a whole batch of texts with array operations.

Words: NFKC, lower case, maximal runs of letters and digits.  A batch is one array of code points; word boundaries and
64-bit word hashes come from table look-ups and one running sum, so the cost is a few nanoseconds a character.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

U = np.uint64
_OPTIONS = re.compile(r"(?:^|\n|\r)[ \t]*options:")
_TABLES: dict[str, np.ndarray] = {}
_BASE = 0x9E3779B97F4A7C15
_M1, _M2, _M3 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), U(0x165667B19E3779F9)
#: Characters handled at once; bounds the memory of a batch.
CHUNK = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> U(33))
    x = x * _M1
    x = x ^ (x >> U(33))
    x = x * _M2
    return x ^ (x >> U(33))


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        n = 0x110000
        _TABLES["alnum"] = np.fromiter((chr(i).isalnum() for i in range(n)), bool, n)
        with np.errstate(over="ignore"):
            _TABLES["code"] = mix(np.arange(1, n + 1, dtype=U) * U(_BASE))
    return _TABLES


def _powers(n: int) -> np.ndarray:
    p = _TABLES.get("pow")
    if p is None or len(p) < n:
        size = max(n, CHUNK + 1)
        p = np.full(size, _BASE, U)
        p[0] = 1
        _TABLES["pow"] = p = np.cumprod(p, dtype=U)
        q = np.full(size, pow(_BASE, -1, 1 << 64), U)
        q[0] = 1
        _TABLES["inv"] = np.cumprod(q, dtype=U)
    return p


def body(question: str | None) -> str:
    """The text before the first line that begins, after spaces or tabs, with ``options:`` in any case."""
    if not question:
        return ""
    low = question.lower()
    at = low.find("options:")
    if at < 0:
        return question
    if len(low) != len(question):  # a letter that grows when lower-cased
        m = re.search(r"(?:^|\n|\r)[ \t]*options:", question, re.I)
        return question[: m.start()] if m else question
    m = _OPTIONS.search(low)
    return question[: m.start()] if m else question


def folded(text: str | None) -> str:
    """NFKC and lower case; null gives an empty text."""
    if not text:
        return ""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return text.lower()


def _chunk(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    t = _tables()
    joined = "\n".join(texts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    al = np.empty(len(cp) + 1, bool)
    al[0] = False
    np.take(t["alnum"], cp, out=al[1:])
    edge = np.flatnonzero(al[1:] != al[:-1])
    start, end = edge[0::2], edge[1::2]
    n = len(cp)
    with np.errstate(over="ignore"):
        pw = _powers(n + 1)
        run = np.empty(n + 1, U)
        run[0] = 0
        np.cumsum(t["code"][cp] * pw[:n], out=run[1:])
        h = mix((run[end] - run[start]) * _TABLES["inv"][start] + (end - start).astype(U) * _M3)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    stop = np.cumsum(lens)
    counts = np.diff(np.searchsorted(start, np.concatenate([[0], stop])))
    return h, counts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text) of whole texts."""
    if not texts:
        return np.empty(0, U), np.empty(0, np.int64)
    low = [folded(x) for x in texts]
    hs, cs, at, size = [], [], 0, 0
    for i, x in enumerate(low):
        size += len(x) + 1
        if size >= CHUNK or i == len(low) - 1:
            h, c = _chunk(low[at : i + 1])
            hs.append(h)
            cs.append(c)
            at, size = i + 1, 0
    return np.concatenate(hs), np.concatenate(cs)


def sequence_hashes(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's word sequence; texts without words have 0, 0."""
    out = []
    stop = np.cumsum(counts)
    first = stop - counts
    pos = np.arange(len(h)) - np.repeat(first, counts)
    with np.errstate(over="ignore"):
        for salt in (_M3, _M1):
            v = mix(h * salt + mix(pos.astype(U) * U(_BASE) + salt))
            run = np.concatenate([[U(0)], np.cumsum(v, dtype=U)])
            s = run[stop] - run[first]
            out.append(np.where(counts > 0, mix(s + counts.astype(U) * salt), U(0)))
    return out[0], out[1]


def trigrams(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of three words, index of its text), in order, with repeats."""
    if len(h) < 3:
        return np.empty(0, U), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    ok = doc[:-2] == doc[2:]
    with np.errstate(over="ignore"):
        g = mix(mix(h[:-2] * _M3 + U(1)) + h[1:-1] * _M1 + U(2))
        g = mix(g + h[2:] * _M2)
    return g[ok], doc[:-2][ok]


def trigram_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct trigram hashes, grouped by text and sorted; index of the text of each; set size of each text)."""
    h, counts = word_hashes(texts)
    g, doc = trigrams(h, counts)
    # one key of text and leading hash bits: a single integer sort
    o = np.argsort((doc.astype(U) << U(44)) | (g >> U(20))) if len(texts) < 1 << 20 else np.lexsort((g, doc))
    g, doc = g[o], doc[o]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[keep], doc[keep]
    return g, doc, np.bincount(doc, minlength=len(texts)).astype(np.int64)


def slices(weights: list[int], most: int = 2 * CHUNK):
    """(start, stop) of runs whose weights sum to at most ``most`` (or one item that is heavier)."""
    at, size = 0, 0
    for i, w in enumerate(weights):
        if size and size + w > most:
            yield at, i
            at, size = i, 0
        size += w
    if at < len(weights):
        yield at, len(weights)
