"""The same or nearly the same record in an evaluation split and in training data.

The evaluation texts are cut into shards of fixed size; each shard is a compressed full-text index, a self-index over
the words of its texts: the successor array of their suffixes (the inverse of the Burrows-Wheeler transform's
last-to-first mapping), which rises within each word and is stored as its differences, and the text numbers of every
eighth suffix.  No text is kept beside it.

A training text meets only the shards where it may have a partner.  Trigrams are ordered from rare to frequent, by counts
kept in a sketch of fixed size (any order is right).  Of two similar texts each has, among so many of its rarest trigrams
as the two may differ in and a few more, those few in common; the rarest trigrams of the evaluation texts are postings,
in tables of a few shards, and a training text goes to the shard of every evaluation text with which it has enough in
common at ranks and sizes that similar texts can have.  This only leaves out shards without a partner.  Evaluation rows
of the same text are one text of the index, and training rows of the same text that meet in a task are searched once.

There training texts go through backward search: every trigram gets the interval of evaluation suffixes that begin with
it.  A training text that has too many trigrams without any occurrence
has no partner and ends there.  Of the others, the rarest trigrams, a few more than a partner may lack, are located;
for an evaluation text that is found often enough for its length, the words' suffixes are read off the index and all
occurrences are extended to maximal matches; the matches are merged into spans, and the trigrams in them are the
trigrams that both texts share.  No partner is lost and none is capped.

Tasks read the shards and the postings from the shared folder, one at a time, so neither is at the driver nor broadcast.
"""

from __future__ import annotations

import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import key
from ..operators.skew import heavy_light_join
from ..workspace import Workspace, spread

#: Evaluation rows of a shard; bounds the index that a worker holds.
SHARD_ROWS = 20_000
#: Shards whose postings are one table; bounds the postings that a worker holds.
GROUP = 8
#: Cells of the sketch of trigram counts, 4 bytes each.
CELLS = 1 << 22
#: Rare trigrams that two texts must share before one is sent to the other's shard.
AGREED = 6
#: Tasks over which the training texts of a shard are dealt.
SALTS = 8
#: Words of training texts that a task holds while the postings, or the shards, pass by.
HELD_WORDS = 4_000_000
#: Where workers cannot read the shared folder themselves: bytes of shards that one pass may broadcast.
PASS_BYTES = 32_000_000
NUM, DEN = 3, 5
#: Trigrams beyond the least number that are located for each text; as many must be shared before texts are compared.
LEVELS = 6
#: Suffixes that are located at once, and occurrences of a pair beyond which they are extended row by row.
LOCATED = 2_000_000
#: Every so many words a suffix has its text number stored.
SAMPLED = 8


class Index:
    """Backward search, location and extraction over the word sequences of a shard's texts."""

    @staticmethod
    def build(ids, texts: list[str], sizes=None) -> bytes:
        import numpy as np
        import zstandard

        from . import text as T

        h, counts = T.word_hashes(texts)
        vocabulary, word = np.unique(h, return_inverse=True)
        docs = len(texts)
        # text k is followed by its own separator k, so that no match runs on and all suffixes differ
        seq = np.insert(word.astype(np.int64) + docs, np.cumsum(counts), np.arange(docs))
        n = len(seq)
        rank, step = seq.copy(), 1
        while n:
            second = np.zeros(n, np.int64)
            second[: max(n - step, 0)] = rank[step:] + 1
            both = rank * (max(n, docs + len(vocabulary)) + 2) + second
            order = np.argsort(both, kind="stable")
            new = np.ones(n, np.int64)
            new[0] = 0
            new[1:] = both[order][1:] != both[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == n - 1 or step >= n:
                break
            step *= 2
        order = order if n else np.zeros(0, np.int64)
        psi = rank[(order + 1) % max(n, 1)]
        ends = np.flatnonzero(seq < docs)
        doc = np.searchsorted(ends, order)
        first_of = np.concatenate([[0], ends[:-1] + 1]) if docs else ends
        sampled = np.flatnonzero((order - first_of[doc]) % SAMPLED == 0) if n else np.zeros(0, np.int64)
        sizes = T.trigram_sets(texts)[2] if sizes is None else sizes
        buf = io.BytesIO()
        np.savez(
            buf, ids=np.asarray(ids, np.int64), vocabulary=vocabulary, lengths=counts.astype(np.int32), sizes=sizes.astype(np.int32), tally=np.bincount(seq, minlength=docs + len(vocabulary)).astype(np.int32),
            steps=np.diff(psi, prepend=0).astype(np.int32), rows=np.diff(sampled, prepend=0).astype(np.int32), texts=doc[sampled].astype(np.int32),
        )
        return zstandard.ZstdCompressor(level=3).compress(buf.getvalue())

    def __init__(self, blob: bytes):
        import numpy as np
        import zstandard

        z = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(blob)))
        self.ids, self.vocabulary, self.lengths, self.sizes = z["ids"], z["vocabulary"], z["lengths"].astype(np.int64), z["sizes"]
        self.first = np.concatenate([[0], np.cumsum(z["tally"], dtype=np.int64)])
        self.psi = np.cumsum(z["steps"], dtype=np.int32)
        self.docs, self.n = len(self.ids), len(self.psi)
        # a bit for each suffix whose text is stored, and the number of such bits before each word of 64
        bits = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        bits[np.cumsum(z["rows"], dtype=np.int32)] = len(z["rows"]) > 0
        self.bits = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.cumsum(np.bitwise_count(self.bits), dtype=np.int32) - np.bitwise_count(self.bits)
        self.sampled_text = z["texts"]

    def symbols(self, hashes):
        """Symbol of each word, -1 if no text of the shard has it."""
        import numpy as np

        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        k = np.searchsorted(self.vocabulary, hashes)
        k[k == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[k] == hashes, k + self.docs, -1)

    def _rank(self, c, row):
        """The first suffix of symbol c whose successor is not before ``row``: a binary search in c's rising run."""
        import numpy as np

        lo, hi = self.first[c], self.first[c + 1]
        size = int((hi - lo).max()) if len(c) else 0
        for _ in range(size.bit_length()):
            mid = (lo + hi) >> 1
            less = (lo < hi) & (self.psi[np.minimum(mid, self.n - 1)] < row)
            hi = np.where(less | (lo >= hi), hi, mid)
            lo = np.where(less, mid + 1, lo)
        return lo

    def back(self, c, lo, hi):
        """The interval of the suffixes that are c followed by what [lo, hi) begin with."""
        return self._rank(c, lo), self._rank(c, hi)

    def trigram_intervals(self, s):
        """[lo, hi) of the suffixes that begin with each run of three symbols; empty where one is unknown."""
        import numpy as np

        m = max(len(s) - 2, 0)
        lo, hi = np.zeros(m, np.int64), np.zeros(m, np.int64)
        if not m or not self.n:
            return lo, hi
        at = np.flatnonzero((s[:-2] >= 0) & (s[1:-1] >= 0) & (s[2:] >= 0))
        a, b, c = s[at], s[at + 1], s[at + 2]
        # each distinct pair and triple is searched once, in sorted order
        pairs, inv = np.unique((b << 32) | c, return_inverse=True)
        pb, pc = pairs >> 32, pairs & 0xFFFFFFFF
        l2, h2 = self.back(pb, self.first[pc], self.first[pc + 1])
        some = (h2 > l2)[inv]
        at, a, inv = at[some], a[some], inv[some]
        triples, inv3 = np.unique(a * max(len(pairs), 1) + inv, return_inverse=True)
        ta, tp = triples // max(len(pairs), 1), triples % max(len(pairs), 1)
        l3, h3 = self.back(ta, l2[tp], h2[tp])
        lo[at], hi[at] = l3[inv3], h3[inv3]
        return lo, hi

    def texts_of(self, rows):
        """Text number of each suffix: successors are followed until one is sampled or a text's end."""
        import numpy as np

        out, at, row = np.empty(len(rows), np.int64), np.arange(len(rows)), np.asarray(rows, np.int64)
        while len(row):
            word, bit = self.bits[row >> 6], np.uint64(1) << (row & 63).astype(np.uint64)
            known, end = (word & bit) != 0, row < self.docs
            k = self.before[row[known] >> 6] + np.bitwise_count(word[known] & (bit[known] - np.uint64(1)))
            out[at[known]] = self.sampled_text[k]
            out[at[end]] = row[end]
            go = ~(known | end)
            at, row = at[go], self.psi[row[go]].astype(np.int64)
        return out

    def rows_of(self, text: int):
        """The suffixes of a text's words, in order, read off the index."""
        import numpy as np

        row, out = int(self.psi[text - 1 if text else self.docs - 1]), np.empty(int(self.lengths[text]), np.int64)
        for t in range(len(out)):
            out[t] = row
            row = int(self.psi[row])
        return out

    def maximal_matches(self, lo, hi, rows):
        """(start in x, start in y, length in words) of all maximal matches of at least three words of texts x and y.

        [lo, hi) are x's trigram intervals, ``rows`` the suffixes of y's words.  An occurrence that continues another is
        not a match of its own.
        """
        import numpy as np

        order = np.argsort(rows)
        a, b = np.searchsorted(rows[order], lo), np.searchsorted(rows[order], hi)
        n = np.where(hi > lo, b - a, 0)
        if n.sum() > LOCATED:
            return self._matches_by_row(a, n, order, len(rows))
        p = np.repeat(np.arange(len(lo)), n)
        t = order[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        o = np.lexsort((p, p - t))
        p, t = p[o], t[o]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] - t[1:] != p[:-1] - t[:-1]) | (p[1:] != p[:-1] + 1)
        at = np.flatnonzero(new)
        return p[at], t[at], np.diff(np.append(at, len(p))) + 2

    @staticmethod
    def _matches_by_row(a, n, order, size):
        """The same for texts that repeat themselves so often that their occurrences are not held at once."""
        import numpy as np

        run, out = np.zeros(size + 1, np.int64), []
        for p in range(len(n) + 1):
            now = np.zeros(size + 1, np.int64)
            if p < len(n) and n[p]:
                t = order[a[p] : a[p] + n[p]]
                now[t + 1] = run[t] + 1
            over = np.flatnonzero((run > 0) & np.append(now[1:] == 0, True))
            out.append(np.stack([p - run[over], over - run[over], run[over] + 2], axis=1))
            run = now
        m = np.concatenate(out)
        return m[:, 0], m[:, 1], m[:, 2]

    def partners(self, hashes, counts, num: int, den: int):
        """(text number, shard text, shared, union, spans, longest match) of all pairs of similarity num/den or more."""
        import numpy as np

        from . import text as T

        out = []
        g, gdoc = T.trigrams(hashes, counts)
        if not len(g) or not self.n:
            return out
        pos = np.flatnonzero((d := np.repeat(np.arange(len(counts)), counts))[:-2] == d[2:])
        lo, hi = self.trigram_intervals(self.symbols(hashes))
        lo, hi = lo[pos], hi[pos]
        o = np.argsort((gdoc.astype(T.U) << T.U(44)) | (g >> T.U(20))) if len(counts) < 1 << 20 else np.lexsort((g, gdoc))
        keep = np.ones(len(o), bool)
        keep[1:] = (g[o][1:] != g[o][:-1]) | (gdoc[o][1:] != gdoc[o][:-1])
        rep = o[keep]  # one position for each distinct trigram of a text
        rdoc, rcount = gdoc[rep], hi[rep] - lo[rep]
        size = np.bincount(rdoc, minlength=len(counts))
        lacking = np.bincount(rdoc[rcount == 0], minlength=len(counts))
        may_lack = size - (num * size + den - 1) // den
        alive = (size > 0) & (lacking <= may_lack)
        levels = np.minimum(LEVELS, size - may_lack)  # what any partner shares is at least this
        # the rarest trigrams of each text that is left: of these, a partner has at least ``levels``
        r = rep[alive[rdoc] & (rcount > 0)]
        rd, rc = gdoc[r], hi[r] - lo[r]
        o = np.lexsort((rc, rd))
        r, rd, rc = r[o], rd[o], rc[o]
        nth = np.arange(len(r)) - np.searchsorted(rd, rd)
        use = nth < (may_lack + levels - lacking)[rd]
        r, rd, rc = r[use], rd[use], rc[use]
        taken = np.bincount(rd, minlength=len(counts))
        run = np.concatenate([[0], np.cumsum(rc)])
        starts = np.concatenate([np.flatnonzero(np.diff(rd, prepend=-1)), [len(rd)]])
        begin = np.searchsorted(gdoc, np.arange(len(counts) + 1))
        rows: dict[int, object] = {}
        i = 0
        while i < len(starts) - 1:
            # texts whose located suffixes fill a block; a single text never has more than its trigrams times the shard
            j = max(i + 1, int(np.searchsorted(run[starts], run[starts[i]] + LOCATED, side="right")) - 1)
            s0, s1 = starts[i], starts[j]
            i = j
            n = rc[s0:s1]
            at = np.repeat(lo[r[s0:s1]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            pair, hits = np.unique(np.repeat(rd[s0:s1], n) * self.docs + self.texts_of(at), return_counts=True)
            x, e = pair // self.docs, pair % self.docs
            nx, ny = size[x], self.sizes[e]
            need = (num * (nx + ny) + num + den - 1) // (num + den)
            ok = (den * np.minimum(ny, nx) >= num * np.maximum(ny, nx)) & (hits >= taken[x] + lacking[x] - (nx - need)) & (hits > 0)
            for x1, e1 in zip(x[ok].tolist(), e[ok].tolist()):
                y = rows.get(e1)
                if y is None:
                    if len(rows) > 4096:
                        rows.clear()
                    y = rows[e1] = self.rows_of(e1)
                l, h = lo[begin[x1] : begin[x1 + 1]], hi[begin[x1] : begin[x1 + 1]]
                start, _, length = self.maximal_matches(l, h, y)
                covered = np.zeros(len(l) + 1, np.int64)
                np.add.at(covered, start, 1)
                np.add.at(covered, start + length - 2, -1)
                inside = np.cumsum(covered)[:-1] > 0
                # trigrams are told apart by their intervals
                shared, total = len(np.unique(l[inside])), int(size[x1] + self.sizes[e1])
                if (num + den) * shared >= num * total:
                    out.append((x1, e1, shared, total - shared, int((np.diff(np.concatenate([[0], inside.astype(np.int8)])) == 1).sum()), int(length.max())))
        return out


def _text(q, a, answers: bool) -> str:
    from .text import body

    return f"{body(q)} {a or ''}" if answers else body(q)


def _texts(table, answers: bool) -> list[str]:
    return [_text(q, a, answers) for q, a in zip(table.column("q").to_pylist(), table.column("a").to_pylist())]


def _in_shards(evaluation: DataFrame, shards: int) -> DataFrame:
    return evaluation.select("id", "q", "a", F.pmod(F.xxhash64("id"), F.lit(max(shards, 1))).cast("int").alias("shard"))


def build_shards(evaluation: DataFrame, answers: bool, work: Workspace) -> tuple[str, int]:
    """(folder of the indexes in the shared folder, a file a shard; their number)."""
    n = evaluation.count()
    shards = -(-n // SHARD_ROWS)

    def build(table):
        import numpy as np
        import pyarrow as pa

        from . import text as T

        texts = _texts(table, answers)
        g, _, sizes = T.trigram_sets(texts)
        cells = np.stack(np.unique((g & T.U(CELLS - 1)).astype(np.int64), return_counts=True)).astype("<u4")
        return pa.table({"shard": table.column("shard").slice(0, 1), "blob": pa.array([Index.build(table.column("id").to_pylist(), texts, sizes)], pa.binary()), "cells": pa.array([cells.tobytes()], pa.binary())})

    path = work.folder("shards")
    _in_shards(evaluation, shards).groupBy("shard").applyInArrow(build, "shard int, blob binary, cells binary").write.option("compression", "none").partitionBy("shard").parquet(path)
    return path, shards


def _stored(path: str, column: str):
    """The one value of a folder of the shared folder, read by the process that needs it; None if there is none."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    where, at = fs.FileSystem.from_uri(path)
    if where.get_file_info(at).type == fs.FileType.NotFound:
        return None
    for f in where.get_file_info(fs.FileSelector(at)):
        if f.base_name.endswith(".parquet"):
            got = pq.read_table(f.path, filesystem=where, columns=[column], partitioning=None).column(column)
            if len(got):
                return got[0].as_buffer()
    return None


def read_shard(path: str, shard: int) -> Index | None:
    """A shard's index; None if no row fell into the shard."""
    blob = _stored(f"{path}/shard={shard}", "blob")
    return None if blob is None else Index(blob)


def build_sketch(spark, path: str, shards: int, work: Workspace) -> str:
    """Folder of the sketch: in how many evaluation texts the trigrams of each cell are, summed over the shards."""

    def add(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(CELLS, np.int64)
        for b in batches:
            for k in b.column("id").to_pylist():
                if (x := _stored(f"{path}/shard={k}", "cells")) is not None:
                    cell, n = np.frombuffer(x, "<u4").reshape(2, -1)
                    total[cell] += n
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())], ["counts"])

    folder = work.folder("sketch")
    spark.range(0, shards, 1, 1).mapInArrow(add, "counts binary").write.option("compression", "zstd").parquet(folder)
    return folder


def _read_sketch(folder: str):
    import numpy as np

    return np.frombuffer(_stored(folder, "counts"), "<u4")


def _rarest(texts: list[str], counts, num: int, den: int):
    """(trigram, text, rank in its text) of the trigrams of which two similar texts share AGREED, or all; set sizes."""
    import numpy as np

    from . import text as T

    g, doc, n = T.trigram_sets(texts)
    # by text, then from rare to frequent, then by hash: g is sorted within a text and the sort is stable
    o = np.argsort((doc.astype(T.U) << T.U(32)) | counts[(g & T.U(CELLS - 1)).astype(np.int64)].astype(T.U), kind="stable")
    rank = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
    keep = rank < (n - (num * n + den - 1) // den + AGREED)[doc]
    return g[o][keep], doc[keep], rank[keep], n


def _furthest(n, rank, num: int, den: int):
    """The largest size of a text of which a partner of size n has a trigram at this rank among those that count."""
    return (num + den) * (n - rank + AGREED - 1) // num - n


class Postings:
    """The rarest trigrams of some shards' texts: texts are numbered by size, so a range of sizes is a range of a list."""

    @staticmethod
    def build(shard, size, g, text, furthest) -> bytes:
        import numpy as np

        by_size = np.argsort(size, kind="stable")
        number = np.empty(len(size), np.int64)
        number[by_size] = np.arange(len(size))
        names, k = np.unique(g, return_inverse=True)
        key = (k.astype(np.int64) << 32) | number[text]
        o = np.argsort(key)
        buf = io.BytesIO()
        np.savez(buf, names=names, key=key[o], furthest=furthest[o].astype(np.int32), size=size[by_size].astype(np.int32), shard=shard[by_size].astype(np.int32))
        return buf.getvalue()

    def __init__(self, blob):
        import numpy as np
        import pyarrow as pa

        z = np.load(pa.BufferReader(blob))
        self.names, self.key, self.furthest, self.size, self.shard = (z[c] for c in ("names", "key", "furthest", "size", "shard"))
        # texts of fewer trigrams than each number
        self.below = np.searchsorted(self.size, np.arange(int(self.size[-1]) + 2)) if len(self.size) else np.zeros(1, np.int64)

    def shards_of(self, g, x, rank, n, num: int, den: int):
        """(text, shard) of all texts x that may have a partner in a shard; g, x, rank of their rarest trigrams, n their sizes.

        Tokens are given in the order of x.
        """
        import numpy as np

        none = np.zeros((0, 2), np.int64)
        if not len(g) or not len(self.names):
            return none
        # lists are looked up in their order
        o = np.argsort(g, kind="stable")
        new = np.append(True, g[o][1:] != g[o][:-1])
        mine = g[o][new]
        k = np.minimum(np.searchsorted(self.names, mine), len(self.names) - 1)
        here = (self.names[k] == mine)[of := np.cumsum(new) - 1]
        o, k = o[here], k[of[here]].astype(np.int64) << 32
        nx, last = n[x[o]], len(self.below) - 1
        low = self.below[np.minimum((num * nx + den - 1) // den, last)]
        high = self.below[np.clip(np.minimum(den * nx // num, _furthest(nx, rank[o], num, den)) + 1, 0, last)]
        lo, hi = np.searchsorted(self.key, k | low), np.searchsorted(self.key, k | high)
        some = hi > lo
        o, lo, m = o[some], lo[some], (hi - lo)[some]
        back = np.argsort(o)
        x, lo, m = x[o][back], lo[back], m[back]
        run, texts, out = np.concatenate([[0], np.cumsum(m)]), len(self.size), [none]
        starts = np.append(np.flatnonzero(np.diff(x, prepend=-1)), len(x))
        i = 0
        while i < len(starts) - 1:
            # texts whose postings fill a block; a single text never has more than its trigrams times the texts
            j = max(i + 1, int(np.searchsorted(run[starts], run[starts[i]] + LOCATED, side="right")) - 1)
            s0, s1 = starts[i], starts[j]
            i = j
            at = np.repeat(lo[s0:s1] - (run[s0:s1] - run[s0]), m[s0:s1]) + np.arange(run[s1] - run[s0])
            whose = np.repeat(x[s0:s1], m[s0:s1])
            ok = self.furthest[at] >= n[whose]
            pair, hits = np.unique(whose[ok] * texts + (self.key[at[ok]] & 0xFFFFFFFF), return_counts=True)
            a, b = pair // texts, pair % texts
            ok = hits >= np.minimum((num * (n[a] + self.size[b]) + num + den - 1) // (num + den), AGREED)
            out.append(np.unique(np.stack([a[ok], self.shard[b[ok]]], axis=1), axis=0))
        return np.concatenate(out)


def build_postings(evaluation: DataFrame, shards: int, answers: bool, sketch: str, work: Workspace, num: int, den: int) -> tuple[str, int]:
    """(folder of the postings, a file for each GROUP shards; their number)."""
    group = GROUP

    def rare(batches):
        import numpy as np
        import pyarrow as pa

        from . import text as T

        counts = _read_sketch(sketch)
        for b in batches:
            texts, shard = _texts(b, answers), b.column("shard").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in T.slices([len(x) + 1 for x in texts]):
                g, doc, rank, n = _rarest(texts[i:j], counts, num, den)
                top, to, rows = _furthest(n[doc], rank, num, den), shard[i:j] // group, []
                for k in np.unique(to):
                    mine = (to == k) & (n > 0)
                    use = mine[doc]
                    parts = shard[i:j][mine], n[mine], g[use], (np.cumsum(mine) - 1)[doc[use]], top[use]
                    rows.append((int(k), *(np.ascontiguousarray(v).astype(t).tobytes() for v, t in zip(parts, _PACKED.values()))))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * len(_PACKED))], ["part", *_PACKED])

    def merge(table):
        import numpy as np
        import pyarrow as pa

        cols = {c: [np.frombuffer(x.as_buffer(), t) for x in table.column(c)] for c, t in _PACKED.items()}
        first = np.cumsum([0] + [len(v) for v in cols["shard"]])
        cols["text"] = [v.astype(np.int64) + at for v, at in zip(cols["text"], first)]
        return pa.table({"part": table.column("part").slice(0, 1), "blob": pa.array([Postings.build(*(np.concatenate(cols[c]) for c in _PACKED))], pa.binary())})

    path = work.folder("postings")
    packed = spread(_in_shards(evaluation, shards)).mapInArrow(rare, "part int, " + ", ".join(f"{c} binary" for c in _PACKED))
    packed.groupBy("part").applyInArrow(merge, "part int, blob binary").write.option("compression", "none").partitionBy("part").parquet(path)
    return path, -(-shards // group)


#: Columns of packed postings.
_PACKED = {"shard": "<i4", "size": "<i4", "g": "<u8", "text": "<u4", "furthest": "<i4"}
ROUTED = "shard int, id bigint, q string, a string"


def _route(batches, answers: bool, num: int, den: int, sketch: str, postings: str, parts: int):
    """Rows of ROUTED: each text once for every shard where it may have a partner."""
    import numpy as np
    import pyarrow as pa

    from . import text as T

    counts = _read_sketch(sketch)

    def send(rows, found, weights):
        table = pa.Table.from_batches(rows)
        sizes = np.concatenate([f[3] for f in found])
        first = np.cumsum([0] + [len(f[3]) for f in found])
        g, rank = (np.concatenate([f[c] for f in found]) for c in (0, 2))
        x = np.concatenate([f[1] + at for f, at in zip(found, first)])
        for k in range(parts):
            if (blob := _stored(f"{postings}/part={k}", "blob")) is None:
                continue
            to = Postings(blob).shards_of(g, x, rank, sizes, num, den)
            for i, j in T.slices([weights[v] for v in to[:, 0].tolist()]):
                got = table.take(pa.array(to[i:j, 0])).combine_chunks()
                yield from got.add_column(0, "shard", pa.array(to[i:j, 1].astype(np.int32))).to_batches()

    rows, found, weights = [], [], []
    for b in batches:
        texts = _texts(b, answers)
        weights += [len(x) + 8 for x in texts]
        for i, j in T.slices(weights[-len(texts) :]):
            found.append(_rarest(texts[i:j], counts, num, den))
        rows.append(b)
        if sum(weights) > 8 * HELD_WORDS:  # characters of a word, and bytes of an empty text
            yield from send(rows, found, weights)
            rows, found, weights = [], [], []
    if rows:
        yield from send(rows, found, weights)


def routed_texts(evaluation: DataFrame, training: DataFrame, path: str, shards: int, answers: bool, work: Workspace, num: int, den: int) -> DataFrame:
    """shard, id, q, a: each training text once for every shard of ``build_shards`` where it may have a partner."""
    sketch = build_sketch(training.sparkSession, path, shards, work)
    postings, parts = build_postings(evaluation, shards, answers, sketch, work, num, den)
    return training.mapInArrow(lambda batches: _route(batches, answers, num, den, sketch, postings, parts), ROUTED)


SCHEMA = "eval_id bigint, train_key bigint, shared int, all_trigrams int, spans int, longest_match int"


def _search(batches, answers: bool, num: int, den: int, indexes):
    """Rows of SCHEMA; ``indexes`` gives the shards anew for each block of texts held."""
    import numpy as np
    import pyarrow as pa

    from . import text as T

    def look(ids, hs, cs):
        h, c = np.concatenate(hs), np.concatenate(cs)
        # texts of at most so many words meet a shard at once
        edges = np.searchsorted(np.cumsum(c), np.arange(0, len(h) + 400_000, 400_000))
        edges = np.unique(np.concatenate([[0], edges, [len(c)]]))
        stops = np.concatenate([[0], np.cumsum(c)])
        for index in indexes():
            rows = []
            for i, j in zip(edges[:-1], edges[1:]):
                rows += [(int(index.ids[e]), ids[i + x], *rest) for x, e, *rest in index.partners(h[stops[i] : stops[j]], c[i:j], num, den)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), [pa.int64()] * 2 + [pa.int32()] * 4)], ["eval_id", "train_key", "shared", "all_trigrams", "spans", "longest_match"])

    ids, hs, cs, held = [], [], [], 0
    for b in batches:
        texts = [_text(q, a, answers) for q, a in zip(b.column("q").to_pylist(), b.column("a").to_pylist())]
        for i, j in T.slices([len(x) + 1 for x in texts], T.CHUNK):
            h, c = T.word_hashes(texts[i:j])
            hs.append(h)
            cs.append(c)
            held += len(h)
        ids += b.column("id").to_pylist()
        if held > HELD_WORDS:
            yield from look(ids, hs, cs)
            ids, hs, cs, held = [], [], [], 0
    if ids:
        yield from look(ids, hs, cs)


def _search_once(batch, answers: bool, num: int, den: int, index):
    """The same for one batch and one shard; texts that are alike are searched once."""
    import numpy as np
    import pyarrow as pa

    alike: dict[tuple, int] = {}
    which = np.array([alike.setdefault(t, len(alike)) for t in zip(batch.column("q").to_pylist(), batch.column("a").to_pylist())], np.int64)
    ids = batch.column("id").take(pa.array(np.argsort(which, kind="stable")))
    n = np.bincount(which, minlength=len(alike))
    first = np.cumsum(n) - n
    distinct = pa.RecordBatch.from_arrays([pa.array(range(len(alike)), pa.int64()), *(pa.array([t[c] for t in alike], pa.string()) for c in (0, 1))], ["id", "q", "a"])
    for found in _search([distinct], answers, num, den, lambda: [index]):
        t = found.column("train_key").to_numpy()
        m = n[t]
        at = np.repeat(first[t] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        rows = found.take(pa.array(np.repeat(np.arange(len(t)), m)))
        yield rows.set_column(1, "train_key", ids.take(pa.array(at)))


def _search_routed(batches, answers: bool, num: int, den: int, path: str):
    """The same for rows of ROUTED in the order of their shards, each searched in its own shard."""
    import numpy as np

    known, index = None, None
    for b in batches:
        shard = b.column("shard").to_numpy(zero_copy_only=False)
        edges = np.concatenate([np.flatnonzero(np.diff(shard, prepend=-1)), [len(shard)]])
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if shard[i] != known:
                index = None  # one at a time
                known, index = shard[i], read_shard(path, int(shard[i]))
            yield from _search_once(b.slice(i, j - i), answers, num, den, index)


def find_overlaps(evaluation: DataFrame, training: DataFrame, answers: bool, work: Workspace, num: int = NUM, den: int = DEN, by_file: bool | None = None) -> DataFrame:
    """eval_id, train_key, shared, all_trigrams, spans, longest_match of all pairs of similarity num/den or more.

    Both tables have id, q (question) and a (answer).  With ``answers`` a text is the question body, a space and the
    answer, else the body.  Null texts are empty; texts of fewer than three words have no partner.  Repeated rows
    each count.  Empty tables give no rows.  ``spans`` counts the training text's merged matches, ``longest_match`` is the
    longest maximal match in words.  Workers read shards and postings from the shared folder; where they cannot
    (``by_file`` False, or no Python file system for its scheme) shards are broadcast in passes, one at a time, each
    pass's rows written before its broadcast is dropped; all training texts then go through all shards.
    """
    texts, members = _distinct(evaluation, work)
    pairs = work.keep(_text_overlaps(texts, training, answers, work, num, den, by_file), "pairs")
    return heavy_light_join(pairs.withColumnRenamed("eval_id", "text"), members, ["text"]).select("eval_id", *pairs.columns[1:])


def _distinct(evaluation: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(id, q, a of the distinct texts; eval_id and the id of its text of every row)."""
    q, a = F.coalesce("q", F.lit("")), F.coalesce("a", F.lit(""))
    named = evaluation.select(F.col("id").alias("eval_id"), "q", "a", F.md5(F.concat(F.length(q), F.lit(":"), q, a)).alias("digest"))
    texts = work.keep(named.dropDuplicates(["digest"]).select(F.monotonically_increasing_id().alias("id"), "q", "a", "digest"), "texts")
    return texts.drop("digest"), work.keep(heavy_light_join(named.select("eval_id", "digest"), texts.select("digest", F.col("id").alias("text")), ["digest"]).select("eval_id", "text"), "members")


def _text_overlaps(texts: DataFrame, training: DataFrame, answers: bool, work: Workspace, num: int, den: int, by_file: bool | None) -> DataFrame:
    """``find_overlaps`` for evaluation texts, whose ids stand for eval_id."""
    spark = training.sparkSession
    path, shards = build_shards(texts, answers, work)
    if not shards:
        return spark.createDataFrame([], SCHEMA)
    rows = spread(training.select("id", "q", "a"))
    if by_file is None:
        by_file = _readable(path)
    if by_file:
        routed = routed_texts(texts, rows, path, shards, answers, work, num, den)
        cores = spark.sparkContext.defaultParallelism
        routed = routed.repartition(max(3 * cores, shards), "shard", F.pmod(F.xxhash64("q", "a"), F.lit(SALTS))).sortWithinPartitions("shard", F.xxhash64("q", "a"))
        return routed.mapInArrow(lambda batches: _search_routed(batches, answers, num, den, path), SCHEMA)
    table = spark.read.parquet(path)
    sizes = table.select("shard", F.length("blob").alias("size")).orderBy("shard").collect()  # one row a shard
    result, at = None, 0
    while at < len(sizes):
        names, size = [], 0
        while at < len(sizes) and (not names or size + sizes[at]["size"] <= PASS_BYTES):
            names.append(sizes[at]["shard"])
            size += sizes[at]["size"]
            at += 1
        blobs = spark.sparkContext.broadcast([bytes(r["blob"]) for r in table.where(F.col("shard").isin(names)).select("blob").collect()])

        def run(batches, blobs=blobs):
            return _search(batches, answers, num, den, lambda: (Index(x) for x in blobs.value))

        got = work.keep(rows.mapInArrow(run, SCHEMA), "pass")
        blobs.destroy()
        result = got if result is None else result.unionByName(got)
    return result


def _readable(path: str) -> bool:
    import pyarrow as pa
    import pyarrow.fs as fs

    try:
        where, at = fs.FileSystem.from_uri(path)
        return where.get_file_info(at).type == fs.FileType.Directory
    except (pa.ArrowInvalid, OSError, ValueError):
        return False


def _rows(df: DataFrame, id_: str, answer: str | None) -> DataFrame:
    return df.select(F.col(id_).cast("bigint").alias("id"), F.col("question").cast("string").alias("q"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("a"))


def cross_split_overlaps(evals: DataFrame, records: DataFrame) -> DataFrame:
    """train_table and the columns of ``find_overlaps`` for both training tables.

    Splits are compared trimmed and lower-cased; a row whose split is null counts as outside train.
    """
    work = Workspace(evals.sparkSession, "overlap")
    split = F.coalesce(key(F.col("split")), F.lit(""))
    held, own = evals.where(split != "train"), evals.where(split == "train")
    one = find_overlaps(_rows(held, "eval_id", None), _rows(records, "record_id", None), False, work).withColumn("train_table", F.lit("qa_records"))
    two = find_overlaps(_rows(held, "eval_id", "gold_answer"), _rows(own, "eval_id", "gold_answer"), True, work).withColumn("train_table", F.lit("eval_examples"))
    return one.unionByName(two)


def overlap_report(evals: DataFrame, records: DataFrame) -> DataFrame:
    """split, dataset_name, train_table, n_pairs, n_eval, longest_match: overlaps per split and data set."""
    about = evals.select(F.col("eval_id").cast("bigint").alias("eval_id"), key(F.col("split")).alias("split"), "dataset_name")
    work = Workspace(evals.sparkSession, "overlap-report")
    pairs = work.keep(cross_split_overlaps(evals, records), "pairs")
    return heavy_light_join(pairs, about, ["eval_id"]).groupBy("split", "dataset_name", "train_table").agg(
        F.count("*").alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval"), F.max("longest_match").alias("longest_match")
    )
