"""Corpus counts of fixed size: hashed counters that tasks fill, that add up by block, and that fit in a broadcast."""

from __future__ import annotations

from collections import Counter

import xxhash

#: Distinct texts that are held before they are hashed.
HELD = 300_000
BLOCK = 1 << 14
SCHEMA = "cell int, counts binary"


def slot(text: str, cells: int) -> int:
    return xxhash.xxh3_64_intdigest(text) & (cells - 1)


class Counters:
    """Named counters in one array; each has ``cells`` slots (a power of two, at least BLOCK)."""

    def __init__(self, names: list[str], cells: int):
        import numpy as np

        self.names, self.cells = names, cells
        self.base = {n: k * cells for k, n in enumerate(names)}
        self.array = np.zeros(cells * len(names), np.int64)
        self.held = {n: Counter() for n in names}

    def add(self, name: str, texts) -> None:
        """Count texts (an iterable of strings, repeats counted)."""
        held = self.held[name]
        held.update(texts)
        if len(held) > HELD:
            self.flush(name)

    def flush(self, name: str) -> None:
        """Move what is held by text to the slots; each distinct text is hashed once."""
        import numpy as np

        held, h, m = self.held[name], xxhash.xxh3_64_intdigest, self.cells - 1
        at = np.fromiter((h(w) & m for w in held), np.int64, len(held)) + self.base[name]
        np.add.at(self.array, at, np.fromiter(held.values(), np.int64, len(held)))
        held.clear()

    def rows(self):
        """(block number, counts) of the blocks that hold anything."""
        for n in self.names:
            self.flush(n)
        for k in range(0, len(self.array), BLOCK):
            x = self.array[k : k + BLOCK]
            if x.any():
                yield k // BLOCK, x.astype("<u4").tobytes()


def collect(rows, names: list[str], cells: int):
    """The sum of all tasks' counters: {name: uint32 array}; its size does not depend on the corpus."""
    import numpy as np

    def add(table):
        import pyarrow as pa

        total = np.zeros(BLOCK, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), "<u4")
        total = np.minimum(total, 0xFFFFFFFF)
        return pa.table({"cell": table.column("cell").slice(0, 1), "counts": pa.array([total.astype("<u4").tobytes()], pa.binary())})

    out = np.zeros(cells * len(names), np.uint32)
    for r in rows.groupBy("cell").applyInArrow(add, SCHEMA).collect():
        out[r["cell"] * BLOCK : (r["cell"] + 1) * BLOCK] = np.frombuffer(bytes(r["counts"]), "<u4")
    return {n: out[k * cells : (k + 1) * cells] for k, n in enumerate(names)}
