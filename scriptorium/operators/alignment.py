"""Alignment of two sequences of one row: words that a least edit replaces, and the blocks that two texts share.

Spark deals the pairs; within a row the sequences are NumPy arrays, and a table of edits or of runs is a row at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A cell outside the band; larger than any number of edits.
FAR = 1 << 30


def codes(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers, equal for equal items."""
    seen: dict[str, int] = {}
    both = np.fromiter((seen.setdefault(x, len(seen)) for x in (*a, *b)), np.int64, len(a) + len(b))
    return both[: len(a)], both[len(a) :]


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Band:
    """Rows of the edit table of ``a`` and ``b`` within ``width`` of the diagonal; every ``step``-th one is kept, the others
    are made again when the way back needs them, so that memory grows with the root of the table."""

    def __init__(self, a: np.ndarray, b: np.ndarray, width: int) -> None:
        self.a, self.b, self.width = a, b, width
        self.step = max(16, int(len(a) ** 0.5))
        first = np.arange(len(b) + 1)
        first[width + 1 :] = FAR
        self.kept, row = {0: first}, first
        for i in range(1, len(a) + 1):
            row = self.after(row, i)
            if i % self.step == 0:
                self.kept[i] = row
        self.edits = int(row[-1])
        self.block: dict[int, np.ndarray] = {}

    def after(self, row: np.ndarray, i: int) -> np.ndarray:
        lo, hi = max(0, i - self.width), min(len(self.b), i + self.width)
        out = np.full(len(row), FAR)
        best = row[lo : hi + 1] + 1  # a's item goes
        at = max(1, lo)
        if at <= hi:
            best[at - lo :] = np.minimum(best[at - lo :], row[at - 1 : hi] + (self.b[at - 1 : hi] != self.a[i - 1]))
        place = np.arange(lo, hi + 1)
        out[lo : hi + 1] = np.minimum.accumulate(best - place) + place  # b's items come in
        return out

    def row(self, i: int) -> np.ndarray:
        if i not in self.block:
            start = i - i % self.step
            self.block = {start: self.kept[start]} | ({i + 1: self.block[i + 1]} if i + 1 in self.block else {})
            for k in range(start + 1, i + 1):
                self.block[k] = self.after(self.block[k - 1], k)
        return self.block[i]


def replaced(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of the items of ``a`` that a least edit replaces by items of ``b``, rising.

    Equal ends are left alone first. Of several least edits the one is taken that, read from the end, lets an item of ``a`` go
    where it can, else takes one of ``b`` in where the table falls towards it, else pairs the two. The band is doubled until
    the edits fit it, which makes it exact.
    """
    n = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:n] == b[:n], False)))
    rest = n - head
    tail = int(np.argmin(np.append(a[len(a) - rest :][::-1] == b[len(b) - rest :][::-1], False))) if rest else 0
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not len(x) or not len(y):
        return []
    width = max(8, abs(len(x) - len(y)))
    while (band := _Band(x, y, width)).edits > width:
        width *= 2
    i, j, out = len(x), len(y), []
    while i and j:
        here, above = band.row(i), band.row(i - 1)
        if above[j] + 1 == here[j]:
            i -= 1
        elif here[j - 1] + 1 == here[j] and here[j - 1] < above[j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            if x[i] != y[j]:
                out.append((head + i, head + j))
    return out[::-1]


#: A text of so many characters or more has common ones, those that make up over a hundredth of it.
LONG, SHARE = 200, 100


def shared_blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, n): blocks ``a[i:i + n] == b[j:j + n]``, rising, with neighbouring ones joined.

    The longest run of equal items comes first, of equal ones the first in ``a``, then in ``b``; then the same on either side
    of it. Items that make up over a hundredth of a ``b`` of 200 or more start no run, they only widen one; where a range has
    no other, the block is what both begin with. Runs are kept for one item of ``a`` at a time, so memory grows with ``b``.
    """
    order = np.argsort(b, kind="stable")
    kinds, begin, count = np.unique(b[order], return_index=True, return_counts=True)
    rare = {int(k): order[s : s + n] for k, s, n in zip(kinds, begin, count, strict=True) if len(b) < LONG or n <= len(b) // SHARE + 1}
    runs, found, todo = np.zeros(len(b) + 1, np.int64), [], [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, left, right = todo.pop()
        at, to, size = lo, left, 0
        last = np.zeros(0, np.int64)
        for i in range(lo, hi):
            js = rare.get(int(a[i]))
            js = last[:0] if js is None else js[np.searchsorted(js, left) : np.searchsorted(js, right)]
            run = runs[js] + 1
            runs[last + 1] = 0
            runs[js + 1] = run
            last = js
            if len(js) and (most := int(run.max())) > size:
                at, to, size = i - most + 1, int(js[run.argmax()]) - most + 1, most
        runs[last + 1] = 0
        while at > lo and to > left and a[at - 1] == b[to - 1]:
            at, to, size = at - 1, to - 1, size + 1
        while at + size < hi and to + size < right and a[at + size] == b[to + size]:
            size += 1
        if size:
            found.append((at, to, size))
            todo += [(lo, at, left, to), (at + size, hi, to + size, right)]
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def ratio(a: str, b: str) -> float:
    """Twice the shared characters over all; 1 for two empty texts."""
    total = len(a) + len(b)
    return 2.0 * sum(n for _, _, n in shared_blocks(letters(a), letters(b))) / total if total else 1.0


def differences(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """What turns ``a`` into ``b``, in order: (replace, delete or insert; i1, i2, j1, j2), the places between shared blocks."""
    out, i, j = [], 0, 0
    for x, y, n in [*shared_blocks(letters(a), letters(b)), (len(a), len(b), 0)]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        i, j = x + n, y + n
    return out


def by_row(df: DataFrame, inputs: list[str], keys: list[str], schema: str, f: Callable[..., tuple]) -> DataFrame:
    """``keys`` of each row and the values of ``schema`` that ``f`` makes of its ``inputs``, batch by batch."""
    kinds = {x.name: x.dataType.simpleString() for x in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f(*row) for row in zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=[*keys, *names])

    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}[x.split()[1]] for x in schema.split(", ")]
    return df.select(*keys, *(c for c in inputs if c not in keys)).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema)
