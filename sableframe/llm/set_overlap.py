"""Exact overlaps of small integer sets, and union-find: kernels for verifying candidate groups."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle


class Postings:
    """An inverted index over a list of sets (arrays of distinct integers)."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        codes = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(self.n), [len(s) for s in sets])
        order = np.argsort(codes, kind="stable")
        self.owner, codes = owner[order], codes[order]
        self.codes, self.start = np.unique(codes, return_index=True)
        self.end = np.append(self.start[1:], len(codes))

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        """How many of ``s``'s elements each set has."""
        if not len(self.codes) or not len(s):
            return np.zeros(self.n, np.int64)
        at = np.minimum(np.searchsorted(self.codes, s), len(self.codes) - 1)
        at = at[self.codes[at] == s]
        first, size = self.start[at], self.end[at] - self.start[at]
        ends = np.cumsum(size)
        if not len(ends):
            return np.zeros(self.n, np.int64)
        take = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        return np.bincount(self.owner[take], minlength=self.n)


class Unions:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(b.schema.names.index(k)) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        first = tuple(c[0].as_py() for c in columns)
        change[0] = last is not None and first != last
        cuts = [*np.flatnonzero(change).tolist(), b.num_rows]
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(b.slice(at, cut - at))
            if cut < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
            at = cut
        last = tuple(c[b.num_rows - 1].as_py() for c in columns)
    if held:
        yield pa.Table.from_batches(held)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
