"""Packing documents into sequences by best-fit decreasing.

A document is its token ids and the id 1. Documents of more than a window are first cut into full
windows, each a sequence of its own, and a rest. Rests are dealt into shards of about ``SHARD_PIECES``
by the hash of their document; in each shard they are taken from the longest to the shortest, and a
segment tree indexed by remaining capacity finds the open sequence with the least room that suffices.
A shard is so large that its few unfilled sequences do not matter, and so small that it is packed in a
task's memory; their number grows with the input.

Defined results: a null text is empty and gives one piece of one id. Repeated rows are packed as often as
they occur. Pieces of equal length go in the order of doc_id (null first), start and ids. An empty table
gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableframe.llm.tables import table
from sableframe.llm.text_kernels import lean, tokenizer

WINDOW, END_ID, SHARD_PIECES = 2048, 1, 8192
_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows and the rest of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for b in lean(batches):
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    a = np.array([*ids, END_ID], "<u4")
                    rows += [(doc, s, len(p := a[s : s + window]), zlib.crc32(p.tobytes()), len(a)) for s in range(0, len(a), window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_PIECE)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class Room:
    """Open sequences by remaining capacity, in a segment tree over the capacities."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)  # how many open sequences lie below each node
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def _count(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += by
            node >>= 1

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._count(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """(room, sequence) of the open sequence with the least room of ``length`` or more, taken out."""
        node = length + self.size
        while not self.tree[node]:
            while node & 1:  # a right child: go up
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            if node & (node - 1) == 0:  # past the last capacity
                return None
        while node < self.size:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.size
        self._count(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece, for pieces in descending order of length."""
    room, placed, n = Room(window), [], 0
    for length in lengths:
        found = room.tightest(length) if length < window else None
        left, sequence = found or (window, n)
        n += found is None
        placed.append((sequence, window - left))
        if left > length:
            room.add(left - length, sequence)
    return placed


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every piece with its ``sequence_id``, its ``offset`` there, and the sequence's tokens and padded length."""
    shards = max(1, -(-docs.count() // shard_pieces))
    cut = pieces(docs, window, path).withColumn("_shard", F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(shards)))

    def place(shard: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        t = shard.sort_by(order)
        at = np.array(best_fit(t["length"].to_pylist(), window), np.int64).reshape(-1, 2)
        used = np.bincount(at[:, 0], t["length"].to_numpy()).astype(np.int64)
        exact = (used & (used - 1)) == 0
        base = np.int64(t["_shard"][0].as_py()) << np.int64(32)
        made = {"sequence_id": at[:, 0] + base, "offset": at[:, 1], "sequence_tokens": used[at[:, 0]], "padded_length": np.where(exact, used, window)[at[:, 0]]}
        out = t.select(_PIECE.names)
        for name, values in made.items():
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    kind = ", ".join(f"{n} long" for n in [*_PIECE.names, "sequence_id", "offset", "sequence_tokens", "padded_length"])
    return cut.groupBy("_shard").applyInArrow(place, kind)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
