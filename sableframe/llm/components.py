"""Connected components of an edge table, by alternating star contractions (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sableframe.llm.staging import staged

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b): the label is the component's least node.

    Each round hangs every node's greater neighbours on its least one, then its lesser ones; rounds grow
    with the logarithm of the longest path. Only sums of the edges reach the driver.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(e)
    for _ in range(MOST_ROUNDS if state[0] else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        top = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(top, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("s"))
        e = staged(small.select(F.col("s.a").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct())
        before, state = state, _state(e)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return r[0], r[1]
