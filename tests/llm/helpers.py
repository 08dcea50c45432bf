"""Small tables for the operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=False):
    """``documents`` of (doc_id, text) or (doc_id, text, lang, source), with clashing extra columns if asked."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        names = ("score", "size", "hash", "node", "line", "n_removed", "n_lines", "token", "_key", "row", "times")
        df = df.withColumns({n: F.lit("x") for n in names})
    return df


def prose(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n)]


def edited(words: list[str], seed: int, changes: int) -> list[str]:
    rng, out = random.Random(seed), list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


ODD = [(None, None), (None, ""), (1, None), (1, ""), (2, "   \n\t \n"), (2, "one"), (2, "one"), (3, "a b c d e"), (3, "a b c d e"), (4, "é" * 3000 + " 😀 \x85 x" * 5)]
