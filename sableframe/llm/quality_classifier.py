"""Bradley-Terry quality scores: a ranking learnt from preference pairs.

Labelled texts of quality 1 are preferred to those of quality 0. The weights of a document's score are
those that minimise the logistic loss of the feature differences over pairs; a quantile of the training
scores, the one that parts the labels best, then becomes the threshold, and the logistic of a score's
distance from it is the score returned: at least 0.5 means quality 1.

Learning uses at most ``MOST_LABELLED`` labelled documents, the first by the hash of their id, with one
text for each id (of several the one with the least features), and ``PAIRS`` pairs drawn from them with a
fixed seed; both bounds hold at every size of the input and for every number of rows of an id. Scoring
reads every whole text. Features are counts of characters, words and lines, and the shares of words and of runs of three
characters in ``HASHED`` hash buckets each; labels, language, source and ids are never features.

Defined results: a null text is empty; empty texts have the score of their features. Labels other than
0 and 1, and ids with both, are not learnt from. If either label is missing every score is 0.5. A null
doc_id is not held out. Repeated rows have equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sableframe.llm.tables import table
from sableframe.llm.text_kernels import WordHashes, has_word, lean, split_words

MOST_LABELLED, PAIRS, RIDGE, SEED = 20_000, 100_000, 1e-3, 7
HASHED, CHUNK = 64, 5_000
_WORDS = WordHashes()


def hashed(codes: np.ndarray, words: list[str]) -> np.ndarray:
    """Roots of the shares of a text's words and of its runs of three characters in hash buckets."""
    w = np.bincount((_WORDS.of(words) >> np.uint64(20)).astype(np.int64) % HASHED, minlength=HASHED)
    c = codes.astype(np.uint64)
    runs = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(58)
    r = np.bincount(runs.astype(np.int64), minlength=HASHED)
    return np.sqrt(np.concatenate([w / max(len(words), 1), r / max(len(runs), 1)]))


def features(text: str | None) -> np.ndarray:
    """Shares and logarithms that describe a text: ``PLAIN`` counts, then the hashed ones."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(len(codes), 1)
    c = np.bincount(np.minimum(codes, 256), minlength=257).astype(float)
    upper = c[65:91].sum() + c[0xC0:0xDF].sum() - c[0xD7]
    lower = c[97:123].sum() + c[0xDF:0x100].sum() - c[0xF7]
    digits, spaces = c[48:58].sum(), c[32] + c[9:14].sum()
    marks = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    w = split_words(text)
    k = max(len(w), 1)
    distinct = len(set(w))
    twice = sum(a == b for a, b in zip(w, w[1:], strict=False))
    pairs = len(set(zip(w, w[1:], strict=False)))
    lines = [x for x in text.split("\n") if has_word(x)]
    endings = sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines)
    root = lambda x: np.sqrt(max(x, 0.0))
    plain = np.array([
        np.log1p(len(w)), len(codes) / k, root(upper / n), root(upper / max(upper + lower, 1)), root(digits / n), root(marks / n),
        root(c[33] / n), root(c[124] / n), root((c[35] + c[36] + c[37] + c[38] + c[42]) / n), root(c[256] / n), root((c[46] + c[44]) / n),
        root(spaces / n), root(twice / k), distinct / k, np.log1p(distinct) / np.log1p(k), pairs / max(k - 1, 1), np.log1p(len(lines)), k / max(len(lines), 1) / 100,
        len(set(lines)) / max(len(lines), 1), endings / max(len(lines), 1), np.log1p(k / max(distinct, 1)), float(not w),
    ])
    return np.concatenate([plain, hashed(codes, w)])


PLAIN = len(features(None)) - 2 * HASHED


@dataclass(frozen=True)
class Ranking:
    """Weights on standardised features, the threshold, and the spread that scales scores."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = standardised(x, self.mean, self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip((s - self.threshold) / self.spread, -30, 30)))


def standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features in standard deviations, within 3, and the squares of the plain ones."""
    z = np.clip((x - mean) / scale, -3, 3)
    return np.hstack([z, z[:, :PLAIN] ** 2])


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = SEED) -> Ranking | None:
    """The ranking learnt from labelled features; None if either label is missing."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = standardised(x, mean, scale)
    rng = np.random.default_rng(seed)
    preferred, other = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(z.shape[1])
    for _ in range(12):  # Newton steps on the logistic loss of the differences, summed over chunks of pairs
        gradient, hessian = -RIDGE * w, RIDGE * np.eye(len(w))
        for at in range(0, pairs, CHUNK):
            d = z[preferred[at : at + CHUNK]] - z[other[at : at + CHUNK]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient = gradient + d.T @ p / pairs
            hessian = hessian + (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.sort(s)
    quantiles = np.unique((np.arange(0, 1001) / 1000 * (len(s) - 1)).astype(int))
    cuts = (order[quantiles] + order[np.maximum(quantiles - 1, 0)]) / 2
    right = [((s >= t) == (y == 1)).mean() for t in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    gap = order[quantiles] - order[np.maximum(quantiles - 1, 0)]
    threshold = cuts[best[np.argmax(gap[best])]]
    return Ranking(mean, scale, w, float(threshold), float(max(1.0, np.abs(s - threshold).mean() / 4)))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Ranking | None:
    """The ranking learnt from at most ``most`` labelled documents that are not held out."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.min("quality").alias("_y"), F.max("quality").alias("_z")).where("_y = _z")
    chosen = one.select("doc_id", "_y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py()).astype(np.float32) for t in b.column(2)], pa.list_(pa.float32()))], ["id", "y", "x"])

    measured = texts.select("doc_id", F.col("_y").cast("int").alias("y"), "text").mapInArrow(measure, "id long, y int, x array<float>")
    rows = measured.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).select("y", "x").toArrow()  # a row per chosen id
    if not rows.num_rows:
        return None
    # Sorted, so that sums do not depend on the order in which partitions arrive.
    x, y = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).astype(float), rows["y"].to_numpy()
    order = np.lexsort((*x.T[::-1], y))
    return fit(x[order], y[order])


def scored(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """``docs`` with ``score``; a column of that name is replaced."""
    from pyspark.sql.types import DoubleType, StructType

    kind = StructType([f for f in docs.schema.fields if f.name != "score"]).add("score", DoubleType())
    at = kind.fieldNames().index("text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            s = np.full(b.num_rows, 0.5)
            if ranking is not None and b.num_rows:
                s = ranking.scores(np.array([features(t.as_py()) for t in b.column(at)]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    return docs.select(*[f"`{n}`" for n in kind.fieldNames()[:-1]]).mapInArrow(rate, kind)


def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    ranking = learn(docs, table(spark, sf_dir, "labels"))
    judged = scored(docs.select("doc_id", "text"), ranking)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
