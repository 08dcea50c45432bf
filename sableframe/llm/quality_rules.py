"""Robust multivariate outliers: minimum covariance determinant per language and source.

Every text is measured by a few counts; a base rule rejects short and repetitive texts outright. For all
others, transformed statistics are compared with a robust mean and covariance of their language and
source. Those estimates are found by concentration steps over all rows: distances are binned finely, the
moments of each bin are summed per group in one aggregation, and the bins that hold the closest
``SUPPORT`` of a group's rows give the next estimate. A last step weighs rows anew: all whose distance
is usual (``USUAL`` of normal rows) give the final estimate. Rows never leave their partitions; only sums per
group and bin are shuffled, so a hot group costs no more than any other. A text is rejected if its
squared Mahalanobis distance exceeds ``CUTOFF``, a quantile of chi-square with 5 degrees of freedom that a
normal row exceeds once in a million times.

Groups of fewer than ``LEAST_ROWS`` rows that passed the base rule are estimated together by language, and
languages with fewer still together.

Defined results: a null text is empty; texts without words fail the base rule. Null languages and sources
are groups of their own. Repeated rows count as often as they occur. Groups in which all rows are equal
have only the covariance floor, and keep those rows. An empty table gives no rows. The columns of
``measured`` are the only ones read and returned.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sableframe.llm.staging import broadcast_if_small, staged
from sableframe.llm.tables import key, table
from sableframe.llm.text_kernels import has_word, lean, split_words

LEAST_WORDS, MOST_REPEAT_SHARE = 50, 0.5
LEAST_ROWS, SUPPORT, STEPS, USUAL, FALSE_ALARMS = 60, 0.6, 6, 0.975, 1e-6
SYMBOLS = "#*$%&|<>"


def chi_square(x: float) -> float:
    """Share of chi-square values with 5 degrees of freedom up to ``x``."""
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)


def chi_square_quantile(share: float) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid) < share else (low, mid)
    return low


CUTOFF = chi_square_quantile(1 - FALSE_ALARMS)  # 35.9
#: Standard deviations that are added to the estimates: a difference of this size in words' log count,
#: mean word length, and the root of the share of symbols is ordinary. Most groups hardly vary in their repetition; its
#: two are so large that a text of repeated lines only, or with as many repeated words as the base rule allows, is beyond the cutoff by that alone.
FLOOR = (0.25, 0.25, 0.08, 0.95 / math.sqrt(CUTOFF), 0.95 * math.sqrt(MOST_REPEAT_SHARE / CUTOFF))
P = len(FLOOR)
BINS_PER_E, LOW_BIN, HIGH_BIN = 24, -120, 360
_STATS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the number of lines with words."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    w = split_words(text)
    lines = [x for x in text.split("\n") if has_word(x)]
    grams = list(zip(w, w[1:], w[2:], strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        often, end = Counter(grams), 0
        for i, g in enumerate(grams):
            if often[g] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(w), sum(map(len, w)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, n_lines and base_failed of every document."""
    names = ["n_words", *_STATS, "n_lines"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            found = np.array([text_counts(t.as_py()) for t in b.column(3)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(found[:, k]) for k in range(len(names)))], ["doc_id", "lang", "source", *names])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    counted = kept.mapInArrow(count, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEAT_SHARE * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def transformed() -> Column:
    """The vector of transformed statistics."""
    n = F.greatest("n_words", F.lit(1))
    return F.array(
        F.log1p("n_words"),
        F.col("word_chars") / n,
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    )


def fit_groups(rows: DataFrame) -> DataFrame:
    """Adds ``_group``, the language and source or what is estimated together with it."""
    fine, coarse = F.concat_ws("\u0001", key("lang"), key("source")), F.concat_ws("\u0001", key("lang"), F.lit("*"))
    counted = rows.withColumns({"_fine": fine, "_lang": coarse})
    sizes = counted.where(~F.col("base_failed")).groupBy("_fine", "_lang").agg(F.count("*").alias("_n"))
    small = F.col("_n") < LEAST_ROWS
    langs = sizes.where(small).groupBy("_lang").agg(F.sum("_n").alias("_m"))
    names = sizes.join(langs, "_lang", "left").select("_fine", F.when(~small, F.col("_fine")).when(F.col("_m") >= LEAST_ROWS, F.col("_lang")).otherwise(F.lit("*")).alias("_group"))
    return counted.join(names, "_fine", "left").drop("_fine", "_lang")


def distance() -> Column:
    """Squared Mahalanobis distance of ``x`` by the columns ``mean`` and ``precision`` (row by row)."""
    d = [F.col("x")[i] - F.col("mean")[i] for i in range(P)]
    return sum((d[i] * d[j] * F.col("precision")[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)), F.lit(0.0))


def _cdf7(x: float) -> float:
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3 + x * x / 15)


def widening(share: float) -> float:
    """Factor that makes the covariance of the closest ``share`` of normal rows that of all of them."""
    return 1.0 if share >= 0.999 else share / max(_cdf7(chi_square_quantile(share)), 1e-9)


def estimate(moments: pd.DataFrame, support: float, share: float | None = None) -> pd.DataFrame:
    """Mean and precision of one group from the moments of its closest bins (at most HIGH_BIN - LOW_BIN + 1 rows).

    The bins hold ``support`` of the rows; they stand for the closest ``share`` of all (that support if not given).
    """
    m = moments.sort_values("bin")
    counts = m["n"].to_numpy(float)
    take = min(int(np.searchsorted(np.cumsum(counts), support * counts.sum())) + 1, len(m))
    first, second, n = (np.array(m[c].tolist())[:take].sum(axis=0) for c in ("s1", "s2", "n"))
    mean = first / n
    cov = np.zeros((P, P))
    cov[np.triu_indices(P)] = second / n
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    cov = cov * widening(n / counts.sum() if share is None else share) + np.diag(np.square(FLOOR))
    # The sums are of x less the group's first centre, which is added again.
    centre = np.array(m["centre"].iloc[0])
    return pd.DataFrame({"_group": [m["_group"].iloc[0]], "mean": [mean + centre], "precision": [np.linalg.inv(cov).ravel()], "centre": [centre]})


_PARAMS = "_group string, mean array<double>, precision array<double>, centre array<double>"


def first_estimates(rows: DataFrame) -> DataFrame:
    """Medians and quartile spreads of each group, read off counts by group, statistic and fine bin."""
    cells = rows.select("_group", F.posexplode("x").alias("dim", "v")).select("_group", "dim", F.floor(F.col("v") * 64).cast("int").alias("cell"))
    counts = cells.groupBy("_group", "dim", "cell").agg(F.count("*").alias("n"))

    def start(t: pd.DataFrame) -> pd.DataFrame:
        mid, spread = np.zeros(P), np.ones(P)
        for k, part in t.groupby("dim"):
            part = part.sort_values("cell")
            run = np.cumsum(part["n"].to_numpy())
            q = [part["cell"].iloc[int(np.searchsorted(run, s * run[-1]))] / 64 for s in (0.25, 0.5, 0.75)]
            mid[k], spread[k] = q[1], (q[2] - q[0]) / 1.349
        return pd.DataFrame({"_group": [t["_group"].iloc[0]], "mean": [mid], "precision": [np.diag(1 / (spread**2 + np.square(FLOOR))).ravel()], "centre": [mid]})

    return counts.groupBy("_group").applyInPandas(start, _PARAMS)


def _moments(at: DataFrame) -> DataFrame:
    """Sums by group and bin of rows with x, centre and bin."""
    c = [F.col("x")[i] - F.col("centre")[i] for i in range(P)]
    sums = {f"a{i}": F.sum(c[i]) for i in range(P)} | {f"b{i}_{j}": F.sum(c[i] * c[j]) for i in range(P) for j in range(i, P)}
    moments = at.groupBy("_group", "bin").agg(F.count("*").alias("n"), F.first("centre").alias("centre"), *[v.alias(k) for k, v in sums.items()])
    return moments.select("_group", "bin", "n", "centre", F.array(*[f"a{i}" for i in range(P)]).alias("s1"), F.array(*[f"b{i}_{j}" for i in range(P) for j in range(i, P)]).alias("s2"))


def concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One concentration step over all rows."""
    at = rows.join(broadcast_if_small(params), "_group").withColumn("d2", distance())
    b = F.floor(F.log(F.col("d2") + 1e-9) * BINS_PER_E).cast("int")
    binned = at.withColumn("bin", F.least(F.greatest(b, F.lit(LOW_BIN)), F.lit(HIGH_BIN)))
    return _moments(binned).groupBy("_group").applyInPandas(lambda m: estimate(m, SUPPORT), _PARAMS)


def reweighted(rows: DataFrame, params: DataFrame) -> DataFrame:
    """The estimate from all rows at usual distances."""
    at = rows.join(broadcast_if_small(params), "_group").where(distance() <= chi_square_quantile(USUAL)).withColumn("bin", F.lit(0))
    return _moments(at).groupBy("_group").applyInPandas(lambda m: estimate(m, 1.0, USUAL), _PARAMS)


def reject_outliers(docs: DataFrame) -> DataFrame:
    """The measured documents with ``distance2`` and ``kept``."""
    rows = staged(fit_groups(staged(measured(docs))).withColumn("x", transformed()))
    fitted = rows.where(~F.col("base_failed")).select("_group", "x")
    params = staged(first_estimates(fitted))  # a row per group
    for _ in range(STEPS):
        params = staged(concentrate(fitted, params))
    params = staged(reweighted(fitted, params))
    d2 = F.when(F.col("base_failed"), F.lit(None)).otherwise(distance())
    judged = rows.join(broadcast_if_small(params), "_group", "left").withColumn("distance2", F.round(d2, 3))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True))).drop("x", "mean", "precision", "centre")


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    judged = reject_outliers(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", *_STATS, "base_failed", "kept", "distance2")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
