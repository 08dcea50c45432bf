"""Exact token counts by length histograms.

Documents are aggregated by encoded length; sums over the lengths above each one then answer totals,
quantiles and truncated totals for every context limit without another look at the texts.

Defined results: a null or empty text has length 0. Repeated rows count as often as they occur. An
empty table has an empty histogram; its totals are 0 and its quantiles null. Only the text is read, so
other columns and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sableframe.llm.staging import staged
from sableframe.llm.tables import table
from sableframe.llm.text_kernels import lean, tokenizer

#: Lengths that are summed together before sums of sums, so that no task orders all lengths.
SPAN = 1024


def encoded_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(length): one row per document."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for b in lean(batches):
            texts = b.column(0)
            for at in range(0, len(texts), 256):
                yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in encode(texts[at : at + 256].to_pylist())], pa.int64())], ["length"])

    return docs.select("text").mapInArrow(lengths, "length long")


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(length, n_docs), counted in part before the shuffle."""
    return encoded_lengths(docs, path).groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length L: n_docs and n_tokens of that length, docs_at_least, tokens_at_least, docs_at_most, and truncated_total: all tokens if every document is cut at L."""
    h = histogram.withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "_span": F.floor(F.col("length") / SPAN)})
    spans = h.groupBy("_span").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    above, everything = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    later = spans.select(
        "_span",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_tokens_above"),
        F.sum("_d").over(everything).alias("_docs"),
        F.sum("_t").over(everything).alias("_tokens"),
    )
    inside = Window.partitionBy("_span").orderBy(F.desc("length"))
    full = h.join(later, "_span").withColumns(
        {
            "docs_at_least": F.sum("n_docs").over(inside) + F.col("_docs_above"),
            "tokens_at_least": F.sum("n_tokens").over(inside) + F.col("_tokens_above"),
        }
    )
    return full.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_at_least",
        "tokens_at_least",
        (F.col("_docs") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_at_most"),
        (F.col("_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
    )


def totals(sums: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens and longest."""
    return sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.max("length").alias("longest"))


def quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, length): the least length that at least that share of the documents does not exceed."""
    n = F.col("docs_at_most") + F.col("docs_at_least") - F.col("n_docs")
    return sums.agg(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.min(F.when(F.col("docs_at_most") >= F.lit(float(s)) * n, F.col("length"))).alias("length")) for s in shares]).alias("q")).select(F.inline("q"))


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, tokens): all tokens if every document is cut at the limit, for any limits."""
    cut = [F.struct(F.lit(int(x)).cast("long").alias("limit"), F.coalesce(F.sum(F.least("length", F.lit(int(x))) * F.col("n_docs")), F.lit(0)).alias("tokens")) for x in limits]
    return sums.agg(F.array(*cut).alias("c")).select(F.inline("c"))


def op3_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of all documents with its suffix sums."""
    return suffix_sums(staged(length_histogram(table(spark, sf_dir, "documents"))))
