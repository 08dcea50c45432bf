"""Reading the input tables and shaping clashing columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the ASCII characters 0x20 and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(column: str | Column) -> Column:
    """A string that tells null from every value, for joins and groups in which null is a key."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c.cast("string")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, for use inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
