"""A corpus pipeline of five stages: quality, lines, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's documents. All but the last return the columns of ``documents``. ``labels`` is read by
the first stage alone, to learn from.

Defined results: a stage keeps rows with null ids, languages or sources; a null text is an empty text and is
judged as such. Empty documents give an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableframe.llm import line_dedup, mixing, near_duplicates, packing, quality_classifier
from sableframe.llm.staging import dropped, scratch, staged
from sableframe.llm.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with ``n_chars`` that of the text as it is now."""
    return df.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least one half."""
    ranking = quality_classifier.learn(docs, table(spark, sf_dir, "labels"))
    return _documents(quality_classifier.scored(docs, ranking).where("score >= 0.5"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are near an earlier line; documents of which no line with a word is left go."""
    made = line_dedup.dedup_lines(docs)
    return _documents(made.where("n_removed = 0 OR text RLIKE '[^ \\t-\\r]'"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return _documents(near_duplicates.keep_one(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by target weights; a document that is taken several times is as many rows."""
    return _documents(mixing.mix(docs))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_distinct),
    ("mixture", mix_sources),
    ("packing", pack_documents),
]

#: SQL can state neither the learnt scores nor the tokenizer's ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch():
            docs = staged(stage(spark, docs, sf_dir), keep=True)
        if last:
            dropped(spark, last)
        last = docs.inputFiles()[0].rsplit("/", 1)[0] if docs.inputFiles() else None
    return STAGES[-1][1](spark, docs, sf_dir)
