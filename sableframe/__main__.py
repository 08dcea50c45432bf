"""Redacts a table or folder of texts: ``spark-submit ... -m sableframe -i INPUT -o OUTPUT``.

One input (``-i`` a Parquet table with a text column, or ``-t`` a folder of text files, a row per file) gives one
Parquet table with the columns of the input, ``spans`` and ``masked``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    """The options; two inputs at once, or none, end the program with status 2."""
    parser = argparse.ArgumentParser(prog="sableframe", description="Finds and masks personal data in texts.")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("-i", "--input", help="a Parquet table")
    source.add_argument("-t", "--text-folder", help="a folder of .txt files")
    parser.add_argument("-o", "--output", required=True, help="where the result is written, as Parquet")
    parser.add_argument("-c", "--column", default="text", help="the column of the texts")
    parser.add_argument("-r", "--reconstruct", action="store_true", help="also write the redacted lines and their neighbours, below OUTPUT_lines")
    return parser.parse_args(given)


def lines_of(found: DataFrame, column: str) -> DataFrame:
    """Redacted lines and their neighbours of texts that have an ``_id``."""
    from sableframe.operators import layout, redaction, spans

    rows = layout.paragraphs(layout.lines(found.select(F.col("_id").alias("doc_id"), F.col(column).alias("text"))))
    texts = rows.select("doc_id", "paragraph", "paragraph_line", "line_text")
    hit = spans.detect(texts, "line_text").select("doc_id", "paragraph", "paragraph_line", F.explode(spans.resolved(F.col("line_text"), spans.aligned(F.col("line_text"), F.col("spans")))).alias("s"))
    return redaction.redacted_lines(hit.select("doc_id", "paragraph", "paragraph_line", "s.start", "s.end"), rows)


def main(given: list[str] | None = None) -> None:
    from sableframe.streaming.detect import masked_stream

    a = arguments(given)
    spark = SparkSession.builder.getOrCreate()
    if a.input:
        docs = spark.read.parquet(a.input)
    else:
        files = spark.read.text(a.text_folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[tT][xX][tT]")
        docs = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias(a.column))
    masked_stream(docs, a.column).write.mode("errorifexists").parquet(a.output)
    if a.reconstruct:
        done = spark.read.parquet(a.output).withColumn("_id", F.sha2(F.col(a.column), 256)).dropDuplicates(["_id"])
        lines_of(done, a.column).write.mode("errorifexists").parquet(a.output.rstrip("/") + "_lines")


if __name__ == "__main__":
    main()
