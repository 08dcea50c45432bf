"""Detection on streams: the span operators keep no state, so the batch plan runs as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sableframe.functions.rules import RuleBook
from sableframe.operators.spans import aligned, detect, masked, resolved


def masked_stream(docs: DataFrame, text: str = "text", book: RuleBook | None = None) -> DataFrame:
    """``docs`` (batch or stream) with ``spans`` and ``masked``."""
    found = detect(docs, text, book)
    kept = found.withColumn("spans", resolved(F.col(text), aligned(F.col(text), F.col("spans"))))
    return kept.withColumn("masked", masked(F.col(text), F.col("spans")))


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that is there as Parquet, exactly once, and ends."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
