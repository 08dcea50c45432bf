"""Lines, paragraphs and their geometry, for texts that come without a layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_LINES, PITCH, HEIGHT, BREAK, GAP = 50, 14, 10, 6, 5.0


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per line with its page and vertical extent.

    Lines lie PITCH apart on pages of PAGE_LINES; after a line that ends in a full stop the next lies BREAK lower.
    """
    rows = docs.select(key, F.posexplode(F.split("text", "\n", -1)).alias("line", "line_text"))
    page = F.floor(F.col("line") / PAGE_LINES).cast("int")
    stops = F.sum(F.when(F.col("line_text").endswith("."), 1).otherwise(0)).over(Window.partitionBy(key, "page").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("page", page).withColumn("y0", (PITCH * (F.col("line") % PAGE_LINES) + BREAK * F.coalesce(stops, F.lit(0))).cast("double"))
    return placed.withColumn("y1", F.col("y0") + HEIGHT)


def paragraphs(rows: DataFrame, key: str = "doc_id", gap: float = GAP) -> DataFrame:
    """Adds paragraph, its line index, and each line's offsets in the paragraph's text; empty lines are left out."""
    full = rows.where("line_text <> ''")
    w = Window.partitionBy(key).orderBy("page", "y1", "line")
    new = (F.col("y0") - F.lag("y1").over(w) > gap) | (F.col("page") != F.lag("page").over(w))
    grouped = full.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("paragraph", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    p = Window.partitionBy(key, "paragraph").orderBy("page", "y1", "line")
    start = F.coalesce(F.sum(F.length("line_text") + 1).over(p.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = grouped.withColumns({"paragraph_line": F.row_number().over(p) - 1, "line_start": start.cast("int")})
    return at.withColumn("line_end", F.col("line_start") + F.length("line_text")).drop("_new")


def by_text(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``first_line`` and ``n_equal`` of the lines of a page with the same text, and ``position``: lines at the same height are ordered by the first line of their text."""
    same = Window.partitionBy(key, "page", "line_text")
    known = rows.withColumns({"first_line": F.min("line").over(same), "n_equal": F.count("*").over(same)})
    return known.withColumn("position", F.row_number().over(Window.partitionBy(key, "page").orderBy("y1", "first_line", "line")) - 1)


def paragraph_texts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per paragraph: its lines joined by a space."""
    said = F.array_sort(F.collect_list(F.struct("paragraph_line", "line_text")))
    return rows.groupBy(key, "paragraph").agg(F.array_join(F.transform(said, lambda s: s["line_text"]), " ").alias("paragraph_text"), F.count("*").alias("n_lines"))


def entity_lines(ents: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Entities of paragraphs with each line that they share characters with, and their part of it.

    An entity that runs over a line's end has a row for every line it touches, so none of it stays when lines are redacted.
    """
    touch = (F.col("e.start") < F.col("l.line_end")) & (F.col("l.line_start") < F.col("e.end"))
    same = (F.col(f"e.{key}") == F.col(f"l.{key}")) & (F.col("e.paragraph") == F.col("l.paragraph"))
    first, last = F.greatest("e.start", "l.line_start"), F.least("e.end", "l.line_end")
    return ents.alias("e").join(rows.alias("l"), same & touch).select("e.*", "l.line", "l.page", (first - F.col("l.line_start")).alias("in_line_start"), (last - F.col("l.line_start")).alias("in_line_end"))


def neighbour_lines(hit: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines that are redacted, and those just before and after one in its paragraph."""
    near = hit.select(key, "paragraph", "paragraph_line").distinct().select(key, "paragraph", F.explode(F.array(F.col("paragraph_line") - 1, F.col("paragraph_line"), F.col("paragraph_line") + 1)).alias("paragraph_line")).distinct()
    return rows.join(near, [key, "paragraph", "paragraph_line"])
