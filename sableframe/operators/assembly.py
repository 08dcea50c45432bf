"""From detections to what is redacted: entities of normalised text carried to the raw text, and rectangles of texts, images and drawings united by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sableframe.functions.rules import DATE_RULE, RuleBook
from sableframe.functions.text import normalized
from sableframe.operators import geometry, layout, matching, similarity, spans

LEAST_RATIO, CORNERS = 0.95, ("x0", "y0", "x1", "y1")


def carried(rows: DataFrame, keys: list[str], text: str, book: RuleBook | None = None, least: float = LEAST_RATIO) -> DataFrame:
    """Entities of the normalised text with their place in the raw text: keys, label, rank, start, end, ent, raw_start, raw_end, ratio, placed.

    Where the raw text holds the entity as it is, that is its first occurrence (:func:`redaction.occurrences` finds the others); else the
    first window that normalising makes the entity of, else the one that is most like it. ``placed`` is false for windows less like it than ``least``, which must not be taken for its place, but
    such rows are returned, so that nothing found is lost in silence. A null text has no entities.
    """
    found = spans.detect(rows.select(*keys, F.col(text).alias("_raw")).withColumn("_plain", normalized(F.col("_raw"))), "_plain", book)
    one = found.select(*keys, "_raw", "_plain", F.explode("spans").alias("s"))
    ents = one.select(*keys, "_raw", "s.label", "s.rank", "s.start", "s.end", F.substring("_plain", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("ent"))
    at = ents.withColumn("_at", matching.boundaries(F.col("_raw"), F.col("ent"), spelled=True))
    placed = F.coalesce(F.col("_at.ratio") >= least, F.lit(False))
    return at.select(*keys, "label", "rank", "start", "end", "ent", F.col("_at.start").alias("raw_start"), F.col("_at.end").alias("raw_end"), F.col("_at.ratio").alias("ratio"), placed.alias("placed"))


def substitutes(ents: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Substitutes of placed entities (as of :func:`carried`, by key and paragraph) on every line they touch.

    Names are numbered by label in the order of a document's paragraphs: key, paragraph, line, label, ent, new_val, in_line_start, in_line_end.
    """
    at = F.struct("paragraph", "start", "rank")
    named = ents.where("placed").select(key, "paragraph", "label", "ent", F.col("raw_start").alias("start"), F.col("raw_end").alias("end"), "rank")
    stand_ins = spans.pseudonyms(named.select(key, "label", "ent", at.alias("start"), "rank"), key).select(key, "label", "ent", "new_val").distinct()
    same = [F.col(f"n.{c}") == F.col(f"s.{c}") for c in (key, "label", "ent")]
    both = named.alias("n").join(stand_ins.alias("s"), same[0] & same[1] & same[2]).select("n.*", "s.new_val")
    touched = layout.entity_lines(both.distinct(), rows, key)
    return touched.select(key, "paragraph", "line", "label", "ent", "new_val", "in_line_start", "in_line_end").distinct()


def image_redactions(lines: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Where the page is covered for lines read from images: those with an entity of any rule, dates among them.

    ``lines`` (path, ord, line_text, x0 to y1 in the image), ``images`` (path, ord, width, height, rect, and the keys of its page); of an
    image that lies on several places the first counts. Returns keys, ord, x0 to y1 on the page.
    """
    book = RuleBook()
    book.register("DATE", DATE_RULE)
    hit = spans.detect(lines.select("path", "ord", "line_text", *CORNERS), "line_text", book).where(F.size("spans") > 0)
    first = similarity.first_by(images.select("path", F.col("ord").alias("_place"), "width", "height", "rect", *keys), ["path"], ["_place"])
    on = geometry.on_page(geometry.box(*map(F.col, CORNERS)), F.col("rect"), F.col("width"), F.col("height"))
    return hit.join(first, "path").withColumn("_on", on).select(*keys, "ord", *[F.col(f"_on.{c}").alias(c) for c in CORNERS])


def drawing_redactions(predictions: DataFrame, drawings: DataFrame, keys: list[str]) -> DataFrame:
    """The boxes of drawings that are predicted to be signatures.

    ``predictions`` (path, is_signature; null is false), ``drawings`` (path, ord, x0 to y1, and the keys of its page); the first drawing of a path counts.
    """
    first = similarity.first_by(drawings.select("path", "ord", *CORNERS, *keys), ["path"], ["ord"])
    return first.join(predictions.where("is_signature").select("path").distinct(), "path", "left_semi").select(*keys, "ord", *CORNERS)


def page_redactions(texts: DataFrame, images: DataFrame, drawings: DataFrame, keys: list[str]) -> DataFrame:
    """All rectangles of a page (each part: keys, ord, x0 to y1), texts first, then images, then drawings, with those that overlap merged."""
    part = lambda df, k: df.select(*keys, F.lit(k).alias("_part"), "ord", *[F.col(c).cast("double").alias(c) for c in CORNERS])
    every = part(texts, 0).unionByName(part(images, 1)).unionByName(part(drawings, 2))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("_part", "ord", *CORNERS))
    return geometry.merge_overlapping(every.withColumn("ord", order), keys)
