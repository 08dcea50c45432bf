"""Redaction of lines: widths, marks no wider than what they cover, runs of names, rectangles, and the commands that draw them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sableframe.functions.rules import OTHER_WIDTH, WIDTHS
from sableframe.functions.text import let, running
from sableframe.operators.geometry import box
from sableframe.operators.spans import matches

MARK, MARK_WIDTH, RUN_GAP, FLAT, MARGIN = "x", 500, 3, 0.01, 0.2


def text_width(text: Column) -> Column:
    """Width of a text in thousandths of its size: every character is mapped to the letter of its width, and letters are counted."""
    letters = {w: chr(0xE000 + k) for k, w in enumerate(WIDTHS)}  # private characters, which count as others themselves
    private = "".join(letters.values())
    source = "".join(WIDTHS.values())
    target = "".join(letters[w] * len(chars) for w, chars in WIDTHS.items())
    classes = F.regexp_replace(F.translate(F.translate(text, private, ""), source, target), f"[^{private}]+", "")

    def width(c: Column) -> Column:
        counted = F.length(text).cast("long") * OTHER_WIDTH
        for w, letter in letters.items():
            counted = counted + F.regexp_count(c, F.lit(letter)) * (w - OTHER_WIDTH)
        return counted

    return let(classes, width)


def mark_for(old: Column, mark: str = MARK) -> Column:
    """As many marks as the text is long, less those that would make it as wide as the text or wider."""
    fits = F.floor((text_width(old) - 1) / F.lit(MARK_WIDTH)).cast("int")
    return F.repeat(F.lit(mark), F.greatest(F.least(F.length(old), fits), F.lit(0)))


def redacted(text: Column, subs: Column, mark: str = MARK) -> Column:
    """A line with its spans (array of start, end) replaced by marks, from the last to the first. Empty spans change nothing."""
    last_first = F.array_sort(subs, lambda a, b: b["start"] - a["start"])

    def cover(t: Column, s: Column) -> Column:
        old = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        return F.concat(F.substring(t, F.lit(1), s["start"]), mark_for(old, mark), F.substring(t, s["end"] + 1, F.length(t)))

    return F.aggregate(last_first, text, cover)


def redacted_lines(subs: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines that are redacted, with their marks, and the lines before and after one in its paragraph as they are.

    ``subs`` (key, paragraph, paragraph_line, start, end within the line), ``rows`` the lines of paragraphs.
    One shuffle by document serves the grouping and the join; a line's neighbours are found by window.
    """
    at = [key, "paragraph", "paragraph_line"]
    spans = subs.groupBy(*at).agg(F.collect_list(F.struct("start", "end")).alias("_subs"))
    w = Window.partitionBy(key, "paragraph").orderBy("paragraph_line")
    hit = F.coalesce(F.size("_subs"), F.lit(0)) > 0
    flagged = rows.join(spans, at, "left").withColumn("is_redacted", hit)
    near = F.col("is_redacted") | F.coalesce(F.lag("is_redacted").over(w), F.lit(False)) | F.coalesce(F.lead("is_redacted").over(w), F.lit(False))
    made = flagged.withColumn("_near", near).where("_near")
    return made.withColumn("redacted_text", F.when(F.col("is_redacted"), redacted(F.col("line_text"), F.col("_subs"))).otherwise(F.col("line_text"))).drop("_subs", "_near")


def merged_runs(subs: DataFrame, keys: list[str], label: str = "ORG", gap: int = RUN_GAP) -> DataFrame:
    """Substitutes of a line (keys, label, old_val, new_val, start, end, line_text) where a name that follows itself within ``gap`` is one run.

    Only names of ``label`` form runs; a closing parenthesis right after a run belongs to it. Adds ``ord``: other labels first, each by start.
    """
    w = Window.partitionBy(*keys, "label").orderBy("start", "end")
    before = lambda c: F.lag(c).over(w)
    goes_on = (F.col("label") == label) & (F.col("old_val") == before("old_val")) & (F.col("new_val") == before("new_val")) & (F.col("start") - before("end") <= gap)
    islands = subs.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(*keys, "label", "_run").agg(F.first("old_val").alias("old_val"), F.first("new_val").alias("new_val"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.first("line_text").alias("_t"))
    closed = (F.col("n") > 1) & (F.substring("_t", F.col("end") + 1, F.lit(1)) == ")")
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("label") == label, "start", "label"))
    return runs.withColumn("end", F.when(closed, F.col("end") + 1).otherwise(F.col("end"))).withColumn("ord", order).drop("_run", "_t")


def occurrences(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """All places in a line (keys, line_text) where a value (keys, old_val) stands, in any case: start, end. Empty values have none."""
    paired = rows.join(values.where("old_val <> ''").select(*keys, "old_val").distinct(), keys)
    low, value = F.lower("line_text"), F.lower("old_val")
    pieces = F.split(low, F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    found = paired.select(*keys, "line_text", "old_val", F.posexplode(F.slice(F.transform(pieces, lambda p: F.length(p)), 1, F.size(pieces) - 1)).alias("_i", "_gap"))
    w = Window.partitionBy(*keys, "old_val").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("_gap").over(w) + F.col("_i") * F.length("old_val")
    return found.withColumn("start", start.cast("int")).select(*keys, "old_val", "start", (F.col("start") + F.length("old_val")).alias("end"))


def flat_rect(rect: Column, offset: float = FLAT) -> Column:
    """A rectangle drawn in to a strip around the middle of its height, so that deleting below it spares neighbours."""
    middle = rect["y0"] + (rect["y1"] - rect["y0"]) / 2
    return box(rect["x0"], middle - offset, rect["x1"], middle + offset)


def drawn_rect(rect: Column, line: Column) -> Column:
    """What is painted: as wide as the rectangle, as high as its line."""
    return box(rect["x0"], line["y0"], rect["x1"], line["y1"])


def tight_rect(rect: Column, origin_y: Column, size: Column, ascender: Column, descender: Column) -> Column:
    """A span's box with the height of its font: from the baseline up by the ascender and down by the descender."""
    high = ascender - descender
    top = origin_y - size * ascender / high
    return box(rect["x0"], top, rect["x1"], top + size)


def span_offsets(texts: Column) -> Column:
    """Offsets of a line's spans in its text: (text, start, end)."""
    return F.zip_with(texts, running(F.transform(texts, lambda t: F.length(t))), lambda t, at: F.struct(t.alias("text"), at.alias("start"), (at + F.length(t)).alias("end")))


def line_box(boxes: Column) -> Column:
    """A line's box: left and top of its first span, right of its last, bottom of the lowest. Null without spans."""
    first, last = F.get(boxes, 0), F.get(boxes, F.size(boxes) - 1)
    return F.when(F.size(boxes) > 0, box(first["x0"], first["y0"], last["x1"], F.array_max(F.transform(boxes, lambda b: b["y1"]))))


def spans_touched(spans: Column, start: Column, end: Column) -> Column:
    """A line's spans (text, start, end) that share characters with a range."""
    return F.filter(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def draw_commands(rects: DataFrame, texts: DataFrame, keys: list[str], color: str = "0,0,0") -> DataFrame:
    """What a renderer must do, in order (keys, step, op, x0, y0, x1, y1, color, text).

    First the strips of ``rects`` (keys, rect, line_box) are deleted; then the background of the lines of ``texts``
    (keys, box, text, background) is filled and their text written; the rectangles are painted last.
    """
    part = lambda df, step, op, b, col, text: df.select(*keys, F.lit(step).alias("step"), F.lit(op).alias("op"), *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")], col.alias("color"), text.alias("text"))
    none = F.lit(None).cast("string")
    b = F.col("box")
    wider = box(b["x0"] - MARGIN, b["y0"] - MARGIN, b["x1"] + MARGIN, b["y1"] + MARGIN)
    steps = [
        part(rects, 1, "delete", flat_rect(F.col("rect")), F.lit(color), none),
        part(texts, 2, "fill", wider, F.col("background"), none),
        part(texts, 3, "write", b, none, F.col("text")),
        part(rects, 4, "paint", drawn_rect(F.col("rect"), F.col("line_box")), F.lit(color), none),
    ]
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def black_or_white(pixels: Column, threshold: int = 200) -> Column:
    """Grey values: black below the threshold, else white."""
    return F.transform(pixels, lambda p: F.when(p < threshold, 0).otherwise(255))


def accepted_reading(candidates: Column, enough: float = -0.05, like: float = 0.95, keep_empty: bool = True) -> Column:
    """The best reading (array of text, score, likeness) if its score and likeness are above the limits; of equals the first. Else null."""
    keyed = F.transform(candidates, lambda c, i: F.struct(c["score"].alias("score"), (-i).alias("neg"), c.alias("c")))
    ok = F.filter(keyed, lambda k: (k["score"] > enough) & (k["c"]["likeness"] > like) & ((k["c"]["text"] != "") | F.lit(keep_empty)))
    return F.array_max(F.transform(ok, lambda k: F.struct(k["c"]["likeness"].alias("likeness"), k["neg"].alias("neg"), k["c"]["text"].alias("text"))))["text"]


def value_spans(text: Column, pattern: str, label: str) -> Column:
    """Matches of a pattern as (start, end), for use with :func:`redacted`."""
    return F.transform(matches(text, pattern, label, 0), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
