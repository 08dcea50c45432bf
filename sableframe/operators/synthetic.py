"""Made-up variants of annotated examples: placeholders, made-up values with re-based offsets, parts of addresses, checks of rephrased texts.

Annotations are arrays of (start, end, label) within the example's own text, so all of it is done inside the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sableframe.functions.rules import PLACEHOLDER_WORDS
from sableframe.functions.text import date_form, let

ANNOTS = "array<struct<start:int,end:int,label:string>>"
#: Values that stand for real ones, by label.
VALUES = {
    "LOC": ("Andorra", "Botswana", "Chile", "Denmark", "Estonia", "Fiji", "Ghana", "Honduras"),
    "ORG": ("Alder and Sons", "Birch Ltd", "Cedar Group", "Elm Partners", "Fir Works", "Hazel Inc", "Larch Foods", "Maple Lines"),
    "PERSON": ("Ada Brook", "Ben Field", "Cora Hill", "Dan Lake", "Eve Marsh", "Finn Moor", "Gwen Shore", "Hugh Vale"),
    "POST_CODE": ("10017", "20134", "30290", "40356", "50481", "60522", "70693", "80748"),
    "ADDR": ("1 Quay Row, Ashby, 10017", "22 Mill Lane, Barrow, 20134", "3 High Street, Corby, 30290", "48 Station Road, Derby, 40356"),
}
#: How a date is written by Spark, for each form.
_WRITTEN = {"%B %d": "MMMM dd", "%B %d, %Y": "MMMM dd, yyyy", "%Y %B %d": "yyyy MMMM dd", "%d %B %Y": "dd MMMM yyyy", "%d/%m/%Y": "dd/MM/yyyy", "%Y-%m-%d": "yyyy-MM-dd"}


def without_parts(annots: Column) -> Column:
    """Annotations by start, without places and post codes that lie inside an address."""
    whole = F.filter(annots, lambda a: a["label"] == "ADDR")
    part = lambda a: a["label"].isin("LOC", "POST_CODE") & F.exists(whole, lambda w: (a["start"] >= w["start"]) & (a["end"] <= w["end"]))
    return F.array_sort(F.filter(annots, lambda a: ~part(a)))


def _word(label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in PLACEHOLDER_WORDS.items() for x in pair]), label)


def placeholders(text: Column, annots: Column) -> Column:
    """(text, values): annotated spans replaced by ``[Word<k>]``, k counting a label's spans from 1, and the (label, k, value, form) that they stand for.

    ``form`` is a date's form, else null. Annotations of labels without a word are left in place.
    """
    kept = F.filter(without_parts(annots), lambda a: a["label"].isin(list(PLACEHOLDER_WORDS)))

    def number(kept: Column, a: Column, i: Column) -> Column:
        k = F.size(F.filter(F.slice(kept, 1, i + 1), lambda b: b["label"] == a["label"]))
        value = F.substring(text, a["start"] + 1, a["end"] - a["start"])
        form = F.when(a["label"] == "DATE", date_form(value))
        return F.struct(a["label"].alias("label"), k.alias("k"), value.alias("value"), form.alias("form"), a["start"].alias("start"), a["end"].alias("end"))

    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(s: Column, v: Column) -> Column:
        mark = F.concat(F.lit("["), _word(v["label"]), v["k"].cast("string"), F.lit("]"))
        return F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, F.greatest(v["start"] - s["at"], F.lit(0))), mark).alias("out"), v["end"].alias("at"))

    def both(numbered: Column) -> Column:
        said = F.aggregate(numbered, first, put, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
        values = F.transform(numbered, lambda v: F.struct(v["label"].alias("label"), v["k"].alias("k"), v["value"].alias("value"), v["form"].alias("form")))
        return F.struct(said.alias("text"), values.alias("values"))

    # Named by ``let``: an expression used within the steps of another is computed anew in each step.
    return let(let(kept, lambda some: F.transform(some, lambda a, i: number(some, a, i))), both)


def placeholder_spans(text: Column, values: Column) -> Column:
    """Placeholders in a (rephrased) text by start: (start, end, label, form); the i-th date takes the i-th stored form."""
    from sableframe.operators.spans import matches

    def of(label: str, word: str) -> Column:
        spans = matches(text, rf"(?i)\[{word}[0-9]+:?[^\]]*\]", label, 0)
        forms = F.filter(values, lambda v: v["label"] == label)
        made = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.get(forms, i)["form"].alias("form")))
        return F.when(F.size(forms) > 0, made).otherwise(F.array().cast("array<struct<start:int,end:int,label:string,form:string>>"))

    found = [of(label, word) for label, word in PLACEHOLDER_WORDS.items()]
    return F.array_sort(F.concat(*found))


def made_up(label: Column, form: Column, *seed: Column) -> Column:
    """A made-up value of a label, the same for the same seed (the md5 of the seed's parts)."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", *[s.cast("string") for s in seed])), 1, 8), 16, 10).cast("long")
    day = F.date_add(F.lit("1990-01-01").cast("date"), (drawn % 10000).cast("int"))
    out = F.when(F.lit(False), F.lit(""))
    for name, values in VALUES.items():
        out = out.when(label == name, F.get(F.array(*map(F.lit, values)), (drawn % len(values)).cast("int")))
    for name, written in _WRITTEN.items():
        out = out.when((label == "DATE") & (form == name), F.date_format(day, written))
    return out.when(label == "DATE", F.date_format(day, "dd/MM/yyyy"))


def address_parts(address: Column, start: Column) -> Column:
    """Spans of an address that begins at ``start``: each part between commas as LOC, and the last word of the last part as POST_CODE. Blank parts have none."""
    parts = F.split(address, ",", -1)

    def spans(p: Column, i: Column) -> Column:
        said = F.regexp_replace(p, r"^\s+|\s+$", "")
        before = F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, q: n + F.length(q) + 1)
        at = start + before + F.length(p) - F.length(F.regexp_replace(p, r"^\s+", ""))
        one = lambda a, b, label: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(label).alias("label"))
        end = at + F.length(said)
        code = F.length(F.regexp_extract(said, r"\S+$", 0))
        place = F.array(one(at, end, "LOC"))
        last = F.when(i == F.size(parts) - 1, F.concat(place, F.array(one(end - code, end, "POST_CODE")))).otherwise(place)
        return F.when(said == "", F.array().cast(ANNOTS)).otherwise(last)

    return F.flatten(F.transform(parts, spans))


def filled(text: Column, spans: Column, *seed: Column) -> Column:
    """(text, annots): placeholders (as from :func:`placeholder_spans`) replaced by made-up values, with the new offsets.

    An address also gets the spans of its parts.
    """
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.array().cast(ANNOTS).alias("annots"))

    def put(s: Column, p: Column) -> Column:
        def with_value(lead: Column, value: Column) -> Column:
            own = F.array(F.struct(F.length(lead).alias("start"), (F.length(lead) + F.length(value)).alias("end"), p["label"].alias("label")))
            parts = F.when(p["label"] == "ADDR", address_parts(value, F.length(lead))).otherwise(F.array().cast(ANNOTS))
            return F.struct(F.concat(lead, value).alias("out"), p["end"].alias("at"), F.concat(s["annots"], own, parts).alias("annots"))

        lead = F.concat(s["out"], F.substring(text, s["at"] + 1, p["start"] - s["at"]))
        return let(lead, lambda x: let(made_up(p["label"], p["form"], *seed, p["label"], p["start"]), lambda v: with_value(x, v)))

    rest = lambda s: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))).alias("text"), s["annots"].alias("annots"))
    return F.aggregate(spans, first, put, rest)


def marked(rows: DataFrame, wanted: Column) -> DataFrame:
    """Adds ``_m`` and ``_s``, the placeholders of the ``wanted`` examples and where they lie, which :func:`made` fills.

    They are columns of their own, so that they are computed once per row and not within each step of the filling.
    """
    said = rows.withColumn("_m", F.when(wanted, placeholders(F.col("text"), F.col("annots"))))
    return said.withColumn("_s", placeholder_spans(F.col("_m.text"), F.col("_m.values")))


def made() -> Column:
    """(text, annots): a :func:`marked` example with made-up values, by example_id and variant; null where it is not wanted."""
    return filled(F.col("_m.text"), F.col("_s"), F.col("example_id"), F.col("variant"))


def variants(examples: DataFrame, n: str | Column = "num_aug") -> DataFrame:
    """``n`` variants of each example (example_id, text, annots, and the count): placeholders filled with other values.

    A rephrasing step goes between :func:`placeholders` and :func:`filled`; without one, the words stay as they are.
    An example without annotations keeps its text.
    """
    count = F.col(n) if isinstance(n, str) else n
    # Placeholders are the same for all variants of an example.
    rows = marked(examples.withColumn("_n", count.cast("int")).where("_n > 0"), F.lit(True)).withColumn("variant", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return rows.withColumn("made", made()).select("example_id", "variant", F.col("made.text").alias("text"), F.col("made.annots").alias("annots"))


def kept_rephrasings(rows: DataFrame, key: str = "example_id", text: str = "text", score: str = "score", low: float = 0.85, high: float = 0.995) -> DataFrame:
    """Rephrased texts whose likeness to the original lies between the limits (both included), each once per example."""
    return rows.where(F.col(score).between(low, high)).dropDuplicates([key, text])
