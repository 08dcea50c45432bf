"""Scalar text functions, as Column expressions."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sableframe.functions.rules import DATE_FORMS, DEFAULT_DATE_FORM, JAVA, LABELS, PATTERNS

FROM = " ‘’“”–—·"
TO = " ''\"\"---"
DROPPED = "​‎‏﻿"
PLAIN = dict(zip(FROM, TO, strict=True))
_BLANKS = r"[\s\x1c-\x1f]+"


def nfc(text: Column) -> Column:
    """Canonical composition, by an Arrow function (Spark has none of its own)."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return compose(text)


def normalized(text: Column, composed: bool = True) -> Column:
    """Composed text with plain quotes, dashes and spaces, no invisible marks, and single blanks."""
    base = nfc(text) if composed else text
    plain = F.translate(F.replace(base, F.lit("…"), F.lit("...")), FROM + DROPPED, TO)
    return F.trim(F.regexp_replace(plain, "(?U)" + _BLANKS, " "))


def is_link(text: Column) -> Column:
    """Whether the text begins with a URL or an e-mail address."""
    return text.rlike(f"^(?:{PATTERNS['URL']})") | text.rlike(f"^(?:{JAVA[PATTERNS['EMAIL']]})")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def running(lengths: Column, chunk: int = 256) -> Column:
    """The sum of all lengths before each one. Sums grow within chunks, so that long arrays are not copied for every element."""
    step = lambda at: F.struct(at.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda s, n: F.struct((s["at"] + n).cast("int").alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def whole(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / chunk).cast("int") - 1, F.lit(0))), lambda k: F.slice(x, k * chunk + 1, F.lit(chunk)))
        sums = lambda p: F.transform(p, lambda c: F.aggregate(c, F.lit(0), lambda a, n: (a + n).cast("int")))
        before = lambda p: F.aggregate(sums(p), step(F.lit(0)), add, lambda s: s["out"])
        return let(parts, lambda p: let(before(p), lambda b: F.flatten(F.transform(p, lambda c, k: F.aggregate(c, step(F.get(b, k)), add, lambda s: s["out"])))))

    short = lambda x: F.aggregate(x, step(F.lit(0)), add, lambda s: s["out"])
    return let(lengths.cast("array<int>"), lambda x: F.when(F.size(x) <= chunk, short(x)).otherwise(whole(x)))


def pseudonym(label: Column, n: Column) -> Column:
    """The quoted stand-in of a label's n-th name (from 0): numbers, or letters with an A for each 26 (rounded half to even)."""
    described = F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v[0])])
    letters = [k for k, v in LABELS.items() if v[1] == "str"]
    text = F.concat(F.repeat(F.lit("A"), F.bround(n / 26.0).cast("int")), F.char(F.lit(65) + n % 26))
    return F.concat(F.lit('"'), F.try_element_at(described, label), F.lit(" "), F.when(label.isin(letters), text).otherwise((n + 1).cast("string")), F.lit('"'))


def date_form(text: Column) -> Column:
    """The form of a date, by the first pattern that its beginning matches."""
    out = F.when(F.lit(False), F.lit(""))
    for pattern, form in DATE_FORMS:
        out = out.when(text.rlike(f"(?i)^(?:{pattern})"), F.lit(form))
    return out.otherwise(F.lit(DEFAULT_DATE_FORM))


def acronym_of(short: Column, long_form: Column) -> Column:
    """Whether the words of ``long_form`` (array) begin with the letters of ``short``."""
    initials = F.array_join(F.transform(long_form, lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.upper(short) == F.regexp_replace(initials, r"(?U)[^\w]", "")


def intersection_area(a: Column, b: Column) -> Column:
    """Common area of two boxes (x0, y0, x1, y1)."""
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection_area(a, b)
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    union = area(a) + area(b) - both
    return F.when(union == 0, F.lit(0.0)).otherwise(both / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays of equal length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
