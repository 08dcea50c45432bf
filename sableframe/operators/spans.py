"""Entity spans: detection with offsets, token alignment, overlap resolution, pseudonyms and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sableframe.functions.rules import ACRONYM_RULE, DATE_RULE, DATE_TOKEN, JAVA, LABELS, NAME_RULES, NEEDS, PATTERNS, RuleBook
from sableframe.functions.text import let, pseudonym, running

SPAN = "array<struct<rank:int,label:string,start:int,end:int>>"
_MARK, _OTHER = "\uffff", "\ufffe"  # no characters of text; a mark in a text is taken for the other
_EDGE = r"[\s\p{P}!-/:-@\[-`{-~]"


def matches(text: Column, pattern: str, label: str, rank: int) -> Column:
    """All matches of a pattern with code-point offsets, in one pass: matches are set between marks, and the text is split at those."""
    java = JAVA.get(pattern, pattern)
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(_OTHER)), f"(?U){java}", f"{_MARK}$0{_MARK}")
    none = F.array().cast(SPAN)

    def spans(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda p: F.length(p))
        one = lambda at, n: F.struct(F.lit(rank).alias("rank"), F.lit(label).alias("label"), at.alias("start"), (at + n).alias("end"))
        found = F.zip_with(running(sizes), sizes, one)
        return F.filter(found, lambda s, i: i % 2 == 1)

    made = let(F.split(marked, _MARK, -1), lambda p: F.when(F.size(p) > 1, spans(p)).otherwise(none))
    return F.when(F.contains(text, F.lit(NEEDS[label])), made).otherwise(none) if pattern == PATTERNS.get(label) and label in NEEDS else made


def detect(docs: DataFrame, text: str = "text", book: RuleBook | None = None, only: str | tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``spans``, the matches of every rule (or of some labels). Stateless, so it runs on streams as well."""
    wanted = (only,) if isinstance(only, str) else only
    rules = [r for r in (book or RuleBook()).rules if wanted is None or r.label in wanted]
    source = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("spans", F.concat(*[matches(source, r.pattern, r.label, r.rank) for r in rules]))


def date_tokens(text: Column, rank: int = 0) -> Column:
    """Tokens (runs of letters, digits, ``_``, ``/`` and ``-``) that hold a date, as DATE. Texts without a date are not cut into tokens."""
    holds = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike(DATE_RULE)
    found = F.filter(matches(text, f"{DATE_TOKEN}+", "DATE", rank), holds)  # the second + makes the run possessive
    return F.when(text.rlike(DATE_RULE), found).otherwise(F.array().cast(SPAN))


def named(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``spans``: persons, organisations and places by rules, a stand-in where no model is given to the seam of named entities."""
    return detect(docs, text, RuleBook(NAME_RULES))


def acronym_tags(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tagged words (key, ord, tag, text, tok_start, tok_end, sent) of long forms with their short form in parentheses, as a model of acronyms gives them.

    A stand-in by a rule. The n-th match of a text is its n-th sentence, and its words are counted from 1000 n.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key, source.alias("_t"), F.posexplode(matches(source, ACRONYM_RULE, "", 0)).alias("sent", "s"))
    words = F.regexp_extract_all(F.substring("_t", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), F.lit("[A-Za-z]+"), F.lit(0))
    cut = rows.withColumn("_n", F.size(words)).select(key, "sent", "_n", F.posexplode(words).alias("_i", "text"))
    short, at = F.col("_i") == F.col("_n") - 1, F.col("sent") * 1000 + F.col("_i")
    at = at + F.when(short, 1).otherwise(0)  # the parenthesis is a token
    tag = F.when(short, "B-short").when(F.col("_i") == 0, "B-long").otherwise("I-long")
    return cut.select(key, at.alias("ord"), tag.alias("tag"), "text", at.alias("tok_start"), (at + 1).alias("tok_end"), "sent")


def aligned(text: Column, spans: Column) -> Column:
    """Spans that begin and end at token edges: their neighbours are missing, blank or punctuation, their own ends not blank."""
    char = lambda i: F.substring(text, i + 1, F.lit(1))
    edge = lambda c: (c == "") | c.rlike(f"(?U)^{_EDGE}$")
    blank = lambda c: c.rlike(r"(?U)^\s$")

    def keep(s: Column) -> Column:
        before = F.when(s["start"] == 0, F.lit("")).otherwise(char(s["start"] - 1))
        return edge(before) & edge(char(s["end"])) & ~blank(char(s["start"])) & ~blank(char(s["end"] - 1))

    return F.filter(spans, keep)


def resolved(text: Column, spans: Column) -> Column:
    """Spans without overlaps, folded rule by rule: of overlapping ones the longest in tokens, then the first, then the one found earlier stays."""
    ranks = F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["rank"])))
    tokens = lambda s: F.size(F.regexp_extract_all(F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit(r"(?U)\w+|[^\w\s]+"), F.lit(0)))

    def fold(kept: Column, rank: Column) -> Column:
        both = F.concat(kept, F.filter(spans, lambda s: s["rank"] == rank))
        keyed = F.transform(both, lambda s, i: F.struct((-tokens(s)).alias("size"), s["start"].alias("start"), i.alias("order"), s.alias("span")))
        free = lambda out, k: ~F.exists(out, lambda o: (o["start"] < k["span"]["end"]) & (k["span"]["start"] < o["end"]))
        return F.aggregate(F.array_sort(keyed), F.array().cast(SPAN), lambda out, k: F.when(free(out, k), F.concat(out, F.array(k["span"]))).otherwise(out))

    return F.array_sort(F.aggregate(ranks, F.array().cast(SPAN), fold), lambda a, b: a["start"] - b["start"])


def entities(docs: DataFrame, key: str = "doc_id", text: str = "text", spans: str = "spans") -> DataFrame:
    """One row per span: key, label, rank, start, end and the text."""
    rows = docs.select(key, F.col(text).alias("_text"), F.explode(spans).alias("s"))
    return rows.select(key, F.col("s.label").alias("label"), F.col("s.rank").alias("rank"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.substring(F.col("_text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("ent"))


def pseudonyms(ents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``ordinal`` (order in which a document's names of a label first occur) and the stand-in ``new_val``."""
    known = ents.where(F.col("label").isin(list(LABELS)))
    first = known.groupBy(key, "label", "ent").agg(F.min(F.struct("start", "rank")).alias("first"))
    order = first.withColumn("ordinal", F.dense_rank().over(Window.partitionBy(key, "label").orderBy("first", "ent")) - 1)
    named = order.withColumn("new_val", pseudonym(F.col("label"), F.col("ordinal"))).drop("first")
    return known.alias("e").join(named.alias("n"), F.col(f"e.{key}").eqNullSafe(F.col(f"n.{key}")) & (F.col("e.label") == F.col("n.label")) & (F.col("e.ent") == F.col("n.ent"))).select("e.*", "n.ordinal", "n.new_val")


def masked(text: Column, spans: Column, mark: str = "x") -> Column:
    """The text with every span overwritten by marks of its length."""
    def cover(t: Column, s: Column) -> Column:
        n = s["end"] - s["start"]
        return F.concat(F.substring(t, F.lit(1), s["start"]), F.repeat(F.lit(mark), n), F.substring(t, s["end"] + 1, F.length(t)))

    return F.aggregate(spans, text, cover)
