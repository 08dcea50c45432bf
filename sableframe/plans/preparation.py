"""Queries of redaction, matching and training examples, with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableframe.functions import text as T
from sableframe.functions.rules import DEFAULT_FONTS, LABELS, OTHER_WIDTH, PLACEHOLDER_WORDS, STOP_NAMES, WIDTHS
from sableframe.operators import examples, geometry, layout, matching, redaction, similarity, spans, synthetic
from sableframe.plans import catalog as base

NUMBER, NAME = r"[0-9]+", r"[A-Z][a-z]+"
KEYWORDS = ("@", "License", "license", "Copyright")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rows(values: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else _q(v) if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in values)


# Sentences and examples: a sentence with its numbers as ORG and its capitalised words as PERSON


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    return examples.sentences(_docs(spark, sf), "doc_id", "text")


_SENT_SQL = r"""
    SELECT doc_id, sent, (b + lead)::INT AS start, (b + lead + length(sentence))::INT AS "end", sentence FROM (
      SELECT doc_id, (i - 1)::INT AS sent, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
        length(p) - length(regexp_replace(p, '^\s+', '')) AS lead, regexp_replace(p, '^\s+|\s+$', '', 'g') AS sentence
      FROM (SELECT doc_id, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM documents))) WHERE sentence <> ''"""


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    s = _sentences(spark, sf).select("doc_id", F.concat_ws(":", "doc_id", "sent").alias("example_id"), F.col("sentence").alias("text"))
    found = F.concat(spans.matches(F.col("text"), NUMBER, "ORG", 0), spans.matches(F.col("text"), NAME, "PERSON", 1))
    return s.withColumn("annots", F.array_sort(F.transform(found, lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["label"].alias("label")))))


_EX_SQL = f"""x AS (SELECT doc_id, doc_id || ':' || sent AS k, sentence FROM ({_SENT_SQL})),
    a AS ({base._matches_sql('ORG', NUMBER, 0, 'x', 'k', 'sentence')} UNION ALL {base._matches_sql('PERSON', NAME, 1, 'x', 'k', 'sentence')}),
    n AS (SELECT k, label, start, (start + length(ent))::INT AS "end", ent, (row_number() OVER (PARTITION BY k, label ORDER BY start))::INT AS num,
      coalesce(lag(start + length(ent)) OVER (PARTITION BY k ORDER BY start), 0) AS before FROM a)"""
_WORD_SQL = "CASE label " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in PLACEHOLDER_WORDS.items()) + " END"


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf)


def keyword_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return examples.keyword_sentences(_docs(spark, sf), "doc_id", "text", list(KEYWORDS)).select("doc_id", "sent", "sentence")


def placeholder_text(spark: SparkSession, sf: str) -> DataFrame:
    marked = _examples(spark, sf).select("example_id", synthetic.placeholders(F.col("text"), F.col("annots")).alias("m"))
    return marked.select("example_id", F.col("m.text").alias("text"), F.size("m.values").alias("n_values"))


def placeholder_values(spark: SparkSession, sf: str) -> DataFrame:
    marked = _examples(spark, sf).select("example_id", F.explode(synthetic.placeholders(F.col("text"), F.col("annots"))["values"]).alias("v"))
    return marked.select("example_id", "v.label", "v.k", "v.value")


def placeholder_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Where the placeholders lie in the texts that have them."""
    marked = _examples(spark, sf).select("example_id", synthetic.placeholders(F.col("text"), F.col("annots")).alias("m"))
    found = marked.select("example_id", F.explode(synthetic.placeholder_spans(F.col("m.text"), F.col("m.values"))).alias("s"))
    return found.select("example_id", "s.label", "s.start", "s.end")


def made_up_variants(spark: SparkSession, sf: str) -> DataFrame:
    """One variant of every example with made-up values and the new offsets."""
    made = synthetic.variants(_examples(spark, sf), F.lit(1))
    return made.select("example_id", "variant", "text", F.size("annots").alias("n_annots"))


def made_up_values(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.explode(F.array(*map(F.lit, ["LOC", "ORG", "PERSON", "POST_CODE", "ADDR"]))).alias("label")
    return _docs(spark, sf).select("doc_id", kinds).select("doc_id", "label", synthetic.made_up(F.col("label"), F.lit(None).cast("string"), F.col("doc_id")).alias("value"))


def address_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the customers' addresses with their market segment and phone."""
    said = F.concat_ws(", ", F.coalesce("c_name", F.lit("")), F.coalesce("c_mktsegment", F.lit("")))
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.explode(synthetic.address_parts(said, F.lit(7))).alias("s"))
    return rows.select("c_custkey", "s.label", "s.start", "s.end")


def sentence_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences with the entities that they hold; those that one entity crosses are one."""
    found = base._aligned(spark, sf).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.label")
    return examples.sentence_examples(_sentences(spark, sf), found, "doc_id").select("doc_id", "sent", "start", "end", F.size("annots").alias("n_annots"))


def interleaved_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a number spread evenly among those without."""
    rows = _docs(spark, sf).select("doc_id", F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False)).alias("positive"))
    return examples.interleaved(rows, "doc_id", F.col("positive")).select("doc_id", "positive", "position")


def dataset_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf).select(F.col("doc_id").alias("example_id"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0)).alias("annots"))
    return examples.dataset(rows).select("example_id", "part", "position")


def balanced_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences balanced by their class, with made-up variants of the smaller classes."""
    return examples.balanced(_examples(spark, sf).select("example_id", "text", "annots")).select("example_id", "variant", "label", "text")


def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the benchmark's items with their offsets in the text joined by spaces."""
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.split("text", " ").alias("tokens"))
    at = rows.select("item_id", F.posexplode(examples.token_offsets(F.col("tokens"))).alias("ord", "o"))
    return at.select("item_id", "ord", "o.start", "o.end")


def bio_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the benchmark's items labelled by their length modulo 5; the last label is outside."""
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("example_id"), F.split("text", " ").alias("tokens"))
    tagged = rows.withColumn("labels", F.transform("tokens", lambda t: F.length(t) % 5))
    made = examples.bio_examples(tagged, ["B-short", "I-short", "B-long", "I-long"]).select("example_id", F.explode("annots").alias("a"))
    return made.select("example_id", "a.label", "a.start", "a.end")


def expanded_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in sentences widened to the words that hold them."""
    rows = _examples(spark, sf).select("example_id", F.explode(examples.expanded(F.col("text"), F.filter("annots", lambda a: a["label"] == "ORG"))).alias("a"))
    return rows.select("example_id", "a.start", "a.end")


def unknown_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of the word 'the' in the benchmark's items, as of a token that a vocabulary lacks."""
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.explode(examples.unknown_tokens(F.split("text", " "), "the")).alias("position"))
    return rows


# Matching


def entity_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Where each entity's text first lies in its document."""
    ents = spans.entities(base._aligned(spark, sf)).select("doc_id", "ent").distinct()
    rows = ents.join(_docs(spark, sf).select("doc_id", "text"), "doc_id").select("doc_id", "ent", matching.boundaries(F.col("text"), F.col("ent")).alias("b"))
    return rows.select("doc_id", "ent", "b.start", "b.end", "b.ratio")


def fuzzy_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of the normalised texts found again in the raw ones. Only texts that lack their sentence as it is go on to Python."""
    docs = _docs(spark, sf).select(F.struct("doc_id", "text").alias("doc"), T.normalized(F.col("text")).alias("text"))
    at = F.position(F.col("sentence"), F.col("doc.text"))
    rows = examples.sentences(docs, "doc", "text").select("doc.doc_id", "sent", F.col("sentence").alias("ent"), at.alias("at"), F.when(at == 0, F.col("doc.text")).alias("raw"))
    exact = F.struct((F.col("at") - 1).cast("int").alias("start"), (F.col("at") - 1 + F.length("ent")).cast("int").alias("end"), F.lit(1.0).alias("ratio"))
    found = rows.select("doc_id", "sent", "ent", F.when(F.col("at") > 0, exact).otherwise(matching.boundaries(F.col("raw"), F.col("ent"))).alias("b"))
    return found.select("doc_id", "sent", "ent", "b.start", "b.end", F.round("b.ratio", 6).alias("ratio"))


_INSTALLED = ("Arial", "Helvetica", "Times New Roman", "Courier New", "Symbol", "Liberation Sans", *DEFAULT_FONTS.values())
_WANTED = ("ArialMT", "Arial-BoldMT", "TimesNewRomanPSMT", "CourierNewPSMT", "Unknown-bold", "Unknown-italic", "Unknown")


def font_matches(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([(w,) for w in _WANTED], "font string")
    installed = spark.createDataFrame([(f, k) for k, f in enumerate(_INSTALLED)], "full_name string, ord int")
    other = spark.createDataFrame([("ArialMT", 1, "Helvetica"), ("ArialMT", 2, "Liberation Sans"), ("TimesNewRomanPSMT", 1, "Times New Roman")], "font string, place int, name string")
    return matching.match_fonts(wanted, installed, other).select("font", "match", F.round("weight", 6).alias("weight"))


def canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as the names of documents of 100: the first earlier one that is like each."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.select(F.floor(F.col("vec_id") / 100).cast("long").alias("doc_id"), F.col("vec_id").alias("start"), F.concat(F.lit("v"), "vec_id").alias("ent"), F.col("embedding").cast("array<double>").alias("vector"), F.lit(None).cast("array<array<double>>").alias("partners"))
    return similarity.canonical_names(rows)


def _named_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors as names of documents of 100, relations between each tenth and the next, and the last vectors of documents 0 to 9 as stop names."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.floor(F.col("vec_id") / 100).cast("long").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    ents = e.select("doc_id", F.col("vec_id").alias("start"), F.concat(F.lit("v"), "vec_id").alias("ent"), "vector")
    near = e.where("vec_id % 10 = 0").select("doc_id", F.concat(F.lit("v"), "vec_id").alias("long"), F.concat(F.lit("v"), F.col("vec_id") + 1).alias("short"))
    return ents, near, e.where("vec_id % 100 = 99 AND vec_id < 1000").select(F.col("vec_id").alias("cand_id"), F.col("vector").alias("cand_vector"))


def organisation_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-ins of names, with those that mean the same under one."""
    return similarity.organisation_pseudonyms(*_named_vectors(spark, sf))


_NAMED = (("HTML", "ORG"), ("Acme", "ORG"), ("10.0.0.1", "IPv4"), ("1/2/2020", "DATE"), ("SMTP", "PERSON"), ("IANA", "ORG"))


def processed_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that are processed: their label is known, and organisations are no stop names."""
    rows = spark.createDataFrame(list(_NAMED), "ent string, label string")
    return rows.where(F.col("label").isin(list(LABELS)) & ~((F.col("label") == "ORG") & F.col("ent").isin(list(STOP_NAMES))))


_READINGS = ((1, "abc", -0.01, 0.97), (1, "abd", -0.02, 0.99), (2, "x", -0.2, 0.99), (3, "y", -0.01, 0.95), (4, "", -0.01, 0.96), (5, "p", -0.01, 0.98), (5, "q", -0.01, 0.98))


def accepted_readings(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([(k, o, t, s, x) for o, (k, t, s, x) in enumerate(_READINGS)], "img int, ord int, text string, score double, likeness double")
    listed = rows.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "score", "likeness"))).alias("c"))
    return listed.select("img", redaction.accepted_reading(F.col("c")).alias("text"))


_SAID = ((1, "a", 0.9), (1, "a", 0.91), (1, "b", 0.85), (1, "c", 0.84), (1, "d", 0.996), (2, "a", 0.995))


def kept_rephrasings(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(list(_SAID), "example_id int, text string, score double")
    return synthetic.kept_rephrasings(rows).select("example_id", "text")


# Redaction


def text_widths(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", redaction.text_width(F.col("text")).alias("width"))


def _width_sql(text: str) -> str:
    return f"(length({text}) * {OTHER_WIDTH} + " + " + ".join(f"(length({text}) - length(translate({text}, {_q(c)}, ''))) * ({w - OTHER_WIDTH})" for w, c in WIDTHS.items()) + ")"


def _redacted(ents: DataFrame, rows: DataFrame) -> DataFrame:
    at = layout.entity_lines(ents, rows.select("doc_id", "paragraph", "line_start", "line_end", F.col("paragraph_line").alias("line"), "page"))
    subs = at.select("doc_id", "paragraph", F.col("line").alias("paragraph_line"), F.col("in_line_start").alias("start"), F.col("in_line_end").alias("end"))
    return redaction.redacted_lines(subs, rows)


def redacted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with phone numbers, those that run over a line's end too, redacted, and their neighbours as they are."""
    return _redacted(*base._paragraph_entities(spark, sf, ("PHONE",))).select("doc_id", "line", "is_redacted", "redacted_text")


def all_redacted_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with entities of any rule, redacted, and their neighbours as they are."""
    return _redacted(*base._all_paragraph_entities(spark, sf)).select("doc_id", "line", "is_redacted", "redacted_text")


_REDACTED_SQL = f"""{base._hits_sql("PHONE")},
    s AS (SELECT h.doc_id, h.line, h.a AS s, h.b AS e, o.line_text FROM h JOIN o ON h.doc_id = o.doc_id AND h.line = o.line),
    b AS (SELECT *, substr(line_text, s + 1, e - s) AS old, coalesce(lag(e) OVER (PARTITION BY doc_id, line ORDER BY s), 0) AS pe FROM s),
    r AS (SELECT doc_id, line, string_agg(substr(line_text, pe + 1, s - pe) || repeat('x', greatest(least(length(old), ({_width_sql('old')} - 1) // {redaction.MARK_WIDTH}), 0)), '' ORDER BY s)
      || substr(any_value(line_text), max(e) + 1) AS redacted FROM b GROUP BY doc_id, line)
    SELECT DISTINCT o.doc_id, o.line, r.redacted IS NOT NULL AS is_redacted, coalesce(r.redacted, o.line_text) AS redacted_text
    FROM o JOIN h ON o.doc_id = h.doc_id AND o.paragraph = h.paragraph AND abs(o.paragraph_line - h.paragraph_line) <= 1 LEFT JOIN r ON r.doc_id = o.doc_id AND r.line = o.line"""


def merged_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of the same capitalised word in a line."""
    rows = layout.lines(_docs(spark, sf)).select("doc_id", "line", "line_text", F.explode(spans.matches(F.col("line_text"), NAME, "ORG", 0)).alias("s"))
    word = F.substring("line_text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    subs = rows.select("doc_id", "line", F.col("s.label").alias("label"), word.alias("old_val"), word.alias("new_val"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), "line_text")
    return redaction.merged_runs(subs, ["doc_id", "line"]).select("doc_id", "line", "old_val", "start", "end", "n")


def line_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """All places in the lines of a document where its words of capitals stand, in any case."""
    rows = layout.lines(_docs(spark, sf)).where("line_text <> ''").select("doc_id", "line", "line_text")
    values = rows.select("doc_id", "line", F.explode(F.regexp_extract_all("line_text", F.lit("[A-Z][A-Z]+"), F.lit(0))).alias("old_val"))
    return redaction.occurrences(rows, values, ["doc_id", "line"])


def redaction_rects(spark: SparkSession, sf: str) -> DataFrame:
    """Strips that are deleted for the boxes of lines."""
    b = redaction.flat_rect(F.col("box"))
    return base._boxes(spark, sf).select("doc_id", "line", F.round(b["y0"], 6).alias("y0"), F.round(b["y1"], 6).alias("y1"), b["x1"].alias("x1"))


def draw_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Commands for the first lines of pages: their boxes redacted, the lines below written again."""
    rows = layout.lines(_docs(spark, sf)).where("line_text <> ''")
    boxed = rows.withColumn("box", geometry.box(F.lit(0), F.col("y0"), F.length("line_text"), F.col("y1")))
    first = boxed.where(f"line % {layout.PAGE_LINES} = 0").select("doc_id", "page", F.col("box").alias("rect"), F.col("box").alias("line_box"))
    second = boxed.where(f"line % {layout.PAGE_LINES} = 1").select("doc_id", "page", "box", F.col("line_text").alias("text"), F.lit("1,1,1").alias("background"))
    made = redaction.draw_commands(first, second, ["doc_id", "page"])
    return made.select("doc_id", "page", "step", "op", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")], "color", "text")


def entity_draw_commands(spark: SparkSession, sf: str) -> DataFrame:
    """Commands for all pages: the lines that hold entities are deleted and painted, they and their neighbours are written again."""
    near = _redacted(*base._all_paragraph_entities(spark, sf))
    boxed = near.withColumn("box", geometry.box(F.lit(0), F.col("y0"), F.length("line_text"), F.col("y1")))
    rects = boxed.where("is_redacted").select("doc_id", "page", F.col("box").alias("rect"), F.col("box").alias("line_box"))
    texts = boxed.select("doc_id", "page", "box", F.col("redacted_text").alias("text"), F.lit("1,1,1").alias("background"))
    made = redaction.draw_commands(rects, texts, ["doc_id", "page"])
    return made.select("doc_id", "page", "step", "op", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")], "color", "text")


def black_or_white(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as grey values: how many become white."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("int")).alias("px"))
    return e.select("vec_id", F.size(F.filter(redaction.black_or_white(F.col("px")), lambda p: p == 255)).alias("n_white"))


def span_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Words of lines as spans, and the line's box around them."""
    rows = layout.lines(_docs(spark, sf)).where("line_text <> ''").select("doc_id", "line", F.split("line_text", "(?<= )", -1).alias("t"))
    return rows.select("doc_id", "line", F.explode(redaction.span_offsets(F.col("t"))).alias("s")).groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.max("s.end").alias("end"))


def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a page's boxes that lie next to each other, one text each."""
    rows = layout.lines(_docs(spark, sf)).where("line_text <> ''")
    b = rows.select("doc_id", "page", F.col("line").alias("ord"), F.col("line_text").alias("text"), F.lit(0.0).alias("x0"), "y0", F.length("line_text").cast("double").alias("x1"), "y1")
    return geometry.text_lines(b, ["doc_id", "page"])


def path_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of the path through a vector's values taken in pairs."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(F.get("embedding", i * 2).cast("double").alias("x"), F.get("embedding", i * 2 + 1).cast("double").alias("y"))).alias("pts"))
    b = e.select("vec_id", geometry.path_box(F.col("pts")).alias("b"))
    return b.select("vec_id", *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


def queries() -> dict:
    """Queries by name; each takes (spark, sf_dir)."""
    found = (
        sentences, keyword_sentences, placeholder_text, placeholder_values, placeholder_positions, made_up_variants, made_up_values, address_parts, sentence_examples, interleaved_examples, dataset_parts,
        balanced_examples, token_offsets, bio_examples, expanded_spans, unknown_tokens, entity_boundaries, fuzzy_boundaries, font_matches, canonical_names, organisation_pseudonyms, processed_entities, accepted_readings, kept_rephrasings,
        text_widths, redacted_lines, all_redacted_lines, merged_runs, line_occurrences, redaction_rects, draw_commands, entity_draw_commands, black_or_white, span_offsets, text_lines, path_boxes,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    """DuckDB SQL by the name of the query."""
    drawn = "('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT"
    value = "CASE label " + " ".join(f"WHEN {_q(k)} THEN ([{', '.join(map(_q, v))}])[({drawn} % {len(v)}) + 1]" for k, v in synthetic.VALUES.items()) + " END"
    tokens = "SELECT item_id, unnest(range(0, len(t))) AS i, unnest(t) AS w FROM (SELECT item_id, string_split(text, ' ') AS t FROM benchmark)"
    offsets = f"SELECT item_id, i::INT AS ord, coalesce(sum(length(w) + 1) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, w FROM ({tokens})"
    spread = """
        f AS (SELECT *, row_number() OVER (PARTITION BY grp, positive ORDER BY md5(id::VARCHAR)) - 1 AS k FROM r),
        c AS (SELECT grp, count(*) FILTER (positive) AS a, count(*) FILTER (NOT positive) AS b FROM r GROUP BY grp),
        g AS (SELECT f.*, a, b, least(a, b) AS s, a + b AS n, positive = (a <= b) AS small FROM f JOIN c USING (grp)),
        i AS (SELECT *, round_even((k * n)::DOUBLE / s, 0)::BIGINT AS pos FROM g WHERE small),
        z AS (SELECT grp, id, positive, pos AS position FROM i UNION ALL
          SELECT l.grp, l.id, l.positive, p.pos FROM (SELECT * FROM g WHERE NOT small) l JOIN (
            SELECT grp, q AS pos, row_number() OVER (PARTITION BY grp ORDER BY q) - 1 AS k FROM (SELECT grp, unnest(range(0, a + b)) AS q FROM c)
            WHERE (grp, q) NOT IN (SELECT (grp, pos) FROM i)) p ON p.grp = l.grp AND p.k = l.k)"""
    parts = "string_split(coalesce(c_name, '') || ', ' || coalesce(c_mktsegment, ''), ',') AS l"
    rect = ", ".join(f"round({c}, 6) AS {c}" for c in ("x0", "y0", "x1", "y1"))
    page = layout.PAGE_LINES
    boxed = f"SELECT doc_id, page, line, line_text, 0::DOUBLE AS x0, y0, length(line_text)::DOUBLE AS x1, y0 + {layout.HEIGHT} AS y1 FROM ({base._LINES_SQL}) WHERE line_text <> ''"
    flat = redaction.FLAT
    return {
        "sentences": f'SELECT doc_id, sent, start, "end", sentence FROM ({_SENT_SQL})',
        "keyword_sentences": f"SELECT doc_id, sent, sentence FROM ({_SENT_SQL}) JOIN documents d USING (doc_id) WHERE " + " OR ".join(f"contains(d.text, {_q(k)})" for k in KEYWORDS),
        "placeholder_text": f"""
            WITH {_EX_SQL}, j AS (SELECT n.k, string_agg(substr(x.sentence, (n.before + 1)::BIGINT, (n.start - n.before)::BIGINT) || '[' || {_WORD_SQL} || num || ']', '' ORDER BY n.start)
              || substr(any_value(x.sentence), max(n."end") + 1) AS text, count(*) AS c FROM n JOIN x ON n.k = x.k GROUP BY n.k)
            SELECT x.k AS example_id, coalesce(j.text, x.sentence) AS text, coalesce(j.c, 0)::INT AS n_values FROM x LEFT JOIN j ON x.k = j.k""",
        "placeholder_values": f"WITH {_EX_SQL} SELECT k AS example_id, label, num AS k, ent AS value FROM n",
        "placeholder_positions": f"""
            WITH {_EX_SQL}, m AS (SELECT k, label, start, "end", length({_WORD_SQL}) + 2 + length(num::VARCHAR) AS size FROM n),
            p AS (SELECT k, label, start + coalesce(sum(size - ("end" - start)) OVER (PARTITION BY k ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, size FROM m)
            SELECT k AS example_id, label, s::INT AS start, (s + size)::INT AS "end" FROM p""",
        "made_up_values": f"SELECT doc_id, label, {value} AS value FROM documents, (VALUES ('LOC'), ('ORG'), ('PERSON'), ('POST_CODE'), ('ADDR')) v(label)",
        "address_parts": rf"""
            WITH p AS (SELECT c_custkey, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS i, len(l) AS n FROM (SELECT c_custkey, {parts} FROM customer)),
            o AS (SELECT *, 7 + coalesce(sum(length(p) + 1) OVER (PARTITION BY c_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(p) - length(ltrim(p)) AS s, trim(p) AS t FROM p)
            SELECT c_custkey, 'LOC' AS label, s::INT AS start, (s + length(t))::INT AS "end" FROM o WHERE t <> '' UNION ALL
            SELECT c_custkey, 'POST_CODE', (s + length(t) - length(regexp_extract(t, '\S+$')))::INT, (s + length(t))::INT FROM o WHERE t <> '' AND i = n""",
        "sentence_examples": f"""
            WITH x AS ({_SENT_SQL}), e AS ({base._ALIGNED_SQL}), v AS (SELECT *, lag("end") OVER (PARTITION BY doc_id ORDER BY start) AS pe FROM x),
            c AS (SELECT v.*, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.doc_id = v.doc_id AND e.start < v.pe AND e."end" > v.pe) THEN 0 ELSE 1 END AS nw FROM v),
            i AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS isl FROM c),
            w AS (SELECT doc_id, min(sent) AS sent, min(start) AS start, max("end") AS "end" FROM i GROUP BY doc_id, isl)
            SELECT w.doc_id, w.sent, w.start, w."end", count(e.label)::INT AS n_annots FROM w LEFT JOIN e ON e.doc_id = w.doc_id AND e.start >= w.start AND e."end" <= w."end" GROUP BY ALL""",
        "interleaved_examples": f"WITH r AS (SELECT 0 AS grp, doc_id AS id, coalesce(regexp_matches(text, '[0-9]'), false) AS positive FROM documents), {spread} SELECT id AS doc_id, positive, position FROM z",
        "dataset_parts": f"""
            WITH d AS (SELECT doc_id AS id, coalesce(regexp_matches(text, '[0-9]'), false) AS positive FROM documents),
            q AS (SELECT *, row_number() OVER (PARTITION BY positive ORDER BY md5(id::VARCHAR)) - 1 AS o, count(*) OVER (PARTITION BY positive) AS m FROM d),
            t AS (SELECT id, positive, CASE WHEN o < floor(m * 0.7::DOUBLE) THEN 'train' WHEN o < floor(m * (0.7::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS part FROM q),
            r AS (SELECT 0 AS grp, id, positive FROM t WHERE part = 'train'), {spread}
            SELECT t.id AS example_id, t.part, z.position FROM t LEFT JOIN z ON t.id = z.id""",
        "token_offsets": f'SELECT item_id, ord, start, (start + length(w))::INT AS "end" FROM ({offsets})',
        "bio_examples": f"""SELECT item_id AS example_id, (['B-short', 'I-short', 'B-long', 'I-long'])[length(w) % 5 + 1] AS label, start, (start + length(w))::INT AS "end" FROM ({offsets}) WHERE length(w) % 5 <> 4""",
        "expanded_spans": rf"""
            WITH {_EX_SQL}, w AS (SELECT n.k, n.start - length(regexp_extract(substr(x.sentence, 1, n.start), '[\p{{L}}\p{{M}}\p{{N}}_]*$')) AS s,
              n."end" + length(regexp_extract(substr(x.sentence, n."end" + 1), '^[\p{{L}}\p{{M}}\p{{N}}_]*')) AS e FROM n JOIN x ON n.k = x.k WHERE n.label = 'ORG')
            SELECT k AS example_id, s::INT AS start, e::INT AS "end" FROM w""",
        "unknown_tokens": f"SELECT item_id, i::INT AS position FROM ({tokens}) WHERE w = 'the'",
        "entity_boundaries": f"""
            SELECT DISTINCT a.doc_id, a.ent, (strpos(d.text, a.ent) - 1)::INT AS start, (strpos(d.text, a.ent) - 1 + length(a.ent))::INT AS "end", 1.0::DOUBLE AS ratio
            FROM ({base._ALIGNED_SQL}) a JOIN documents d ON a.doc_id = d.doc_id""",
        "processed_entities": f"SELECT ent, label FROM (VALUES {_rows(list(_NAMED))}) v(ent, label) WHERE label IN ({', '.join(map(_q, LABELS))}) AND NOT (label = 'ORG' AND ent IN ({', '.join(map(_q, STOP_NAMES))}))",
        "accepted_readings": f"""
            WITH v AS (SELECT * FROM (VALUES {_rows([(k, o, t, s, x) for o, (k, t, s, x) in enumerate(_READINGS)])}) v(img, ord, text, score, likeness)),
            b AS (SELECT img, text, row_number() OVER (PARTITION BY img ORDER BY likeness DESC, ord) AS r FROM v WHERE score > -0.05 AND likeness > 0.95)
            SELECT i.img, b.text FROM (SELECT DISTINCT img FROM v) i LEFT JOIN b ON i.img = b.img AND b.r = 1""",
        "kept_rephrasings": f"SELECT DISTINCT example_id, text FROM (VALUES {_rows(list(_SAID))}) v(example_id, text, score) WHERE score BETWEEN 0.85 AND 0.995",
        "text_widths": f"SELECT doc_id, {_width_sql('text')}::BIGINT AS width FROM documents",
        "redacted_lines": _REDACTED_SQL,
        "merged_runs": f"""
            WITH x AS (SELECT doc_id, line, doc_id || ':' || line AS k, line_text FROM ({base._LINES_SQL})), m AS ({base._matches_sql('ORG', NAME, 0, 'x', 'k', 'line_text')}),
            l AS (SELECT *, start + length(ent) AS e, lag(ent) OVER w AS pt, lag(start + length(ent)) OVER w AS pe FROM m WINDOW w AS (PARTITION BY k ORDER BY start)),
            r AS (SELECT *, sum(CASE WHEN ent = pt AND start - pe <= {redaction.RUN_GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM l),
            g AS (SELECT k, any_value(ent) AS old_val, min(start) AS start, max(e) AS e, count(*) AS n FROM r GROUP BY k, run)
            SELECT x.doc_id, x.line, old_val, start::INT AS start, (e + CASE WHEN n > 1 AND substr(line_text, e + 1, 1) = ')' THEN 1 ELSE 0 END)::INT AS "end", n FROM g JOIN x ON g.k = x.k""",
        "line_occurrences": f"""
            WITH l AS (SELECT doc_id, line, line_text FROM ({base._LINES_SQL}) WHERE line_text <> ''),
            v AS (SELECT DISTINCT doc_id, line, line_text, unnest(regexp_extract_all(line_text, '[A-Z][A-Z]+')) AS old_val FROM l),
            p AS (SELECT *, string_split(lower(line_text), lower(old_val)) AS s FROM v),
            u AS (SELECT doc_id, line, old_val, unnest(s) AS t, unnest(range(0, len(s))) AS i, len(s) AS n FROM p),
            q AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id, line, old_val ORDER BY i ROWS UNBOUNDED PRECEDING) + i * length(old_val) AS st FROM u)
            SELECT doc_id, line, old_val, st::INT AS start, (st + length(old_val))::INT AS "end" FROM q WHERE i < n - 1""",
        "redaction_rects": f"SELECT doc_id, line, round((y0 + y1) / 2 - {flat}, 6) AS y0, round((y0 + y1) / 2 + {flat}, 6) AS y1, x1 FROM ({boxed})",
        "draw_commands": f"""
            WITH b AS ({boxed}), f AS (SELECT * FROM b WHERE line % {page} = 0), s AS (SELECT * FROM b WHERE line % {page} = 1), u AS (
              SELECT doc_id, page, 1 AS step, 'delete' AS op, x0, (y0 + y1) / 2 - {flat} AS y0, x1, (y0 + y1) / 2 + {flat} AS y1, '0,0,0' AS color, NULL AS text FROM f UNION ALL
              SELECT doc_id, page, 2, 'fill', x0 - {redaction.MARGIN}, y0 - {redaction.MARGIN}, x1 + {redaction.MARGIN}, y1 + {redaction.MARGIN}, '1,1,1', NULL FROM s UNION ALL
              SELECT doc_id, page, 3, 'write', x0, y0, x1, y1, NULL, line_text FROM s UNION ALL
              SELECT doc_id, page, 4, 'paint', x0, y0, x1, y1, '0,0,0', NULL FROM f)
            SELECT doc_id, page, step, op, {rect}, color, text FROM u""",
        "black_or_white": "SELECT vec_id, len(list_filter(embedding, lambda v: floor(v::DOUBLE * 1000) >= 200))::INT AS n_white FROM embeddings",
        "span_offsets": f"SELECT doc_id, line, (length(line_text) - length(replace(line_text, ' ', '')) + 1)::BIGINT AS n, length(line_text)::INT AS \"end\" FROM ({base._LINES_SQL}) WHERE line_text <> ''",
        "path_boxes": """
            WITH p AS (SELECT vec_id, unnest(range(1, 33)) AS i, embedding AS e FROM embeddings)
            SELECT vec_id, round(min(e[2 * i - 1]::DOUBLE), 6) AS x0, round(min(e[2 * i]::DOUBLE), 6) AS y0, round(greatest(max(e[2 * i - 1]::DOUBLE), 0), 6) AS x1, round(greatest(max(e[2 * i]::DOUBLE), 0), 6) AS y1 FROM p GROUP BY vec_id""",
    }
