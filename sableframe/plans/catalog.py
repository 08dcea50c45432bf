"""Registry of the engine's queries and of the SQL that states the same results."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableframe.functions import text as T
from sableframe.functions.rules import DATE_FORMS, DATE_RULE, DEFAULT_DATE_FORM, LABELS, PATTERNS, SSN_INLINE, STOP_NAMES
from sableframe.operators import examples, geometry, layout, similarity, spans


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Texts for rules that the given tables have no match of, and for entities that run over a line's end.
CASES = (
    (-1, "fe80::1 and ::1, 1:2:3:4:5:6:7:8 or 2001:db8::ff00:42:8329 but not 12:34"),
    (-2, "123-45-6789"), (-3, "000-45-6789"), (-4, "666-45-6789"), (-5, "123-00-6789"), (-6, "123-45-0000"), (-7, "912-45-6789"), (-8, "x 123-45-6789"),
    (-9, "VIN 1HGCM82633A004352 and 1HGCM82633A0043521, JH4KA8260MC000000."),
    (-10, "on 1/2/2020, 31/12/1999 and 2020-01-02; 11/22/33333"),
    (-11, "see https://www.a-b.org/x?y=1, ftp://f.example.net or mail bob.x@mail.example.com"),
    (-12, "call 555\n1234567 today\nor +48 123\n456 7890\nor (02) 9999 1234"),
    (-13, "host 10.0.0.1\nand 10.1.2.3 with 0400\n123456"),
)


def _docs_and_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", "text").unionByName(spark.createDataFrame(list(CASES), "doc_id long, text string"))


def _with_cases(sql: str) -> str:
    rows = ", ".join(f"({k}, {_q(t)})" for k, t in CASES)
    return sql.replace("FROM documents", f"FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id::BIGINT, text FROM (VALUES {rows}) v(doc_id, text)) documents")


# Detection

def _entities(spark: SparkSession, sf: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    return spans.entities(spans.detect(_table(spark, sf, table), text), key, text)


def detect_one(spark: SparkSession, sf: str, label: str, pattern: str) -> DataFrame:
    """All matches of one rule with their offsets, in the documents and in the cases."""
    found = _docs_and_cases(spark, sf).withColumn("spans", spans.matches(F.coalesce("text", F.lit("")), pattern, label, 0))
    return spans.entities(found).select("doc_id", "label", "start", "end", "ent")


def _matches_sql(label: str, pattern: str, rank: int = 0, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    p = _q(pattern)
    if pattern == _SSN_SQL:
        table = f"(SELECT * FROM {table} WHERE NOT regexp_matches({text}, '{_NO_SSN}'))"
    return f"""
    SELECT {key}, {_q(label)} AS label, {rank} AS rank,
      (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INT AS start, m[i] AS ent
    FROM (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT {key}, regexp_extract_all({text}, {p}, 0) AS m, regexp_split_to_array({text}, {p}) AS g FROM {table}) WHERE len(m) > 0)"""


def _detect_sql(label: str, pattern: str) -> str:
    return _with_cases(f'SELECT doc_id, label, start, start + length(ent)::INT AS "end", ent FROM ({_matches_sql(label, pattern)})')


#: SSN without lookaheads, which the other engine lacks, and what they exclude.
_SSN_SQL, _NO_SSN = r"^[0-8]\d{2}-\d{2}-\d{4}$", "^000|^666|-00-|-0000$"


def _all_sql(**names) -> str:
    return " UNION ALL ".join(_matches_sql(label, _SSN_SQL if label == "SSN" else p, k, **names) for k, (label, p) in enumerate(PATTERNS.items()))


def entity_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _entities(spark, sf).select("doc_id", "label", "start", "end", "ent")


def page_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Matches in raw pages, by label."""
    return _entities(spark, sf, "pages", "page_id", "html").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


def conversation_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Matches in conversations, and in the cases as turns of their own role."""
    turns = _table(spark, sf, "conversations").select("role", "text")
    cases = spark.createDataFrame(list(CASES), "doc_id long, text string").select(F.lit("case").alias("role"), "text")
    return spans.detect(turns.unionByName(cases)).select("role", F.explode("spans").alias("s")).groupBy("role", F.col("s.label").alias("label")).agg(F.count("*").alias("n"))


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    found = spans.detect(_docs(spark, sf))
    return found.withColumn("spans", spans.aligned(F.col("text"), F.col("spans")))


def aligned_entities(spark: SparkSession, sf: str) -> DataFrame:
    return spans.entities(_aligned(spark, sf)).select("doc_id", "label", "start", "end", "ent")


_EDGE_SQL = r"^[\s!-/:-@\[-`{-~\x{00A0}\p{P}]$"
_ALIGNED_SQL = f"""
    SELECT e.doc_id, e.label, e.rank, e.start, (e.start + length(e.ent))::INT AS "end", e.ent FROM ({_all_sql()}) e JOIN documents d ON e.doc_id = d.doc_id
    WHERE (e.start = 0 OR regexp_matches(substr(d.text, e.start, 1), '{_EDGE_SQL}'))
      AND (e.start + length(e.ent) >= length(d.text) OR regexp_matches(substr(d.text, e.start + length(e.ent) + 1, 1), '{_EDGE_SQL}'))
      AND NOT regexp_matches(substr(e.ent, 1, 1), '^\\s$') AND NOT regexp_matches(substr(e.ent, -1, 1), '^\\s$')"""


def entity_counts(spark: SparkSession, sf: str, by: str) -> DataFrame:
    rows = _aligned(spark, sf).select(by, "doc_id", F.explode("spans").alias("s"))
    return rows.groupBy(by, F.col("s.label").alias("label")).agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_entities"))


def resolved_entities(spark: SparkSession, sf: str) -> DataFrame:
    found = _aligned(spark, sf).withColumn("spans", spans.resolved(F.col("text"), F.col("spans")))
    return spans.entities(found).select("doc_id", "label", "start", "end", "ent")


def pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return spans.pseudonyms(spans.entities(_aligned(spark, sf))).select("doc_id", "label", "start", "ent", F.col("ordinal").cast("int").alias("ordinal"), "new_val")


def _pseudonyms_sql() -> str:
    described = "CASE label " + " ".join(f"WHEN {_q(k)} THEN {_q(v[0])}" for k, v in LABELS.items()) + " END"
    return f"""
    WITH a AS ({_ALIGNED_SQL}), f AS (SELECT doc_id, label, ent, min(start) AS s0, arg_min(rank, start) AS r0 FROM a GROUP BY ALL),
    o AS (SELECT *, (dense_rank() OVER (PARTITION BY doc_id, label ORDER BY s0, r0, ent) - 1)::INT AS ordinal FROM f)
    SELECT a.doc_id, a.label, a.start, a.ent, o.ordinal, '"' || {described.replace('label', 'a.label')} || ' ' || (o.ordinal + 1) || '"' AS new_val
    FROM a JOIN o ON a.doc_id = o.doc_id AND a.label = o.label AND a.ent = o.ent"""


def masked_text(spark: SparkSession, sf: str) -> DataFrame:
    found = _aligned(spark, sf).withColumn("spans", spans.resolved(F.col("text"), F.col("spans"))).where(F.size("spans") > 0)
    return found.select("doc_id", F.size("spans").alias("n_spans"), spans.masked(F.col("text"), F.col("spans")).alias("masked"))


def pseudonym_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-ins of the first 200 companies and addresses of a document."""
    n = spark.range(200).select(F.col("id").cast("int").alias("n"))
    return n.select("n", T.pseudonym(F.lit("ORG"), F.col("n")).alias("org"), T.pseudonym(F.lit("IPv4"), F.col("n")).alias("ip"))


# Texts and layout


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.normalized(F.col("text")).alias("normalized"))


def is_link_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.is_link(F.col("text")).alias("is_link"))


def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", "lang", "source", F.length("text").cast("long").alias("length"))


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return layout.paragraphs(layout.lines(_docs(spark, sf)))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return layout.lines(_docs(spark, sf)).select("doc_id", "line", "page", "y0", "y1", F.length("line_text").alias("n"))


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _paragraphs(spark, sf).select("doc_id", "line", "paragraph", "paragraph_line", "line_start", "line_end")


def paragraph_text(spark: SparkSession, sf: str) -> DataFrame:
    return layout.paragraph_texts(_paragraphs(spark, sf))


_LINES_SQL = f"""
    SELECT doc_id, (i - 1)::INT AS line, line_text, ((i - 1) // {layout.PAGE_LINES})::INT AS page,
      ({layout.PITCH} * ((i - 1) % {layout.PAGE_LINES}) + {layout.BREAK} * coalesce(sum(CASE WHEN line_text LIKE '%.' THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id, (i - 1) // {layout.PAGE_LINES} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS y0
    FROM (SELECT doc_id, unnest(l) AS line_text, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
_PARAGRAPHS_SQL = f"""
    WITH l AS ({_LINES_SQL}), f AS (SELECT *, y0 + {layout.HEIGHT} AS y1 FROM l WHERE line_text <> ''),
    n AS (SELECT *, CASE WHEN y0 - lag(y1) OVER w > {layout.GAP} OR page <> lag(page) OVER w THEN 1 ELSE 0 END AS nw FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY page, y1, line)),
    p AS (SELECT *, (sum(nw) OVER (PARTITION BY doc_id ORDER BY page, y1, line ROWS UNBOUNDED PRECEDING))::INT AS paragraph FROM n),
    o AS (SELECT *, (row_number() OVER q - 1)::INT AS paragraph_line, coalesce(sum(length(line_text) + 1) OVER (PARTITION BY doc_id, paragraph ORDER BY page, y1, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS line_start
      FROM p WINDOW q AS (PARTITION BY doc_id, paragraph ORDER BY page, y1, line))"""


def _paragraph_entities(spark: SparkSession, sf: str, labels: tuple[str, ...] = ("IPv4", "PHONE")) -> tuple[DataFrame, DataFrame]:
    """Matches of some rules in the paragraphs of the documents and cases, and the lines."""
    rows = layout.paragraphs(layout.lines(_docs_and_cases(spark, sf)))
    found = spans.detect(layout.paragraph_texts(rows), "paragraph_text", only=labels)
    return found.select("doc_id", "paragraph", F.explode("spans").alias("s")).select("doc_id", "paragraph", F.col("s.start").alias("start"), F.col("s.end").alias("end")), rows


def _all_paragraph_entities(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Entities of every rule in paragraphs, aligned and without overlaps, with their labels; and the lines."""
    rows = _paragraphs(spark, sf)
    text = F.col("paragraph_text")
    found = spans.detect(layout.paragraph_texts(rows), "paragraph_text").where(F.size("spans") > 0)
    kept = found.select("doc_id", "paragraph", F.explode(spans.resolved(text, spans.aligned(text, F.col("spans")))).alias("s"))
    return kept.select("doc_id", "paragraph", "s.label", "s.start", "s.end"), rows


def all_entity_line_map(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of every rule with the line that holds them; entity_line_map has addresses of machines only."""
    ents, rows = _all_paragraph_entities(spark, sf)
    return layout.entity_lines(ents, rows).select("doc_id", "paragraph", "label", "start", "end", "line", "in_line_start", "in_line_end")


def all_neighbour_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that hold an entity of any rule, and those next to them in their paragraph."""
    ents, rows = _all_paragraph_entities(spark, sf)
    hit = layout.entity_lines(ents, rows).select("doc_id", "paragraph", "line")
    marked = rows.join(hit.distinct(), ["doc_id", "paragraph", "line"], "left_semi")
    return layout.neighbour_lines(marked, rows).select("doc_id", "paragraph", "line")


def entity_line_map(spark: SparkSession, sf: str) -> DataFrame:
    ents, rows = _paragraph_entities(spark, sf)
    return layout.entity_lines(ents, rows).select("doc_id", "paragraph", "start", "end", "line", "in_line_start", "in_line_end")


def neighbour_lines(spark: SparkSession, sf: str) -> DataFrame:
    ents, rows = _paragraph_entities(spark, sf)
    hit = layout.entity_lines(ents, rows).select("doc_id", "paragraph", "line")
    marked = rows.join(hit.distinct(), ["doc_id", "paragraph", "line"], "left_semi")
    return layout.neighbour_lines(marked, rows).select("doc_id", "paragraph", "line")


def _hits_sql(*labels: str) -> str:
    found = " UNION ALL ".join(f"SELECT k.doc_id, k.paragraph, m.start, (m.start + length(m.ent))::INT AS stop FROM ({_matches_sql(x, PATTERNS[x], 0, 'k', 'k')}) m JOIN k ON m.k = k.k" for x in labels)
    return f"""{_with_cases(_PARAGRAPHS_SQL)},
    t AS (SELECT doc_id, paragraph, string_agg(line_text, ' ' ORDER BY paragraph_line) AS text FROM o GROUP BY ALL),
    k AS (SELECT doc_id || ':' || paragraph AS k, doc_id, paragraph, text FROM t),
    e AS ({found}),
    h AS (SELECT e.doc_id, e.paragraph, e.start, e.stop AS "end", o.line, o.paragraph_line, o.line_start,
        (greatest(e.start, o.line_start) - o.line_start)::INT AS a, (least(e.stop, o.line_start + length(o.line_text)) - o.line_start)::INT AS b
      FROM e JOIN o ON e.doc_id = o.doc_id AND e.paragraph = o.paragraph AND e.start < o.line_start + length(o.line_text) AND o.line_start < e.stop)"""


# Similarity and examples


def cosine_top1(spark: SparkSession, sf: str) -> DataFrame:
    """Best class representative (the vector of the least id) of every vector, if its cosine is above 0.95."""
    e = _table(spark, sf, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("cand_vector"), F.min("vec_id").alias("cand_id"))
    return similarity.top_candidate(e.select("vec_id", "embedding"), first).select("vec_id", "best_id", F.when(F.col("best_id").isNotNull(), F.col("score")).alias("score"))


def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return examples.dedup_first(_docs(spark, sf).select("doc_id", "text"), "text", "doc_id").select("doc_id", "text")


def undersample(spark: SparkSession, sf: str) -> DataFrame:
    return examples.undersample(_docs(spark, sf).select("doc_id", "lang"), "lang", "doc_id")


def oversample_plan(spark: SparkSession, sf: str) -> DataFrame:
    return examples.oversample_plan(_docs(spark, sf), "lang")


def split_train_val_test(spark: SparkSession, sf: str) -> DataFrame:
    return examples.split(_docs(spark, sf).select("doc_id"), "doc_id")


def _label_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf).select(F.col("doc_id").alias("example_id"), F.col("spans").alias("annots"))


def class_groups(spark: SparkSession, sf: str) -> DataFrame:
    return examples.class_groups(_label_groups(spark, sf))


def single_entity_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _label_groups(spark, sf).select("example_id", examples.single_entity().alias("single"))


def stoplist_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Words of capitals that are no stop names, by document."""
    stop = spark.createDataFrame([(s,) for s in STOP_NAMES], "word string")
    words = _docs(spark, sf).select("doc_id", F.explode(F.split("text", "[ \n]+")).alias("word")).where(F.col("word").rlike("^[A-Z]{3,6}$"))
    return words.join(F.broadcast(stop), "word", "left_anti").groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def date_form_class(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(d,) for d in _DATES], "text string").select("text", T.date_form(F.col("text")).alias("form"))


_DATES = ("March 21", "March 21, 2020", "2020 March 21", "21 March 2020", "21/03/2020", "2020-03-21", "soon", "", "5 May", "x 1/2/2020")


def unique_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = layout.lines(_docs(spark, sf)).where("line_text <> ''")
    return examples.unique_lines(rows, "doc_id", "line_text", "line").select("doc_id", "line")


def url_outside_email(spark: SparkSession, sf: str) -> DataFrame:
    """URL matches that no e-mail match contains: two rules in one scan, compared within the row."""
    of = lambda label: F.filter("spans", lambda s: s["label"] == label)
    found = spans.detect(_docs(spark, sf), only=("URL", "EMAIL")).withColumn("spans", examples.outside(of("URL"), of("EMAIL")))
    return spans.entities(found).select("doc_id", "start", "end", "ent")


# Geometry: a line's box is as wide as its text


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    rows = layout.lines(_docs(spark, sf)).where("line_text <> ''")
    return rows.select("doc_id", "page", "line", geometry.box(F.lit(0), F.col("y0"), F.length("line_text"), F.col("y1")).alias("box"))


def enclosing_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.enclosing(_boxes(spark, sf), ["doc_id", "page"])


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _boxes(spark, sf).alias("a"), _boxes(spark, sf).alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.line") < F.col("b.line")))


def adjacent_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).where(geometry.adjacent(F.col("a.box"), F.col("b.box"))).select("a.doc_id", F.col("a.line").alias("line_a"), F.col("b.line").alias("line_b"))


def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of each line's box with the next one's, moved up by its height."""
    up = geometry.box(F.col("b.box.x0"), F.col("b.box.y0") - 10, F.col("b.box.x1"), F.col("b.box.y1") - 10)
    near = _pairs(spark, sf).where("b.line = a.line + 1")
    return near.select("a.doc_id", F.col("a.line").alias("line_a"), F.round(T.iou(F.col("a.box"), up), 6).alias("iou"))


def merge_rects(spark: SparkSession, sf: str) -> DataFrame:
    rows = _boxes(spark, sf).select("doc_id", "page", F.col("line").alias("ord"), "box.x0", (F.col("box.y0") - 3).alias("y0"), "box.x1", (F.col("box.y1") + 3).alias("y1"))
    return geometry.merge_overlapping(rows, ["doc_id", "page"])


_BOXES_SQL = f"SELECT doc_id, page, line, 0::DOUBLE AS x0, y0, length(line_text)::DOUBLE AS x1, y0 + {layout.HEIGHT} AS y1 FROM ({_LINES_SQL}) WHERE line_text <> ''"


def _normal_sql(text: str = "text") -> str:
    blank = "[\\s\\x{00A0}\\x{0085}\\x{1C}-\\x{1F}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0B}]+"
    plain = f"nfc_normalize({text})"
    for a, b in ((" ", " "), ("‘", "''"), ("’", "''"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "..."), ("·", "-"), ("​", ""), ("‎", ""), ("‏", ""), ("﻿", "")):
        plain = f"replace({plain}, '{a}', '{b}')"
    return f"trim(regexp_replace({plain}, '{blank}', ' ', 'g'), ' ')"


def queries() -> dict:
    """Queries by name; each takes (spark, sf_dir)."""
    found = {f"detect_{label.lower()}": partial(detect_one, label=label, pattern=p) for label, p in PATTERNS.items()}
    found["detect_ssn_inline"] = partial(detect_one, label="SSN", pattern=SSN_INLINE)
    found["detect_date"] = partial(detect_one, label="DATE", pattern=DATE_RULE)
    found["entity_counts_by_lang"] = partial(entity_counts, by="lang")
    found["entity_counts_by_source"] = partial(entity_counts, by="source")
    for f in (
        entity_offsets, page_entities, conversation_entities, aligned_entities, resolved_entities, pseudonyms, masked_text, pseudonym_suffixes, normalize_text, is_link_flags, scan_documents,
        lines, paragraphs, paragraph_text, entity_line_map, neighbour_lines, all_entity_line_map, all_neighbour_lines, cosine_top1, dedup_first, undersample, oversample_plan, split_train_val_test, class_groups, single_entity_flags,
        stoplist_antijoin, date_form_class, unique_lines, url_outside_email, enclosing_bbox, adjacent_boxes, iou_pairs, merge_rects,
    ):
        found[f.__name__] = f
    return found


def oracle_sql() -> dict:
    """DuckDB SQL by the name of the query."""
    offsets = f'SELECT doc_id, label, start, (start + length(ent))::INT AS "end", ent FROM ({_all_sql()})'
    first_date = "CASE " + " ".join(f"WHEN regexp_matches(text, {_q(f'(?i)^(?:{p})')}) THEN {_q(f)}" for p, f in DATE_FORMS) + f" ELSE {_q(DEFAULT_DATE_FORM)} END"
    sql = {f"detect_{label.lower()}": _detect_sql(label, _SSN_SQL if label == "SSN" else p) for label, p in PATTERNS.items()}
    return sql | {
        "detect_ssn_inline": _detect_sql("SSN", SSN_INLINE),
        "detect_date": _detect_sql("DATE", DATE_RULE),
        "entity_offsets": offsets,
        "aligned_entities": f'SELECT doc_id, label, start, "end", ent FROM ({_ALIGNED_SQL})',
        "entity_counts_by_lang": f"SELECT lang, label, count(DISTINCT a.doc_id) AS n_docs, count(*) AS n_entities FROM ({_ALIGNED_SQL}) a JOIN documents USING (doc_id) GROUP BY ALL",
        "entity_counts_by_source": f"SELECT source, label, count(DISTINCT a.doc_id) AS n_docs, count(*) AS n_entities FROM ({_ALIGNED_SQL}) a JOIN documents USING (doc_id) GROUP BY ALL",
        "page_entities": f"SELECT label, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM ({_all_sql(table='pages', key='page_id', text='html')}) GROUP BY label",
        "conversation_entities": f"SELECT role, label, count(*) AS n FROM ({_all_sql(table='(SELECT role, text FROM conversations UNION ALL SELECT ' + _q('case') + ', text FROM (VALUES ' + ', '.join(f'({_q(t)})' for _, t in CASES) + ') v(text))', key='role')}) GROUP BY ALL",
        "pseudonyms": _pseudonyms_sql(),
        "pseudonym_suffixes": """SELECT n::INT AS n, '"Company ' || repeat('A', round_even(n / 26.0, 0)::INT) || chr((65 + n % 26)::INT) || '"' AS org, '"IPv4 Address ' || (n + 1) || '"' AS ip FROM range(200) r(n)""",
        "normalize_text": f"SELECT doc_id, {_normal_sql()} AS normalized FROM documents",
        "is_link_flags": f"SELECT doc_id, regexp_matches(text, {_q('^(?:' + PATTERNS['URL'] + ')')}) OR regexp_matches(text, {_q('^(?:' + PATTERNS['EMAIL'] + ')')}) AS is_link FROM documents",
        "scan_documents": "SELECT doc_id, lang, source, length(text)::BIGINT AS length FROM documents",
        "lines": f"SELECT doc_id, line, page, y0, y0 + {layout.HEIGHT} AS y1, length(line_text)::INT AS n FROM ({_LINES_SQL})",
        "paragraphs": f"{_PARAGRAPHS_SQL} SELECT doc_id, line, paragraph, paragraph_line, line_start, (line_start + length(line_text))::INT AS line_end FROM o",
        "paragraph_text": f"{_PARAGRAPHS_SQL} SELECT doc_id, paragraph, string_agg(line_text, ' ' ORDER BY paragraph_line) AS paragraph_text, count(*) AS n_lines FROM o GROUP BY ALL",
        "entity_line_map": f'{_hits_sql("IPv4", "PHONE")} SELECT doc_id, paragraph, start, "end", line, a AS in_line_start, b AS in_line_end FROM h',
        "neighbour_lines": f"{_hits_sql('IPv4', 'PHONE')} SELECT DISTINCT o.doc_id, o.paragraph, o.line FROM o JOIN h ON o.doc_id = h.doc_id AND o.paragraph = h.paragraph AND abs(o.paragraph_line - h.paragraph_line) <= 1",
        "cosine_top1": f"""
            WITH c AS (SELECT min(vec_id) AS cand_id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
            s AS (SELECT vec_id, cand_id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, c),
            r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cand_id) AS k FROM s)
            SELECT vec_id, CASE WHEN score > {similarity.THRESHOLD} THEN cand_id END AS best_id, CASE WHEN score > {similarity.THRESHOLD} THEN round(score, 6) END AS score FROM r WHERE k = 1""",
        "dedup_first": "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text",
        "undersample": """
            WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), m AS (SELECT min(n) AS least FROM s),
            l AS (SELECT lang, CASE WHEN n::DOUBLE / least > 1.5 THEN 2 * least ELSE n END AS lim FROM s, m)
            SELECT doc_id, d.lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) AS k FROM documents) d JOIN l ON d.lang = l.lang WHERE k <= lim""",
        "oversample_plan": """
            WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), m AS (SELECT max(n) AS most FROM s)
            SELECT lang, n, (CASE WHEN most::DOUBLE / n > 1.5 THEN floor(round_even(n * (most::DOUBLE / n), 0) / n) + 1 ELSE 0 END)::BIGINT AS num_aug FROM s, m""",
        "split_train_val_test": """
            SELECT doc_id, CASE WHEN k < floor(n * 0.7::DOUBLE) THEN 'train' WHEN k < floor(n * (0.7::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS part
            FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) - 1 AS k, count(*) OVER () AS n FROM documents)""",
        "class_groups": f"SELECT DISTINCT doc_id AS example_id, label FROM ({_ALIGNED_SQL})",
        "single_entity_flags": f"SELECT d.doc_id AS example_id, count(DISTINCT a.label) = 1 AS single FROM documents d LEFT JOIN ({_ALIGNED_SQL}) a ON a.doc_id = d.doc_id GROUP BY d.doc_id",
        "stoplist_antijoin": f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \n]+')) AS word FROM documents) WHERE regexp_full_match(word, '[A-Z]{{3,6}}') AND word NOT IN ({', '.join(map(_q, STOP_NAMES))}) GROUP BY ALL",
        "date_form_class": f"SELECT text, {first_date} AS form FROM (VALUES {', '.join(f'({_q(d)})' for d in _DATES)}) v(text)",
        "unique_lines": f"""
            WITH l AS (SELECT * FROM ({_LINES_SQL}) WHERE line_text <> '')
            SELECT a.doc_id, a.line FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.doc_id = a.doc_id AND contains(b.line_text, a.line_text)
              AND (length(b.line_text) > length(a.line_text) OR (length(b.line_text) = length(a.line_text) AND b.line < a.line)))""",
        "url_outside_email": f"""
            WITH e AS ({offsets}) SELECT i.doc_id, i.start, i."end", i.ent FROM e i WHERE i.label = 'URL'
              AND NOT EXISTS (SELECT 1 FROM e o WHERE o.label = 'EMAIL' AND o.doc_id = i.doc_id AND i.start >= o.start AND i."end" <= o."end")""",
        "enclosing_bbox": f"SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({_BOXES_SQL}) GROUP BY ALL",
        "adjacent_boxes": f"""
            WITH b AS ({_BOXES_SQL}) SELECT a.doc_id, a.line AS line_a, b.line AS line_b FROM b a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND a.line < b.line
            WHERE (abs(b.x0 - a.x1) < 10 AND abs(b.y0 - a.y0) < 5) OR (abs(b.x0 - a.x0) < 5 AND abs(b.y0 - a.y1) < 10)""",
        "iou_pairs": f"""
            WITH b AS ({_BOXES_SQL}), p AS (SELECT a.doc_id, a.line AS line_a, a.x1 AS ax, b.x1 AS bx, least(a.y1, b.y1 - 10) - greatest(a.y0, b.y0 - 10) AS h FROM b a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND b.line = a.line + 1),
            i AS (SELECT *, least(ax, bx) * greatest(h, 0) AS shared FROM p)
            SELECT doc_id, line_a, round(CASE WHEN (ax + bx) * 10 - shared = 0 THEN 0 ELSE shared / ((ax + bx) * 10 - shared) END, 6) AS iou FROM i""",
    }
