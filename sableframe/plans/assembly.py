"""Queries of entities carried to raw text, page redactions, stand-ins of models and groups, with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableframe.functions.rules import ACRONYM_RULE, DATE_RULE, DATE_TOKEN, NAME_RULES, PATTERNS
from sableframe.operators import assembly, examples, geometry, layout, similarity, spans
from sableframe.plans import catalog as base
from sableframe.plans import preparation
from sableframe.sources import readers

#: Texts for rules that the given tables have few matches of.
CASES = (
    (-21, "Dr. Ada Brook of Northern Quay Ltd lives in Mill Lane."),
    (-22, "Multi Protocol Label Switching (MPLS) and World Bank (WB); (XY) and Far (F)"),
    (-23, "On 31/12/1999, by 1/2/2020-draft or 11/22/33333 and 1/2/20"),
    (-24, "mail  “bob.x@mail.example.com”​ — 10.0.0.1…"),
)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs_and_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(list(CASES), "doc_id long, text string"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CASES_SQL = f"(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id::BIGINT, text FROM (VALUES {', '.join(f'({k}, {_q(t)})' for k, t in CASES)}) v(doc_id, text))"


# Entities of normalised text


def _carried(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = layout.paragraphs(layout.lines(_table(spark, sf, "documents")))
    return assembly.carried(layout.paragraph_texts(rows), ["doc_id", "paragraph"], "paragraph_text"), rows


def carried_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of normalised documents and cases, by every rule, and where they lie in the raw text. The SQL states those that the raw text holds as they are."""
    ents = assembly.carried(_docs_and_cases(spark, sf), ["doc_id"], "text")
    return ents.select("doc_id", "label", "start", "end", "ent", "raw_start", "raw_end", "ratio", "placed")


def entity_substitutes(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-ins of the entities of normalised paragraphs, on every line that they touch."""
    return assembly.substitutes(*_carried(spark, sf))


def date_tokens(spark: SparkSession, sf: str) -> DataFrame:
    found = _docs_and_cases(spark, sf).withColumn("spans", spans.date_tokens(F.coalesce("text", F.lit(""))))
    return spans.entities(found).select("doc_id", "start", "end", "ent")


def named_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Persons, organisations and places by the stand-in rules."""
    return spans.entities(spans.named(_docs_and_cases(spark, sf))).select("doc_id", "label", "start", "end", "ent")


def acronym_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Long forms with the short forms that follow them."""
    return similarity.acronym_relations(spans.acronym_tags(_docs_and_cases(spark, sf))).distinct()


def named_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations of a text's numbers as post codes, its capitalised words as persons, and others of a type or label that is not read."""
    text = F.coalesce("text", F.lit(""))
    kinds = ((readers.ENTITY_TYPE, "POST_CODE", preparation.NUMBER), (readers.ENTITY_TYPE, "PERSON", preparation.NAME), (readers.ENTITY_TYPE, "MISC", "[@]"), ("sentence", "ORG", "[.]"))
    made = None
    for k, (kind, label, pattern) in enumerate(kinds):
        one = _table(spark, sf, "documents").select("doc_id", F.explode(spans.matches(text, pattern, label, k)).alias("s"))
        rows = one.select("doc_id", F.lit(kind).alias("type"), "s.start", "s.end", F.col("s.label").alias("value"))
        made = rows if made is None else made.unionByName(rows)
    return readers.named_annotations(made, ["doc_id"])


# Pages: lines as they lie on pages, and the same lines as if they had been read from an image on the upper left quarter of the page


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    rows = layout.lines(_table(spark, sf, "documents")).where("line_text <> ''")
    path = F.concat_ws(":", "doc_id", "page")
    corners = {"x0": F.lit(0.0), "x1": F.length("line_text").cast("double")}
    return rows.select("doc_id", "page", path.alias("path"), F.col("line").alias("ord"), "line_text", "y0", "y1").withColumns(corners)


def _images(rows: DataFrame) -> DataFrame:
    sized = rows.groupBy("doc_id", "page", "path").agg(F.max("x1").alias("width"), F.max("y1").alias("height"))
    return sized.withColumns({"ord": F.lit(0), "rect": geometry.box(F.lit(0.0), F.lit(0.0), F.col("width") / 2, F.col("height") / 2)})


def _rounded(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, *[F.round(c, 6).alias(c) for c in assembly.CORNERS])


def image_redactions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _placed(spark, sf)
    return _rounded(assembly.image_redactions(rows, _images(rows), ["doc_id", "page"]), "doc_id", "page", "ord")


def _drawings(spark: SparkSession, sf: str) -> DataFrame:
    """Toxic documents as signatures: the first line of each as the drawing."""
    said = _table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("path"), (F.col("toxic") == 1).alias("is_signature"))
    return assembly.drawing_redactions(said, _placed(spark, sf).withColumn("path", F.col("doc_id").cast("string")), ["doc_id", "page"])


def drawing_redactions(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_drawings(spark, sf), "doc_id", "page", "ord")


def page_redactions(spark: SparkSession, sf: str) -> DataFrame:
    """The rectangles of lines that hold entities, of images and of drawings, merged by page."""
    rows = _placed(spark, sf)
    texts = spans.detect(rows, "line_text").where(F.size("spans") > 0)
    images = assembly.image_redactions(rows, _images(rows), ["doc_id", "page"])
    return _rounded(assembly.page_redactions(texts, images, _drawings(spark, sf), ["doc_id", "page"]), "doc_id", "page")


def drawing_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of the drawing that a vector's values make: four times a line, a curve and an operation that is not drawn."""
    v = F.col("embedding").cast("array<double>")
    points = lambda at, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.get(v, at + i * 2).alias("x"), F.get(v, at + i * 2 + 1).alias("y")))
    ops = [F.struct(F.lit(op).alias("op"), points(16 * k + at, n).alias("points")) for k in range(4) for op, at, n in (("l", 0, 2), ("c", 4, 4), ("re", 12, 2))]
    rows = _table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(*ops)).alias("o")).select("vec_id", "o.op", "o.points")
    return _rounded(geometry.drawing_boxes(rows, ["vec_id"]), "vec_id")


# Groups


def groups_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return examples.groups_by_size(_table(spark, sf, "documents"), "source", "doc_id")


def lines_by_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = layout.lines(_table(spark, sf, "documents")).where("line_text <> ''")
    return layout.by_text(rows).select("doc_id", "line", "first_line", "n_equal", "position")


def dataset_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with and without numbers in the parts of a dataset."""
    rows = _table(spark, sf, "documents").select(F.col("doc_id").alias("example_id"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0)).alias("annots"))
    return examples.dataset_counts(examples.dataset(rows), F.size("annots") > 0)


def cosine_top1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """As cosine_top1, with the first and the last vector of a class as a pair of which the better counts."""
    e = _table(spark, sf, "embeddings")
    pairs = e.groupBy("label").agg(F.min("vec_id").alias("cand_id"), F.min_by("embedding", "vec_id").alias("cand_vector"), F.max_by("embedding", "vec_id").alias("cand_other"))
    return similarity.top_candidate(e.select("vec_id", "embedding"), pairs).select("vec_id", "best_id", F.when(F.col("best_id").isNotNull(), F.col("score")).alias("score"))


def queries() -> dict:
    """Queries by name; each takes (spark, sf_dir)."""
    found = (
        carried_entities, entity_substitutes, date_tokens, named_entities, acronym_relations, named_annotations, image_redactions, drawing_redactions, page_redactions, drawing_boxes,
        groups_by_size, lines_by_text, dataset_counts, cosine_top1_pairs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    """DuckDB SQL by the name of the query."""
    on_cases = lambda label, p, rank=0: base._matches_sql(label, p, rank, f"{_CASES_SQL} c")
    placed = f"p AS (SELECT doc_id, page, line, line_text, length(line_text)::DOUBLE AS x1, y0, y0 + {layout.HEIGHT} AS y1 FROM ({base._LINES_SQL}) WHERE line_text <> '')"
    rules = [p for label, p in PATTERNS.items() if label != "SSN"] + [DATE_RULE]
    some = " OR ".join(f"regexp_matches(line_text, {_q(p)})" for p in rules)
    some += f" OR (regexp_matches(line_text, {_q(base._SSN_SQL)}) AND NOT regexp_matches(line_text, {_q(base._NO_SSN)}))"
    normal = f"n AS MATERIALIZED (SELECT doc_id, text AS raw, {base._normal_sql()} AS text FROM {_CASES_SQL})"
    marks = " UNION ALL ".join(base._matches_sql(label, p) for label, p in (("POST_CODE", preparation.NUMBER), ("PERSON", preparation.NAME)))
    lows = lambda at: ", ".join(f"e[{16 * k + i}]" for k in range(4) for i in at)
    named = " UNION ALL ".join(on_cases(label, p) for label, p in NAME_RULES.items())
    return {
        "carried_entities": f"""
            WITH {normal}, e AS ({base._all_sql(table="n")})
            SELECT e.doc_id, label, start, (start + length(ent))::INT AS "end", ent, (position(ent IN raw) - 1)::INT AS raw_start, (position(ent IN raw) - 1 + length(ent))::INT AS raw_end,
              1::DOUBLE AS ratio, true AS placed FROM e JOIN n ON e.doc_id = n.doc_id""",
        "date_tokens": f'SELECT doc_id, start, (start + length(ent))::INT AS "end", ent FROM ({on_cases("DATE", DATE_TOKEN)}) WHERE regexp_matches(ent, {_q(DATE_RULE)})',
        "named_entities": f'SELECT doc_id, label, start, (start + length(ent))::INT AS "end", ent FROM ({named})',
        "acronym_relations": f"""SELECT DISTINCT doc_id, regexp_extract(ent, '^(.*) \\(', 1) AS long, regexp_extract(ent, '\\(([A-Z]+)\\)', 1) AS short FROM ({on_cases("A", ACRONYM_RULE)})""",
        "named_annotations": f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start, ent) - 1)::INT AS ord, start, (start + length(ent))::INT AS "end", label AS value FROM ({marks})""",
        "image_redactions": f"""
            WITH {placed}, h AS (SELECT * FROM p WHERE {some})
            SELECT doc_id, page, line AS ord, 0::DOUBLE AS x0, round(y0 / 2, 6) AS y0, round(x1 / 2, 6) AS x1, round(y1 / 2, 6) AS y1 FROM h""",
        "drawing_redactions": f"""
            WITH {placed} SELECT doc_id, page, line AS ord, 0::DOUBLE AS x0, y0, x1, y1 FROM p
            WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line) = 1""",
        "drawing_boxes": f"""
            SELECT vec_id, round(least({lows((1, 3, 5))}), 6) AS x0, round(least({lows((2, 4, 6, 8, 10, 12))}), 6) AS y0, round(greatest(0, {lows((1, 3, 9, 11))}), 6) AS x1,
              round(greatest(0, {lows((2, 4, 6, 8, 10, 12))}), 6) AS y1 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
        "groups_by_size": """
            SELECT *, (row_number() OVER (ORDER BY n DESC, first, source) - 1)::INT AS place FROM (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source)""",
        "lines_by_text": f"""
            WITH {placed}, f AS (SELECT *, min(line) OVER s AS first_line, count(*) OVER s AS n_equal FROM p WINDOW s AS (PARTITION BY doc_id, page, line_text))
            SELECT doc_id, line, first_line, n_equal, (row_number() OVER (PARTITION BY doc_id, page ORDER BY y1, first_line, line) - 1)::INT AS position FROM f""",
        "dataset_counts": f"""
            SELECT part, count(*) FILTER (positive) AS n_positive, count(*) FILTER (NOT positive) AS n_negative
            FROM ({preparation.oracle_sql()["dataset_parts"]}) JOIN (SELECT doc_id AS example_id, coalesce(regexp_matches(text, '[0-9]'), false) AS positive FROM documents) USING (example_id) GROUP BY part""",
        "cosine_top1_pairs": f"""
            WITH c AS (SELECT min(vec_id) AS cand_id, arg_min(embedding, vec_id) AS v, arg_max(embedding, vec_id) AS o FROM embeddings GROUP BY label),
            s AS (SELECT vec_id, cand_id, greatest(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), list_cosine_similarity(embedding::DOUBLE[], o::DOUBLE[])) AS score FROM embeddings, c),
            r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cand_id) AS k FROM s)
            SELECT vec_id, CASE WHEN score > {similarity.THRESHOLD} THEN cand_id END AS best_id, CASE WHEN score > {similarity.THRESHOLD} THEN round(score, 6) END AS score FROM r WHERE k = 1""",
    }
