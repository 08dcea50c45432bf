"""Entities carried to raw text, page redactions and stand-ins on small cases; their queries against DuckDB on the smallest tables."""

import json
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from sableframe.operators import assembly, examples, geometry, layout, matching, similarity, spans
from sableframe.plans import assembly as queries
from sableframe.sources import readers
from tests.test_core import SF, plain


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got and got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)


def test_carried_entities_of_changed_texts(spark):
    rows = [
        (1, "call +48 123  456 7890 now", "+48 123 456 7890", "+48 123  456 7890"),
        (2, "call 123\u2013456\u20147890 now", "123-456-7890", "123\u2013456\u20147890"),
        (3, "mail a\u200bda@mail.example.com now", "ada@mail.example.com", "a\u200bda@mail.example.com"),
        (4, "10.0.0.1", "10.0.0.1", "10.0.0.1"),
        (5, None, None, None),
        (6, "", None, None),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {}
    for r in assembly.carried(docs, ["doc_id"], "text").collect():
        got.setdefault(r["doc_id"], {})[r["ent"]] = r
    assert set(got) <= {1, 2, 3, 4}
    for key, text, ent, raw in rows[:4]:
        r = got[key][ent]
        assert r["placed"] == (r["ratio"] >= assembly.LEAST_RATIO)
        if raw is not None:
            assert r["placed"] and text[r["raw_start"] : r["raw_end"]] == raw
    assert not any(r["placed"] for r in assembly.carried(docs, ["doc_id"], "text", least=1.01).collect())


def test_spellings():
    for ent, raw in (("a-b", "a\u2014b"), ("it's", "it\u2019s"), ("x... y", "x\u2026\u00a0\u200b y"), ("caf\u00e9", "cafe\u0301"), ("(a.b)", "(a.b)")):
        assert matching.spellings(ent).fullmatch(raw), (ent, raw)
    assert not matching.spellings("a.b").search("axb")


def test_substitutes_cover_every_line_of_an_entity(spark):
    text = "host 10.0.0.1 and\n10.0.0.1 or 10.0.0.2\ncall +48 123\n456 7890"
    rows = layout.paragraphs(layout.lines(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    ents = assembly.carried(layout.paragraph_texts(rows), ["doc_id", "paragraph"], "paragraph_text")
    got = [tuple(r) for r in assembly.substitutes(ents, rows).where("label IN ('IPv4', 'PHONE')").select("line", "label", "ent", "new_val", "in_line_start", "in_line_end").collect()]
    assert {(0, "IPv4", "10.0.0.1", '"IPv4 Address 1"', 5, 13), (1, "IPv4", "10.0.0.2", '"IPv4 Address 2"', 12, 20)} <= set(got)
    assert {(r[0], r[4], r[5]) for r in got if r[2] == "+48 123 456 7890"} == {(2, 5, 12), (3, 0, 8)}


def test_queries_of_substitutes_and_pages_give_whole_results(spark):
    rows = layout.paragraphs(layout.lines(spark.read.parquet(f"{SF}/documents.parquet")))
    texts = {(r["doc_id"], r["line"]): r["line_text"] for r in rows.collect()}
    for r in queries.entity_substitutes(spark, SF).collect():
        part = texts[r["doc_id"], r["line"]][r["in_line_start"] : r["in_line_end"]]
        assert part and " ".join(unicodedata.normalize("NFC", part).split()) in r["ent"]
    boxes = {}
    for r in queries.page_redactions(spark, SF).collect():
        boxes.setdefault((r["doc_id"], r["page"]), []).append((r["x0"], r["y0"], r["x1"], r["y1"]))
    single = [*queries.image_redactions(spark, SF).collect(), *queries.drawing_redactions(spark, SF).collect()]
    assert single
    for r in single:
        assert any(b[0] <= r["x0"] and b[1] <= r["y0"] and r["x1"] <= b[2] and r["y1"] <= b[3] for b in boxes[r["doc_id"], r["page"]])


def test_pages_unite_texts_images_and_drawings(spark):
    part = lambda *rows: spark.createDataFrame(list(rows), "page int, ord int, x0 double, y0 double, x1 double, y1 double")
    none = part((0, 0, 0.0, 0.0, 0.0, 0.0)).where("false")
    made = assembly.page_redactions(part((1, 0, 0.0, 0.0, 5.0, 5.0), (2, 0, 0.0, 0.0, 5.0, 5.0)), part((1, 0, 4.0, 0.0, 9.0, 5.0)), part((1, 0, 30.0, 0.0, 31.0, 1.0)), ["page"])
    assert sorted(map(tuple, made.collect())) == [(1, 0.0, 0.0, 9.0, 5.0), (1, 30.0, 0.0, 31.0, 1.0), (2, 0.0, 0.0, 5.0, 5.0)]
    assert assembly.page_redactions(none, none, none, ["page"]).collect() == []


def test_images_with_dates_and_signatures(spark):
    lines = spark.createDataFrame([("a", 0, "on 1/2/2020", 0.0, 0.0, 10.0, 5.0), ("a", 1, "nothing", 0.0, 5.0, 10.0, 10.0), ("b", 0, None, 0.0, 0.0, 1.0, 1.0)], "path string, ord int, line_text string, x0 double, y0 double, x1 double, y1 double")
    box = "struct(double({}) as x0, double({}) as y0, double({}) as x1, double({}) as y1)"
    images = spark.createDataFrame([("a", 0, 20, 10, 7), ("a", 1, 20, 10, 8), ("b", 0, 1, 1, 7)], "path string, ord int, width int, height int, page int").withColumn("rect", F.expr(box.format(100, 100, 140, 120)))
    assert [tuple(r) for r in assembly.image_redactions(lines, images, ["page"]).collect()] == [(7, 0, 100.0, 100.0, 120.0, 110.0)]
    said = spark.createDataFrame([("a", True), ("a", True), ("b", False), ("c", None)], "path string, is_signature boolean")
    drawings = spark.createDataFrame([(p, k, 0.0, 0.0, 1.0 + k, 1.0, 3) for p in "abc" for k in (1, 0)], "path string, ord int, x0 double, y0 double, x1 double, y1 double, page int")
    assert [tuple(r) for r in assembly.drawing_redactions(said, drawings, ["page"]).collect()] == [(3, 0, 0.0, 0.0, 1.0, 1.0)]


def test_drawing_boxes(spark):
    ops = [(1, "l", [(-3.0, 2.0), (4.0, -5.0)]), (1, "c", [(1.0, 1.0), (-90.0, 9.0), (8.0, 2.0), (2.0, 3.0)]), (1, "re", [(-50.0, 0.0), (50.0, 0.0)]), (2, "re", [(0.0, 0.0)]), (3, "l", [(-3.0, -2.0), (-1.0, -1.0)]), (4, "l", []), (5, None, None)]
    rows = spark.createDataFrame(ops, "k int, op string, points array<struct<x:double,y:double>>")
    assert sorted(map(tuple, geometry.drawing_boxes(rows, ["k"]).collect())) == [(1, -3.0, -5.0, 8.0, 9.0), (3, -3.0, -2.0, 0.0, 0.0)]


def test_annotations_of_a_file(spark, tmp_path):
    kind = readers.ENTITY_TYPE
    said = [{"%TYPE": kind, "begin": 9, "end": 12, "value": "LOC"}, {"%TYPE": kind, "begin": 0, "end": 3, "value": "ORG"}, {"%TYPE": kind, "begin": 1, "end": 2, "value": "MISC"}, {"%TYPE": kind, "begin": 4, "end": 5}, {"%TYPE": "x.Sentence", "begin": 0, "end": 20, "value": "ORG"}]
    (tmp_path / "a.json").write_text(json.dumps({"%FEATURE_STRUCTURES": said}))
    rows = readers.named_annotations(readers.annotations(spark, str(tmp_path)), ["path"])
    assert [tuple(r) for r in rows.drop("path").orderBy("ord").collect()] == [(0, 0, 3, "ORG"), (1, 9, 12, "LOC")]
    spark.createDataFrame([("t1", ["a", "b"], [4, 0])], "id string, tokens array<string>, labels array<long>").write.parquet(f"{tmp_path}/tokens")
    rows = examples.bio_examples(readers.tokenised(spark, f"{tmp_path}/tokens"), ["B", "C", "D", "E", "O"])
    assert [(r["text"], [tuple(a) for a in r["annots"]]) for r in rows.collect()] == [("a b", [(2, 3, "B")])]


def test_groups_and_lines(spark):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate("bbaac")], "k long, c string")
    assert [r["c"] for r in examples.groups_by_size(rows, "c", "k").orderBy("place").collect()] == ["b", "a", "c"]
    assert [r["c"] for r in examples.groups_by_size(rows, "c", "k", descending=False).orderBy("place").collect()] == ["c", "b", "a"]
    lines = spark.createDataFrame([(1, 0, 0, "x", 9.0), (1, 0, 1, "y", 9.0), (1, 0, 2, "x", 9.0), (1, 0, 3, "z", 5.0)], "doc_id int, page int, line int, line_text string, y1 double")
    assert [r["line"] for r in layout.by_text(lines).orderBy("position").collect()] == [3, 0, 2, 1]
    cands = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [0.0, 1.0], [1.0, 0.01])], "cand_id long, cand_vector array<double>, cand_other array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.01]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "k int, embedding array<double>")
    assert {r["k"]: r["best_id"] for r in similarity.top_candidate(asked, cands).collect()} == {1: 2, 2: 1, 3: None}


def test_date_tokens_and_long_runs(spark):
    docs = spark.createDataFrame([(1, "a" * 1_000_000), (2, "x-1/2/2020 " + "b" * 200_000), (3, None)], "doc_id long, text string")
    found = docs.withColumn("spans", spans.date_tokens(F.coalesce("text", F.lit(""))))
    assert [(r["doc_id"], r["ent"]) for r in spans.entities(found).collect()] == [(2, "x-1/2/2020")]
    assert spans.entities(spans.named(docs)).collect() == [] and spans.acronym_tags(docs).collect() == []
