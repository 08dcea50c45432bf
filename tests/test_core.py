"""The engine's own operators on small cases; the catalog against DuckDB on the smallest tables."""

import datetime
import decimal
import os
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sableframe.functions import text as T
from sableframe.functions.rules import PATTERNS, RuleBook
from sableframe.operators import examples, geometry, similarity, spans
from sableframe.plans import catalog
from sableframe.sources import readers
from sableframe.streaming import detect as streaming

SF = "/root/testdata/sf0.001"
TEXTS = [
    "Mail bob.x@mail.example.com or 10.0.0.1, 256.1.1.1.",
    "call +48 (123) 456-7890 now; é10.1.2.3 or (10.1.2.3)",
    "123-45-6789",
    "000-45-6789",
    "see https://www.a-b.org/x?y=1 and ftp://f.example.net",
    "fe80::1 and ::1 and 1:2:3:4:5:6:7:8",
    "VIN 1HGCM82633A004352, abc 123 45 6789 a1",
    "😀 10.0.0.1 😀",
    "",
    "no entity here",
]


@pytest.mark.parametrize("label", PATTERNS)
def test_matches_equal_python(spark, label):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    got = {r["k"]: [(s["start"], s["end"]) for s in r["s"]] for r in df.select("k", spans.matches(F.col("t"), PATTERNS[label], label, 0).alias("s")).collect()}
    assert got == {k: [m.span() for m in re.finditer(PATTERNS[label], t)] for k, t in enumerate(TEXTS)}


def test_overlaps_and_masks(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    rows = streaming.masked_stream(df.withColumnRenamed("t", "text")).collect()
    for r in rows:
        assert len(r["masked"]) == len(r["text"])
        ends = [(s["start"], s["end"]) for s in r["spans"]]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert [s["label"] for s in rows[0]["spans"]] == ["EMAIL", "IPv4", "IPv4"][: len(rows[0]["spans"])] and len(rows[0]["spans"]) >= 2
    assert rows[2]["masked"] == "x" * 11 and rows[9]["masked"] == TEXTS[9]


def test_streams_give_what_batches_give(spark, tmp_path):
    spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, text string").parquet(f"{tmp_path}/in")
    streaming.write(streaming.masked_stream(stream), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    batch = streaming.masked_stream(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(batch.collect())


def test_own_rules(spark):
    book = RuleBook()
    book.register("TICKET", r"\bT-\d+\b")
    found = spans.detect(spark.createDataFrame([("see T-42",)], "text string"), book=book).first()["spans"]
    assert [(s["label"], s["start"], s["end"]) for s in found] == [("TICKET", 4, 8)]
    with pytest.raises(ValueError):
        book.register("", "x")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a b", "a b"), ("“q” ‘s’ — –", "\"q\" 's' - -"), ("a​b", "ab"), ("a   b", "a b"), ("a…", "a..."), ("a·b", "a-b"), ("  a\t\nb ", "a b"), ("", ""), ("plain", "plain"),
        (unicodedata.normalize("NFD", "é"), "é"),
    ],
)
def test_normalized(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.normalized(F.col("t"))).first()[0] == want


def test_links_dates_and_acronyms(spark):
    df = spark.createDataFrame([("https://abc.de",), ("ftp://xyz.de",), ("a@b.co.uk",), ("see https://abc.de",), ("plain",), ("",)], "t string")
    assert [r[0] for r in df.select(T.is_link(F.col("t"))).collect()] == [True, True, True, False, False, False]
    ok = spark.range(1).select(T.acronym_of(F.lit("mpls"), F.array(*map(F.lit, ["Multi", "Protocol", "Label", "Switching"]))).alias("a"), T.acronym_of(F.lit("x"), F.array(F.lit("Y"))).alias("b")).first()
    assert tuple(ok) == (True, False)


def test_balance(spark):
    rows = spark.createDataFrame([(k, "abbb"[k % 4]) for k in range(40)], "k long, label string")
    assert {r["label"]: r["count"] for r in examples.undersample(rows, "label", "k", 2.0).groupBy("label").count().collect()} == {"a": 10, "b": 20}
    assert {r["label"]: r["num_aug"] for r in examples.oversample_plan(rows, "label", 2.0).collect()} == {"a": 4, "b": 0}
    parts = {r["part"]: r["count"] for r in examples.split(spark.range(100).withColumnRenamed("id", "k"), "k").groupBy("part").count().collect()}
    assert parts == {"train": 70, "val": 19, "test": 11}


def test_boxes(spark):
    b = lambda *x: geometry.box(*map(F.lit, x))
    r = spark.range(1).select(
        T.iou(b(0, 0, 2, 2), b(1, 1, 3, 3)).alias("i"), T.iou(b(0, 0, 0, 0), b(0, 0, 0, 0)).alias("z"), geometry.adjacent(b(0, 0, 10, 5), b(15, 1, 20, 5)).alias("a"), geometry.adjacent(b(0, 0, 10, 5), b(20, 0, 30, 5)).alias("e"),
        geometry.on_page(b(0, 0, 10, 10), b(100, 100, 200, 150), F.lit(20), F.lit(10)).alias("p"),
    ).first()
    assert r["i"] == pytest.approx(1 / 7) and r["z"] == 0 and r["a"] and not r["e"]
    assert tuple(r["p"]) == (100.0, 100.0, 150.0, 150.0)
    rects = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 5.0), (1, 1, 20.0, 0.0, 25.0, 5.0), (1, 2, 4.0, 0.0, 21.0, 5.0)], "page int, ord int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, geometry.merge_overlapping(rects, ["page"]).collect())) == [(1, 0.0, 0.0, 21.0, 5.0), (1, 20.0, 0.0, 25.0, 5.0)]


def test_relations_of_acronyms(spark):
    rows = [(1, 0, "B-long", "World", 0, 1, 0), (1, 1, "I-long", "Bank", 1, 2, 0), (1, 2, "B-short", "WB", 3, 4, 0), (1, 3, "B-long", "Far", 10, 11, 1), (1, 4, "B-short", "F", 20, 21, 1)]
    got = similarity.acronym_relations(spark.createDataFrame(rows, "doc_id long, ord int, tag string, text string, tok_start int, tok_end int, sent int")).collect()
    assert [tuple(r) for r in got] == [(1, "World Bank", "WB")]


def test_sources_and_seams(spark, tmp_path):
    os.makedirs(f"{tmp_path}/a/b")
    for name in ("a/x.pdf", "a/b/y.PDF", "a/z.txt"):
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write("x")
    assert readers.files(spark, f"{tmp_path}/a").count() == 2
    with open(f"{tmp_path}/cas.json", "w") as f:
        f.write('{"%FEATURE_STRUCTURES": [{"%TYPE": "Ent", "begin": 1, "end": 3, "value": "ORG"}]}')
    assert tuple(readers.annotations(spark, f"{tmp_path}/cas.json").select("type", "start", "end", "value").first()) == ("Ent", 1, 3, "ORG")
    with pytest.raises(RuntimeError):
        readers.OCR(spark.range(1))


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_catalog_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["lang", "label", "n_docs", "n_entities"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


LONG = ['"' + "a" * 1_000_000, "a." * 200_000 + "@", "x@" + "a." * 200_000, "x@" + "a" * 1_000_000, "x@[1.1.1.a:" + "y" * 300_000, "1" * 1_000_000, "a" * 1_000_000, "1:" * 100_000, "+1 " * 100_000, "a-" * 200_000, "\\" * 300_000, "A1" * 300_000]


@pytest.mark.parametrize("label", PATTERNS)
def test_long_tokens_end(spark, label):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(LONG)], "k int, t string").repartition(4)
    got = df.select("k", F.size(spans.matches(F.col("t"), PATTERNS[label], label, 0)).alias("n")).collect()
    assert len(got) == len(LONG) and all(r["n"] >= 0 for r in got)


EMAILS = ['"a b\\" c"@x.org', '"ab"@x.y-z.org.', "a..b@c.de", ".a@b.cd", "a.b.@c.d", "u@a-.b", "u@-a.b", "u@a.b-c-.d", "x@[1.2.3.4]", "x@[1.2.3.tag:a]b]c] d", "x@[1.2.3.tag:a\\ b]", "x@[1.2.3.t:\\\\ \\\t]z", "two@x.yz;three@x.yz", "x@b.co_y@z.w", "x@y.co.-b@z.w", "a@b", "é.a@b.co", '""@b.co', '"\\"@b.co']


def test_loops_match_what_the_pattern_matches(spark):
    import itertools

    texts = EMAILS + ["".join(x) for x in itertools.product(['a', '.', '@', '"', "\\", "-"], repeat=5)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: [(s["start"], s["end"]) for s in r["s"]] for r in df.select("k", spans.matches(F.col("t"), PATTERNS["EMAIL"], "EMAIL", 0).alias("s")).collect()}
    assert got == {k: [m.span() for m in re.finditer(PATTERNS["EMAIL"], t)] for k, t in enumerate(texts)}


def test_running_sums(spark):
    rows = [(k, [(i * 7 + k) % 11 for i in range(n)]) for k, n in enumerate((0, 1, 5, 255, 256, 257, 1000))]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(rows, "k int, x array<int>").select("k", T.running(F.col("x")).alias("s")).collect()}
    assert got == {k: [sum(x[:i]) for i in range(len(x))] for k, x in rows}


def brute_entities(text):
    """Aligned matches of all rules in turn, each time without overlaps: longest in tokens, then first, then found earlier."""
    edge = lambda c: c == "" or re.fullmatch(r"\s", c) or unicodedata.category(c)[0] == "P" or c in "$+<=>^`|~"
    kept = []
    for label, pattern in PATTERNS.items():
        found = [(m.start(), m.end(), label) for m in re.finditer(pattern, text)]
        found = [(a, b, x) for a, b, x in found if edge(text[a - 1 : a]) and edge(text[b : b + 1]) and text[a:b] == text[a:b].strip()]
        free = []
        size = lambda s: len(re.findall(r"\w+|[^\w\s]+", text[s[0] : s[1]]))
        for s in sorted(kept + found, key=lambda s: (-size(s), s[0])):
            if all(s[1] <= o[0] or o[1] <= s[0] for o in free):
                free.append(s)
        kept = sorted(free)
    return kept


def test_resolved_and_masked_equal_brute_force(spark, tmp_path):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(-k - 1, t) for k, t in enumerate(TEXTS)] + [(k - 100, t) for k, t in catalog.CASES]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: brute_entities(t) for i, t in docs}
    got = {}
    for r in catalog.resolved_entities(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["label"]))
    assert {i: sorted(s) for i, s in got.items()} == {i: s for i, s in want.items() if s}
    texts = dict(docs)
    for r in catalog.masked_text(spark, str(tmp_path)).collect():
        t = list(texts[r["doc_id"]])
        for a, b, _ in want[r["doc_id"]]:
            t[a:b] = "x" * (b - a)
        assert r["masked"] == "".join(t)


def test_entities_over_a_line_end_are_redacted_on_both_lines(spark):
    from sableframe.operators import layout, redaction

    docs = spark.createDataFrame([(1, "call 555\n1234567 now\n\nother")], "doc_id long, text string")
    rows = layout.paragraphs(layout.lines(docs))
    ents = spans.detect(layout.paragraph_texts(rows), "paragraph_text", only="PHONE").select("doc_id", "paragraph", F.explode("spans").alias("s")).select("doc_id", "paragraph", "s.start", "s.end")
    hits = layout.entity_lines(ents, rows).select("line", "in_line_start", "in_line_end").collect()
    assert sorted(map(tuple, hits)) == [(0, 5, 8), (1, 0, 7)]
    at = layout.entity_lines(ents, rows.select("doc_id", "paragraph", "line_start", "line_end", F.col("paragraph_line").alias("line"), "page"))
    subs = at.select("doc_id", "paragraph", F.col("line").alias("paragraph_line"), F.col("in_line_start").alias("start"), F.col("in_line_end").alias("end"))
    got = {r["line"]: r["redacted_text"] for r in redaction.redacted_lines(subs, rows).collect()}
    assert got[0] == "call xxx" and got[1] == "xxxxxxx now" and "555" not in str(got)


def test_organisations_share_stand_ins(spark):
    rows = [(1, 0, "Acme", [1.0, 0.0, 0.0]), (1, 5, "Acme Inc", [0.99, 0.05, 0.0]), (1, 9, "Beta Corp", [0.0, 1.0, 0.0]), (1, 12, "BC", [0.0, 0.0, 1.0]), (1, 20, "HTML", [0.5, 0.5, 0.0]), (2, 3, "BC", [0.0, 0.0, 1.0]), (1, 30, "Acme", [1.0, 0.0, 0.0])]
    ents = spark.createDataFrame(rows, "doc_id long, start long, ent string, vector array<double>")
    relations = spark.createDataFrame([(1, "Beta Corp", "BC")], "doc_id long, long string, short string")
    stops = spark.createDataFrame([(7, [0.5, 0.5, 0.0])], "cand_id long, cand_vector array<double>")
    got = {(r["doc_id"], r["start"]): (r["canonical"], r["new_val"]) for r in similarity.organisation_pseudonyms(ents, relations, stops).collect()}
    a, b = ("Acme", '"Company A"'), ("Beta Corp", '"Company B"')
    assert got == {(1, 0): a, (1, 5): a, (1, 30): a, (1, 9): b, (1, 12): b, (2, 3): ("BC", '"Company A"')}
