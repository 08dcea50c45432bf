"""Redaction, matching and training examples on small cases; their queries against DuckDB on the smallest tables."""

import hashlib
import os
import re
import string
import unicodedata
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from sableframe import __main__ as command
from sableframe.functions.rules import PATTERNS
from sableframe.operators import examples, geometry, matching, redaction, similarity, synthetic
from sableframe.plans import catalog, preparation
from sableframe.sources import readers
from tests.test_core import SF, plain


def right(s, e):
    return s, e + 1


def slid(s, e):
    return s + 1, e + 1


def wider_left(s, e):
    return s - 1, e


WINDOWS = {
    "found where it was sought": ("Ada Brook", "to Ada Brook, Ashby", (3, 12), right, (1.0, 3, 12)),
    "moved until it is equal": ("10017", "Ashby: 10017", (2, 7), slid, (1.0, 7, 12)),
    "widened over a mark that normalising dropped": ("co-op", "co\u200b-op", (0, 5), right, (10 / 11, 0, 6)),
    "widened to the left": ("Mill Lane", "22 Mill Lane", (4, 12), wider_left, (1.0, 3, 12)),
    "nothing in common": ("quay", "0123", (0, 4), slid, (0.0, 0, 4)),
    "no source": ("", "Derby", (1, 1), right, (0.0, 1, 1)),
    "no target": ("Derby", "", (0, 0), slid, (0.0, 0, 0)),
}


@pytest.mark.parametrize("case", WINDOWS)
def test_windows_climb_to_the_best(case):
    source, target, window, step, (ratio, s, e) = WINDOWS[case]
    got = matching.climb(source, target, *window, 0.0, step)
    assert got[0] == pytest.approx(ratio) and got[1:] == (s, e)


def test_windows_outside_the_target_are_errors():
    for window in ((-2, 2), (1, 9), (4, 2)):
        with pytest.raises(ValueError, match="window"):
            matching.climb("lane", "a lane", *window, 0.0, slid)


def test_boundaries(spark):
    rows = [("a “Foo  Bar” b", '"Foo Bar"'), ("abc", "bc"), ("abc", "zz"), (None, "a"), ("a", ""), ("a", None)]
    df = spark.createDataFrame(rows, "raw string, ent string")
    got = [r[0] and (r[0]["start"], r[0]["end"], round(r[0]["ratio"], 3)) for r in df.select(matching.boundaries(F.col("raw"), F.col("ent"))).collect()]
    assert got == [(3, 12, 0.778), (1, 3, 1.0), None, None, None, None]
    assert tuple(df.limit(1).select(matching.boundaries(F.col("raw"), F.col("ent"), compat=True)).first()[0]) == (3, 12, 1.0)


def test_fonts(spark):
    assert {r["font"]: (r["match"], r["weight"]) for r in preparation.font_matches(spark, SF).collect()} == {
        "ArialMT": ("Arial", round(4 * 10 / 12, 6)), "Arial-BoldMT": ("Segoe UI", None), "TimesNewRomanPSMT": ("Times New Roman", 3 * 26 / 32),
        "CourierNewPSMT": ("Courier New", round(2 * 20 / 25, 6)), "Unknown-bold": ("Segoe UI Bold", None), "Unknown-italic": ("Segoe UI Italic", None), "Unknown": ("Segoe UI", None),
    }


EXAMPLES = [
    (1, "Bob of Acme at 1 Road, Town on March 21. Acme!", [(0, 3, "PERSON"), (7, 11, "ORG"), (15, 27, "ADDR"), (23, 27, "LOC"), (31, 39, "DATE"), (41, 45, "ORG")]),
    (2, "plain", []), (3, "", []), (4, None, None), (5, "at 5/6/2020", [(3, 11, "DATE")]),
]


def test_placeholders_and_variants(spark):
    ex = spark.createDataFrame(EXAMPLES, f"example_id long, text string, annots {synthetic.ANNOTS}")
    marked = {r["example_id"]: r["m"] for r in ex.select("example_id", synthetic.placeholders(F.col("text"), F.col("annots")).alias("m")).collect()}
    assert marked[1]["text"] == "[Person1] of [Organization1] at [Address1] on [Date1]. [Organization2]!"
    assert [(v["label"], v["k"], v["value"], v["form"]) for v in marked[1]["values"]][3] == ("DATE", 1, "March 21", "%B %d")
    assert marked[2]["text"] == "plain" and marked[3]["text"] == "" and marked[4]["text"] is None
    made = synthetic.variants(ex.withColumn("num_aug", F.lit(3)))
    rows = made.collect()
    assert len(rows) == 15 and sorted(map(str, rows)) == sorted(map(str, made.collect()))
    for r in rows:
        for a in r["annots"] or []:
            said = r["text"][a["start"] : a["end"]]
            if a["label"] in ("ORG", "PERSON", "ADDR"):
                assert said in synthetic.VALUES[a["label"]]
            elif a["label"] == "POST_CODE":
                assert said.isdigit()
            elif a["label"] == "DATE" and r["example_id"] == 5:
                assert said[2] == said[5] == "/"
    assert {len(r["annots"]) for r in rows if r["example_id"] == 1} == {9}


def test_parts_of_addresses(spark):
    got = lambda t: [tuple(s) for s in spark.range(1).select(synthetic.address_parts(F.lit(t), F.lit(10))).first()[0]]
    assert got("1 Road,, Old Town 123") == [(10, 16, "LOC"), (19, 31, "LOC"), (28, 31, "POST_CODE")]
    assert got("") == [] and got("a, ") == [(10, 11, "LOC")]


@pytest.mark.parametrize(("a", "b"), [(3, 8), (8, 3), (4, 4), (0, 3), (3, 0), (1, 9), (100, 37), (0, 0)])
def test_interleaving(spark, a, b):
    rows = spark.range(a + b).withColumn("x", F.col("id") < a)
    got = [(r["position"], r["x"]) for r in examples.interleaved(rows, "id", F.col("x")).orderBy("position").collect()]
    assert [p for p, _ in got] == list(range(a + b))
    s, n = min(a, b), a + b
    if s:
        assert [p for p, x in got if x == (a <= b)] == [round(i * n / s) for i in range(s)]


def test_sentences_of_annotations(spark):
    rows = spark.createDataFrame([(1, "Hi a. Go b! Then c? End"), (2, ""), (3, None)], "k long, t string")
    sents = examples.sentences(rows, "k", "t")
    assert sorted(tuple(r) for r in sents.collect()) == [(1, 0, 0, 5, "Hi a."), (1, 1, 6, 11, "Go b!"), (1, 2, 12, 19, "Then c?"), (1, 3, 20, 23, "End")]
    spans = spark.createDataFrame([(1, 3, 8, "A"), (1, 6, 7, "B")], "k long, start int, end int, label string")
    full = examples.sentence_examples(sents, spans, "k").orderBy("start").collect()
    assert [(r["start"], r["end"], [tuple(a) for a in r["annots"]]) for r in full] == [(0, 11, [(3, 8, "A"), (6, 7, "B")]), (12, 19, []), (20, 23, [])]
    assert examples.sentence_examples(sents, spans, "k", keep_trailing=False).count() == 1
    assert {r["sent"] for r in examples.keyword_sentences(rows, "k", "t", ["Then"]).collect()} == {0, 1, 2, 3}


def test_tokens(spark):
    ex = examples.bio_examples(spark.createDataFrame([(1, ["World", "Bank", "(", "WB"], [2, 3, 4, 0])], "example_id long, tokens array<string>, labels array<int>"), ["B-short", "I-short", "B-long", "I-long"]).first()
    assert ex["text"] == "World Bank ( WB" and [tuple(a) for a in ex["annots"]] == [(0, 5, "B-long"), (6, 10, "I-long"), (13, 15, "B-short")]
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("L").alias("label")) for a, b in ((6, 8), (3, 4), (4, 30), (2, 2), (10, 11))])
    assert [tuple(a) for a in spark.range(1).select(examples.expanded(F.lit("see foobar, x"), spans)).first()[0]] == [(4, 10, "L"), (10, 11, "L")]
    assert spark.range(1).select(examples.unknown_tokens(F.array(F.lit("a"), F.lit("[UNK]"), F.lit("[UNK]")))).first()[0] == [1, 2]


def test_redacted_lines(spark):
    t = spark.createDataFrame([("ill ABC mm end", [(0, 3), (4, 7), (8, 10), (2, 2)])], "t string, s array<struct<start:int,end:int>>")
    assert t.select(redaction.redacted(F.col("t"), F.col("s"))).first()[0] == "x xxx xx end"
    lines = spark.createDataFrame([(1, 0, k, f"line {k}") for k in range(5)], "doc_id long, paragraph int, paragraph_line int, line_text string")
    subs = spark.createDataFrame([(1, 0, 3, 0, 4)], "doc_id long, paragraph int, paragraph_line int, start int, end int")
    got = redaction.redacted_lines(subs, lines).orderBy("paragraph_line").collect()
    assert [(r["paragraph_line"], r["redacted_text"]) for r in got] == [(2, "line 2"), (3, "xxx 3"), (4, "line 4")]


def test_runs_and_occurrences(spark):
    text = "A (A) B A"
    rows = [(1, "ORG", "A", "C", 0, 1, text), (1, "ORG", "A", "C", 3, 4, text), (1, "URL", "B", "u", 6, 7, text), (1, "ORG", "A", "C", 8, 9, text)]
    runs = redaction.merged_runs(spark.createDataFrame(rows, "k long, label string, old_val string, new_val string, start int, end int, line_text string"), ["k"]).orderBy("ord").collect()
    assert [(r["label"], r["start"], r["end"]) for r in runs] == [("URL", 6, 7), ("ORG", 0, 5), ("ORG", 8, 9)]
    lines = spark.createDataFrame([(1, r"Ab aB x.y \Eq ab X.Y \eQ")], "k long, line_text string")
    values = spark.createDataFrame([(1, "AB"), (1, "x.y"), (1, ""), (1, r"\eq"), (1, "AB")], "k long, old_val string")
    found = sorted((r["old_val"], r["start"], r["end"]) for r in redaction.occurrences(lines, values, ["k"]).collect())
    assert found == [("AB", 0, 2), ("AB", 3, 5), ("AB", 14, 16), (r"\eq", 10, 13), (r"\eq", 21, 24), ("x.y", 6, 9), ("x.y", 17, 20)]


def test_canonical_names(spark):
    rows = [(1, 0, "A", [1.0, 0.0], None), (1, 5, "B", [0.99, 0.01], None), (1, 9, "C", [0.0, 1.0], [[1.0, 0.0]]), (1, 12, "D", [0.0, 1.0], []), (1, 15, "A", [1.0, 0.0], None), (1, 20, "E", None, None), (2, 0, "B", [1.0, 0.0], None)]
    got = similarity.canonical_names(spark.createDataFrame(rows, "doc_id long, start int, ent string, vector array<double>, partners array<array<double>>")).collect()
    assert sorted((r["doc_id"], r["start"], r["canonical"]) for r in got) == [(1, 0, "A"), (1, 5, "A"), (1, 9, "A"), (1, 12, "D"), (1, 15, "A"), (1, 20, "E"), (2, 0, "B")]


def test_text_lines_and_boxes(spark):
    rows = [(1, 0, "a", 0.0, 0.0, 10.0, 10.0), (1, 1, "b", 15.0, 1.0, 25.0, 10.0), (1, 2, "far", 200.0, 200.0, 210.0, 210.0), (2, 0, "only", 0.0, 0.0, 1.0, 1.0)]
    got = geometry.text_lines(spark.createDataFrame(rows, "p int, ord int, text string, x0 double, y0 double, x1 double, y1 double"), ["p"]).collect()
    assert [tuple(r) for r in got] == [(1, "a b", 0.0, 0.0, 25.0, 10.0)]
    b = lambda *x: geometry.box(*map(F.lit, x))
    r = spark.range(1).select(
        redaction.flat_rect(b(0, 0, 4, 10)).alias("f"), redaction.line_box(F.array(b(1, 2, 3, 4), b(3, 0, 9, 3))).alias("l"), redaction.drawn_rect(b(1, 5, 2, 6), b(0, 4, 9, 8)).alias("d"),
        redaction.tight_rect(b(0, 0, 5, 20), F.lit(15), F.lit(10), F.lit(0.8), F.lit(-0.2)).alias("t"), redaction.black_or_white(F.array(F.lit(150), F.lit(200), F.lit(255))).alias("p"),
    ).first()
    assert tuple(r["f"]) == (0.0, 4.99, 4.0, 5.01) and tuple(r["l"]) == (1.0, 2.0, 9.0, 4.0) and tuple(r["d"]) == (1.0, 4.0, 2.0, 8.0)
    assert tuple(r["t"]) == pytest.approx((0.0, 7.0, 5.0, 17.0)) and r["p"] == [0, 255, 255]


def test_balanced_and_dataset(spark):
    rows = [(k, f"Acme{k}", [(0, 4, "ORG")]) for k in range(12)] + [(12, "Bob", [(0, 3, "PERSON")]), (13, "Bob Acme", [(0, 3, "PERSON"), (4, 8, "ORG")]), (14, "none", [])]
    ex = spark.createDataFrame(rows, f"example_id long, text string, annots {synthetic.ANNOTS}")
    n = {r["label"]: r["count"] for r in examples.balanced(ex).groupBy("label").count().collect()}
    assert n == {"ORG": 12, "PERSON": 13, None: 2}
    parts = examples.dataset(ex).collect()
    assert len(parts) == 15 and sorted(r["position"] for r in parts if r["part"] == "train") == list(range(sum(r["part"] == "train" for r in parts)))


def test_balanced_keeps_the_first_rows_of_a_cut_class(spark):
    ex = [(f"{label}{k}", f"{name}{k} x", [(0, len(f"{name}{k}"), label)]) for label, name, n in (("ORG", "Acme", 20), ("PERSON", "Bob", 14), ("LOC", "Rome", 9)) for k in range(n)]
    ex += [("both", "Bob Acme", [(0, 3, "PERSON"), (4, 8, "ORG")]), ("none", "none", []), ("null", "said", None)]
    got = examples.balanced(spark.createDataFrame(ex, f"example_id string, text string, annots {synthetic.ANNOTS}"), 1.2).collect()
    # PERSON needs 2 variants each (28 rows), LOC 3 (27); 28 and 27 exceed 1.2 times the least class of 20, of which one time 20 stay.
    for label, n, most in (("PERSON", 14, 2), ("LOC", 9, 3)):
        keys = sorted((f"{label}{k}:{v}" for k in range(n) for v in range(1, most + 1)), key=lambda s: (hashlib.md5(s.encode()).hexdigest(), s))[:20]
        assert sorted(f"{r['example_id']}:{r['variant']}" for r in got if r["label"] == label) == sorted(keys)
    assert sum(r["label"] == "ORG" and r["variant"] == 0 and r["text"].startswith("Acme") for r in got) == 20
    assert {r["example_id"] for r in got if r["label"] is None} == {"both", "none", "null"}
    assert all(r["annots"][0]["label"] == r["label"] and r["text"].endswith(" x") for r in got if r["label"])


def test_balanced_reads_the_examples_twice(spark, tmp_path):
    rows = [(k, f"Acme{k}", [(0, 4, "ORG")]) for k in range(12)] + [(12, "Bob", [(0, 3, "PERSON")])]
    spark.createDataFrame(rows, f"example_id long, text string, annots {synthetic.ANNOTS}").write.parquet(f"{tmp_path}/ex")
    made = examples.balanced(spark.read.parquet(f"{tmp_path}/ex"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == 25 and plan.count("parquet") == 1 and "Window" not in plan


def test_files_by_name(spark, tmp_path):
    for d, name, said in (("a", "x.json", '{"%FEATURE_STRUCTURES": [{"%TYPE": "T", "begin": 0, "end": 2, "value": "ORG"}]}'), ("a", "y.json", '{"%FEATURE_STRUCTURES": [{"%TYPE": "T", "begin": 0, "end": 1, "value": "LOC"}]}'), ("t", "x.txt", "ab\nc")):
        os.makedirs(f"{tmp_path}/{d}", exist_ok=True)
        with open(f"{tmp_path}/{d}/{name}", "w") as f:
            f.write(said)
    found, missing = readers.annotated_texts(spark, f"{tmp_path}/a", f"{tmp_path}/t")
    assert [tuple(r) for r in found.collect()] == [("x", "ab\nc", "T", 0, 2, "ORG")] and [r[0] for r in missing.collect()] == ["y"]


def test_command(spark, tmp_path):
    with pytest.raises(SystemExit) as both:
        command.arguments(["-i", "a", "-t", "b", "-o", "c"])
    assert both.value.code == 2
    os.makedirs(f"{tmp_path}/texts")
    with open(f"{tmp_path}/texts/a.TXT", "w") as f:
        f.write("see\n10.0.0.1")
    command.main(["-t", f"{tmp_path}/texts", "-o", f"{tmp_path}/out_texts"])
    assert [r["masked"] for r in spark.read.parquet(f"{tmp_path}/out_texts").collect()] == ["see\nxxxxxxxx"]
    spark.createDataFrame([(1, "one\nat 10.0.0.1 now\nlast"), (2, None)], "id long, text string").write.parquet(f"{tmp_path}/in")
    command.main(["-i", f"{tmp_path}/in", "-o", f"{tmp_path}/out", "-r"])
    assert spark.read.parquet(f"{tmp_path}/out").where("id = 1").first()["masked"] == "one\nat xxxxxxxx now\nlast"
    assert [r["redacted_text"] for r in spark.read.parquet(f"{tmp_path}/out_lines").orderBy("line").collect()][1] == "at " + "x" * 7 + " now"


@pytest.mark.parametrize("name", sorted(preparation.oracle_sql()))
def test_queries_equal_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = preparation.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(preparation.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)


def test_fuzzy_boundaries_of_whole_table(spark):
    raw = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = preparation.fuzzy_boundaries(spark, SF).collect()
    assert rows and any(r["ratio"] < 1 for r in rows)
    for r in rows:
        text = raw[r["doc_id"]]
        if r["ent"] in text:
            assert (r["start"], r["ratio"]) == (text.find(r["ent"]), 1.0)
        elif r["start"] is not None:
            assert r["ratio"] == pytest.approx(SequenceMatcher(None, r["ent"], text[r["start"] : r["end"]]).ratio(), abs=1e-5)


def test_fuzzy_boundaries_look_up_whole_sentences(spark, tmp_path):
    said = ["It is “quoted” here. Plain one.", "Wait… and see – now.", "A cafe\u0301 in town. Next\u200bone  follows.", None, ""]
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["sent"]): r for r in preparation.fuzzy_boundaries(spark, str(tmp_path)).collect()}
    assert {k: r["ent"] for k, r in got.items()} == {(0, 0): 'It is "quoted" here.', (0, 1): "Plain one.", (1, 0): "Wait...", (1, 1): "and see - now.", (2, 0): "A café in town.", (2, 1): "Nextone follows."}
    assert all(r["start"] is not None for r in got.values())
    assert (got[0, 0]["start"], got[0, 0]["end"], got[0, 0]["ratio"]) == (0, 20, 0.9) and got[0, 1]["ratio"] == 1.0
    for (k, _), r in got.items():
        assert r["ratio"] == pytest.approx(SequenceMatcher(None, r["ent"], said[k][r["start"] : r["end"]]).ratio(), abs=1e-5)


def test_fuzzy_boundaries_have_a_row_for_each_sentence(spark):
    norm = preparation.T.normalized(F.col("text")).alias("text")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", norm)
    assert preparation.fuzzy_boundaries(spark, SF).where("start IS NOT NULL").count() == examples.sentences(docs, "doc_id", "text").count()


def brute_entities(text):
    """Entities of every rule at token edges; of overlapping ones the longest in tokens, folded rule by rule."""
    def at(i):
        return text[i : i + 1] if i >= 0 else ""

    def edge(c):
        return c == "" or c.isspace() or c in string.punctuation or unicodedata.category(c)[0] == "P"

    kept = []
    for label, pattern in PATTERNS.items():
        new = [(label, m.start(), m.end()) for m in re.finditer(pattern, text)]
        both = kept + [x for x in new if edge(at(x[1] - 1)) and edge(at(x[2])) and not at(x[1]).isspace() and not at(x[2] - 1).isspace()]
        kept = []
        for x in sorted(both, key=lambda x: (-len(re.findall(r"\w+|[^\w\s]+", text[x[1] : x[2]])), x[1])):
            if not any(x[1] < k[2] and k[1] < x[2] for k in kept):
                kept.append(x)
    return kept


def brute_map(spark, sf):
    """(doc_id, paragraph, label, start, end, line, in_line_start, in_line_end) of all entities, and the lines by paragraph."""
    found, by = set(), {}
    for r in catalog._paragraphs(spark, sf).collect():
        by.setdefault((r["doc_id"], r["paragraph"]), []).append(r)
    for key, rows in by.items():
        rows.sort(key=lambda r: r["paragraph_line"])
        for label, s, e in brute_entities(" ".join(r["line_text"] for r in rows)):
            found |= {(*key, label, s, e, r["line"], s - r["line_start"], e - r["line_start"]) for r in rows if r["line_start"] <= s and e <= r["line_end"]}
    return found, by


def entity_table(spark, path):
    said = ["see\nwrite to a.b@mail.org now\nnext\nfar\ncall +1 555-1234567 or 10.0.0.1", "123-45-6789", "at http://www.acme.com/x\nfe80:0:0:0:1:2:3:4 up\nlast", "id 1M8GDM9AXKP042788", "plain", "", None, "abc 123 45 6789 ab here"]
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("given", [True, False])
def test_lines_of_entities_of_every_rule(spark, tmp_path, given):
    sf = SF if given else entity_table(spark, tmp_path)
    want, by = brute_map(spark, sf)
    assert {x[2] for x in want} >= ({"PHONE", "EMAIL"} if given else {"PHONE", "EMAIL", "IPv4", "IPv6", "URL", "VIN", "MEDICARE"})  # as long as the SSN, PHONE is the earlier rule
    got = [tuple(r) for r in catalog.all_entity_line_map(spark, sf).collect()]
    assert sorted(got) == sorted(want)
    hit = {(d, p, line) for d, p, _, _, _, line, _, _ in want}
    near = {(*key, r["line"]) for key, rows in by.items() for k, r in enumerate(rows) if any((*key, x["line"]) in hit for x in rows[max(k - 1, 0) : k + 2])}
    assert sorted(tuple(r) for r in catalog.all_neighbour_lines(spark, sf).collect()) == sorted(near)
    text = {(d, r["line"]): r["line_text"] for (d, _), rows in by.items() for r in rows}
    lines = {(r["doc_id"], r["line"]): r for r in preparation.all_redacted_lines(spark, sf).collect()}
    assert set(lines) == {(d, line) for d, _, line in near}
    for key, r in lines.items():
        cuts = sorted(x[6:] for x in want if (x[0], x[5]) == key)
        assert r["is_redacted"] == bool(cuts)
        rest, at = "", 0
        for s, e in cuts:
            rest, at = rest + re.escape(text[key][at:s]) + f"x{{0,{e - s}}}", e
        assert re.fullmatch(rest + re.escape(text[key][at:]), r["redacted_text"])


def test_draw_commands_of_all_lines_with_entities(spark, tmp_path):
    said = "\n".join("" if k % 50 == 0 else f"line {k} of 10.0.0.{k}" if k in (7, 49, 51, 99) else f"line {k}" for k in range(120))
    spark.createDataFrame([(1, said), (2, "mail a.b@mail.org"), (3, "plain\nlines"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r["doc_id"], r["line"]): r for r in catalog._paragraphs(spark, str(tmp_path)).collect()}
    lines = {(r["doc_id"], r["line"]): r for r in preparation.all_redacted_lines(spark, str(tmp_path)).collect()}
    assert {k for k, r in lines.items() if r["is_redacted"]} == {(1, 7), (1, 49), (1, 51), (1, 99), (2, 0)}
    want = []
    for key, r in lines.items():
        d, page, y0, y1, x1 = key[0], rows[key]["page"], rows[key]["y0"], rows[key]["y1"], float(len(rows[key]["line_text"]))
        want += [(d, page, 2, "fill", -0.2, y0 - 0.2, x1 + 0.2, y1 + 0.2, "1,1,1", None), (d, page, 3, "write", 0.0, y0, x1, y1, None, r["redacted_text"])]
        if r["is_redacted"]:
            middle = (y0 + y1) / 2
            want += [(d, page, 1, "delete", 0.0, middle - 0.01, x1, middle + 0.01, "0,0,0", None), (d, page, 4, "paint", 0.0, y0, x1, y1, "0,0,0", None)]
    by = lambda found: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found), key=repr)
    assert by(preparation.entity_draw_commands(spark, str(tmp_path)).collect()) == by(want)
