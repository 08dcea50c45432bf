"""The pipeline's stages on the given documents and on odd ones."""

import zlib
from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline
from sableframe.llm import catalog, mixing, quality_classifier, text_kernels
from tests.llm.helpers import ODD, documents, edited, prose
from tests.llm.test_dedup import brute_lines, brute_links

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    assert 0 < docs.count() <= 3 * n


def test_run_packs_every_document_of_the_mixture(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.where("start = 0").count() > 0
    assert catalog.queries().keys() >= {"op1_html_text", "op10_fingerprints"}


def test_odd_documents_pass_every_stage(spark):
    rows = ODD + [(50 + k, " ".join(prose(k, 80))) for k in range(30)]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, rows), SF).count() >= 0, name
        assert stage(spark, documents(spark, []), SF).count() == 0, name


def test_every_stage_and_run_equal_plain_python(spark, tmp_path):
    """Kept ids, texts, multiplicities and packed pieces of a small table, stage by stage, with the learnt ranking given."""
    rows = []
    for k in range(90):
        base = prose(k % 30, 70 + k % 40, 5000)
        words = edited(base, k, k % 4) if k >= 30 else base
        text = " ".join(words) if k % 9 else " ".join(w.upper() + "!!" for w in words)
        footer = "\nthe same footer line for every page" if k % 5 == 0 else ""
        rows.append((k, text + footer + f"\n{' '.join(prose(700 + k, 12, 5000))}", "en", f"s{k % 4}"))
    said = prose(999, 132, 10**6)
    rows += [(300 + n, "\n".join(" ".join(said[i : i + n]) for i in range(0, len(said), n)), "en", "s2") for n in (5, 8, 13)]  # one text, broken into other lines
    rows += [(200, rows[7][1], "en", "s9"), (201, None, None, None), (202, "", "en", "s1")]
    labels = [(k, int(k % 9 != 0), 0) for k in range(90)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ranking = quality_classifier.learn(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    steps = {}
    docs = [r[:2] + (r[3],) for r in rows]
    docs = [d for d in docs if ranking.scores(np.array([quality_classifier.features(d[1])]))[0] >= 0.5]
    steps["quality"] = docs
    texts = brute_lines([d[:2] for d in docs])
    docs = [(i, t if t != (old or "") else old, s) for (i, old, s), t in zip(docs, texts, strict=True) if t == (old or "") or t.split()]
    steps["lines"] = docs
    _, roots = brute_links([d[:2] for d in docs])
    docs = [min((docs[j] for j in range(len(docs)) if roots[j] == r), key=lambda d: (d[0] is None, d[0])) for r in sorted(set(roots))]
    steps["near_duplicates"] = docs
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", docs)
    mixed = db.sql(f"SELECT doc_id, size, taken FROM ({mixing.oracle()})").fetchall()
    times = {i: taken // size if size else 0 for i, size, taken in mixed}
    docs = [d for d in docs if d[1] for _ in range(times[d[0]])]
    steps["mixture"] = docs

    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, given, str(tmp_path))
        got = sorted((r["doc_id"], r["text"] or "") for r in made.collect() if name != "mixture" or r["text"])
        assert got == sorted((d[0], d[1] or "") for d in steps[name]), name
        given = spark.createDataFrame(made.collect(), made.schema)
    assert 0 < len(steps["near_duplicates"]) < len(steps["lines"]) < len(steps["quality"]) < len(rows)

    encode, want = text_kernels.tokenizer(), Counter()
    for i, t, _ in docs:
        ids = np.array([*encode([t])[0], 1], "<u4")
        want[(i, 0, len(ids), zlib.crc32(ids.tobytes()))] += 1
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r["length"] > 1)
    assert got == want
