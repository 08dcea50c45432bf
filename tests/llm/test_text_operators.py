"""Extraction, rules, counts, chats, ranking, packing and fingerprints on small cases and against brute force."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sableframe.llm import chat_format, html_extract, mixing, packing, quality_classifier, quality_rules, sketch, text_kernels, token_counts
from tests.llm.helpers import ODD, documents, prose

SF = "/root/testdata/sf0.001"


# Pages


def test_blocks_of_a_page():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body class='has-sidebar'>"
        "<header><h1>Site</h1></header><nav><ul><li><a href='/x'>Menu</a></ul></nav><div class=\"ad-box\">Buy</div><div class='cookie-notice'>We use</div>"
        "<article><header><h1>A &amp; B</h1><span>by me</span></header><p>One<br>two  <b>bold</b>x\n<p>Three &lt;tag&gt;<div><form><input> Send</form>"
        "<ul><li>i1<li>i2</ul><pre>p  q</pre><aside>side</aside></div><section id='comments'><p>First!</p></section></article><aside>s</aside><footer>&copy; f"
    )
    assert [t for z, t in html_extract.blocks(page) if z == html_extract.MAIN] == ["A & B", "One two boldx", "Three <tag>", "i1", "i2", "p q"]
    assert html_extract.blocks(None) == [] and html_extract.blocks("") == []
    assert html_extract.blocks("a < b <p>c<script>x") == [(1, "a < b"), (1, "c")]


def test_runs_shared_by_pages_are_removed_where_no_article_is(spark):
    menu = "home news sport weather travel shop login help contact about"
    rows = [(k, f"http://h{k % 2}.x/{k}", f"<body><div>{menu}</div><div>{' '.join(prose(k, 40))}</div></body>") for k in range(12)] + [(50, None, None), (51, None, ""), (52, "http://z/", "<p>" + menu)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (10**6, 60):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(pages, shard_tokens=size).collect()}
        assert got == {**{k: " ".join(prose(k, 40)) for k in range(12)}, 50: "", 51: "", 52: menu}
    assert html_extract.extract(pages.limit(0)).count() == 0


def main_text(page):
    return "\n\n".join(t for z, t in html_extract.blocks(page) if z in (html_extract.MAIN, html_extract.MARKED))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>Hello <span class='share'>SHARE ME</span> world of text</p></article>", "Hello world of text"),
        ("<article><p>One <span class='ad'>AD <b>bold</b><p>Two</p></article>", "One\n\nTwo"),
        ("<article><p>a <b class='x'>b</b> c <i>d</i></p></article>", "a b c d"),
        ("<article><div class='related-work'><p>kept</p></div><div class='widget-doc'>kept too</div><p id='toolbar-guide'>and this</p><p class='advert-free'>free</p></article>", "kept\n\nkept too\n\nand this\n\nfree"),
        ("<article><div class='share-buttons top'>x</div><p class='site-footer'>y</p><p>z</p></article>", "z"),
    ],
)
def test_names_and_inline_furniture(page, text):
    assert main_text(page) == text


def test_deeply_nested_pages_end():
    n = 30_000
    assert main_text("<article>" + "<div>" * n + "deep" + "</div>" * n + "<p>after</p>" + "<b>" * n + "x" + "</i>" * n) == "deep\n\nafter\n\nx"


def brute_texts(pages, run):
    """Texts by comparing runs of all pages of a host with each other."""
    parsed = {k: (html_extract.host_of(u), html_extract.blocks(h)) for k, u, h in pages}
    seen, hosts = {}, Counter(host for host, _ in parsed.values())
    streams = {k: [w for z, t in found if z != html_extract.MAIN for w in t.split()] for k, (_, found) in parsed.items()}
    for k, w in streams.items():
        for i in range(len(w) - run + 1):
            seen.setdefault((parsed[k][0], tuple(w[i : i + run])), set()).add(k)
    out = {}
    for k, (host, found) in parsed.items():
        article, w = any(z >= html_extract.MAIN for z, _ in found), streams[k]
        least = max(html_extract.MARKED_PAGES, -(-hosts[host] // 2)) if article else 2
        gone = {i + d for i in range(len(w) - run + 1) if len(seen[(host, tuple(w[i : i + run]))]) >= least for d in range(run)}
        kept, at = [], 0
        for z, t in found:
            if z == html_extract.MAIN:
                kept.append(t)
                continue
            left = [x for i, x in enumerate(t.split(), at) if i not in gone]
            at += len(t.split())
            if left and z == (html_extract.MARKED if article else html_extract.OPEN):
                kept.append(" ".join(left))
        out[k] = "\n\n".join(kept)
    return out


@pytest.mark.parametrize("shard", [10**6, 80])
def test_texts_equal_brute_force_and_runs_change_pages_with_an_article(spark, shard):
    call = "read more stories like this one in our weekly letter today"
    shared = " ".join(prose(99, 30))
    rows = []
    for k in range(24):
        note = f"<div class='teaser'>{call} {'' if k % 3 else ' '.join(prose(k, 12))}</div>"
        quote = f"<p>{shared}</p><div class='quote'>{shared}</div>" if k in (3, 5) else ""
        body = f"<p>{' '.join(prose(200 + k, 40))}</p>"
        page = f"<nav>{call}</nav><article>{body}{quote}{note}</article>" if k % 4 else f"<div>{call}</div><div>{' '.join(prose(k, 25))}</div>"
        rows.append((k, f"http://h{k % 2}.x/{k}", page))
    rows += [(50, None, None), (51, None, ""), (52, "http://h0.x/1", rows[1][2]), (52, "http://h0.x/1", rows[1][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("row", "text", "host", "zones")})
    got = html_extract.extract(pages, shard_tokens=shard).collect()
    want = brute_texts([(i, u, h) for i, (_, u, h) in enumerate(rows)], html_extract.RUN)
    assert Counter((r["page_id"], r["text"]) for r in got) == Counter((k, want[i]) for i, (k, _, _) in enumerate(rows))
    texts = {r["page_id"]: r["text"] for r in got}
    assert all(call not in t for t in texts.values())
    assert texts[3].count(shared) == 2 and " ".join(prose(203, 40)) in texts[3]


def test_suffix_array_classes_equal_brute_force():
    pages = [prose(k, 60, 6) for k in range(5)]
    want = Counter()
    for p in pages:
        want.update({tuple(p[i : i + 4]) for i in range(len(p) - 3)})
    got = html_extract.shared_runs(pages, 4)
    assert sorted(c[1] for c in got) == sorted(want.values())
    for _, n, places in got:
        assert want[tuple(pages[places[0][0]][places[0][1] : places[0][1] + 4])] == n


# Counts and outliers


def slow_counts(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\t\x1c\x85 é", max_size=60))
def test_counts_equal_brute_force(text):
    assert quality_rules.text_counts(text)[:5] == slow_counts(text)


def test_outliers_are_rejected_and_clean_texts_stay(spark):
    rows = [(k, " ".join(prose(k, 80 + k % 90, 5000)), "en", f"s{k % 2}") for k in range(400)]
    rows += [(1000 + k, " ".join(w + "###" for w in prose(k, 90, 5000)), "en", "s0") for k in range(20)]
    rows += [(2000, "too short", "en", None), (2001, None, None, None), (2002, "the same three " * 60, "de", "s0")]
    got = {r["doc_id"]: r for r in quality_rules.reject_outliers(documents(spark, rows)).collect()}
    assert all(got[k]["kept"] for k in range(400))
    assert not any(got[1000 + k]["kept"] or got[1000 + k]["base_failed"] for k in range(20))
    assert all(got[k]["base_failed"] and not got[k]["kept"] for k in (2000, 2001, 2002))
    assert quality_rules.reject_outliers(documents(spark, [])).count() == 0
    assert len(quality_rules.reject_outliers(documents(spark, ODD, extra=True)).collect()) == len(ODD)


def brute_distances(x, floor):
    """Distances by the plain algorithm on all rows of one group: concentration from the medians, then reweighting."""
    def cov(y, share):
        return np.cov(y.T, bias=True) * quality_rules.widening(share) + np.diag(np.square(floor))

    def far(mean, c):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(c), x - mean)

    spread = (np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349
    mean, c = np.median(x, axis=0), np.diag(spread**2 + np.square(floor))
    for _ in range(quality_rules.STEPS):
        near = x[np.argsort(far(mean, c), kind="stable")[: int(quality_rules.SUPPORT * len(x)) + 1]]
        mean, c = near.mean(axis=0), cov(near, len(near) / len(x))
    near = x[far(mean, c) <= quality_rules.chi_square_quantile(quality_rules.USUAL)]
    return far(near.mean(axis=0), cov(near, quality_rules.USUAL))


def test_distances_of_one_group_equal_the_plain_algorithm(spark):
    rows = [(k, " ".join(prose(k, 60 + k % 120, 4000)) + ("\nsame line here" * (k % 5)), "en", "s") for k in range(220)]
    rows += [(1000 + k, " ".join(w + "&%" * (k % 4) for w in prose(k, 80, 4000)), "en", "s") for k in range(30)]
    rows += [(2000, "\n".join(["one line that is said again and again in it"] * 3 + [" ".join(prose(5, 60, 4000))]), "en", "s")]
    got = {r["doc_id"]: r for r in quality_rules.reject_outliers(documents(spark, rows)).collect()}
    used = [(i, quality_rules.text_counts(t)) for i, t, *_ in rows if not got[i]["base_failed"]]
    x = np.array([(np.log1p(n), c / n, np.sqrt(y / n), np.sqrt(d / max(k, 1)), np.sqrt(r / n)) for _, (n, c, y, d, r, k) in used])
    want = brute_distances(x, np.array(quality_rules.FLOOR))
    for (i, _), d in zip(used, want, strict=True):
        assert got[i]["distance2"] == pytest.approx(d, rel=0.25, abs=0.6), i
        if not 0.75 < d / quality_rules.CUTOFF < 1.33:
            assert got[i]["kept"] == (d <= quality_rules.CUTOFF), i


def test_cutoff_is_a_quantile_and_repetition_alone_can_reject():
    rng = np.random.default_rng(2)
    d = (rng.normal(size=(400_000, 5)) ** 2).sum(axis=1)
    assert quality_rules.chi_square_quantile(0.99) == pytest.approx(np.quantile(d, 0.99), rel=0.02)
    assert quality_rules.CUTOFF == pytest.approx(35.89, abs=0.01)
    assert (1 / quality_rules.FLOOR[3]) ** 2 > quality_rules.CUTOFF and 0.5 / quality_rules.FLOOR[4] ** 2 > quality_rules.CUTOFF


def test_widening_of_half_the_rows():
    rng = np.random.default_rng(1)
    d = np.sort((rng.normal(size=(200_000, 5)) ** 2).sum(axis=1))[:120_000]
    assert quality_rules.widening(0.6) == pytest.approx(5 / d.mean(), rel=0.02)


# Token lengths and packing


def test_histogram_equals_brute_force(spark):
    rows = [(k, " ".join(prose(k, k * 7))) for k in range(60)] + ODD
    encode = text_kernels.tokenizer()
    lengths = [len(x) for x in encode([t for _, t in rows])]
    sums = token_counts.suffix_sums(token_counts.length_histogram(documents(spark, rows, extra=True)))
    for r in sums.collect():
        x = r["length"]
        assert r["n_docs"] == lengths.count(x)
        assert r["docs_at_least"] == sum(n >= x for n in lengths)
        assert r["tokens_at_least"] == sum(n for n in lengths if n >= x)
        assert r["docs_at_most"] == sum(n <= x for n in lengths)
        assert r["truncated_total"] == sum(min(n, x) for n in lengths)
    assert token_counts.totals(sums).first() == (len(rows), sum(lengths), max(lengths))
    assert dict(token_counts.truncated_totals(sums, [5, 100]).collect()) == {c: sum(min(n, c) for n in lengths) for c in (5, 100)}
    half = {q: sorted(lengths)[-(-len(lengths) * int(q * 100) // 100) - 1] for q in (0.5, 0.9)}
    assert dict(token_counts.quantiles(sums, [0.5, 0.9]).collect()) == half
    none = token_counts.suffix_sums(token_counts.length_histogram(documents(spark, [])))
    assert none.count() == 0 and token_counts.totals(none).first() == (0, 0, None)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_both_encoders_agree(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [text, text + " é ñ\n\n x", "a<|endoftext|>b " + text]
    assert text_kernels.tokenizer()(texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_takes_the_tightest():
    rng = random.Random(3)
    lengths = sorted((rng.randrange(1, 65) for _ in range(500)), reverse=True)
    open_, want = [], []
    for n in lengths:
        fits = [(room, s) for s, room in enumerate(open_) if room >= n]
        room = min(fits)[0] if fits else None
        want.append(room)
        if room is None:
            open_.append(64 - n)
        else:
            open_[open_.index(room)] = room - n
    placed, used, got = packing.best_fit(lengths, 64), Counter(), []
    for n, (s, offset) in zip(lengths, placed, strict=True):
        assert used[s] == offset and offset + n <= 64
        got.append(64 - offset if offset else None)
        used[s] += n
    assert got == want


def test_packing_is_a_partition_of_all_ids(spark):
    rows = [(k, " ".join(prose(k, 40 + 30 * k))) for k in range(80)] + ODD
    got = packing.pack(documents(spark, rows, extra=True), shard_pieces=32).collect()
    encode, want = text_kernels.tokenizer(), Counter()
    for i, t in rows:
        ids = np.array([*encode([t])[0], 1], "<u4")
        for s in range(0, len(ids), 2048):
            want[(i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(documents(spark, [])).count() == 0


# Chats

TEXT = st.text(alphabet=st.sampled_from(list("<>[]|\\/ims_tarendINSTSYu\nx\"é😀")), max_size=40)
CONTROLS = st.lists(st.one_of(TEXT, st.sampled_from(chat_format.CONTROL)), max_size=5).map("".join)


def test_turns_come_back_and_no_control_string_stays(spark):
    rng = random.Random(5)
    some = [CONTROLS.example() for _ in range(20)]
    rows = []
    for k in range(150):
        turns = [(rng.choice(["user", "assistant", "sys\\<s>"]), rng.choice([*some, *chat_format.CONTROL, "\\", "<\\s>", ""])) for _ in range(rng.randrange(5))]
        rows.append((k, turns))
    df = spark.createDataFrame(rows, "k long, turns array<struct<role:string,text:string>>")
    made = chat_format.format_turns(df)
    for r in made.select("k", "formatted", chat_format.read_turns(F.col("formatted")).alias("back"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect():
        turns = rows[r["k"]][1]
        assert [tuple(t) for t in r["back"]] == turns
        assert r["loss"] == "".join(t for role, t in turns if role == "assistant")
        assert r["formatted"].count(chat_format.START) == len(turns) and r["formatted"].count("</s>") == 0


def test_layouts_are_selected_by_their_field_paths(spark):
    cases = [
        ({"messages": [{"role": "user", "content": "hi"}, {"content": None, "role": "assistant"}]}, "messages", [("user", "hi"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": 7}]}, "conversations", [("user", "q"), ("assistant", "7")]),
        ({"instruction": "do", "input": "", "output": "done"}, "instruction_input", [("user", "do"), ("assistant", "done")]),
        ({"output": "done", "instruction": "do"}, "instruction", [("user", "do"), ("assistant", "done")]),
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"unknown": 1}, None, None),
        ({"id": 3, "messages": [{"role": "user", "content": "x", "name": "n", "calls": [{"f": {"g": [1]}}]}], "tags": [], "meta": {"a": {"b": {}}}, "none": None}, "messages", [("user", "x")]),
        ({"question": "q", "answer": "a", "score": 0.5, "kind": {"x": [{"y": 1}]}}, "question_answer", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "only"}, None, None),
        ({"prompt": "p", "question": "two layouts' fields", "completion": "c"}, None, None),
    ]
    rows = [(k, json.dumps(c[0])) for k, c in enumerate(cases)] + [(97, "{broken"), (98, None), (99, "")]
    df = spark.createDataFrame(rows, "k long, record string")
    got = {r["k"]: r for r in chat_format.canonical_turns(df, "record").collect()}
    for k, (_, name, turns) in enumerate(cases):
        assert got[k]["layout"] == name and (None if got[k]["turns"] is None else [tuple(t) for t in got[k]["turns"]]) == turns
    assert all(got[k]["layout"] is None for k in (97, 98, 99))


def test_conversations_of_the_given_table_come_back_from_every_layout(spark):
    said = chat_format._said(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet"))
    extra = [(k, [(0, "user", "a\n\nb\n\n"), (1, "assistant", "c")]) for k in range(40)]
    said = said.unionByName(spark.createDataFrame(extra, "conv_id long, said array<struct<turn:bigint,role:string,content:string>>"))
    made = chat_format.canonical_turns(said.withColumn("record", chat_format.dealt_record()), "record")
    assert {r["layout"] for r in made.select("layout").distinct().collect()} == {x.name for x in chat_format.LAYOUTS}
    same = F.transform("said", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("text")))
    assert made.where(~F.col("turns").eqNullSafe(same)).count() == 0


def test_chats_of_empty_repeated_and_widened_tables(spark, tmp_path):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, 1, "assistant", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("record", "layout", "turns", "said", "content")})
    df.write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = {r["conv_id"]: r["n_turns"] for r in chat_format.op4_chat_format(spark, f"{tmp_path}/a").collect()}
    assert got == {1: 3, None: 1, -7: 2}
    df.limit(0).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert [r["conv_id"] for r in chat_format.op4_chat_format(spark, f"{tmp_path}/b").collect()] == [-7]


def test_conversations_of_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (2, None, "user", "a"), (2, None, "assistant", "b"), (None, 1, "user", "n")]
    made = chat_format.format_turns(chat_format.canonical_turns(chat_format.conversation_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "record"))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in made.collect()}
    assert got == {1: [("", "x"), ("assistant", "")], 2: [("assistant", "b"), ("user", "a")], None: [("user", "n")]}


# Ranking


def test_ranking_learns_and_gives_scores_for_every_text(spark):
    rows = [(k, " ".join(prose(k, 60, 3000)) if k % 2 else " ".join(w.upper() + "!!" for w in prose(k, 60, 3000))) for k in range(300)]
    docs = documents(spark, rows, extra=True)
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(5, 0), (None, 1)], "doc_id long, quality int")
    ranking = quality_classifier.learn(docs, labels)
    got = quality_classifier.scored(docs, ranking)
    assert got.where(F.col("score").between(0, 1)).count() == 300
    wrong = [r["doc_id"] for r in got.collect() if (r["score"] >= 0.5) != bool(r["doc_id"] % 2)]
    assert not wrong
    odd = documents(spark, ODD)
    assert quality_classifier.scored(odd, ranking).where("score between 0 and 1").count() == len(ODD)
    assert quality_classifier.learn(docs, labels.where("quality = 1")) is None
    assert {r["score"] for r in quality_classifier.scored(odd, None).collect()} == {0.5}


def test_rows_at_the_driver_are_bounded_and_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    many = docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat("text", F.lit(" more"))))
    seen = []
    keep = quality_classifier.fit
    try:
        quality_classifier.fit = lambda x, y, **_: seen.append(len(x)) or keep(x, y)
        quality_classifier.learn(many, labels, most=100)
        ranking = quality_classifier.learn(docs, labels)
    finally:
        quality_classifier.fit = keep
    assert seen[0] == 100
    judged = quality_classifier.scored(docs, ranking).join(labels, "doc_id").where(quality_classifier.held_out(F.col("doc_id")))
    right = judged.where((F.col("score") >= 0.5) == (F.col("quality") == 1)).count()
    assert judged.count() > 100 and right >= 0.98 * judged.count()


def test_pairs_in_chunks_give_the_weights_of_all_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, quality_classifier.PLAIN + 2 * quality_classifier.HASHED))
    y = (x[:, 0] + x[:, 5] + rng.normal(size=300) > 0).astype(int)
    monkeypatch.setattr(quality_classifier, "CHUNK", 100)
    small = quality_classifier.fit(x, y, pairs=2000)
    monkeypatch.setattr(quality_classifier, "CHUNK", 10**6)
    assert np.allclose(small.weights, quality_classifier.fit(x, y, pairs=2000).weights, atol=1e-8)


def test_held_out_rows_are_not_learnt_from(spark):
    ids = spark.range(200).select(F.col("id").alias("doc_id"))
    got = [r[0] for r in ids.where(quality_classifier.held_out(F.col("doc_id"))).collect()]
    assert got == [k for k in range(200) if zlib.crc32(str(k).encode()) % 3 == 1]


# Mixing


def test_mixture_of_odd_and_empty_tables(spark):
    rows = [(k, " ".join(prose(k, 5 + k % 50)), "en", None if k % 7 == 0 else f"s{k % 5}") for k in range(900)] + [(None, None, None, "e"), (None, "", None, "e")]
    docs = documents(spark, rows, extra=True)
    plan, sizes = mixing.mix_plan(docs)
    got = mixing.times_taken(sizes, plan).collect()
    assert len(got) == len(rows)
    words, taken, target = Counter(), Counter(), {}
    for r in got:
        words[r["source"]] += r["size"]
        taken[r["source"]] += r["times"] * r["size"]
        target[r["source"]] = r["target"]
        assert r["times"] <= 3
    assert sum(target.values()) == pytest.approx(sum(words.values()))
    for s in words:
        assert target[s] <= 3 * words[s] and abs(taken[s] - target[s]) <= 55
    copies = Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    assert copies == Counter({r["doc_id"]: r["times"] for r in got if r["times"]})
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(documents(spark, [])).count() == 0


def test_sources_of_null_or_equal_ids_meet_their_targets(spark):
    rows = [(None, " ".join(prose(k, 30)), "en", "a") for k in range(300)] + [(7, " ".join(prose(900 + k, 30)), "en", "c") for k in range(300)] + [(k, " ".join(prose(2000 + k, 30)), "en", "b") for k in range(300)]
    plan, sizes = mixing.mix_plan(documents(spark, rows))
    taken, target = Counter(), {}
    for r in mixing.times_taken(sizes, plan).collect():
        taken[r["source"]] += r["times"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 60 for s in "abc") and target["c"] < 300 * 30


# Fingerprints


def true_jaccard(a, b):
    def s(t):
        w = t.split()
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("chars", [sketch.RANGE_CHARS, 2000, 1])
def test_next_documents_and_likeness(spark, chars):
    rows = [(k * 3, " ".join(prose(k // 2, 20 + 10 * (k % 30)))) for k in range(60)] + [(2**62, "far away"), (-(2**62), "far before")]
    random.Random(1).shuffle(rows)
    docs = documents(spark, rows, extra=True)
    got = {r["doc_id"]: r for r in sketch.with_next(docs, chars).collect()}
    order = sorted(rows)
    assert {i: r["next_text"] for i, r in got.items()} == {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    assert all(got[i]["next_sketch"] == got[order[(k + 1) % len(order)][0]]["sketch"] for k, (i, _) in enumerate(order))


def test_rows_with_equal_and_null_ids_follow_each_other_by_their_hashes(spark):
    rows = [(7, f"same id {k}") for k in range(40)] + [(None, f"no id {k}") for k in range(40)] + [(9, "twice the same")] * 30 + [(3, None)]
    for chars in (sketch.RANGE_CHARS, 300):
        got = Counter((r["doc_id"], r["text"], r["next_text"]) for r in sketch.with_next(documents(spark, rows), chars).collect())
        hashed = {r["text"]: r["h"] for r in documents(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()}
        order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, x[0] or 0, hashed.get(x[1], 0)))
        assert got == Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))


def test_likeness_is_near_the_true_one(spark):
    texts = [" ".join(prose(k // 2, 40 + 20 * (k % 30), 10**5 if k % 3 else 60)) for k in range(120)]
    pairs = spark.createDataFrame([(k, texts[k], texts[k + 1]) for k in range(119)], "k long, a string, b string")
    off = []
    for r in pairs.select("k", sketch.likeness(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("j")).collect():
        off.append(abs(r["j"] - true_jaccard(texts[r["k"]], texts[r["k"] + 1])))
    assert max(off) < 0.25 and np.mean(off) < 0.03


def test_sketches_merge_and_contain(spark):
    long_, part = prose(1, 4000, 10**6), prose(1, 4000, 10**6)[:600]
    df = spark.createDataFrame([(" ".join(long_), " ".join(part), " ".join(long_[2000:]), " ".join(long_[:2004]))], "l string, p string, q string, r string")
    s = {c: sketch.sketch(F.col(c)) for c in "lpqr"}
    r = df.select(sketch.containment(s["p"], s["l"]).alias("c"), sketch.containment(s["l"], s["p"]).alias("d"), (sketch.merged(s["q"], s["r"]) == s["l"]).alias("m"), F.size(s["l"]).alias("n")).first()
    assert r["c"] == 1.0 and r["d"] == pytest.approx(0.15, abs=0.05) and r["m"] and abs(r["n"] - 1998) < 150


def test_every_text_with_words_has_a_mark_and_one_rule_holds_at_every_length(spark):
    rows = [(k, " ".join(prose(k, 1 + k % 12, 10**6))) for k in range(200)]
    made = documents(spark, rows).select(sketch.shingle_hashes(F.col("text")).alias("h"), sketch.sketch(F.col("text")).alias("s")).collect()
    for r in made:
        low = sorted(x for x in r["h"] if x < 0)
        assert r["s"] == (low or [min(r["h"])])


def test_fingerprints_of_odd_rows(spark, tmp_path):
    documents(spark, ODD, extra=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = sketch.op10_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(ODD) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    documents(spark, []).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert sketch.op10_fingerprints(spark, f"{tmp_path}/e").count() == 0


def test_edited_texts_of_the_given_documents(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in sketch.op10_fingerprints(spark, SF).collect()}
    off = []
    for k, (i, t) in enumerate(rows):
        n, nxt = len(t) // 4, rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - n] + nxt[:n]
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        off += [abs(got[i]["near_edited"] - true_jaccard(t, e)), abs(got[i]["near_next"] - true_jaccard(t, nxt))]
    # A text of a few shingles has a mark or two, so its likeness is coarse; on the whole it is near.
    assert np.mean(off) < 0.04 and np.quantile(off, 0.99) < 0.3


def test_conversations_above_the_size_of_a_parsed_record_keep_their_turns(spark, tmp_path):
    text = "ab </s> " * 2_700_000
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", text), (2, 0, "user", "short")]
    spark.createDataFrame([(c, t, r, x if x != text else None) for c, t, r, x in rows], "conv_id long, turn long, role string, text string").selectExpr(
        "conv_id", "turn", "role", "coalesce(text, repeat('ab </s> ', 2700000)) AS text"
    ).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat_format.op4_chat_format(spark, str(tmp_path)).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == len(text)
    assert got[1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(f"user\nhi\nassistant\n{text}\n".encode()).hexdigest()
    assert got[2]["n_turns"] == 1
