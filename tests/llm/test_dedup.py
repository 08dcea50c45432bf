"""Line dedup and the Jaccard join against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from sableframe.llm import line_dedup, near_duplicates, staging
from sableframe.llm.components import components
from sableframe.llm.set_overlap import Postings
from tests.llm.helpers import ODD, documents, edited, prose


def family_rows():
    rows, k = [], 0
    for f in range(6):
        base = prose(f, 120 + 40 * f)
        for copy in range(12):
            rows.append((k, " ".join(edited(base, 100 * f + copy, copy % 7))))
            k += 1
    rows += [(k + i, rows[5][1]) for i in range(5)] + [(900 + i, " ".join(prose(500 + i, 60))) for i in range(20)]
    return rows


def brute_links(rows):
    def shingles(t):
        w = (t or "").split()
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    sets = [shingles(t) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                links[i] += 1
                links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    return links, [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("block", [near_duplicates.BLOCK_SHINGLES, 900])
def test_jaccard_join_equals_brute_force(spark, block):
    rows = family_rows()
    links, roots = brute_links(rows)
    got = {r["doc_id"]: r for r in near_duplicates.jaccard_join(documents(spark, rows, extra=True), block_shingles=block).collect()}
    assert len(got) == len(rows)
    for (i, _), n, r in zip(rows, links, roots, strict=True):
        assert (got[i]["n_links"], got[i]["class_id"]) == (n, min(rows[k][0] for k in range(len(rows)) if roots[k] == r)), i


def test_recall_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    links, _ = brute_links(rows)
    got = {r["doc_id"]: r["n_links"] for r in near_duplicates.jaccard_join(docs).collect()}
    assert [got[i] for i, _ in rows] == links


def test_join_of_odd_and_empty_tables(spark):
    got = near_duplicates.jaccard_join(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    empty = [r for r in got if r["n_links"] == 3]
    assert len(empty) == 4 and {r["class_id"] for r in empty} == {1}
    kept = near_duplicates.keep_one(documents(spark, ODD, extra=True))
    assert kept.count() == 5 and "node" in kept.columns
    assert near_duplicates.jaccard_join(documents(spark, [])).count() == 0


def test_prefixes_are_shortened_to_the_recall():
    assert near_duplicates.prefix_depth(0.8) == 5
    assert near_duplicates.prefix_depth(0.95) == 8


def test_recall_of_the_tries_by_similarity():
    """Pairs in each band of Jaccard from 0.8 on share a path of the shortened length in some trie."""
    rng, depth = np.random.default_rng(1), near_duplicates.prefix_depth(0.8)
    for low in (0.8, 0.84, 0.88, 0.92, 0.96):
        hit = 0
        for _ in range(250):
            n = int(rng.integers(20, 300))
            both = int(np.ceil(n * (low + 0.02 * rng.random())))
            values = rng.integers(0, 2**63, n, np.uint64)
            left, right = values[: both + (n - both) // 2], np.concatenate([values[:both], values[both + (n - both) // 2 :]])
            a, b = (near_duplicates.forest_paths(np.sort(x), near_duplicates.TREES, near_duplicates.SCOUTS, depth) for x in (left, right))
            hit += bool((a[0] == b[0]).any())
        assert hit >= 0.99 * 250, low


def test_full_paths_extend_the_shortened_ones():
    x = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    short, full = near_duplicates.forest_paths(x, 24, 6, 8)
    assert (short[:6] == full).all() and len(short) == 24


def test_family_of_near_copies_is_one_class_whatever_the_blocks(spark):
    base = prose(3, 400, 10**6)
    rows = [(k, " ".join(edited(base, k, 4 + k % 5))) for k in range(150)] + [(900, " ".join(edited(base, 7, 60)))]
    links, roots = brute_links(rows)
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in near_duplicates.jaccard_join(documents(spark, rows), block_shingles=3000).collect()}
    assert got == {i: (links[k], rows[roots[k]][0]) for k, (i, _) in enumerate(rows)}
    assert near_duplicates.keep_one(documents(spark, rows)).count() == len(set(roots))


def test_very_long_texts_and_lines(spark):
    long_ = " ".join(prose(11, 60_000, 10**6))
    rows = [(1, long_), (2, long_ + " one more"), (3, "x" * 400_000), (4, "x" * 400_000), (5, "y " * 100_000)]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.jaccard_join(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert kept == {1: long_, 2: "", 3: rows[2][1], 4: "", 5: rows[4][1]}


def test_sizes_beyond_the_joined_bits_are_compared_too(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_FULL", 31)
    rows = line_rows()
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == brute_lines(rows)


def test_lines_of_equal_texts_go_from_the_later_ones(spark):
    rows = [(5, "a b\n\nc d e"), (3, "a b\n\nc d e"), (None, "a b\n\nc d e"), (9, "c d e\nf"), (3, "a b\n\nc d e")]
    got = [(r["doc_id"], r["text"], r["n_removed"], r["n_lines"]) for r in line_dedup.dedup_lines(documents(spark, rows, extra=True)).collect()]
    assert sorted(got, key=str) == sorted([(5, "", 2, 3), (3, rows[1][1], 0, 3), (None, "", 2, 3), (9, "f", 1, 2), (3, rows[1][1], 0, 3)], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlaps():
    sets = [np.array(s, np.int64) for s in ([1, 2, 3], [], [3, 4])]
    assert Postings(sets).overlaps(np.array([2, 3, 9])).tolist() == [2, 0, 1]
    assert Postings([]).overlaps(np.array([1])).tolist() == []


def brute_lines(rows):
    """Text of each document after removal, by comparing every line with all earlier ones."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = [], {}
    for i in order:
        kept = []
        for line in (rows[i][1] or "").split("\n"):
            w = line.split()
            s = set(w)
            if len(w) >= 1:
                again = any(5 * len(s & o) >= 4 * len(s | o) for o in seen)
                seen.append(s)
                if again:
                    continue
            kept.append(line)
        out[i] = "\n".join(kept)
    return [out[i] for i in range(len(rows))]


def line_rows():
    rows = []
    for k in range(150):
        lines = [" ".join(prose(10_000 + k, 30)), " ".join(edited(prose(k % 5, 40), k, k % 5)), "short line", " ".join(prose(k % 40, 6, 30)), ""]
        if k % 3 == 0:
            lines.append("the same footer line for every page")
        rows.append((1000 - k, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("hot", [64, 4])
def test_line_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "LEADERS", 3)
    monkeypatch.setattr(line_dedup, "BLOCK_WORDS", 300)
    rows = line_rows()
    expected = brute_lines(rows)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, rows, extra=True)).collect()}
    for (i, text), want in zip(rows, expected, strict=True):
        assert got[i]["text"] == want, i
        assert got[i]["n_removed"] == len(text.split("\n")) - len(want.split("\n"))


def test_line_dedup_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[i] for i, _ in rows] == brute_lines(rows)


def test_line_dedup_of_odd_and_empty_tables(spark):
    got = line_dedup.dedup_lines(documents(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r["n_removed"] == 0 for r in got)
    assert sum(r["text"] is None for r in got) == 2
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_short_lines_are_compared_too(spark):
    rows = [(1, "All rights reserved.\nalpha beta gamma delta\n\nHome"), (2, "one of its own\nAll rights reserved.\n\n \nHome"), (3, "alpha beta gamma delta epsilon\nHome page\nreserved. All rights"), (4, "kept alone\nrights reserved.")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("one of its own\n\n ", 2), 3: ("Home page", 2), 4: (rows[3][1], 0)}


def test_short_lines_equal_brute_force_without_a_least_length(spark):
    words = [f"w{k}" for k in range(7)]
    rows = [(k, "\n".join(" ".join(words[(k * a + b * i) % 7] for i in range(1 + (k + a) % 6)) for a, b in ((1, 2), (2, 3), (3, 1)))) for k in range(120)]
    seen, want = [], []
    for _, text in rows:
        kept = []
        for line in text.split("\n"):
            s = set(line.split())
            if not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                kept.append(line)
            seen.append(s)
        want.append("\n".join(kept))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert [got[k] for k, _ in rows] == want


def test_pairs_of_words_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for token in range(60):
        for i in sorted(rng.choice(400, rng.integers(1, 25), replace=False)):
            n = int(rng.choice([1, 2, 5, 9, 10, 11, 30, line_dedup._FULL]))
            bits, parity = int(rng.integers(0, 4)), int(rng.integers(0, 4))
            rows.append((token, int(i), (bits << 32) | (n << 16) | int(rng.integers(0, min(n, 6))), parity))
    want, full = set(), line_dedup._FULL
    for t, i, at, p in rows:
        for u, j, bt, q in rows:
            an, bn, ap, bp = at >> 16 & full, bt >> 16 & full, at & full, bt & full
            if t != u or not (an < bn or (an == bn and i < j)):
                continue
            apart = ((at >> 32) ^ (bt >> 32)).bit_count() + (p ^ q).bit_count()
            near = an * 5 >= bn * 4 and ap * 9 <= an and (min(ap, bp) + min(an - ap, bn - bp)) * 9 >= (an + bn) * 4 and apart * 9 <= an + bn
            if near or bn == full:
                want.add((t, i, j))
    for size, most in ((7, 3), (1000, 500_000)):
        monkeypatch.setattr(line_dedup, "PAIRS_AT_ONCE", most)
        batch = lambda k: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[k : k + size]], pa.int64()) for c in range(4)], ["token", "id", "at", "p"])
        got = [(a, b) for x in line_dedup.pairs_of_words(batch(k) for k in range(0, len(rows), size)) for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]
        assert sorted(got) == sorted((i, j) for _, i, j in want)
    assert list(line_dedup.pairs_of_words(iter([]))) == []


@pytest.mark.parametrize(("most", "broadcast"), [(20_000, 40 << 20), (4, 0)])
def test_rounds_and_dense_words_equal_brute_force(spark, monkeypatch, most, broadcast):
    """Several rounds, by broadcast and by shuffles; hot words that are left to blocks by their pairs or by their number."""
    from sableframe.llm import staging

    for name, value in {"ROUND_CHARS": 1000, "HOT": 4, "DENSE": 1, "MOST": most, "LEADERS": 3, "BLOCK_WORDS": 300}.items():
        monkeypatch.setattr(line_dedup, name, value)
    monkeypatch.setattr(staging, "BROADCAST_BYTES", broadcast)
    rows = line_rows()
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == brute_lines(rows)


def test_frequent_words_are_joined_pairwise_and_families_are_not(monkeypatch):
    """Under one word, 3000 sets that differ give no rows; 600 near ones under another give a few pairs and one mark."""
    monkeypatch.setattr(line_dedup, "PAIRS_AT_ONCE", 2000)
    rng = np.random.default_rng(2)
    far, near = 3000, 600
    token = np.repeat([7, 9], [far, near])
    bits = np.concatenate([rng.integers(-(2**63), 2**63 - 1, far), np.zeros(near, np.int64)])
    made = list(line_dedup.similar_pairs(token, np.arange(far + near), np.full(far + near, 20 << 16), bits))
    rows = [(a, b) for x in made for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]
    assert [r for r in rows if r[1] < 0] == [(9, -1)]
    assert all(a >= far for a, b in rows if b >= 0) and len(rows) < (line_dedup.DENSE + 10) * near


def test_packed_counts_are_at_most_halved():
    n = np.concatenate([np.arange(1, 1000), [65_535, 2**31 - 1]])
    back = line_dedup.unpacked_counts(line_dedup.packed_counts(n))
    assert (back <= n).all() and (2 * back > n).all() and (back[:200] == n[:200]).all()


def pairs_of(batches):
    return [(a, b) for x in batches for a, b in zip(*(c.to_pylist() for c in x.columns), strict=True)]


@pytest.mark.parametrize("hot", [1000, 50])
def test_pairs_of_a_family_grow_with_its_size_alone(monkeypatch, hot):
    """Of m near sets each is paired with few earlier ones, where all pairs were m * (m - 1) / 2."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = np.random.default_rng(3)
    for m in (80, 400):
        rows = np.full(m, 9), rng.permutation(m), (40 + np.arange(m) % 3) << 16, np.zeros(m, np.int64)
        pairs = {x for x in pairs_of(line_dedup.similar_pairs(*rows, rank=rows[1] * 5)) if x[1] >= 0}
        assert {a for a, _ in pairs} == set(range(1, m)) and all((a, 0) in pairs for a in range(1, m))
        assert len(pairs) <= 4 * m


@pytest.mark.parametrize(("hot", "most"), [(500, 50_000), (500, 7), (5, 7)])
def test_pairs_left_out_are_marked_and_found_by_the_second_pass(monkeypatch, hot, most):
    for name, value in {"HOT": hot, "DENSE": 1, "LEADERS": 2, "PAIRS_AT_ONCE": most}.items():
        monkeypatch.setattr(line_dedup, name, value)
    rng = np.random.default_rng(8)
    token = np.sort(rng.integers(0, 12, 200))
    ids, rank = rng.permutation(200), rng.integers(0, 30, 200)
    n = rng.choice([9, 10, 11, 30, line_dedup._FULL], 200)
    at, p = (n << 16) | rng.integers(0, 2, 200), rng.integers(0, 4, 200)
    rank_of = dict(zip(ids.tolist(), rank.tolist(), strict=True))
    monkeypatch.setattr(line_dedup, "HOT", 10**6)
    every = set(pairs_of(line_dedup.similar_pairs(token, ids, at, p)))
    monkeypatch.setattr(line_dedup, "HOT", hot)
    first = set(pairs_of(line_dedup.similar_pairs(token, ids, at, p, rank)))
    marked = {a for a, b in first if b < 0}
    probe = np.isin(ids, list(marked)).astype(np.int64)
    second = set(pairs_of(line_dedup.similar_pairs(token, ids, at, p, rank, probe)))
    dense = {a for a, b in second if b < 0}
    token_of, some = dict(zip(ids.tolist(), token.tolist(), strict=True)), {frozenset(x) for x in first | second}
    assert marked and bool(dense) == (hot == 5) and {frozenset(x) for x in first | second if x[1] >= 0} <= {frozenset((a, b)) for a, b in every if a != b}
    for a, b in every:
        later = {x for x, y in ((a, b), (b, a)) if rank_of[x] >= rank_of[y]}
        assert frozenset((a, b)) in some or (later <= marked and token_of[a] in dense), (a, b)
        assert later <= marked or frozenset((a, b)) in {frozenset(x) for x in first}


def test_kernels_get_texts_in_small_batches(spark):
    """Else an executor and its workers hold up to 64 MB of texts for each task, several times over (F1, F2)."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    texts = spark.range(0, 2000, 1, 1).selectExpr("IF(id = 7, repeat('long ', 800000), repeat('word ', 1000)) AS text")
    got = staging.staged(texts.mapInArrow(sizes, "n long, size long")).collect()
    assert sum(r["n"] for r in got) == 2000
    assert sum(r["size"] > 2 * staging.BATCH_BYTES for r in got) <= 1  # the batch of the long text
    assert spark.conf.get(setting, None) == before
