"""Line deduplication by an exact set-similarity join.

A line's set is its distinct words. Words are ordered by rarity (counts of all words in hash buckets, kept
as one byte each), so two sets with a Jaccard of at least 0.8 share a word of their *prefixes*, the rarest
fifth. Prefix words are joined; pairs are dropped by length, by position, and by 96 parity bits whose
differing bits cannot exceed the sets' difference, and then by 512; the rest is verified on the words themselves,
the earliest candidate of each set first. A line is removed if an earlier line, by doc_id (null last) and place in the text, has a set of at least that similarity.

Equal texts are collapsed before any word is counted: all lines with a word go from the later ones, and
only the first is looked at. Equal sets are collapsed next; a line with a word that occurs once in the
corpus has no equal and takes no part in that.

A family of *m* near copies has *m*² pairs, so under each prefix word a set is at first paired with its
``EARLIEST`` earliest candidates alone (and with the earliest of up to ``LEADERS`` sets that pass the filters, where
the word has more than ``HOT`` sets and more than ``DENSE`` pairs a set). Sets that had further candidates are marked, and those of
them for which no match was verified are compared with all their candidates in a second pass, so none is lost.
Words of which that makes too many pairs, and prefix words of more than ``MOST`` sets, are left to blocks inside
tasks: the sets without a match so far are compared with up to ``LEADERS`` early ones each and then with all. That carries
the words of a set under each such prefix word.

Large tables are worked on in up to ``MOST_ROUNDS`` rounds, by the hash of the prefix word or of the text, so that only one
round's rows lie in shuffle files at a time.

The buckets grow with the text up to ``MOST_BUCKETS``. Beyond that fewer words are seen to be unique and the
order is less exact; results do not change, and the prefixes bound the words that are joined in any case.

Defined results: every line with a word is compared; lines without one always stay. A null text
stays null. Rows with equal doc_id and text are one document and share its result. An empty table gives
no rows. Other columns of the input are kept as they are; ``n_lines`` and ``n_removed`` replace columns of
those names.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sableframe.llm.set_overlap import Postings, groups
from sableframe.llm.staging import broadcast_if_small, dropped, scratch, small_batches, small_enough, staged
from sableframe.llm.tables import let, table
from sableframe.llm.text_kernels import lean, ragged, sorted_distinct, stir, word_table

NUM, DEN = 4, 5  # a Jaccard of 0.8
#: Buckets of words: one for each CHARS bytes of text, a power of two between the limits.
LEAST_BUCKETS, MOST_BUCKETS, CHARS = 1 << 16, 1 << 24, 16
HOT, LEADERS, BLOCK_WORDS, PAIRS_AT_ONCE = 500, 64, 400_000, 50_000
#: Sets of a word that is never joined pairwise, and pairs a set from which a hot word is left to :func:`hot_later`.
MOST, DENSE = 20_000, 16
#: Earliest candidates under a prefix word that a set is compared with at first.
EARLIEST = 2
#: Rounds in which a table is worked on: one for each ROUND_CHARS bytes of text, up to a limit.
MOST_ROUNDS, ROUND_CHARS = 2, 1 << 28
#: Postings that a task packs at a time, and bytes of text for a bucket of them.
PACKED, BUCKET_CHARS = 1 << 19, 1 << 21
_ID_BITS = 55
_BLOCK = 1 << 16  # buckets whose counts travel together
_FULL = (1 << 16) - 1  # sizes and places from here on are not told apart, and filter nothing
_MARKS = 8  # words of 64 parity bits that a candidate's set has
_EXACT = 200  # counts of a task's words up to here are kept as they are
_HAS_WORD = "[^ \\t-\\r]"


def text_key() -> list[Column]:
    """128 bits that stand for a text, as columns h0 and h1."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("h0"), F.xxhash64(text, F.lit(1)).alias("h1")]


def repeated_texts(docs: DataFrame) -> DataFrame:
    """(h0, h1, first): texts of more than one row, with their least doc_id (null last)."""
    counted = docs.select("doc_id", *text_key()).groupBy("h0", "h1").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    return counted.where("copies > 1").select("h0", "h1", "first")


def distinct_texts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, h0, h1, text): each text once, in its first document. Only texts that several rows have are shuffled."""
    marked = docs.select("doc_id", *text_key(), "text").join(broadcast_if_small(repeated.withColumn("_again", F.lit(True))), ["h0", "h1"], "left")
    columns = ["doc_id", "h0", "h1", "text"]
    first = marked.where(F.col("_again") & F.col("doc_id").eqNullSafe(F.col("first")))
    once = staged(first.groupBy("doc_id", "h0", "h1").agg(F.first("text").alias("text")).select(*columns))
    return marked.where("_again IS NULL").select(*columns).unionByName(once)


def bucket_count(chars: int) -> int:
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (chars // CHARS).bit_length()))


def round_count(chars: int) -> int:
    return min(MOST_ROUNDS, chars // ROUND_CHARS + 1)


def packed_counts(n: np.ndarray) -> np.ndarray:
    """Counts in a byte each: exact up to ``_EXACT``, then doublings of it, rounded down."""
    return np.where(n <= _EXACT, n, _EXACT + np.floor(np.log2(np.maximum(n, 1) / _EXACT))).astype(np.uint8)


def unpacked_counts(b: np.ndarray) -> np.ndarray:
    return np.where(b <= _EXACT, b, _EXACT << np.maximum(b.astype(np.int64) - _EXACT, 0))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) with each key once, ascending."""
    at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    return at[starts], np.add.reduceat(n, starts) if len(starts) else n


def word_rarity(texts: DataFrame, buckets: int) -> np.ndarray:
    """For each bucket of words four times the binary logarithm of its count, one byte each; 255 if none."""
    whole = np.uint64(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only buckets with words are held; a table of all would take more memory than the texts do.
        at, n = np.zeros(0, np.int32), np.zeros(0, np.int32)
        more: list[tuple[np.ndarray, np.ndarray]] = []
        for b in lean(batches):
            for k in range(0, b.num_rows, 1024):
                _, code, hashes = word_table(b.column(0).slice(k, 1024))
                more.append(((hashes % whole).astype(np.int32), np.bincount(code, minlength=len(hashes)).astype(np.int32)))
                if sum(len(x) for x, _ in more) > max(1 << 20, len(at)):
                    at, n, more = *summed([(at, n), *more]), []
        at, n = summed([(at, n), *more])
        cuts = np.searchsorted(at, np.arange(0, buckets + 1, _BLOCK))
        found = [(k, at[a:b] - k * _BLOCK, n[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        # Once or more often is exact, and a count is never more than halved.
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in found], pa.int32()), pa.array([x.astype(np.uint16).tobytes() for _, x, _ in found], pa.binary()), pa.array([packed_counts(x).tobytes() for _, _, x in found], pa.binary())],
            ["block", "at", "n"],
        )

    def merge(t: pa.Table) -> pa.Table:
        seen = np.zeros(_BLOCK, np.int64)
        for at, n in zip(t["at"], t["n"], strict=True):
            seen[np.frombuffer(at.as_py(), np.uint16)] += unpacked_counts(np.frombuffer(n.as_py(), np.uint8))
        code = np.where(seen > 0, np.minimum(np.floor(4 * np.log2(np.maximum(seen, 1))), 254), 255).astype(np.uint8)
        return pa.table({"block": t["block"].slice(0, 1), "codes": pa.array([code.tobytes()], pa.binary())})

    counted = texts.select("text").mapInArrow(count, "block int, at binary, n binary").groupBy("block").applyInArrow(merge, "block int, codes binary")
    rarity = np.full(buckets, 255, np.uint8)
    with small_batches(texts.sparkSession):
        found = counted.collect()  # at most MOST_BUCKETS bytes
    for r in found:
        rarity[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["codes"], np.uint8)
    return rarity


def prefix_length(n):
    """How many of a set's rarest words must hold one that any similar set has in its own prefix."""
    return n - -(-NUM * n // DEN) + 1


def sets_of_lines(texts: pa.Array, rarity: np.ndarray) -> dict[str, np.ndarray]:
    """The lines that hold a word: text, line, n, skip, s0, s1, p0, p1 and the prefixes with their ``cuts``.

    A word is an integer that sorts by rarity: its bucket's code above 55 bits of its hash. A set is known
    by two sums over its words' hashes; p0 has 64 parity bits and p1 has 32.
    """
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    per_text = np.diff(lines.offsets.to_numpy())
    owner, code, hashes = word_table(lines.flatten())
    token = (rarity[(hashes % np.uint64(len(rarity))).astype(np.int64)].astype(np.int64) << _ID_BITS) | (hashes >> np.uint64(9)).astype(np.int64)
    known, rank = np.unique(token, return_inverse=True)
    pair = sorted_distinct((owner.astype(np.int64) << 32) | rank[code])
    row, word = pair >> 32, known[pair & 0xFFFFFFFF]
    chosen, starts, n = np.unique(row, return_index=True, return_counts=True)
    first = np.searchsorted(chosen, row)
    once = np.bincount(first, (word >> _ID_BITS) == 0, minlength=len(chosen)).astype(np.int64)
    skip = np.minimum(once, prefix_length(n))  # a word that occurs once in the corpus matches nothing
    count = prefix_length(n) - skip
    bit, one = word % 96, np.int64(1)
    reduce = lambda f, x: f.reduceat(x, starts) if len(starts) else x[:0]
    stirred = stir(word.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return {
        "text": np.repeat(np.arange(len(texts)), per_text)[chosen],
        "line": (np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text))[chosen],
        "n": n,
        "skip": skip,
        "s0": reduce(np.add, stirred).view(np.int64),
        "s1": reduce(np.add, stir(stirred ^ np.uint64(0xA0761D6478BD642F))).view(np.int64),
        "p0": reduce(np.bitwise_xor, np.where(bit < 64, one << (bit & 63), 0)),
        "p1": reduce(np.bitwise_xor, np.where(bit >= 64, one << (bit & 31), 0)).astype(np.uint32).view(np.int32),
        "cuts": np.concatenate([[0], np.cumsum(count)]),
        "prefix": word[ragged(count, starts + skip)],
    }


def line_sets(texts: DataFrame, rarity: np.ndarray) -> DataFrame:
    """One row per line that holds a word: its place, set, prefix and parity bits."""
    shared = texts.sparkSession.sparkContext.broadcast(rarity)
    kinds = {"line": pa.int32(), "n": pa.int32(), "skip": pa.int32(), "s0": pa.int64(), "s1": pa.int64(), "p0": pa.int64(), "p1": pa.int32()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = sets_of_lines(part.column(3), shared.value)
                text = pa.array(x["text"])
                prefix = pa.ListArray.from_arrays(pa.array(x["cuts"], pa.int32()), pa.array(x["prefix"], pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(text) for k in range(3)), *(pa.array(x[k].astype(t.to_pandas_dtype())) for k, t in kinds.items()), prefix], ["doc_id", "h0", "h1", *kinds, "prefix"])

    return texts.select("doc_id", "h0", "h1", "text").mapInArrow(cut, "doc_id long, h0 long, h1 long, line int, n int, skip int, s0 long, s1 long, p0 long, p1 int, prefix array<long>")


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("doc_id"), F.col("h0").alias("h0"), F.col("line").alias("line"))


def repeated_sets(lines: DataFrame) -> DataFrame:
    """(s0, s1, o): sets of more than one line, with their earliest line. Lines with a unique word have no equal."""
    counted = lines.where("skip = 0").groupBy("s0", "s1").agg(F.min(_order()).alias("o"), F.count("*").alias("copies"))
    return counted.where("copies > 1").select("s0", "s1", "o")


def prefix_sets(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(id, n, skip, prefix, p0, p1, rank): each set that has a prefix once, known by the id of its earliest line; ``rank`` is that line's doc_id (null last)."""
    own = lines.where(F.size("prefix") > 0).withColumn("rank", F.coalesce("doc_id", F.lit(2**63 - 1)))
    known = own.where("skip = 0").join(broadcast_if_small(repeated), ["s0", "s1"], "left").where(F.col("o").isNull() | (_order() == F.col("o")))
    columns = ["id", "n", "skip", "prefix", "p0", "p1", "rank"]
    return own.where("skip > 0").select(*columns).unionByName(known.select(*columns))


def prefix_postings(sets: DataFrame) -> DataFrame:
    """(token, id, at, p, rank): a row per prefix word of each set.

    ``at`` holds 32 parity bits, the set's size and the word's place in 16 bits each; ``p`` 64 parity bits. Under words of
    too few sets to leave a candidate out, all ranks are 0, which takes less room.
    """
    rows = sets.select("id", "n", "skip", "p0", "p1", "rank", F.posexplode("prefix").alias("k", "token"))
    some = F.shiftright("token", _ID_BITS) >= int(4 * np.log2(EARLIEST + 2))
    at = F.shiftleft(F.col("p1").cast("long"), 32).bitwiseOR(F.shiftleft(F.least("n", F.lit(_FULL)).cast("long"), 16)).bitwiseOR(F.least(F.col("k") + F.col("skip"), F.lit(_FULL)).cast("long"))
    return rows.select("token", "id", at.alias("at"), F.col("p0").alias("p"), F.when(some, F.col("rank")).otherwise(0).alias("rank"))


def set_size(at: Column) -> Column:
    return F.shiftright(at, 16).bitwiseAND(F.lit(_FULL))


def pairs_of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What :func:`similar_pairs` makes of postings that come by token.

    Only whole tokens are worked on; the rows of the last one wait for the next batch.
    """
    held: list[np.ndarray] | None = None
    for b in lean(batches):
        now = [c.to_numpy() for c in b.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if done:
            yield from similar_pairs(*(x[:done] for x in held))
            held = [x[done:] for x in held]
    if held is not None:
        yield from similar_pairs(*held)


def _two(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def similar_pairs(token: np.ndarray, ids: np.ndarray, at: np.ndarray, p: np.ndarray, rank: np.ndarray | None = None, probe: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(a, b) of whole tokens, of arrays in the order of the token: pairs under the same token that pass the length, position and parity filters.

    A token's rows are ordered by size, rank and id, so the sets that one may be similar to are a run after it. Pairs are made ``PAIRS_AT_ONCE`` at a time.
    Without ranks all pairs are returned, and (token, -1) in place of the further pairs of a dense token. With ranks, a set's pairs
    with the ``EARLIEST`` others of each run, and (id, -1 - token) for a set that has more or whose token is dense. With ``probe`` all pairs of the rows marked by it
    and rows of no greater rank, and (token, -1) for a dense token.
    """
    thin, marked = rank is not None and probe is None, probe is not None
    rank, probe = np.zeros(len(token), np.int64) if rank is None else rank, np.ones(len(token), np.int64) if probe is None else probe
    new = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    alone = new & np.concatenate([new[1:], [True]]) if len(token) else new
    group, token, ids, at, p, rank, probe = np.cumsum(new)[~alone], *(x[~alone] for x in (token, ids, at, p, rank, probe))
    key = (group << 16) | ((at >> 16) & _FULL)
    order = np.lexsort((ids, rank, key))
    key, ids, at, p, rank, probe = key[order], ids[order], at[order], p[order], rank[order], probe[order]
    n, place, bits, base = key & _FULL, at & _FULL, (at >> 32).astype(np.uint32), key & ~np.int64(_FULL)
    after = np.arange(len(key)) + 1
    reach = np.searchsorted(key, base | np.minimum(n * DEN // NUM, _FULL), side="right")
    ends = np.where(place * (NUM + DEN) <= n * (DEN - NUM), reach, after)
    _, begins, owner = np.unique(group, return_index=True, return_inverse=True)  # the order keeps groups where they are
    sizes, made, dense = np.diff(np.append(begins, len(group))), np.zeros(len(begins), np.int64), np.zeros(len(begins), bool)

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether rows and later rows of their tokens pass the filters."""
        an, bn, ap, bp = n[x], n[y], place[x], place[y]
        both = an + bn
        near = (np.minimum(ap, bp) + np.minimum(an - ap, bn - bp)) * (NUM + DEN) >= both * NUM
        apart = np.bitwise_count(p[x].view(np.uint64) ^ p[y].view(np.uint64)).astype(np.int64) + np.bitwise_count(bits[x] ^ bits[y])
        return (near & (apart * (NUM + DEN) <= both * (DEN - NUM)) & (y < ends[x])) | (bn == _FULL)

    def earliest(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        turned = (rank[x] > rank[y]) | ((rank[x] == rank[y]) & (ids[x] > ids[y]))
        later, first = np.where(turned, x, y), np.where(turned, y, x)
        by = np.lexsort((ids[first], rank[first], later))
        later, first = later[by], first[by]
        starts = np.flatnonzero(np.diff(later, prepend=-1))
        more = np.arange(len(later)) - np.repeat(starts, np.diff(np.append(starts, len(later)))) >= EARLIEST
        yield _two(ids[later[~more]], ids[first[~more]])
        # Of equal ranks either may be the later one.
        left = np.unique(np.concatenate([later[more], first[more & (rank[later] == rank[first])]]))
        if len(left):
            yield _two(ids[left], ~token[left])

    def led(g: int) -> Iterator[pa.RecordBatch]:
        rest = begins[g] + np.arange(sizes[g])
        yield _two(ids[rest], ~token[rest])
        rest = rest[np.lexsort((ids[rest], rank[rest]))]
        for _ in range(LEADERS):
            if len(rest) < 2:
                break
            lead, rest = rest[0], rest[1:]
            near = alike(np.minimum(lead, rest), np.maximum(lead, rest))
            if near.any():
                yield _two(ids[rest[near]], np.full(near.sum(), ids[lead]))
            rest = rest[~near]

    rows = np.flatnonzero(probe)
    runs = [(begins[owner[rows]], (begins + sizes)[owner[rows]])] if marked else [(after, ends)]
    if not marked and (n == _FULL).any():  # of a size that is not told apart: nothing is known of such pairs
        runs.append((np.maximum(ends, np.searchsorted(key, base | _FULL)), np.searchsorted(key, base | _FULL, side="right")))
    for first, last in runs:
        count = np.maximum(last - first, 0)
        total = np.concatenate([[0], np.cumsum(count)])
        k = 0
        while k < len(count):
            m = max(k + 1, int(np.searchsorted(total, total[k] + PAIRS_AT_ONCE, side="right")) - 1)
            x, y = np.repeat(rows[k:m], count[k:m]), ragged(count[k:m], first[k:m])
            g0, g1 = owner[rows[k]], owner[rows[m - 1]] + 1
            k = m
            if marked:
                other = (x != y) & (rank[y] <= rank[x])
                x, y = np.minimum(x, y)[other], np.maximum(x, y)[other]
            keep = alike(x, y)
            x, y = x[keep], y[keep]
            if len(x):
                yield from earliest(x, y) if thin else [_two(ids[x], ids[y])]
            if (sizes[g0:g1] > HOT).any():
                made[g0:g1] += np.bincount(owner[x] - g0, minlength=g1 - g0)
                full = g0 + np.flatnonzero((sizes[g0:g1] > HOT) & ~dense[g0:g1] & (made[g0:g1] > DENSE * sizes[g0:g1]))
                dense[full] = True
                if thin:
                    for g in full:
                        yield from led(g)
                elif len(full):
                    yield _two(token[begins[full]], np.full(len(full), -1))
            while k < len(count) and dense[owner[rows[k]]]:
                g = owner[rows[k]]
                k = int(np.searchsorted(rows, begins[g] + sizes[g]))


def packed_postings(sets: DataFrame, buckets: int, rounds: int, k: int) -> DataFrame:
    """(bucket, data): what :func:`prefix_postings` returns for the words of round ``k``, the columns of many rows one after the other in each ``data``.

    All rows of a word are in one bucket. So few rows of bytes are shuffled and sorted in place of one for each posting.
    """
    least = int(4 * np.log2(EARLIEST + 2))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in lean(batches):
            ids, n, skip, p0, p1, rank = (b.column(i).to_numpy() for i in range(6))
            prefix = b.column(6)
            count = np.diff(prefix.offsets.to_numpy())
            token, of = prefix.flatten().to_numpy(), np.repeat(np.arange(len(ids)), count)
            place = ragged(count, np.zeros(len(count), np.int64)) + skip[of]
            at = (p1[of].astype(np.int64) << 32) | (np.minimum(n[of], _FULL).astype(np.int64) << 16) | np.minimum(place, _FULL)
            full = np.stack([token, ids[of], at, p0[of], np.where((token >> _ID_BITS) >= least, rank[of], 0)])
            held.append(full[:, token % rounds == k] if rounds > 1 else full)
            if sum(x.shape[1] for x in held) > PACKED:
                yield bundled(np.concatenate(held, axis=1), buckets)
                held = []
        if held:
            yield bundled(np.concatenate(held, axis=1), buckets)

    return sets.select("id", "n", "skip", "p0", "p1", "rank", "prefix").mapInArrow(pack, "bucket int, data binary")


def bundled(rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, data) of postings, given as a row of numbers for each of their columns."""
    bucket = (stir(rows[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[:, order], bucket[order]
    known, starts = np.unique(bucket, return_index=True)
    data = [rows[:, a:b].tobytes() for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(known, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])


def pairs_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What :func:`similar_pairs` makes of packed postings that come by bucket."""
    for t in groups(batches, ["bucket"]):
        rows = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(5, -1) for x in t["data"]], axis=1)
        yield from similar_pairs(*rows[:, np.argsort(rows[0], kind="stable")])


def packed_pairs(packed: DataFrame) -> DataFrame:
    """What :func:`candidate_pairs` makes of the same postings."""
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(pairs_of_buckets, "a long, b long").distinct()


def candidate_pairs(postings: DataFrame) -> DataFrame:
    """(a, b): ids of sets with a common prefix word that pass the length, position and parity filters, and marks, as :func:`similar_pairs` returns them.

    The smaller set (of equal ones that of the lesser rank) is looked up by its place: its shared word lies in the shorter
    prefix that suffices against sets of its size or more. Sizes of ``_FULL`` or more pass every filter.
    One shuffle and one sort by the word serve both sides.
    """
    return postings.repartition("token").sortWithinPartitions("token").mapInArrow(pairs_of_words, "a long, b long").distinct()


def set_words(texts: DataFrame, wanted: DataFrame, rounds: int = 1) -> DataFrame:
    """(id, o, n, marks, words): size, parity bits and distinct words of the ``wanted`` lines (id, h0, h1, line, o), which come as a list per text.

    Keys that are too large to broadcast are joined in ``rounds``, so that not all texts are shuffled at once.
    """
    keys = staged(wanted.groupBy("h0", "h1").agg(F.collect_list(F.struct("line", "id", "o")).alias("lines")))
    small = small_enough(keys)
    if small or rounds == 1:
        return staged(words_of_lines(texts, F.broadcast(keys) if small else keys))
    part = F.pmod("h0", F.lit(rounds))
    return functools.reduce(DataFrame.unionByName, [staged(words_of_lines(texts.where(part == k), keys.where(part == k))) for k in range(rounds)])


def sets_of_words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, marks, words) of lines: how many distinct words each has, their ``_MARKS`` parity words, and their hashes, ascending in each line."""
    owner, code, hashes = word_table(lines)
    known, rank = np.unique(hashes, return_inverse=True)
    pair = sorted_distinct((owner.astype(np.int64) << 32) | rank[code])
    row, words = pair >> 32, known[pair & 0xFFFFFFFF]
    odd = np.bincount(row * (64 * _MARKS) + (words % np.uint64(64 * _MARKS)).astype(np.int64), minlength=len(lines) * 64 * _MARKS).astype(np.uint8) & 1
    return np.bincount(row, minlength=len(lines)), np.packbits(odd).view(np.int64), words.view(np.int64)


def words_of_lines(texts: DataFrame, keys: DataFrame) -> DataFrame:
    pieces = F.split("text", "\n", -1)
    found = texts.join(keys, ["h0", "h1"]).select(let(pieces, lambda p: F.transform("lines.line", lambda i: F.get(p, i))).alias("said"), "lines.id", "lines.o")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lines, ids, o = (part.column(k).flatten() for k in range(3))
                for k in range(0, len(lines), 4096):
                    n, marks, words = sets_of_words(lines.slice(k, 4096))
                    cuts = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * _MARKS), pa.array(marks)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(words))]
                    yield pa.RecordBatch.from_arrays([ids.slice(k, 4096), o.slice(k, 4096), pa.array(n.astype(np.int32)), *lists], ["id", "o", "n", "marks", "words"])

    return found.mapInArrow(cut, "id long, o struct<x:boolean,doc_id:bigint,h0:bigint,line:int>, n int, marks array<long>, words array<long>")


def near_candidates(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(later, earlier, eo): the pairs whose parity bits differ no more than near sets' may, with the place of the earlier set."""
    side = lambda c: broadcast_if_small(words.select(F.col("id").alias(c), F.struct("o", "n", "marks").alias(f"{c}_")))
    a, b = F.col("a_"), F.col("b_")
    apart = sum((F.bit_count(a["marks"][k].bitwiseXOR(b["marks"][k])) for k in range(_MARKS)), F.lit(0))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where((apart * (NUM + DEN) <= (a["n"] + b["n"]) * (DEN - NUM)) & (a["o"] != b["o"]))
    first = a["o"] < b["o"]
    pick = lambda x, y: F.when(first, x).otherwise(y)
    return near.select(pick(F.col("b"), F.col("a")).alias("later"), pick(F.col("a"), F.col("b")).alias("earlier"), pick(a["o"], b["o"]).alias("eo"))


def verified_later(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(id): the later set of each pair that is as similar as asked.

    Each later set is first compared with its earliest candidate, then those that were not near with all others.
    """
    near = staged(near_candidates(pairs, words))

    def compared(some: DataFrame) -> DataFrame:
        some = staged(some.select("later", "earlier"))
        left = words.select(F.col("id").alias("later"), F.col("words").alias("lw")).join(broadcast_if_small(some), "later")
        needed = broadcast_if_small(staged(some.select("earlier").distinct()))
        right = words.select(F.col("id").alias("earlier"), F.col("words").alias("ew")).join(needed, "earlier")
        both = F.size(F.array_intersect("lw", "ew"))
        return left.join(right, "earlier").where(both * (NUM + DEN) >= (F.size("lw") + F.size("ew")) * NUM).select(F.col("later").alias("id")).distinct()

    first = staged(compared(near.groupBy("later").agg(F.min_by("earlier", "eo").alias("earlier"))))
    rest = near.join(broadcast_if_small(first.withColumnRenamed("id", "later")), "later", "left_anti")
    return first.unionByName(compared(rest)).distinct()


def later_in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """(id): rows marked ``probe`` that have an earlier, similar row marked ``index`` in their group."""
    for t in groups(batches, keys):
        t = t.combine_chunks()
        o = t["o"].combine_chunks()
        place = list(zip(o.field(0).to_pylist(), [x or 0 for x in o.field(1).to_pylist()], o.field(2).to_pylist(), o.field(3).to_pylist(), strict=True))
        order = sorted(range(t.num_rows), key=place.__getitem__)
        before = np.zeros(t.num_rows, np.int64)  # rows of a lesser place
        for k in range(1, t.num_rows):
            before[k] = before[k - 1] if place[order[k]] == place[order[k - 1]] else k
        ids, probe, index = t["id"].to_numpy(), t["probe"].to_numpy(zero_copy_only=False), t["index"].to_numpy(zero_copy_only=False)
        words = t["words"].combine_chunks()
        sets = [words[i].values.to_numpy() for i in order]
        size = np.array([len(s) for s in sets])
        left = np.array([k for k, i in enumerate(order) if index[i]], np.int64)
        if not len(left):
            continue
        postings, found = Postings([sets[k] for k in left]), []
        for k, i in enumerate(order):
            if probe[i]:
                near = postings.overlaps(sets[k]) * (NUM + DEN) >= NUM * (size[left] + size[k])
                if (near & (left < before[k])).any():
                    found.append(ids[i])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["id"])


def hot_later(hot: DataFrame, words: DataFrame, done: DataFrame) -> DataFrame:
    """(id): sets of hot words (token, id, n), but for those that are ``done``, that have an earlier similar set under the same word."""
    probes = staged(hot.join(broadcast_if_small(done), "id", "left_anti"))
    hot = hot.join(broadcast_if_small(staged(probes.select("token").distinct())), "token", "left_semi")
    words = staged(words.join(broadcast_if_small(staged(hot.select("id").distinct())), "id"))  # hot sets only
    members = hot.select("token", "id").join(words.select("id", "o"), "id").withColumn("slot", F.pmod(F.hash("id"), F.lit(LEADERS)))
    leaders = members.groupBy("token", "slot").agg(F.min(F.struct("o", "id")).alias("f")).select("token", "f.id")
    # Leaders of a word are at most LEADERS rows; they go to each of the word's parts.
    sizes = hot.groupBy("token").agg(F.ceil(F.sum("n") / BLOCK_WORDS).cast("int").alias("parts"))
    part = lambda df: df.join(sizes, "token").withColumn("part", F.pmod(F.hash("id", F.lit(1)), "parts"))
    every = leaders.join(sizes, "token").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["token", "part", "other"]

    def run(rows: DataFrame) -> DataFrame:
        full = rows.join(words.select("id", "o", "words"), "id").repartition(*keys).sortWithinPartitions(*keys)
        return full.select(*keys, "id", "o", "words", "probe", "index").mapInArrow(lambda b: later_in_groups(b, keys), "id long").distinct()

    zero, true, false = F.lit(0).alias("other"), F.lit(True), F.lit(False)
    first = part(probes).select("token", "part", zero, "id", true.alias("probe"), false.alias("index"))
    second = every.select("token", "part", zero, "id", false.alias("probe"), true.alias("index"))
    led = staged(run(first.unionByName(second)))
    left = part(probes.join(led, "id", "left_anti"))
    grid = left.select("token", "part", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), true.alias("probe"), false.alias("index"))
    needed = left.select("token", "part").distinct()
    against = part(hot).select("token", F.col("part").alias("other"), "id").join(needed, "token").select("token", "part", "other", "id", false.alias("probe"), true.alias("index"))
    return led.unionByName(run(grid.unionByName(against)))


def removed_lines(texts: DataFrame, chars: int) -> DataFrame:
    """(h0, h1, lines): for each of the distinct texts that loses lines, their numbers from 0. ``chars`` sizes the table of words."""
    rarity = word_rarity(texts, bucket_count(chars))
    whole = staged(line_sets(texts, rarity).withColumn("id", F.monotonically_increasing_id()))
    repeated = staged(repeated_sets(whole))
    # The sets and the places of lines are read apart from here on, and the sets several times.
    sets = staged(prefix_sets(whole, repeated))
    postings = prefix_postings(sets)
    lines = staged(whole.select("id", "s0", "s1", "skip", "doc_id", "h0", "h1", "line"))
    for path in {f.rsplit("/", 1)[0] for f in whole.inputFiles()}:
        dropped(whole.sparkSession, path)
    rounds = round_count(chars)
    # Counts of words are at most halved, so a word of more sets than MOST has at least half that count.
    least = int(4 * np.log2(max(MOST, 2) / 2))
    frequent = postings.where(F.shiftright("token", _ID_BITS) >= least)
    most = staged(frequent.groupBy("token").count().where(F.col("count") > MOST).select("token"))
    never = broadcast_if_small(most) if most.limit(1).count() else None

    def found(k: int) -> DataFrame:
        if never is None:
            return staged(packed_pairs(packed_postings(sets, max(64, chars // BUCKET_CHARS), rounds, k)))
        rows = postings.where(F.pmod("token", F.lit(rounds)) == k) if rounds > 1 else postings
        return staged(candidate_pairs(rows.join(never, "token", "left_anti")))

    def of_pairs(some: DataFrame) -> DataFrame:
        return some.select(F.col("a").alias("id")).unionByName(some.select(F.col("b").alias("id")))

    def words_of(ids: DataFrame) -> DataFrame:
        places = lines.select("id", "doc_id", "h0", "h1", "line").join(broadcast_if_small(staged(ids)), "id")
        return set_words(texts, places.withColumn("o", _order()), rounds)

    def members(tokens: DataFrame | None) -> DataFrame:
        every = postings.select("token", "id", set_size(F.col("at")).alias("n"))
        return staged(every.limit(0) if tokens is None else every.join(broadcast_if_small(tokens), "token", "left_semi"))

    both = functools.reduce(DataFrame.unionByName, [found(k) for k in range(rounds)])
    pairs = staged(both.where("b >= 0").distinct()) if rounds > 1 else both.where("b >= 0")
    hot = members(None if never is None else most)
    words = words_of(of_pairs(pairs).unionByName(hot.select("id")).distinct())
    later = staged(verified_later(pairs, words))
    left = both.where("b < 0").select(F.col("a").alias("id"), F.bitwise_not("b").alias("token"))
    left = staged(left.join(broadcast_if_small(later), "id", "left_anti"))
    if left.limit(1).count():
        # All candidates of the sets that no match was found for, under the words that had more than were compared.
        tokens = broadcast_if_small(staged(left.select("token").distinct()))
        probes = broadcast_if_small(left.withColumn("probe", F.lit(1).cast("long")))
        rows = postings.join(tokens, "token", "left_semi").join(probes, ["token", "id"], "left")
        both = staged(candidate_pairs(rows.select(*postings.columns, F.coalesce("probe", F.lit(0).cast("long")).alias("probe"))))
        pairs = both.where("b >= 0")
        dense = staged(both.where("b < 0").select(F.col("a").alias("token")))
        if dense.limit(1).count():
            hot = members(most.unionByName(dense))
        missing = staged(of_pairs(pairs).unionByName(hot.select("id")).distinct().join(words.select("id"), "id", "left_anti"))
        if missing.limit(1).count():
            words = words.unionByName(words_of(missing))
        later = staged(later.unionByName(verified_later(pairs, words)).distinct())
    if hot.limit(1).count():
        later = later.unionByName(hot_later(hot, words, later)).distinct()
    marked = lines.select("id", "s0", "s1", "skip", "doc_id", "h0", "h1", "line")
    later = marked.join(broadcast_if_small(staged(later)), "id")
    gone_sets = staged(later.select("s0", "s1").distinct())
    # A set that is a later match goes with all its lines; of other repeated sets the first line stays.
    alike = marked.join(broadcast_if_small(gone_sets), ["s0", "s1"]).select("h0", "h1", "line")
    again = marked.where("skip = 0").join(broadcast_if_small(repeated), ["s0", "s1"]).where(_order() != F.col("o")).select("h0", "h1", "line")
    gone = alike.unionByName(again)
    return gone.groupBy("h0", "h1").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the later matches taken out of ``text``, and with ``n_lines`` and ``n_removed``."""
    size = Observation()
    repeated = staged(repeated_texts(docs.observe(size, F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("chars"))), keep=True)
    chars = 0 if docs.isEmpty() else size.get["chars"]  # Spark leaves the observation of an empty table out
    with scratch():
        gone = staged(removed_lines(distinct_texts(docs, repeated), chars), keep=True)
    small = broadcast_if_small(gone.select(F.col("h0").alias("_g0"), F.col("h1").alias("_g1"), F.col("lines").alias("_lines")))
    firsts = broadcast_if_small(repeated.select(F.col("h0").alias("_r0"), F.col("h1").alias("_r1"), F.col("first").alias("_first"), F.lit(True).alias("_again")))
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")])
    h0, h1 = text_key()
    keyed = base.withColumns({"_h0": h0, "_h1": h1})
    joined = keyed.join(small, (F.col("_h0") == F.col("_g0")) & (F.col("_h1") == F.col("_g1")), "left")
    joined = joined.join(firsts, (F.col("_h0") == F.col("_r0")) & (F.col("_h1") == F.col("_r1")), "left")
    pieces = F.split("text", "\n", -1)
    copy = F.coalesce(F.col("_again") & ~F.col("doc_id").eqNullSafe(F.col("_first")), F.lit(False))
    kept = F.filter(pieces, lambda x, i: ~F.array_contains("_lines", i))
    bare = F.filter(pieces, lambda x: ~x.rlike(_HAS_WORD))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    removed = F.when(copy, F.coalesce(F.size(pieces) - F.size(bare), F.lit(0))).when(F.col("_lines").isNotNull(), F.size("_lines")).otherwise(0)
    text = F.when(copy, F.array_join(bare, "\n")).when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    made = joined.withColumns({"n_lines": n_lines, "n_removed": F.when(F.col("text").isNull(), 0).otherwise(removed).cast("long"), "text": text})
    return made.drop("_h0", "_h1", "_g0", "_g1", "_lines", "_r0", "_r1", "_first", "_again")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without lines that are near an earlier line of the corpus."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_removed")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
