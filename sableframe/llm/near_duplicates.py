"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents with equal texts are one *node*. A node's five-word shingles give it a path of minima in each of
``TREES`` prefix tries; a trie node is known by the hash of its path, and nodes are brought together by
sorting on those. The join descends as deep as it can and shortens prefixes only where the data ask for it:

1. In the first ``SCOUTS`` tries, prefixes of full length ``DEPTH`` are matched. Each member of a matched
   prefix is compared with up to ``LEADERS`` of the others; links give components. A family of near
   copies ends as one component here, in time linear in its size.
2. A pair at the threshold is found by full prefixes with too little certainty, so matched prefixes are
   shortened to the longest that reaches ``RECALL`` over all tries. A shorter prefix whose members are one
   component already is left alone; in the others, the members outside the largest component are
   compared with all members of other components. New links join components.
3. Links are counted inside components, each pair once and by the exact Jaccard of the shingle sets.

Nothing but links and sets of the members of matched prefixes is shuffled, in blocks of bounded size. The
first two steps, which are all that :func:`keep_one` needs, are linear in a family of near copies; the exact
number of links of *m* different texts that are near each other takes *m*² comparisons (in blocks, no pair
is written).

Defined results: a null text is an empty text. Equal texts are always linked. A text of one to four words
is one shingle; texts without words are linked only to equal texts. Repeated rows are copies. The class
id is the least doc_id of the class (null only if all are null). An empty table gives no rows. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sableframe.llm.components import components
from sableframe.llm.set_overlap import Postings, Unions, groups
from sableframe.llm.staging import broadcast_if_small, scratch, staged
from sableframe.llm.tables import table
from sableframe.llm.text_kernels import WordHashes, lean, shingles, split_words

THRESHOLD = (4, 5)  # 0.8, as a fraction
TREES, DEPTH, RECALL, SEED = 24, 8, 0.9999, 20240607
SCOUTS, LEADERS = 6, 64
#: Shingles of one block; a task holds two blocks.
BLOCK_SHINGLES = 1_000_000


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold is found with the target recall."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    raise ValueError("the forest needs more trees for this recall")


def node_of(text: Column) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def forest_paths(hashed: np.ndarray, trees: int, scouts: int, depth: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the paths of ``depth`` minima in each trie, and of those of full length in the first ``scouts``."""
    rng = np.random.default_rng(seed)
    k = trees * DEPTH
    mul = rng.integers(0, 2**31, k, np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2**32, k, np.uint32)
    used = np.array([t * DEPTH + d for t in range(trees) for d in range(DEPTH if t < scouts else depth)])
    mul, add, small = mul[used], add[used], (hashed >> np.uint64(32)).astype(np.uint32)
    least = np.full(k, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(small), 1024):
        least[used] = np.minimum(least[used], (small[at : at + 1024, None] * mul + add).min(axis=0))
    minima = least.reshape(trees, DEPTH).T.astype(np.uint64)
    key, short = np.arange(1, trees + 1).astype(np.uint64), None
    for d in range(DEPTH):
        key = (key ^ minima[d]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
        if d + 1 == depth:
            short = key.copy()
    return short.view(np.int64), key[:scouts].view(np.int64)


def signatures(docs: DataFrame, depth: int, trees: int = TREES, scouts: int = SCOUTS) -> DataFrame:
    """(doc_id, node, n, keys, scouts): the number of distinct shingles and the trie paths of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), {}
        none = (0, np.zeros(0, np.int64), np.zeros(0, np.int64))
        flat = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in x])]).astype(np.int32)), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
        for b in lean(batches):
            found = []
            for node, text in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if node not in seen:
                    if len(seen) >= 20_000:
                        seen.clear()
                    s = shingles(hashes.of(split_words(text.as_py())))
                    seen[node] = (len(s), *forest_paths(s, trees, scouts, depth)) if len(s) else none
                found.append(seen[node])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.int64()), flat([f[1] for f in found]), flat([f[2] for f in found])], ["doc_id", "node", "n", "keys", "scouts"])

    return docs.select("doc_id", node_of(F.col("text")).alias("node"), "text").mapInArrow(sign, "doc_id long, node binary, n long, keys array<long>, scouts array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) for the nodes of ``wanted`` (node, rep): one text each, sorted distinct hashes."""
    keyed = docs.select("doc_id", node_of(F.col("text")).alias("node"), "text")
    texts = keyed.join(broadcast_if_small(wanted.select("node", "rep")), "node").where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in lean(batches):
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(hashes.of(split_words(t.as_py()))).view(np.int64) for t in part.column(1)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["node", "shingles"])

    return texts.mapInArrow(cut, "node binary, shingles array<long>").dropDuplicates(["node"])


def _sets(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    whole = t["shingles"].combine_chunks()
    size = np.diff(whole.offsets.to_numpy())
    cuts, values = np.concatenate([[0], np.cumsum(size)]), whole.flatten().to_numpy()
    return [values[cuts[i] : cuts[i + 1]] for i in range(len(size))], size.astype(np.int64)


def link(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(a, b): links between ``probe`` and ``index`` rows of each task's group, a spanning forest of them.

    Rows of one component (``comp``) are not compared with each other.
    """
    for t in groups(batches, ["tree", "key", "part"]):
        sets, size = _sets(t)
        comp, probe = t["comp"].to_numpy(), t["probe"].to_numpy(zero_copy_only=False)
        left = np.flatnonzero(t["index"].to_numpy(zero_copy_only=False))
        index, union, found = Postings([sets[i] for i in left]), Unions(t.num_rows), []
        for j in np.flatnonzero(probe):
            near = index.overlaps(sets[j]) * (num + den) >= num * (size[left] + size[j])
            for i in left[near & (comp[left] != comp[j])].tolist():
                if union.root(i) != union.root(int(j)):
                    union.join(i, int(j))
                    found.append((i, int(j)))
        if found:
            nodes = t["node"].combine_chunks()
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array([i for i, _ in found])), nodes.take(pa.array([j for _, j in found]))], ["a", "b"])


def links_of(sets: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links found in the groups of ``rows`` (tree, key, part, node, comp, probe, index)."""
    columns = ["tree", "key", "part", "node", "comp", "probe", "index"]
    per_node = staged(rows.groupBy("node").agg(F.collect_list(F.struct(*[c for c in columns if c != "node"])).alias("g")))
    full = sets.join(broadcast_if_small(per_node), "node").select("node", "shingles", F.inline("g")).select(*columns, "shingles")
    dealt = full.repartition("tree", "key", "part").sortWithinPartitions("tree", "key", "part")
    return dealt.mapInArrow(lambda b: link(b, num, den), "a binary, b binary")


def once_each(groups_: DataFrame) -> DataFrame:
    """Groups (tree, key, c, s, x, y, ...) with the same members in several tries, once."""
    return groups_.groupBy("c", "s", "x", "y").agg(F.min_by(F.struct(*groups_.columns), F.struct("tree", "key")).alias("g")).select("g.*")


def _members() -> list[Column]:
    """Number, shingles and identity of a group's members."""
    return [F.count("*").alias("c"), F.sum("n").alias("s"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.hash("node")).alias("y")]


def scout_rows(nodes: DataFrame, block: int) -> DataFrame:
    """Rows of the full-length prefixes that several nodes share: all as probes, up to LEADERS of them as index in each part."""
    entries = nodes.select("node", "n", F.posexplode("scouts").alias("tree", "key"))
    shared = once_each(entries.groupBy("tree", "key").agg(*_members()).where("c > 1"))
    members = entries.join(shared.select("tree", "key", F.ceil(F.col("s") / block).cast("int").alias("parts")), ["tree", "key"])
    leaders = members.groupBy("tree", "key", "parts", F.pmod(F.hash("node", "tree"), F.lit(LEADERS)).alias("slot")).agg(F.min("node").alias("node"))
    spread = leaders.select("tree", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", F.lit(False).alias("probe"), F.lit(True).alias("index"))
    probes = members.select("tree", "key", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", F.lit(True).alias("probe"), F.lit(False).alias("index"))
    both = probes.unionByName(spread).groupBy("tree", "key", "part", "node").agg(F.max("probe").alias("probe"), F.max("index").alias("index"))
    return both.withColumn("comp", F.xxhash64("node"))


def shortened_rows(nodes: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Rows of ``nodes`` (those that share a prefix) in the shortened prefixes under which several components lie: all as index in one part, those outside the largest component as probes in every part."""
    known = nodes.select("node", "n", "keys").join(labels, "node", "left").withColumn("comp", F.xxhash64(F.coalesce("label", "node")))
    entries = known.select("node", "n", "comp", F.posexplode("keys").alias("tree", "key"))
    by_comp = entries.groupBy("tree", "key", "comp").agg(*_members())
    whole = by_comp.groupBy("tree", "key").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("c", "comp"))["comp"].alias("main"), F.count("*").alias("comps"))
    mixed = once_each(whole.where("comps > 1"))
    members = entries.join(mixed.select("tree", "key", "main", F.ceil(F.col("s") / block).cast("int").alias("parts")), ["tree", "key"])
    own, outside = F.pmod(F.xxhash64("node"), "parts").cast("int"), F.col("comp") != F.col("main")
    index = members.select("tree", "key", own.alias("part"), "node", "comp", outside.alias("probe"), F.lit(True).alias("index"))
    probes = members.where(outside).withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).where("part <> own")
    return index.unionByName(probes.select("tree", "key", "part", "node", "comp", F.lit(True).alias("probe"), F.lit(False).alias("index")))


def classified(docs: DataFrame, num: int, den: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(signed, nodes, sets, labels): documents with their nodes, nodes, the sets of those that share a prefix, and components (node, label)."""
    signed = staged(signatures(docs, prefix_depth(num / den)))
    nodes = staged(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("scouts").alias("scouts")))
    entries = nodes.select("node", "rep", F.posexplode("keys").alias("tree", "key"))
    shared = entries.groupBy("tree", "key").agg(F.count("*").alias("c")).where("c > 1")
    sets = staged(shingle_sets(docs, staged(entries.join(shared, ["tree", "key"]).select("node", "rep").distinct())))
    first = staged(links_of(sets, scout_rows(nodes, block), num, den))
    labels = staged(components(first))
    sharing = staged(nodes.join(broadcast_if_small(sets.select("node")), "node", "left_semi").select("node", "n", "keys"))
    more = links_of(sets, shortened_rows(sharing, labels, block), num, den)
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b")
    return signed, nodes, sets, staged(components(staged(more.unionByName(known))))


def count_links(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(node, links) of the members of each component, or pair of blocks of one: rows that are near the node."""
    for t in groups(batches, ["label", "lo", "hi"]):
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        block, copies = t["block"].to_numpy(), t["copies"].to_numpy()
        sets, size = _sets(t)
        left = np.arange(t.num_rows) if lo == hi else np.flatnonzero(block == lo)
        right = left if lo == hi else np.flatnonzero(block == hi)
        index, links = Postings([sets[i] for i in left]), np.zeros(t.num_rows, np.int64)
        for at, j in enumerate(right):
            near = index.overlaps(sets[j]) * (num + den) >= num * (size[left] + size[j])
            if lo == hi:
                near[at:] = False
            i = left[near]
            links[i] += copies[j]
            links[j] += copies[i].sum()
        yield pa.RecordBatch.from_arrays([t["node"].combine_chunks(), pa.array(links)], ["node", "links"])


def linked(nodes: DataFrame, sets: DataFrame, labels: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(node, links): for each node of a component, the rows of other nodes that are near it."""
    members = labels.join(nodes.select("node", "n", "copies"), "node")
    sizes = members.groupBy("label").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")))
    tasks = staged(dealt.select("node", "label", "copies", "block", pairs.alias("g")))
    full = sets.join(broadcast_if_small(tasks), "node").select("label", "node", "copies", "block", "shingles", F.inline("g"))
    full = full.select("label", "lo", "hi", "node", "copies", "block", "shingles").repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")
    return full.mapInArrow(lambda b: count_links(b, num, den), "node binary, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _classes(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, rep, copies, class_node, class_id)."""
    known = nodes.select("node", "rep", "copies").join(labels, "node", "left").withColumn("class_node", F.coalesce("label", "node")).drop("label")
    return known.join(known.groupBy("class_node").agg(F.min("rep").alias("class_id")), "class_node")


def jaccard_join(docs: DataFrame, num: int = THRESHOLD[0], den: int = THRESHOLD[1], block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, node, class_node, class_id, n_links): one row per row of ``docs``.

    ``n_links`` is the number of other rows with a Jaccard of at least num/den; ``class_node`` names the
    class; ``class_id`` is its least doc_id.
    """
    with scratch():
        signed, nodes, sets, labels = classified(docs, num, den, block_shingles)
        counted = linked(nodes, sets, labels, num, den, block_shingles)
        info = _classes(nodes, labels).join(counted, "node", "left")
        info = info.select("node", "class_node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        return staged(signed.select("doc_id", "node").join(info, "node"), keep=True)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the least doc_id (null last) stays.

    Rows that are equal in doc_id and text are one document, of which one row stays.
    """
    with scratch():
        signed, nodes, _, labels = classified(docs, *THRESHOLD, BLOCK_SHINGLES)
        joined = signed.select("doc_id", "node").join(_classes(nodes, labels), "node")
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
        firsts = joined.groupBy("class_node").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("_id"), F.col("o.node").alias("_node"))
        firsts = staged(firsts, keep=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), node_of(F.col("text")).alias("_node"))
    kept = rows.alias("r").join(firsts.alias("f"), (F.col("r._node") == F.col("f._node")) & F.col("r._id").eqNullSafe(F.col("f._id")), "left_semi")
    return kept.groupBy("_node", "_id").agg(F.first("_row").alias("_row")).select("_row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
