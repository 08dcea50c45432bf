"""Document fingerprints by threshold-scaled sketches (DataFrame functions only).

A sketch holds every hash of a document's five-word shingles that lies in the lowest 1/``scale`` of the
hash range, ascending; a text with words of which none lies there is marked by its least hash. All texts
share one threshold, so sketches of a text's parts merge by union and the containment of a short document
in a long one can be estimated from two sketches.

Documents follow each other by doc_id (null last), then by a hash of the text, then by the text. For that
they are dealt into ranges of about ``RANGE_CHARS`` of text: a range that is heavier is cut by id into
even parts, one of a single id by hash, one of equal rows by row, until none is heavier than twice that.
There is no greatest number of ranges. The first row of each range is passed on to the one before.

Defined results: a null text is empty. A text of one to four words is one shingle; a text without words
has an empty sketch, whose likeness is 1 to an empty sketch and 0 to any other. Equal texts have equal
fingerprints. Rows with equal doc_ids follow each other in the order of their texts' hashes; null ids come last.
An empty table gives no rows; a single document's next document is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sableframe.llm.staging import broadcast_if_small, staged
from sableframe.llm.tables import let, table, words

SHINGLE, SCALE = 5, 2
#: Characters of a range of documents that are ordered together, and about how many ranges a task takes.
RANGE_CHARS, RANGES_OF_TASK = 16_000_000, 2
_MOST_CUTS = 24


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Distinct hashes of all ``n``-word shingles of a text."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))

    def cut(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(n)]))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= n, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(none)

    return F.array_distinct(let(hashed, cut))


def _retained(hashes: Column, scale: int) -> Column:
    """The hashes below the threshold, ascending, or else the least."""
    below = -(2**63) + 2**64 // scale - 1
    least = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(hashes)
    return let(F.filter(hashes, lambda x: x <= below), lambda low: F.when(F.size(low) > 0, F.array_sort(low)).otherwise(least))


def sketch(text: Column, scale: int = SCALE, n: int = SHINGLE) -> Column:
    """Array of the retained hashes."""
    return let(shingle_hashes(text, n), lambda h: _retained(h, scale))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sketches."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 if ``a`` has no words."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of all shingles of both."""
    return let(F.array_union(a, b), lambda u: _retained(u, scale))


def printed(s: Column, scale: int = SCALE) -> Column:
    """The sketch as a string: the scale and the hashes in hexadecimal."""
    return F.concat(F.lit(f"{scale}:"), F.array_join(F.transform(s, F.hex), ","))


def _dealt(rows: DataFrame, cuts: list[DataFrame]) -> DataFrame:
    """Adds ``_path`` to rows with doc_id and _h: the numbers of their parts at each cut, which sort as the rows do."""
    at = rows.withColumn("_path", F.array(F.when(F.col("doc_id").isNull(), 1).otherwise(0).cast("long")))
    for cut in cuts:
        value = F.when(F.col("_by") == "id", F.col("doc_id").cast("double")).otherwise(F.col("_h").cast("double"))
        even = F.least(F.floor((value - F.col("_lo")) / F.col("_width")), F.col("_parts") - 1)
        part = F.when(F.col("_by") == "row", F.pmod(F.monotonically_increasing_id(), F.col("_parts"))).otherwise(even).cast("long")
        path = F.when(F.col("_by").isNull(), F.col("_path")).otherwise(F.concat("_path", F.array(part)))
        at = at.join(broadcast_if_small(cut.withColumnRenamed("_path", "_of")), F.col("_path") == F.col("_of"), "left").withColumn("_path", path).drop("_of", "_by", "_lo", "_width", "_parts")
    return at


def ranges(docs: DataFrame, chars: int = RANGE_CHARS) -> tuple[list[DataFrame], DataFrame]:
    """(cuts, paths): the cuts that deal ``docs`` (doc_id, text, _h) into ranges, and each range's path with its first id and hash."""
    keys = staged(docs.select("doc_id", "_h", (F.length("text") + 64).cast("long").alias("_weight")))
    cuts: list[DataFrame] = []
    parts = F.ceil(F.col("_w") / chars).cast("long")
    while True:
        sides = [f(c).alias(n) for c, n in (("doc_id", "id"), ("_h", "h")) for f, n in ((F.min, n + "_lo"), (F.max, n + "_hi"))]
        sums = staged(_dealt(keys, cuts).groupBy("_path").agg(F.sum("_weight").alias("_w"), F.count("*").alias("_n"), F.min(F.struct("doc_id", "_h")).alias("_first"), *sides))
        by = F.when(F.col("id_lo") < F.col("id_hi"), "id").when(F.col("h_lo") < F.col("h_hi"), "h")
        heavy = sums.where(F.col("_w") > 2 * chars).withColumns({"_by": by, "_parts": parts})
        uneven = heavy.where("_by IS NOT NULL")
        if len(cuts) == _MOST_CUTS or not uneven.limit(1).count():
            break
        side = lambda end: F.when(F.col("_by") == "id", F.col(f"id_{end}")).otherwise(F.col(f"h_{end}")).cast("double")
        width = F.greatest((side("hi") - side("lo")) / F.col("_parts") * (1 + 1e-12), F.lit(1e-300))
        cuts.append(staged(uneven.withColumns({"_lo": side("lo"), "_width": width}).select("_path", "_by", "_lo", "_width", "_parts")))
    # Equal rows are dealt over parts by turns; the first row of each part is like any other.
    equal = heavy.where("_by IS NULL AND _n > 1").select("_path", F.lit("row").alias("_by"), F.lit(0.0).alias("_lo"), F.lit(1.0).alias("_width"), F.least("_parts", "_n").alias("_parts"))
    cuts.append(staged(equal))
    known = sums.join(broadcast_if_small(cuts[-1].select("_path", "_parts")), "_path", "left")
    every = F.when(F.col("_parts").isNull(), F.array("_path")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1), lambda i: F.concat("_path", F.array(i))))
    return cuts, known.select(F.explode(every).alias("_path"), F.col("_first.doc_id").alias("_id"), F.col("_first._h").alias("_hash"))


def with_next(docs: DataFrame, chars: int = RANGE_CHARS) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): the next row's are the first row's at the last row.

    Texts are shuffled once, and sketched where they have arrived. The list of ranges, one row for each, is ordered in one task.
    """
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    cuts, paths = ranges(hashed, chars)
    order = Window.orderBy("_path")
    following = F.struct("_id", "_hash")
    heads = staged(paths.withColumn("_f", F.coalesce(F.lead(following).over(order), F.first(following).over(order))))
    firsts = heads.select(F.col("_path").alias("_before"), F.col("_f._id").alias("_id"), F.col("_f._hash").alias("_hash"))
    first = (
        hashed.join(broadcast_if_small(staged(firsts)), (F.col("_h") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        .groupBy("_before")
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("_h"), F.col("_before").alias("_path"), F.lit(1).alias("_end"))
    )
    both = _dealt(hashed, cuts).withColumn("_end", F.lit(0)).unionByName(first)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-heads.count() // RANGES_OF_TASK))
    w = Window.partitionBy("_path").orderBy("_end", "doc_id", "_h", "text")
    ordered = both.repartition(tasks, "_path").withColumn("next_text", F.lead("text").over(w)).withColumn("sketch", sketch(F.col("text")))
    return ordered.withColumn("next_sketch", F.lead("sketch").over(w)).where("_end = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next document's beginning."""
    near = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 4) as int))"), F.substring(F.col("next_text"), F.lit(1), tail))
    made = near.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    made = made.withColumn("edited_sketch", sketch(F.col("edited")))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
