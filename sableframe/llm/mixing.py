"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a hash of 36 bits. Words are summed by source and the first 12 bits; the bucket in
which a source's budget ends is refined by the next 12 bits, and that one by the last 12. The result is
one threshold per source, and choosing documents is a filter ``hash < threshold``: nothing is sorted.
Budgets nest: a larger budget keeps every document of a smaller one.

Targets: all words are shared by weight; a target stops at ``most`` times its source's words and the
excess is shared again by weight until no target is above. A target of several times a source takes
every document whole that many times, and the threshold chooses those that are taken once more.

Defined results: a null text has 0 words; a null source is a source of its own, ordered last. The hash is
of the doc_id and the text, so rows with null or equal ids are chosen one by one unless their texts are equal
too: those are taken or left together. At the
threshold, the last hash value is taken if that ends nearer to the target. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sableframe.llm.staging import broadcast_if_small, staged
from sableframe.llm.tables import WORD, key, table, word_count

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix"
LEVELS, BITS = 3, 12


def doc_hash(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """36 bits of the md5 of a seed, an id and the md5 of a text, as a long."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(said), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, size): one row per source.

    The ranking and the cumulative sums run in one task over one row per source, after the words are summed.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    order = Window.orderBy("_limit", "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("weight", weight)
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_limit", F.col("_cap") / F.col("weight"))
        .withColumn("_left", F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_rate", F.col("_left") / F.sum("weight").over(after))
        .withColumn("_first", F.min(F.when(F.col("_rate") <= F.col("_limit"), F.struct("_limit", "_rank", "_rate"))).over(everything))
    )
    return filled.select("source", "source_size", "weight", F.coalesce(F.least("_cap", F.col("_first._rate") * F.col("weight")), F.lit(0.0)).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``copies`` (whole takes) and ``below`` (documents of a lesser hash are taken once more).

    ``sizes`` has source, size and hash; it is scanned once per level, from the second on only within
    the bucket in which the source's budget ends.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("_key", key("source")).withColumn("copies", copies)
    plan = plan.withColumn("_rest", F.col("target") - F.col("copies") * F.col("source_size"))
    edge = plan.select("_key", F.col("_rest"), F.lit(0).cast("long").alias("_prefix"))
    rows = sizes.select(key("source").alias("_key"), "size", "hash")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        at = rows.withColumn("_bucket", F.shiftright("hash", shift)).groupBy("_key", "_bucket").agg(F.sum("size").alias("_words"))
        inside = at.join(edge, "_key").where(F.shiftright("_bucket", BITS) == F.col("_prefix"))
        run = F.sum("_words").over(Window.partitionBy("_key").orderBy("_bucket"))
        crossing = inside.withColumn("_run", run).where(F.col("_run") > F.col("_rest"))
        first = crossing.groupBy("_key").agg(F.min(F.struct("_bucket", "_run", "_words", "_rest")).alias("_e"))
        edge = staged(first.select("_key", (F.col("_e._rest") - (F.col("_e._run") - F.col("_e._words"))).alias("_rest"), F.col("_e._bucket").alias("_prefix"), F.col("_e._words").alias("_words")))
        last = edge
        if level < LEVELS:
            edge = edge.drop("_words")
            rows = rows.join(broadcast_if_small(edge.select("_key", F.col("_prefix").alias("_kept"))), "_key").where(F.shiftright("hash", shift) == F.col("_kept")).select("_key", "size", "hash")
    nearer = F.col("_words") - F.col("_rest") < F.col("_rest")
    cut = last.select("_key", (F.col("_prefix") + F.when(nearer, 1).otherwise(0)).alias("below"))
    return plan.join(cut, "_key", "left").select("_key", "source", "source_size", "weight", "target", "copies", F.coalesce("below", F.lit(0)).cast("long").alias("below"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> tuple[DataFrame, DataFrame]:
    """(plan, sizes): one row per source, and (doc_id, source, size, hash) per document, both staged."""
    sizes = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), F.col("text")).alias("hash")))
    return staged(thresholds(sizes, staged(source_targets(sizes, weights, most)))), sizes


def times_taken(hashed: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``times``: how often the mix takes each row of ``hashed`` (with source and hash)."""
    small = plan.select("_key", "source_size", "target", "copies", "below")
    found = hashed.withColumn("_key", key("source")).join(broadcast_if_small(small), "_key")
    return found.withColumn("times", F.col("copies") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)).drop("_key", "copies", "below")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Words are counted once; the final pass reads whole rows and filters by hash.
    """
    plan, _ = mix_plan(docs, weights, most)
    bare = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    hashed = bare.select("_row", F.col("_row.source").alias("source"), doc_hash(F.col("_row.doc_id"), F.col("_row.text")).alias("hash"))
    taken = times_taken(hashed, plan).where("times > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("_row.*")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    plan, sizes = mix_plan(table(spark, sf_dir, "documents"))
    return times_taken(sizes, plan).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def oracle(documents: str = "documents") -> str:
    """DuckDB SQL for :func:`op8_mix_sources`, by sorting hashes and cumulative sums."""
    return f"""
    WITH d AS (
      SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
        ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, {LEVELS * BITS // 4}))::BIGINT AS h
      FROM {documents}),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
    w AS (SELECT *, ([{', '.join(f'{float(w)}::DOUBLE' for w in WEIGHTS)}])[(rk % {len(WEIGHTS)} + 1)::INT] AS weight, {float(MOST)}::DOUBLE * source_size AS cap FROM r),
    f AS (
      SELECT *, cap / weight AS lim,
        ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w),
    t AS (
      SELECT source, source_size, coalesce(least(cap, weight * (SELECT rate FROM f WHERE rate <= lim ORDER BY lim, rk LIMIT 1)), 0) AS target FROM f),
    p AS (SELECT *, (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS copies FROM t),
    g AS (SELECT d.source, d.h, sum(d.size) AS words FROM d GROUP BY d.source, d.h),
    c AS (
      SELECT g.*, p.target - p.copies * p.source_size AS rest, sum(g.words) OVER (PARTITION BY g.source ORDER BY g.h) AS run
      FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source),
    e AS (SELECT source, min(h) AS h FROM c WHERE run > rest GROUP BY source),
    b AS (
      SELECT c.source, c.h + CASE WHEN c.run - c.rest < c.rest - (c.run - c.words) THEN 1 ELSE 0 END AS below
      FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source AND c.h = e.h)
    SELECT d.doc_id, d.size, p.source_size, p.target,
      (d.size * (p.copies + CASE WHEN d.h < coalesce(b.below, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source"""
