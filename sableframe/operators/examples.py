"""Training examples: deduplication, class balance, splits, interleaving, annotations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sableframe.functions.text import running


def dedup_first(rows: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each text."""
    return rows.groupBy(text).agg(F.min_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def undersample(rows: DataFrame, label: str, key: str, ratio: float = 1.5) -> DataFrame:
    """At most round(ratio) times the smallest class from each class that exceeds the ratio; rows in the order of the md5 of their key.

    Positions are counted in ranges of the md5 within each class, so no task orders a class. Rows without a label are left out.
    """
    labelled = rows.where(F.col(label).isNotNull())
    limit = class_limits(labelled.groupBy(label).agg(F.count("*").alias("_n")), "_n", ratio).select(label, "_limit")
    return numbered(labelled, key, "_at", label).drop("n_rows").join(limit, label).where("_at < _limit").drop("_at", "_limit")


def class_limits(sizes: DataFrame, n: str, ratio: float) -> DataFrame:
    """Adds ``_limit``: how many rows :func:`undersample` leaves of each class, of their sizes."""
    least = F.min(n).over(Window.partitionBy())  # one row per class
    return sizes.withColumn("_min", least).withColumn("_limit", F.when(F.col(n) / F.col("_min") > ratio, F.bround(F.lit(float(ratio))).cast("long") * F.col("_min")).otherwise(F.col(n))).drop("_min")


def oversample_plan(rows: DataFrame, label: str, ratio: float = 1.5) -> DataFrame:
    """Per class its size and how many variants each of its rows needs (0: it is large enough)."""
    return class_variants(rows.groupBy(label).agg(F.count("*").alias("n")), label, ratio)


def class_variants(sizes: DataFrame, label: str, ratio: float) -> DataFrame:
    """What :func:`oversample_plan` returns, of the classes and their sizes ``n``."""
    most = sizes.withColumn("most", F.max("n").over(Window.partitionBy()))  # one row per class
    factor = F.floor(F.bround(F.col("n") * (F.col("most") / F.col("n"))) / F.col("n")).cast("long") + 1
    return most.select(label, "n", F.when(F.col("most") / F.col("n") > ratio, factor).otherwise(F.lit(0)).cast("long").alias("num_aug"))


def split(rows: DataFrame, key: str, train: float = 0.7, val: float = 0.2) -> DataFrame:
    """Adds ``part``: train, val or test, by position in the order of the md5 of the key.

    Positions are those of :func:`numbered`, so no task orders all rows.
    """
    cut = lambda share: F.floor(F.col("n_rows") * F.lit(share)).cast("long")
    part = F.when(F.col("_at") < cut(float(train)), "train").when(F.col("_at") < cut(float(train + val)), "val").otherwise("test")
    return numbered(rows, key, "_at").withColumn("part", part).drop("_at", "n_rows")


def class_groups(examples: DataFrame) -> DataFrame:
    """(label, example_id): an example once per distinct label."""
    return examples.select("example_id", F.explode(F.array_distinct(F.transform("annots", lambda a: a["label"]))).alias("label"))


def groups_by_size(rows: DataFrame, label: str, order: str, descending: bool = True) -> DataFrame:
    """(label, n, first, place): classes in the order of their size, equal ones in the order in which they first occur. One row per class is ordered."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    size = F.desc("n") if descending else F.asc("n")
    return sizes.withColumn("place", (F.row_number().over(Window.partitionBy().orderBy(size, "first", label)) - 1).cast("int"))


def dataset_counts(parts: DataFrame, positive: Column) -> DataFrame:
    """(part, n_positive, n_negative): how many examples of each kind the parts of a dataset have."""
    return parts.withColumn("_yes", F.coalesce(positive, F.lit(False))).groupBy("part").agg(F.count_if("_yes").alias("n_positive"), F.count_if(~F.col("_yes")).alias("n_negative"))


def single_entity() -> Column:
    """Whether an example has exactly one distinct label."""
    return F.size(F.array_distinct(F.transform("annots", lambda a: a["label"]))) == 1


def contained_not_in(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Spans of ``inner`` that no span of ``outer`` of the same key contains."""
    within = (F.col(f"i.{key}") == F.col(f"o.{key}")) & (F.col("i.start") >= F.col("o.start")) & (F.col("i.end") <= F.col("o.end"))
    return inner.alias("i").join(outer.alias("o"), within, "left_anti")


def outside(inner: Column, outer: Column) -> Column:
    """Spans of an array that no span of another array of the same text contains."""
    return F.filter(inner, lambda i: ~F.exists(outer, lambda o: (i["start"] >= o["start"]) & (i["end"] <= o["end"])))


def unique_lines(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Lines that no longer line, or equal earlier one, of their key contains."""
    a, b = rows.alias("a"), rows.alias("b")
    first = (F.length(f"b.{text}") > F.length(f"a.{text}")) | ((F.length(f"b.{text}") == F.length(f"a.{text}")) & (F.col(f"b.{order}") < F.col(f"a.{order}")))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & first & F.contains(F.col(f"b.{text}"), F.col(f"a.{text}")), "left_anti")


def numbered(rows: DataFrame, key: str, at: str = "position", by: str | None = None) -> DataFrame:
    """Adds the position of each row (from 0) in the order of the md5 of its key, and ``n_rows``; within each value of ``by``, if given.

    Positions are counted within 4096 ranges of the md5, to which the sizes of the ranges before are added.
    """
    group = [by] if by else []
    keyed = rows.withColumn("_md5", F.md5(F.col(key).cast("string"))).withColumn("_range", F.substring("_md5", 1, 3))
    sizes = keyed.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.select(*group, "_range", before.alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias("n_rows"))
    within = F.row_number().over(Window.partitionBy(*group, "_range").orderBy("_md5", key)) - 1
    joined = keyed.withColumn(at, within).join(ranges if by else F.broadcast(ranges), [*group, "_range"])  # at most 4096 rows without ``by``
    return joined.withColumn(at, (F.col(at) + F.col("_before")).cast("long")).drop("_md5", "_range", "_before")


def interleaved(rows: DataFrame, key: str, is_first: Column) -> DataFrame:
    """Adds ``position``: the smaller of two parts spread evenly through the larger, each in the order of the md5 of its key.

    The i-th row of the smaller part (S rows) goes to round(i * (L + S) / S), half to even; rows of the larger part
    (L rows) take the places between. Both positions are formulas of the row's own rank, so there is no global sort and
    no join of the parts. Of equal parts the first counts as the smaller. One empty part leaves the other as it is.
    """
    flagged = rows.withColumn("_first", is_first)
    counts = flagged.agg(F.count_if("_first").alias("_a"), F.count_if(~F.col("_first")).alias("_b"))
    a, b = numbered(flagged.where("_first"), key, "_k"), numbered(flagged.where(~F.col("_first")), key, "_k")
    both = a.unionByName(b).drop("n_rows").crossJoin(F.broadcast(counts))  # one row of counts
    small = F.col("_first") == (F.col("_a") <= F.col("_b"))
    s, n, k = F.least("_a", "_b"), F.col("_a") + F.col("_b"), F.col("_k")
    place = lambda i: F.bround((i * n).cast("double") / s).cast("long")
    guess = F.floor((k + 0.5) * s / F.greatest("_a", "_b")).cast("long")
    earlier = F.greatest(guess - 2, F.lit(0))
    for d in range(-2, 4):
        i = guess + d
        earlier = earlier + F.when((i >= 0) & (i < s) & (place(i) - i <= k), 1).otherwise(0)
    at = F.when(small, place(k)).otherwise(F.when(s > 0, k + earlier).otherwise(k))
    return both.withColumn("position", at).drop("_first", "_k", "_a", "_b")


def _local(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """Rows of the driver as a table that needs no Python workers."""
    return spark.createDataFrame(pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(columns.items())}))


def balanced(examples: DataFrame, ratio: float = 1.5) -> DataFrame:
    """Examples (example_id, text, annots) balanced by class: those with one label over- then undersampled, the others appended.

    Classes that are too small are replaced by made-up variants of their examples; others stay as they are (variant 0).
    Returns example_id, variant, text, annots and label (null for examples of several labels or none).

    The classes are counted in a pass of its own, and one row per class goes to the driver. Which rows stay follows from these sizes and the ids: ids
    are ordered only where a class loses rows, and texts are neither shuffled nor joined. Examples of equal id stay or go together.
    """
    from sableframe.operators.synthetic import made, marked

    spark = examples.sparkSession
    # Not filtered by label: Spark moves such a filter to where the annotations come from and makes them twice.
    known = examples.withColumn("label", F.when(single_entity(), F.col("annots")[0]["label"]))
    sizes = [tuple(r) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect() if r["label"] is not None]
    classes = class_variants(_local(spark, sizes, label=pa.string(), n=pa.int64()), "label", ratio)
    plan = class_limits(classes.withColumn("_made", F.col("n") * F.greatest("num_aug", F.lit(1))), "_made", ratio).collect()
    planned = lambda how, rows, **more: known.join(F.broadcast(_local(spark, rows, label=pa.string(), num_aug=pa.int64(), **more)), "label", how)
    number = F.explode(F.when(F.col("num_aug") > 0, F.sequence(F.lit(1), F.col("num_aug").cast("int"))).otherwise(F.array(F.lit(0)))).alias("variant")
    key = F.concat_ws(":", "example_id", "variant")
    cut = [(r["label"], r["num_aug"], r["_limit"]) for r in plan if r["_limit"] < r["_made"]]
    last = {}
    if cut:
        keys = numbered(planned("inner", cut, most=pa.int64()).select("example_id", "label", "most", number).withColumn("_key", key), "_key", "_at", "label")
        last = {r["label"]: r["last"] for r in keys.where("_at < most").groupBy("label").agg(F.max(F.struct(F.md5("_key"), "_key")).alias("last")).collect()}
    lost = {r[0] for r in cut}
    every = [(r["label"], r["num_aug"], r["label"] in lost, *last.get(r["label"], (None, None))) for r in plan]
    rows = marked(planned("left", every, cut=pa.bool_(), last_md5=pa.string(), last_key=pa.string()), F.coalesce(F.col("num_aug") > 0, F.lit(False)))
    rows = rows.select("example_id", number, "text", "annots", "label", "cut", "last_md5", "last_key", "_m", "_s")
    if cut:
        md5 = F.md5(key)
        stays = (md5 < F.col("last_md5")) | ((md5 == F.col("last_md5")) & (key <= F.col("last_key")))
        rows = rows.where(~F.coalesce("cut", F.lit(False)) | F.coalesce(stays, F.lit(False)))
    own = F.col("variant") == 0
    new = lambda c: F.when(own, F.col(c)).otherwise(F.col(f"made.{c}")).alias(c)
    return rows.withColumn("made", made()).select("example_id", "variant", new("text"), new("annots"), "label")


def dataset(examples: DataFrame, key: str = "example_id", train: float = 0.7, val: float = 0.2) -> DataFrame:
    """Examples with ``part`` and, within train, ``position``: positives and negatives are split apart, train interleaves them."""
    has = F.size("annots") > 0
    parts = split(examples.where(has), key, train, val).unionByName(split(examples.where(~has), key, train, val))
    mixed = interleaved(parts.where("part = 'train'"), key, has)
    return mixed.unionByName(parts.where("part <> 'train'").withColumn("position", F.lit(None).cast("long")))


def token_offsets(tokens: Column) -> Column:
    """(start, end) of tokens in their text joined by single spaces."""
    at = running(F.transform(tokens, lambda t: F.length(t) + 1))
    return F.zip_with(tokens, at, lambda t, n: F.struct(n.alias("start"), (n + F.length(t)).alias("end")))


def bio_examples(rows: DataFrame, names: list[str], outside: int = 4) -> DataFrame:
    """(example_id, text, annots) of tokenised rows (example_id, tokens, labels): one annotation per token whose label is not ``outside``."""
    label = F.array(*map(F.lit, names))
    spans = F.arrays_zip(token_offsets(F.col("tokens")).alias("at"), F.col("labels").alias("tag"))
    kept = F.filter(spans, lambda z: z["tag"] != outside)
    annots = F.transform(kept, lambda z: F.struct(z["at"]["start"].alias("start"), z["at"]["end"].alias("end"), F.get(label, z["tag"]).alias("label")))
    return rows.select("example_id", F.array_join("tokens", " ").alias("text"), annots.alias("annots"))


def expanded(text: Column, annots: Column) -> Column:
    """Annotations widened to the edges of the tokens they touch; those that touch none (blank, empty or outside) are dropped."""
    token = r"[\p{L}\p{M}\p{N}_]"

    def widen(a: Column) -> Column:
        size = F.length(text)
        inner = F.substring(text, a["start"] + 1, a["end"] - a["start"])
        lead = F.length(F.regexp_extract(inner, r"(?U)^\s*", 0))
        trail = F.length(F.regexp_extract(inner, r"(?U)\s*$", 0))
        start, end = a["start"] + lead, a["end"] - trail
        left = F.length(F.regexp_extract(F.substring(text, F.lit(1), start), token + "*$", 0))
        right = F.length(F.regexp_extract(F.substring(text, end + 1, size), "^" + token + "*", 0))
        opens = F.substring(text, start + 1, F.lit(1)).rlike(token)
        closes = F.substring(text, end, F.lit(1)).rlike(token)
        ok = (a["start"] >= 0) & (a["end"] <= size) & (start < end)
        return F.when(ok, F.struct((start - F.when(opens, left).otherwise(0)).alias("start"), (end + F.when(closes, right).otherwise(0)).alias("end"), a["label"].alias("label")))

    return F.filter(F.transform(annots, widen), lambda a: a.isNotNull())


def unknown_tokens(tokens: Column, unknown: str = "[UNK]") -> Column:
    """Positions (from 0) of tokens that the vocabulary lacks."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(t == unknown, i)), lambda i: i.isNotNull())


def sentences(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent, start, end, sentence): texts cut after . ! or ? before a blank, without the blanks around; blank ones are left out."""
    pieces = F.split(F.regexp_replace(F.col(text), r"([.!?])(\s)", "$1\u0001$2"), "\u0001", -1)
    cut = rows.select(key, F.posexplode(pieces).alias("sent", "_p"))
    before = F.coalesce(F.sum(F.length("_p")).over(Window.partitionBy(key).orderBy("sent").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    said = F.regexp_replace("_p", r"^\s+|\s+$", "")
    lead = F.length("_p") - F.length(F.regexp_replace("_p", r"^\s+", ""))
    # Blank ones are told by the piece: a condition on the sentence would trim every piece twice.
    placed = cut.withColumn("start", (before + lead).cast("int")).withColumn("sentence", said).where(F.col("_p").rlike(r"\S"))
    return placed.select(key, "sent", "start", (F.col("start") + F.length("sentence")).alias("end"), "sentence")


def keyword_sentences(rows: DataFrame, key: str, text: str, keywords: list[str]) -> DataFrame:
    """Sentences of the texts that contain one of the keywords anywhere."""
    some = F.lit(False)
    for k in keywords:
        some = some | F.contains(F.col(text), F.lit(k))
    return sentences(rows.where(some), key, text)


def sentence_examples(sents: DataFrame, spans: DataFrame, key: str, keep_trailing: bool = True) -> DataFrame:
    """(key, sent, start, end, annots): spans (key, start, end, label) with the sentences that hold them, offsets from the sentence.

    Sentences that one span crosses become one. Sentences without spans have none; ``keep_trailing=False`` leaves out
    those after the last span of their text. Ranges are compared under equal keys, which all steps share as their partitioning.
    """
    w = Window.partitionBy(key).orderBy("start")
    ordered = sents.select(key, "sent", "start", "end").withColumn("_prev", F.lag("end").over(w))
    crosses = (F.col("s.start") < F.col("o._prev")) & (F.col("s.end") > F.col("o._prev")) & (F.col(f"s.{key}") == F.col(f"o.{key}"))
    joined = ordered.alias("o").join(spans.alias("s"), crosses, "left_semi").select(key, "sent", F.lit(0).alias("_new"))
    islands = ordered.join(joined, [key, "sent"], "left").withColumn("_island", F.sum(F.coalesce("_new", F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy(key, "_island").agg(F.min("sent").alias("sent"), F.min("start").alias("start"), F.max("end").alias("end"))
    inside = (F.col(f"s.{key}") == F.col(f"w.{key}")) & (F.col("s.start") >= F.col("w.start")) & (F.col("s.end") <= F.col("w.end"))
    held = whole.alias("w").join(spans.alias("s"), inside, "left")
    one = F.struct((F.col("s.start") - F.col("w.start")).alias("start"), (F.col("s.end") - F.col("w.start")).alias("end"), F.col("s.label").alias("label"))
    out = held.groupBy(f"w.{key}", "w.sent").agg(F.first("w.start").alias("start"), F.first("w.end").alias("end"), F.array_sort(F.collect_list(F.when(F.col("s.label").isNotNull(), one))).alias("annots"))
    if keep_trailing:
        return out
    last = F.max(F.when(F.size("annots") > 0, F.col("start"))).over(Window.partitionBy(key))
    return out.withColumn("_last", last).where("start <= _last").drop("_last")
