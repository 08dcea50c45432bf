"""Top candidates by cosine, and acronym relations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sableframe.functions.text import cosine, pseudonym

THRESHOLD, MOST_CANDIDATES = 0.95, 10_000


def top_candidate(rows: DataFrame, candidates: DataFrame, vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Each row's best candidate (cand_id, cand_vector) with a cosine strictly above the threshold; of equals the least id.

    Candidates may have a second vector, ``cand_other`` (a long and its short form; null: none): the better of the two counts.
    Candidates are a short list (stop names, a document's known names): their number is checked, and a longer
    list is an error rather than a broadcast of unknown size.
    """
    if candidates.limit(MOST_CANDIDATES + 1).count() > MOST_CANDIDATES:
        raise ValueError("too many candidates for a comparison with every row")
    pairs = "cand_other" in candidates.columns
    listed = F.broadcast(candidates.agg(F.array_sort(F.collect_list(F.struct("cand_id", "cand_vector", *["cand_other"] * pairs))).alias("_all")))
    like = lambda c: cosine(F.col(vector), c["cand_vector"])
    best_like = (lambda c: F.greatest(like(c), cosine(F.col(vector), c["cand_other"]))) if pairs else like
    scored = F.transform("_all", lambda c: F.struct(best_like(c).alias("score"), (-c["cand_id"]).alias("neg")))
    best = rows.crossJoin(listed).withColumn("_best", F.array_max(scored))
    return best.select(*rows.columns, F.when(F.col("_best.score") > threshold, -F.col("_best.neg")).alias("best_id"), F.round("_best.score", 6).alias("score"))


def acronym_relations(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, long, short) from tagged tokens (key, ord, tag, text, tok_start, tok_end, sent): a long form and the short form that follows within two tokens, in its sentence or with its initials."""

    def walk(t: pd.DataFrame) -> pd.DataFrame:
        out, words, end, sent = [], [], None, None
        for r in t.sort_values("ord").itertuples():
            near = end is not None and r.tok_start - end <= 2
            if r.tag in ("B-long", "I-long"):
                words = [*words, r.text] if words and (r.tag == "I-long" or near) else [r.text]
                end, sent = r.tok_end, r.sent
            elif r.tag == "B-short" and words and near:
                initials = "".join(c for c in "".join(w[:1].upper() for w in words) if c.isalnum() or c == "_")
                if initials == r.text.upper() or r.sent == sent:
                    out.append((getattr(r, key), " ".join(words), r.text))
                words, end = [], None
        return pd.DataFrame(out, columns=[key, "long", "short"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.groupBy(key).applyInPandas(walk, f"{key} {kind}, long string, short string")


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def canonical_names(ents: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``canonical``: the first name of the document that is like this one, or like a name related to it, else the name itself.

    ``ents`` has the key, ``start``, ``ent``, its ``vector``, and ``partners``, the vectors of the other members of its
    acronym relations (null or empty: none). A name that was given a canonical form is not itself a form for later
    ones. That depends on all names before, so a document's names are one group; its distinct names are what grows.
    """

    def unit(v) -> np.ndarray:
        a = np.asarray(v, dtype="float64")
        size = np.linalg.norm(a)
        return a / size if size else a

    def walk(t: pd.DataFrame) -> pd.DataFrame:
        forms: dict[str, str] = {}
        names, known, out = [], [], []
        for r in t.sort_values(["start", "ent"]).itertuples():
            if r.ent not in forms:
                asked = [unit(v) for v in [r.vector, *(r.partners if r.partners is not None else [])] if v is not None]
                like = np.max(np.stack(known) @ np.stack(asked).T, axis=1) > threshold if known and asked else np.zeros(0, bool)
                if like.any():
                    forms[r.ent] = names[int(np.argmax(like))]
                else:
                    forms[r.ent] = r.ent
                    if r.vector is not None:
                        names.append(r.ent)
                        known.append(unit(r.vector))
            out.append((getattr(r, key), r.start, r.ent, forms[r.ent]))
        return pd.DataFrame(out, columns=[key, "start", "ent", "canonical"])

    kinds = {c: ents.schema[c].dataType.simpleString() for c in (key, "start")}
    return ents.select(key, "start", "ent", "vector", "partners").groupBy(key).applyInPandas(walk, f"{key} {kinds[key]}, start {kinds['start']}, ent string, canonical string")


def organisation_pseudonyms(ents: DataFrame, relations: DataFrame, stops: DataFrame, key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(key, start, ent, canonical, ordinal, new_val): the stand-ins of organisations, where names that mean the same share one.

    ``ents`` (key, start, ent, vector), ``relations`` (key, long, short) and ``stops`` (cand_id, cand_vector), a short list of names that are no organisation
    of a document: what is as like to one of them as ``threshold`` is left out. A name takes the form of the first earlier name that is like it, or like a
    name it is related to; forms are numbered in the order in which they first occur.
    """
    kept = top_candidate(ents.select(key, "start", "ent", "vector"), stops, "vector", threshold).where("best_id IS NULL").drop("best_id", "score")
    both = relations.select(key, F.col("long").alias("ent"), F.col("short").alias("other")).unionByName(relations.select(key, F.col("short").alias("ent"), F.col("long").alias("other")))
    known = kept.groupBy(key, F.col("ent").alias("other")).agg(F.min_by("vector", "start").alias("_v"))
    partners = both.distinct().join(known, [key, "other"]).groupBy(key, "ent").agg(F.transform(F.array_sort(F.collect_list(F.struct("other", "_v"))), lambda p: p["_v"]).alias("partners"))
    named = canonical_names(kept.join(partners, [key, "ent"], "left"), key, threshold)
    first = named.groupBy(key, "canonical").agg(F.min("start").alias("_first"))
    order = first.withColumn("ordinal", (F.row_number().over(Window.partitionBy(key).orderBy("_first", "canonical")) - 1).cast("int"))
    return named.join(order.drop("_first"), [key, "canonical"]).withColumn("new_val", pseudonym(F.lit("ORG"), F.col("ordinal"))).select(key, "start", "ent", "canonical", "ordinal", "new_val")
