"""Main text of web pages: block structure and a suffix array per host.

Each page is cut into blocks of text, and every block lies in one of four zones: *main* (inside an
``article``, or else ``main``, element), *marked* (inside it too, but within an element that a class or id
sets apart from plain prose), *furniture* (inside navigation, headers, footers, sidebars, forms, notices,
adverts and reader comments, known by their elements and roles, or by names that say nothing else) or
*open* (the rest). The token streams of a host's pages outside plain prose are concatenated, a suffix array over them
is built by prefix doubling, and every run of ``RUN`` or more tokens that distinct pages share is
covered. Covered runs are boilerplate and are taken out: from the open zone, whose unique runs are the
text of pages without a main zone, if two pages share them; from marked blocks of articles if
``MARKED_PAGES`` pages or more and at least half of the host's do.

Plain prose of an article is exempt from covering: articles repeat each other's passages (copies,
quotations), which belong to the text. An element whose name only contains a furniture word
(``related-work``) is not furniture by that alone; its repetition decides.

A host of many tokens is cut into shards of pages; each shard's suffix array yields its classes of
equal runs with their number of pages, and sums over the shards find runs whose pages lie in several.

Defined results: null or empty html gives an empty text. Repeated rows are pages of their own. A null
url is a host of its own. Scripts, styles, templates and hidden elements have no text. ``br`` is white
space. Unclosed elements end with their parent. Furniture inside a paragraph is left out and does not break it.
An empty table gives no rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sableframe.llm.staging import broadcast_if_small, staged
from sableframe.llm.tables import table
from sableframe.llm.text_kernels import lean

RUN, SHARD_TOKENS, MARKED_PAGES = 8, 60_000, 3
FURNITURE, OPEN, MAIN, MARKED = 0, 1, 2, 3

# Element names of the HTML standard by their role here, and usual class names of furniture.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"head", "script", "style", "template", "noscript", "iframe", "object", "svg", "math", "canvas", "audio", "video", "textarea", "title", "select", "datalist", "option", "xmp", "noembed", "noframes"}
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "header"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "meter",
    "output", "progress", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "toolbar"}
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
    "footer", "gdpr", "header", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo",
    "related", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toc", "toolbar", "widget",
}
# Words of class names that say what kind of container an element is, not what it holds.
NEUTRAL = {
    "area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "fixed", "group", "inner", "item", "items", "js", "left", "link", "links", "list", "main", "mobile", "outer",
    "page", "panel", "primary", "right", "row", "secondary", "section", "site", "small", "sticky", "text", "top", "unit", "wrap", "wrapper",
}
_WHOLE = {"html", "body", "article", "main"}
_CLOSES = {  # start tags that end an open element of these kinds
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTR.finditer(text)))}


def _zone(name: str, attributes: str, parent: int, in_main: bool) -> int | None:
    """Zone that an element gives its content; None if it has no text at all."""
    if name in SILENT:
        return None
    a = _attributes(attributes) if attributes.strip() else {}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()):
        return None
    role = a.get("role", "").lower()
    if name in ASIDE or role in ROLES:
        return FURNITURE
    named, marked = _named(a) if name not in _WHOLE and role not in ("main", "article") else (False, False)
    if named or parent == FURNITURE:
        return FURNITURE
    if in_main or name == "article" or name == "main" or role in ("main", "article"):
        return MARKED if in_main and (parent == MARKED or (marked and name not in INLINE)) else MAIN
    return parent


def _named(attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether a class or the id names furniture and nothing else, and whether there is a class or id at all."""
    given = [*attributes.get("class", "").lower().split(), attributes.get("id", "").lower()]
    for one in given:
        parts = [p for p in _SPLIT.split(one) if p and not p.isdigit()]
        if parts and NAMES & set(parts) and all(p in NAMES or p in NEUTRAL for p in parts):
            return True, True
    return False, any(given)


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block with text, in page order. White space is collapsed."""
    if not page:
        return []
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    # Open elements with their zones and, for an inline element of another zone, the text before it.
    stack: list[tuple[str, int | None, list[str] | None]] = [("", OPEN, None)]
    opened: Counter[str] = Counter()
    at, size, zone = 0, len(page), OPEN
    strength: list[int] = []

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append((zone, text))
                strength.append(2 if opened["article"] else 1 if opened["main"] else 0)

    def close(k: int) -> None:
        nonlocal zone
        while len(stack) > k:
            name, _, before = stack.pop()
            if before is not None or name not in INLINE:
                flush()
            opened[name] -= 1
            zone = stack[-1][1]
            parts[:0] = before or []

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and zone is not None:
            parts.append(entities.unescape(page[at:lt]))
        if lt == size:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            if zone is not None:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name, attributes = (m[1] or m[3]).lower(), m[2] or m[4] or ""
        if page[lt + 1] == "/":
            if name not in INLINE:
                flush()
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
            continue
        if name == "br":
            if zone is not None:
                parts.append(" ")
            continue
        if name in VOID:
            if name not in INLINE and zone is not None:
                flush()
            continue
        if name not in INLINE:
            flush()
            # A block start ends an open paragraph; list items and cells end their like.
            for i in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
            for i in range(len(stack) - 1, 0, -1) if any(opened[n] for n in _CLOSES.get(name, ())) else ():
                if stack[i][0] in _SCOPES.get(name, ()) or name not in _CLOSES:
                    break
                if stack[i][0] in _CLOSES[name]:
                    close(i)
                    break
        if attributes.endswith("/") and name in ("svg", "path"):
            continue
        if zone is None:
            inner = None
        else:
            inner = _zone(name, attributes, zone, zone in (MAIN, MARKED))
            # A heading stands even in an article's own header.
            if inner == FURNITURE and name in HEADINGS and stack[-1][0] == "header" and opened["article"] + opened["main"] > 0 and not any(opened[n] for n in ASIDE if n != "header"):
                inner = MAIN
        if name in RAW:
            end = re.compile(f"</{name}[\\s/>]", re.IGNORECASE).search(page, at)
            if inner is not None and zone is not None:
                parts.append(entities.unescape(page[at : end.start() if end else size]))
            if not end:
                break
            at = page.find(">", end.start()) + 1 or size
            continue
        apart = name in INLINE and inner is not None and inner != zone
        stack.append((name, inner, parts.copy() if apart else None))
        if apart:
            parts.clear()
        zone = inner
        opened[name] += 1
    close(1)
    flush()
    inside = [s for s, (z, _) in zip(strength, out, strict=True) if z in (MAIN, MARKED)]
    if inside:  # articles outrank a main element around them
        out = [(OPEN if z in (MAIN, MARKED) and s < max(inside) else z, t) for s, (z, t) in zip(strength, out, strict=True)]
    return out


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower()).split("/")[0].split("?")[0].split("#")[0].split("@")[-1]


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, zones, texts, n_outside): the blocks of every page and the number of tokens outside the main zone."""
    kind = "page_id long, url string, host string, zones array<int>, texts array<string>, n_outside long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [blocks(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([host_of(u.as_py()) for u in part.column(1)]), pa.array([[z for z, _ in x] for x in found], pa.list_(pa.int32())),
                        pa.array([[t for _, t in x] for x in found], pa.list_(pa.string())), pa.array([sum(len(t.split()) for z, t in x if z != MAIN) for x in found], pa.int64()),
                    ], ["page_id", "url", "host", "zones", "texts", "n_outside"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(parse, kind)


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes ordered by their first ``depth`` tokens or more, equal ones with equal rank."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    span = 1
    while span < depth:
        step = min(span, depth - span)
        ahead = np.zeros_like(rank)
        ahead[: len(rank) - step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
        span += step
    return np.argsort(rank, kind="stable"), rank


def shared_runs(pages: list[list[str]], run: int = RUN) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(hash, distinct pages, [(page, place)]) of each class of equal ``run``-token substrings, in suffix order."""
    ids: dict[str, int] = {}
    stream, owner, place = [], [], []
    for k, tokens in enumerate(pages):
        stream += [ids.setdefault(t, len(ids)) for t in tokens]
        stream.append(-1 - k)  # no run passes a page's end
        owner += [k] * (len(tokens) + 1)
        place += range(len(tokens) + 1)
    if not stream:
        return []
    order, rank = suffix_array(np.array(stream, np.int64), run)
    owner_, place_, length = np.array(owner), np.array(place), np.array([len(p) for p in pages])
    order = order[place_[order] + run <= length[owner_[order]]]
    if not len(order):
        return []
    cuts = np.flatnonzero(np.diff(rank[order], prepend=-1))
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        at = order[a:b]
        first = pages[owner_[at[0]]][place_[at[0]] : place_[at[0]] + run]
        h = xxhash.xxh3_64_intdigest("\n".join(first).encode("utf-8", "surrogatepass"))
        out.append((h - (1 << 64) if h >> 63 else h, len(np.unique(owner_[at])), list(zip(owner_[at].tolist(), place_[at].tolist(), strict=True))))
    return out


def covered_runs(pages: DataFrame, run: int = RUN, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(row, places): where runs begin, outside plain prose, that distinct pages of the host share, and whether ``many`` do."""
    hosts = staged(pages.groupBy("host").agg(F.ceil(F.sum("n_outside") / shard_tokens).cast("int").alias("shards"), F.count("*").alias("host_pages")))
    outside = F.filter("texts", lambda t, i: F.element_at("zones", i + 1) != MAIN)
    dealt = pages.where(F.col("n_outside") >= run).select("host", "row", outside.alias("texts")).join(broadcast_if_small(hosts.select("host", "shards")), "host")
    dealt = dealt.withColumn("shard", F.pmod(F.hash("row"), "shards"))

    def scan(t: pa.Table) -> pa.Table:
        rows, several = t["row"].to_pylist(), t["shards"][0].as_py() > 1
        tokens = [[w for x in texts for w in x.split()] for texts in t["texts"].to_pylist()]
        classes = [c for c in shared_runs(tokens, run) if several or c[1] > 1]
        return pa.table(
            {
                "host": pa.array([t["host"][0].as_py()] * len(classes), pa.string()),
                "run": pa.array([c[0] for c in classes], pa.int64()),
                "pages": pa.array([c[1] for c in classes], pa.int64()),
                "rows": pa.array([[rows[k] for k, _ in c[2]] for c in classes], pa.list_(pa.int64())),
                "places": pa.array([[p for _, p in c[2]] for c in classes], pa.list_(pa.int32())),
            }
        )

    classes = staged(dealt.groupBy("host", "shard").applyInArrow(scan, "host string, run long, pages long, rows array<long>, places array<int>"))
    common = classes.groupBy("host", "run").agg(F.sum("pages").alias("all")).where(F.col("all") > 1)
    judged = common.join(broadcast_if_small(hosts.select("host", "host_pages")), "host")
    many = F.col("all") >= F.greatest(F.lit(MARKED_PAGES), F.ceil(F.col("host_pages") / 2))
    places = classes.join(judged.select("host", "run", many.alias("many")), ["host", "run"]).select("many", F.explode(F.arrays_zip("rows", "places")).alias("p"))
    return places.groupBy(F.col("p.rows").alias("row")).agg(F.collect_set(F.struct(F.col("p.places").alias("place"), "many")).alias("places"))


def covered_tokens(places: Column, run: int) -> Column:
    """How many tokens the runs at ``places`` cover."""
    order = F.array_sort(places)
    return F.aggregate(order, F.struct(F.lit(0).alias("n"), F.lit(-run).alias("last")), lambda s, p: F.struct((s["n"] + F.least(p - s["last"], F.lit(run))).alias("n"), p.alias("last")), lambda s: s["n"])


def kept_text(zones: list[int], texts: list[str], places: list[dict] | None, run: int) -> str:
    """A page's text, a line per block: prose and what is not covered of marked blocks, or unique runs of the open zone where there is neither."""
    article = MAIN in zones or MARKED in zones
    outside = [t.split() if z != MAIN else [] for z, t in zip(zones, texts, strict=True)]
    hit = np.zeros(sum(map(len, outside)) + run, bool)
    for p in places or ():
        if p["many"] or not article:
            hit[p["place"] : p["place"] + run] = True
    kept, at = [], 0
    for z, t, w in zip(zones, texts, outside, strict=True):
        if z == MAIN:
            kept.append(t)
        elif z == (MARKED if article else OPEN):
            left = [x for x, gone in zip(w, hit[at : at + len(w)], strict=True) if not gone]
            kept += [" ".join(left)] if left else []
        at += len(w)
    return "\n\n".join(kept)


def extract(pages: DataFrame, run: int = RUN, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(page_id, url, text, n_outside, n_repeated): main text, tokens outside plain prose, and those of them in runs that pages of the host share.

    Texts of pages that are plain prose are not shuffled unless the pages that share runs are too many to broadcast.
    """
    held = staged(parsed(pages).withColumn("row", F.monotonically_increasing_id()))
    covered = staged(covered_runs(held, run, shard_tokens))
    plain = F.array_contains("zones", MAIN) & ~F.array_contains("zones", MARKED)
    counts = staged(covered.select("row", covered_tokens(F.col("places.place"), run).cast("long").alias("n_repeated")))
    own = F.array_join(F.filter("texts", lambda t, i: F.element_at("zones", i + 1) == MAIN), "\n\n")
    clear = held.where(plain).select("row", "page_id", "url", own.alias("text"), "n_outside").join(broadcast_if_small(counts), "row", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in lean(batches):
            rows = zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)
            texts = [kept_text(zones, own, places, run) for zones, own, places in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), b.column(5), b.column(6)], ["page_id", "url", "text", "n_outside", "n_repeated"])

    judged = held.where(~plain).join(covered, "row", "left").withColumn("n_repeated", covered_tokens(F.col("places.place"), run).cast("long"))
    made = judged.select("page_id", "url", "zones", "texts", "places", "n_outside", "n_repeated").mapInArrow(write, "page_id long, url string, text string, n_outside long, n_repeated long")
    return clear.drop("row").unionByName(made).withColumn("n_repeated", F.coalesce("n_repeated", F.lit(0)))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    made = extract(table(spark, sf_dir, "pages"))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_outside", "n_repeated")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
