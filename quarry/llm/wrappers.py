"""Main text of web pages by wrappers inferred per host.

Method: union-free regular-expression inference. The pages of a host share a template,
so each page's token stream (block tags with their names, and text slots) is aligned with the
wrapper found so far. Mismatches are resolved without alternatives: neighbouring
elements that repeat become one repeated group ``+``, elements that only one side has become
optional ``?``, texts become slots. The wrapper keeps for each slot how many pages and
characters it had, how many of them linked, and its text if it never varied. From that the slots of the main
text are told, once per host: those of article elements, or of the element that holds most
of the running text, without navigation, forms, notices, adverts and comments, and
without template strings, which are the same on all pages.

Scale: the token streams are counted per (host, stream) in columns, so only distinct
streams are aligned, in groups of ``GROUP``: the wrappers of the groups are aligned in
the next round, until a host has one. A host of any size is many groups. Pages meet their streams'
decisions by an equi join on (host, stream), which Spark splits or broadcasts by size.

Defined results: null and empty html give an empty text; pages without host form a host
of their own; markup that is cut off ends with the page; whatever the order and the
number of partitions, the same pages give the same wrappers; equal pages have equal texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.html_tokens import Node, parse
from quarry.llm.scratch import written

GROUP = 64
ALIGNED_CELLS = 1 << 20
LINKED = 0.5
TEMPLATE_PAGES = 3
SLICE_CHARS = 4 << 20

#: Elements beside the article.
ASIDE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "head"}
#: Names (id, class, role) of parts beside the article, as whole words of a name.
ASIDE_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb",
               "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies",
               "discussion", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav",
               "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager",
               "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "reply", "respond",
               "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
               "subscription", "tags", "toolbar", "topbar", "widget", "widgets"}
#: Names of the part that holds the article.
MAIN_NAMES = {"article", "articlebody", "main"}
MAIN_PAIRS = {("article", "body"), ("article", "content"), ("article", "text"), ("entry", "content"), ("post", "body"),
              ("post", "content"), ("story", "body"), ("main", "content"), ("page", "content")}


# ---- wrappers -------------------------------------------------------------------------
# A wrapper is a node [label, mark, payload, children]: label "tag names" or "#" for a
# slot; mark OPTIONAL and REPEATED as bits; payload of a slot: first the numbers of a page's
# texts, later [pages, characters, linked characters, text hash or None if it varies].

OPTIONAL, REPEATED = 1, 2


def _label(node: Node) -> str:
    if node.tag == "#":
        return "#"
    label = f"{node.tag} {node.names}"
    if not node.names and node.tag in ("div", "section", "table", "td", "center"):
        # nameless boxes are told apart by what they hold
        label += "".join(sorted({f"<{c.tag}" for c in node.children}))
    return label


def _merged(a, b, join, mark: int = 0):
    """One wrapper node for two of the same label."""
    if a[0] == "#":
        return [a[0], a[1] | b[1] | mark, join(a[2], b[2]), []]
    return [a[0], a[1] | b[1] | mark, None, _aligned(a[3], b[3], join)]


def _matches(a: list, b: list) -> list[tuple[int, int]]:
    """Longest common subsequence of the labels of two lists of nodes, as index pairs."""
    x, y = [n[0] for n in a], [n[0] for n in b]
    lo, hi = 0, 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    found = [(i, i) for i in range(lo)]
    x, y = x[lo:len(x) - hi], y[lo:len(y) - hi]
    if x and y and len(x) * len(y) > ALIGNED_CELLS:
        # too long to align by a table: the first match in order
        j = 0
        for i, label in enumerate(x):
            if label in y[j:]:
                j = y.index(label, j) + 1
                found.append((lo + i, lo + j - 1))
    elif x and y:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                found.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return found + [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]


def _collapsed(nodes: list, join) -> list:
    """Neighbours of the same label as one repeated group."""
    out: list = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            both_optional = out[-1][1] & node[1] & OPTIONAL
            mark = (out[-1][1] | node[1]) & ~OPTIONAL | both_optional | REPEATED
            out[-1] = _merged(out[-1], node, join)
            out[-1][1] = mark
        else:
            out.append(node)
    return out


def _optional(node):
    return [node[0], node[1] | OPTIONAL, *node[2:]]


def _aligned(a: list, b: list, join) -> list:
    """Two lists of nodes as one: matched nodes are merged, the others become optional."""
    out, i, j = [], 0, 0
    for p, q in [*_matches(a, b), (len(a), len(b))]:
        out += [_optional(n) for n in a[i:p]] + [_optional(n) for n in b[j:q]]
        if p < len(a):
            out.append(_merged(a[p], b[q], join))
        i, j = p + 1, q + 1
    return _collapsed(out, join)


def _slots(node) -> Iterator:
    if node[0] == "#":
        yield node
    for child in node[3]:
        yield from _slots(child)


def page_stream(source: str | None) -> tuple[str, list[str], list[int], list[int]]:
    """A page's stream (its own wrapper as text), its block texts, how much of each is
    linked, and the stream's slot that each belongs to."""
    texts: list[str] = []
    linked: list[int] = []

    def build(node: Node):
        if node.tag == "#":
            texts.append(node.text)
            linked.append(node.linked)
            return ["#", 0, [len(texts) - 1], []]
        return [_label(node), 0, None, _collapsed([build(c) for c in node.children], list.__add__)]

    tree = build(parse(source))
    slot = [0] * len(texts)
    for k, leaf in enumerate(_slots(tree)):
        for t in leaf[2]:
            slot[t] = k
        leaf[2] = None
    return json.dumps(tree, ensure_ascii=False, separators=(",", ":")), texts, linked, slot


def _joined_stats(a, b):
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] if a[3] == b[3] else None]


def _joined_within(a, b):
    return [max(a[0], b[0]), *_joined_stats(a, b)[1:]]


def with_stats(stream: str, stats: list) -> list:
    """The wrapper of one stream; ``stats`` per slot: pages, characters, linked, hash."""
    tree = json.loads(stream)
    for leaf, s in zip(_slots(tree), stats):
        leaf[2] = list(s)
    return tree


def infer(wrappers: list[list]) -> list:
    """One wrapper for all, aligned one after the other."""
    out = wrappers[0]
    for other in wrappers[1:]:
        out = _merged(out, other, _joined_stats)
    return out


# ---- the main text's slots ------------------------------------------------------------

def _words(name: str) -> list[str]:
    return [w for w in re.split("[^a-z]+", name) if w]


def _part(label: str) -> tuple[str, set[str], bool]:
    """(tag, words of the names, whether the names or the tag mean the article)."""
    tag, _, names = label.partition("<")[0].partition(" ")
    words: set[str] = set()
    main = tag in ("article", "main")
    for name in names.split(" "):
        parts = _words(name)
        words.update(parts)
        main |= name in MAIN_NAMES or any(pair in MAIN_PAIRS for pair in zip(parts, parts[1:]))
    return tag, words, main


class _Choice:
    """Which slots of a wrapper hold the main text."""

    def __init__(self, wrapper):
        self.at = {id(s): k for k, s in enumerate(_slots(wrapper))}
        self.articles: list = []
        self.mains: list = []
        self.survey(wrapper, False)
        running = self.running(wrapper, False)
        self.kept: set[int] = set()
        for parts in (self.articles, self.mains):
            held = sum(self.running(n, True) for n in parts)
            if held and held >= 0.2 * running:
                for n in parts:
                    self.keep(n, True)
                return
        varied = any(s[2][3] is None for s in _slots(wrapper))
        node = wrapper
        while True:
            heavy = [c for c in node[3] if self.running(c, False) >= 0.6 * running and running]
            if not heavy or heavy[0][1] & REPEATED or heavy[0][0] == "#" or self.line(heavy[0]):
                break
            node = heavy[0]
        self.keep(node, False, varied)
        self.headings(wrapper)

    @staticmethod
    def line(node) -> bool:
        return _part(node[0])[0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "pre", "blockquote", "tr")

    def beside(self, node, within: bool) -> bool:
        """Whether an element is beside the article, or beside the text within the article."""
        tag, words, main = _part(node[0])
        if tag in ASIDE_TAGS or tag == "header" and not within:
            return True
        named = words & ASIDE_NAMES - ({"header", "banner"} if within else set())
        return bool(named) and not any(self.holds(node, n) for n in (*self.articles, *self.mains))

    def holds(self, node, wanted) -> bool:
        return node is wanted or any(self.holds(c, wanted) for c in node[3])

    def survey(self, node, within: bool) -> None:
        """Outermost article elements, and other elements that are named as the main part."""
        tag, words, main = _part(node[0])
        if tag in ASIDE_TAGS or main and words & ASIDE_NAMES - {"header", "banner"}:
            return
        if tag == "article" or main and tag != "main":
            self.articles.append(node)
            return
        if main and not within:
            self.mains.append(node)
        for child in node[3]:
            self.survey(child, within or main)

    def running(self, node, within: bool) -> int:
        """Characters outside links, without what is beside the article."""
        if node[0] == "#":
            return node[2][1] - node[2][2]
        if self.beside(node, within):
            return 0
        return sum(self.running(c, within) for c in node[3])

    def keep(self, node, within: bool, varied: bool = False) -> None:
        if node[0] == "#":
            pages, chars, linked, same = node[2]
            template = varied and same is not None and pages >= TEMPLATE_PAGES
            if within or not template and linked <= LINKED * chars:
                self.kept.add(self.at[id(node)])
        elif not self.beside(node, within):
            for child in node[3]:
                self.keep(child, within, varied)

    def headings(self, node) -> None:
        if node[0] != "#" and not self.beside(node, False):
            if _part(node[0])[0] == "h1":
                self.keep(node, True)
            for child in node[3]:
                self.headings(child)


def main_slots(stream: list, wrapper: list) -> list[bool]:
    """For each slot of a page's stream, whether the wrapper says that it is main text; a
    stream without such a slot is judged as a wrapper of its own."""
    kept = _Choice(wrapper).kept
    at = {id(s): k for k, s in enumerate(_slots(wrapper))}
    flags: list[bool] = []

    def walk(node, of):
        if node[0] == "#":
            flags.append(of is not None and at[id(of)] in kept)
            return
        pairs = dict(_matches(node[3], of[3])) if of is not None else {}
        for i, child in enumerate(node[3]):
            walk(child, of[3][pairs[i]] if i in pairs else None)

    walk(stream, wrapper)
    if flags and not any(flags):
        kept = _Choice(stream).kept
        flags = [k in kept for k in range(len(flags))]
    return flags


# ---- on Spark -------------------------------------------------------------------------

def host(url: str) -> Column:
    """The host of a URL in lower case, without user and port; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _parsed(batches):
    for batch in batches:
        htmls = batch.pop("html")
        at = 0
        while at < len(batch):
            rows, chars, first = [], 0, at
            while at < len(batch) and chars < SLICE_CHARS:
                rows.append(page_stream(htmls.iloc[at]))
                chars += len(htmls.iloc[at] or "")
                at += 1
            out = batch.iloc[first:at].copy()
            for k, name in enumerate(("stream", "texts", "linked", "slot")):
                out[name] = [r[k] for r in rows]
            yield out


def _as_wrappers(batches):
    for batch in batches:
        batch["wrapper"] = [
            json.dumps(with_stats(stream, [(pages, x["chars"], x["linked"], x["same"])
                                           for x in (stats if stats is not None else ())]), ensure_ascii=False)
            for stream, stats, pages in zip(batch.pop("stream"), batch.pop("stats"), batch.pop("pages"))]
        yield batch


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("place")
    whole = infer([json.loads(w) for w in rows["wrapper"]])
    return pd.DataFrame({"host": rows["host"].iloc[:1], "part": rows["part"].iloc[:1], "place": [""],
                         "wrapper": [json.dumps(whole, ensure_ascii=False)]})


def _decided(batches):
    for batch in batches:
        flags = [main_slots(json.loads(s), json.loads(w)) for s, w in zip(batch["own"], batch["wrapper"])]
        yield pd.DataFrame({"host": batch["host"], "stream_id": batch["stream_id"], "flags": flags})


def streams(parsed: DataFrame) -> DataFrame:
    """(host, stream_id, own): each distinct stream of a host as a wrapper with the
    counts of all its pages."""
    known = parsed.groupBy("host", "stream_id").agg(F.count(F.lit(1)).alias("pages"), F.min("stream").alias("stream"))
    texts = parsed.select("host", "stream_id", F.explode(F.arrays_zip("texts", "linked", "slot")).alias("t")).select(
        "host", "stream_id", "t.slot", F.length("t.texts").alias("chars"), "t.linked", F.xxhash64("t.texts").alias("h"))
    slots = texts.groupBy("host", "stream_id", "slot").agg(
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
        F.when(F.min("h") == F.max("h"), F.max("h")).alias("same"))
    # bounded by the slots of one stream
    stats = slots.groupBy("host", "stream_id").agg(
        F.array_sort(F.collect_list(F.struct("slot", "chars", "linked", "same"))).alias("stats"))
    return known.join(stats, ["host", "stream_id"], "left").select(
        "host", "stream_id", "stream", "pages", "stats").mapInPandas(
        _as_wrappers, "host string, stream_id string, wrapper string").withColumnRenamed("wrapper", "own")


def host_wrappers(own: DataFrame, group: int = GROUP) -> DataFrame:
    """(host, wrapper) from :func:`streams`, aligned in groups of about ``group``, then groups of those."""
    parts = own.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / group).alias("parts"))
    rows = own.join(parts, "host").select(
        "host", F.pmod(F.xxhash64("stream_id"), F.col("parts")).alias("part"), F.col("stream_id").alias("place"),
        F.col("own").alias("wrapper"))
    while True:
        rows = written(rows.groupBy("host", "part").applyInPandas(
            _folded, "host string, part long, place string, wrapper string"), "wrappers")
        if rows.filter("part > 0").isEmpty():
            return rows.select("host", "wrapper")
        rows = rows.select("host", F.floor(F.col("part") / group).alias("part"),
                           F.lpad(F.col("part").cast("string"), 20, "0").alias("place"), "wrapper")


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url: str = "url", html: str = "html",
              group: int = GROUP) -> DataFrame:
    """The columns ``keep`` of every page, ``text`` (its blocks joined by an empty line, empty
    if there is none) and ``n_chars``."""
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    given = pages.select(*kept, host(url).alias("host"), F.col(html).alias("html"))
    fields = [f for f in given.schema.fields if f.name != "html"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    parsed = given.mapInPandas(_parsed, f"{schema}, stream string, texts array<string>, linked array<long>, "
                                        "slot array<int>").withColumn("stream_id", F.md5("stream"))
    own = written(streams(parsed), "page-streams")
    flags = written(own.join(host_wrappers(own, group), "host").mapInPandas(
        _decided, "host string, stream_id string, flags array<boolean>"), "page-slots")
    found = parsed.drop("stream", "linked").join(flags, ["host", "stream_id"])
    blocks = F.filter(F.arrays_zip("texts", "slot"), lambda t: F.get("flags", t["slot"]))
    text = F.array_join(F.transform(blocks, lambda t: t["texts"]), "\n\n")
    return found.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], text.alias("text"),
                        F.length(text).cast("long").alias("n_chars"))
