"""HTML extraction by wrapper induction: trees of a host's pages are aligned, constant nodes are template, varying slots content."""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small, stored

#: Fixed values of HTML: elements without content, with raw text, that are inline, and whose start ends an open one of the same set.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tr tbody thead article section div main aside nav header footer form blockquote body html".split())
#: Elements, roles and words of class and id names that are never the article.
NOT_ARTICLE = frozenset("nav footer aside form button select dialog menu head object video audio canvas".split())
#: Boxes that stand in a line of text, whatever of them is shown.
INLINE_BOXES = frozenset("audio button canvas datalist input link meta meter object output param picture progress select source track video".split())
#: What may stand in a paragraph and leaves it open.
WITHIN = INLINE | INLINE_BOXES | (RAW - {"xmp"})
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
NOT_NAMES = frozenset(
    "ad ads adsense cookie cookies consent gdpr notice notices alert alerts menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus reply replies respond "
    "share sharing social related newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar pagination pager paywall skiplink skiplinks".split())
NOT_STEMS = ("advert", "sponsor", "promo", "banner", "sidebar", "recommend")
NOT_PAIRS = frozenset("side-bar site-header page-header sign-up skip-link skip-links log-in".split())
#: Words that such a name may have beside it and stay one: ad-slot, related-posts, site-footer; but not share-price.
AROUND = frozenset(
    "a about and area article articles aside author bar block body bottom box btn button buttons card cards center col column container content count desktop div element fixed float form global grid group header heading holder icon icons "
    "in inner item items left link links list login main media mobile module more outer page panel post posts primary right row secondary section single site slot small sticky stories story sub tabs text thread title top ui unit up wrap wrapper".split())
TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
#: A block is template where this share of the different pages of a host have it in the same slot, of this number at least (of fewer than ten, all).
CONSTANT, LEAST_PAGES = 0.9, 3


class Page:
    """A parsed page: its elements in page order (tag, label, whether it is boilerplate, parent), and events: an element's number where it opens, ~number where it closes, and texts."""

    __slots__ = ("tags", "labels", "boilerplate", "parents", "events")

    def __init__(self):
        self.tags, self.labels, self.boilerplate, self.parents, self.events = ["#root"], ["#root"], [False], [-1], []


_elements: dict[tuple[str, str], tuple[str, bool]] = {}


def _element(tag: str, attributes: str) -> tuple[str, bool]:
    """Label (tag and class), and whether tag, role or names say that it isn't the article."""
    if (known := _elements.get((tag, attributes))) is not None:
        return known
    if len(_elements) > 10_000:
        _elements.clear()
    return _elements.setdefault((tag, attributes), _judged(tag, attributes))


def not_article(names: str) -> bool:
    """Whether one of the names of class and id is made of a word that is never the article and words that stand around it."""
    for name in names.split():
        parts = [w.rstrip("0123456789") for w in re.split("[-_]+", re.sub("(?<=[a-z0-9])(?=[A-Z])", "-", name).lower())]
        parts = [w for w in parts if w]
        never = [w in NOT_NAMES or w.startswith(NOT_STEMS) for w in parts]
        if "-".join(parts) in NOT_PAIRS or (any(never) and all(n or w in AROUND for n, w in zip(never, parts, strict=True))):
            return True
    return False


def _judged(tag: str, attributes: str) -> tuple[str, bool]:
    found = {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    own = tag not in ("body", "html", "main", "article") and not_article(names) or tag == "article" and bool({"comment", "comments"} & set(names.lower().split()))
    return tag + "".join(f".{c}" for c in sorted(found.get("class", "").split())), tag in NOT_ARTICLE or found.get("role", "").lower() in NOT_ROLES or hidden or own


def parse(text: str) -> Page:
    """The elements of a page. Unclosed and stray tags are taken as browsers mostly do. Nesting may be of any depth: nothing here recurses."""
    page, at = Page(), 0
    stack, open_ = [0], Counter()  # numbers of open elements; how many of each tag are open

    def close(i: int) -> None:
        """The i-th element of the stack and all in it."""
        while len(stack) > i:
            n = stack.pop()
            open_[page.tags[n]] -= 1
            page.events.append(~n)

    while m := TAG.search(text, at):
        if m.start() > at:
            page.events.append(text[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                own = page.tags[stack[i]]
                if own == tag:
                    close(i)
                    break
                if tag in INLINE and own not in INLINE:
                    break
            continue
        ends = CLOSES.get(tag, () if tag in WITHIN else {"p"})
        if any(open_[t] for t in ends):
            for i in range(len(stack) - 1, 0, -1):
                own = page.tags[stack[i]]
                if own in ends:
                    close(i)
                elif own in SCOPES:
                    break
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        n, (label, boilerplate) = len(page.tags), _element(tag, m[3])
        page.tags.append(tag)
        page.labels.append(label)
        page.boilerplate.append(boilerplate)
        page.parents.append(stack[-1])
        page.events.append(n)
        if tag in VOID or m[3].rstrip().endswith("/"):
            page.events.append(~n)
        else:
            stack.append(n)
            open_[tag] += 1
    if at < len(text):
        page.events.append(text[at:])
    close(1)
    return page


# ---------------------------------------------------------------- skeletons and their alignment


class Shapes:
    """Trees of labels by number: equal trees have one number. parts: each tree's label and children; count: its nodes."""

    def __init__(self):
        self.known: dict[tuple[str, tuple[int, ...]], int] = {}
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.count: list[int] = []

    def of(self, label: str, children: list[int]) -> int:
        """The tree of a label and children, runs of equal siblings being one."""
        key = label, tuple(c for i, c in enumerate(children) if not i or children[i - 1] != c)
        if key not in self.known:
            self.known[key] = len(self.parts)
            self.parts.append(key)
            self.count.append(1 + sum(self.count[c] for c in key[1]))
        return self.known[key]

    def written(self, shape: int) -> str:
        """(depth, label) of each node, depth first."""
        out, stack = [], [(0, shape)]
        while stack:
            depth, n = stack.pop()
            out.append(f"{depth} {self.parts[n][0]}")
            stack += [(depth + 1, c) for c in reversed(self.parts[n][1])]
        return "\n".join(out)

    def read(self, written: str) -> int:
        stack: list[tuple[str, list[int]]] = []
        for line in [*written.split("\n"), "0 "]:
            depth, _, label = line.partition(" ")
            while len(stack) > int(depth):
                own, children = stack.pop()
                n = self.of(own, children)
                if not stack:
                    return n
                stack[-1][1].append(n)
            stack.append((label, []))
        raise ValueError("no tree")


def skeleton(page: Page) -> tuple[Shapes, int, list[int]]:
    """The tree of a page's block elements (those in an inline element or in boilerplate are in none), and each element's place in it, depth first; -1 for the others."""
    blocks = [True] * len(page.tags)
    children: list[list[int]] = [[] for _ in page.tags]
    for n in range(1, len(page.tags)):
        up = page.parents[n]
        blocks[n] = blocks[up] and not page.boilerplate[n] and page.tags[n] not in INLINE
        if blocks[n]:
            children[up].append(n)
    shapes, shape, place = Shapes(), [0] * len(page.tags), [-1] * len(page.tags)
    for n in range(len(page.tags) - 1, -1, -1):
        if blocks[n]:
            shape[n] = shapes.of(page.labels[n], [shape[c] for c in children[n]])
    place[0] = 0
    for n in range(len(page.tags)):
        if blocks[n]:
            following, last = place[n] + 1, None
            for c in children[n]:
                if shape[c] != last:
                    place[c], last = following, shape[c]
                    following += shapes.count[last]
                else:
                    place[c] = following - shapes.count[last]
    return shapes, shape[0], place


class Alignment:
    """Simple tree matching of two trees: most pairs of nodes with equal labels, in order and under matched parents."""

    def __init__(self, shapes: Shapes):
        self.shapes, self.size, self.found = shapes, {}, {}

    def match(self, a: int, b: int) -> int:
        """The number of pairs. Pairs of subtrees are done once each, those below first."""
        parts, stack = self.shapes.parts, [(a, b)]
        while stack:
            x, y = stack[-1]
            if (x, y) in self.size:
                stack.pop()
                continue
            if parts[x][0] != parts[y][0]:
                self.size[x, y] = 0
            elif x == y:
                self.size[x, y] = self.shapes.count[x]
            else:
                below = [(u, v) for u in set(parts[x][1]) for v in set(parts[y][1]) if (u, v) not in self.size]
                if below:
                    stack += below
                    continue
                self.size[x, y], pairs = self._children(x, y)
                self.found[x, y] = dict(pairs)
            stack.pop()
        return self.size[a, b]

    def _children(self, x: int, y: int) -> tuple[int, list[tuple[int, int]]]:
        """Best in-order pairs of the children of two nodes; equal ones at either end are paired outright, which is never worse."""
        own, other = self.shapes.parts[x][1], self.shapes.parts[y][1]
        m, n, first, last = len(own), len(other), 0, 0
        while first < min(m, n) and own[first] == other[first]:
            first += 1
        while last < min(m, n) - first and own[m - 1 - last] == other[n - 1 - last]:
            last += 1
        pairs = [(i, i) for i in range(first)] + [(m - 1 - i, n - 1 - i) for i in range(last)]
        total = 1 + sum(self.shapes.count[own[i]] for i, _ in pairs)
        a, b = own[first : m - last], other[first : n - last]
        if not a or not b:
            return total, pairs
        kinds, at = np.unique(np.array(b), return_inverse=True)
        weights = {u: np.array([self.size[u, v] for v in kinds.tolist()])[at] for u in set(a)}
        best, taken = np.zeros(len(b) + 1, np.int64), np.zeros((len(a), len(b)), np.int8)
        for i, u in enumerate(a):
            with_pair = np.where(weights[u] > 0, best[:-1] + weights[u], -1)
            row = np.maximum.accumulate(np.maximum(best[1:], with_pair))
            taken[i] = np.where(np.concatenate([[0], row[:-1]]) == row, 2, np.where(best[1:] == row, 1, 0))  # 2: left, 1: up, 0: the pair
            best = np.concatenate([[0], row])
        i, j = len(a) - 1, len(b) - 1
        while i >= 0 and j >= 0:
            if taken[i, j] == 0:
                pairs.append((first + i, first + j))
                i, j = i - 1, j - 1
            elif taken[i, j] == 1:
                i -= 1
            else:
                j -= 1
        return total + int(best[-1]), pairs

    def pairs(self, a: int, b: int) -> dict[int, int]:
        """Children of matched trees a and b, by place."""
        return {i: i for i in range(len(self.shapes.parts[a][1]))} if a == b else self.found[a, b]


def slots_of(page: str, template: str) -> list[int]:
    """For each node of a page's skeleton, depth first: a hash of the place of its match in the template, or of its own path where it has none."""
    shapes = Shapes()
    a, b = shapes.read(page), shapes.read(template)
    align = Alignment(shapes)
    matched = align.match(a, b) > 0
    out, stack = [], [(a, b if matched else None, "0")]
    while stack:
        x, y, path = stack.pop()
        slot = xxhash.xxh64_intdigest(path)
        out.append(slot - (1 << 63))
        to = align.pairs(x, y) if y is not None else {}
        own, other = shapes.parts[x][1], shapes.parts[y][1] if y is not None else ()
        stack += [(c, other[to[i]], f"{slot}.{to[i]}") if i in to else (c, None, f"{slot}/{shapes.parts[c][0]}") for i, c in reversed(list(enumerate(own)))]
    return out


# ---------------------------------------------------------------- blocks


def clean(parts: list[str]) -> str:
    return SPACE.sub(" ", references.unescape("".join(parts))).strip()


def blocks(page: Page, place: list[int]) -> list[tuple[int, str]]:
    """(place in the skeleton, text) of the blocks that may be the article, in page order.

    Where the page has an article element (or else a main element) only what is in one counts.
    """
    out: list[tuple[int, str, int]] = []
    run: list[str] = []
    gone = 0  # open elements in boilerplate
    inside: list[tuple[int, int, bool]] = [(0, 0, False)]  # (place, rank, dropped) of the open elements

    def flush() -> None:
        if run:
            at, rank, dropped = inside[-1]
            if not dropped and (text := clean(run)):
                out.append((at, text, rank))
            run.clear()

    for event in page.events:
        if isinstance(event, str):
            if not gone:
                run.append(event)
            continue
        n = event if event >= 0 else ~event
        tag = page.tags[n]
        inline = tag in INLINE or tag in INLINE_BOXES
        if gone or page.boilerplate[n]:
            gone += 1 if event >= 0 else -1
            if gone <= 1:
                run.append(" ") if inline else flush()
        elif inline:
            if event >= 0 and tag == "br":
                run.append(" ")
        elif event >= 0:
            flush()
            at, rank, dropped = inside[-1]
            rank = 2 if tag == "article" else max(rank, 1) if tag == "main" else rank
            inside.append((place[n] if place[n] >= 0 else at, rank, dropped or (tag == "header" and rank == 0)))
        else:
            flush()
            inside.pop()
    flush()
    most = max((r for _, _, r in out), default=0)
    return [(at, text) for at, text, r in out if r == most]


# ---------------------------------------------------------------- the operator


def _parsed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        written, at, texts = [], [], []
        for text in part["html"]:
            page = parse(text or "")
            shapes, shape, place = skeleton(page)
            found = blocks(page, place)
            written.append(shapes.written(shape))
            at.append([a for a, _ in found])
            texts.append([t for _, t in found])
        yield part[["id", "url", "host"]].assign(skeleton=written, at=at, texts=texts)


def _aligned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield part[["host", "shape"]].assign(slots=[slots_of(s, t) for s, t in zip(part["skeleton"], part["template"], strict=True)])


def extract(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, text, n_chars): the article of every page.

    Each page is parsed in its own task. Each different skeleton of a host (a tree of
    block elements, runs of equal siblings as one) is aligned with the host's commonest by simple
    tree matching, which names the slot of every block; skeletons of one host are rows like
    others, so a host's work is spread. Blocks that nearly all different
    pages of a host (three at least; pages differ by any of their blocks) have in the same
    slot are its template and go; so do parts whose
    element, role or name says that they are menus, footers, adverts, forms, comments and
    the like. The rest are the article's blocks: of the article elements where there are
    any, else of main, else of the page.

    Null and empty pages have the text "". Null urls are a host of their own. Pages may be
    long and nested to any depth. Repeated rows
    and pages of equal blocks count as one page for the template and give equal results. An empty table gives no
    rows. Other columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["id"]
    parsed = rows.mapInPandas(_parsed, f"id {kind}, url string, host string, skeleton string, at array<int>, texts array<string>")
    parsed = stored(parsed.withColumns({"page": F.xxhash64("texts"), "shape": F.xxhash64("skeleton")}), "pages")
    shapes = stored(parsed.groupBy("host", "shape").agg(F.min("skeleton").alias("skeleton"), F.count("*").alias("n")), "shapes")
    template = stored(shapes.groupBy("host").agg(F.min_by("skeleton", F.struct(-F.col("n"), "shape")).alias("template")), "templates")
    slots = shapes.join(small(template, 2_000), "host").select("host", "shape", "skeleton", "template").mapInPandas(_aligned, "host string, shape long, slots array<long>")
    placed = parsed.drop("skeleton").join(small(stored(slots, "slots"), 20_000), ["host", "shape"])
    placed = placed.withColumn("places", F.expr("transform(at, i -> slots[i])")).withColumn("keys", F.expr("zip_with(places, texts, (p, t) -> xxhash64(p, t))"))
    seen = placed.select("host", "page", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    different = parsed.where(F.size("texts") > 0).select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    constant = seen.groupBy("host", "key").agg(F.count("*").alias("n")).join(small(different, 100_000), "host").where(F.col("n") >= CONSTANT * F.col("pages"))
    constant = stored(constant.groupBy("host").agg(F.collect_set("key").alias("template")), "template")  # no more than a page's blocks by a tenth
    placed = placed.join(small(constant, 50_000), "host", "left")
    kept = F.expr("filter(texts, (t, i) -> template is null or not array_contains(template, keys[i]))")
    text = F.array_join(kept, "\n")
    return placed.select("id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"), "page_id", "url", "html").withColumnRenamed("id", "page_id")
