"""Main text of web pages, with a site style tree for each host.

All pages of a host are merged into one tree: an element is known by the tags and class names on its way from the root
(runs of equal siblings count once). Its presentation importance is the entropy of the child sequences it was seen with, its
content importance the entropy of its own texts, both over the host's pages; importance flows from the leaves to the root
as in the site style tree of the literature, with a damping factor GAMMA for every style. Branches in which all importance stays
below LEAST on a host with at least PAGES pages are removed.

Elements that name themselves as menus, headers, footers, sidebars, notices, adverts, forms or comments (tag, role, class,
id) go on every host. A class or id of several words (has-sidebar) may tell of the page instead: such a branch stays if an
article (or main) or most of the page's text is in it and no article stands outside of such branches. If nothing is left,
the same holds for names of one word, and then names don't count. The article element (or main) itself is never removed for low importance; what lies below it is, unless
that is all of it and no longer text stays outside: copies of one article would otherwise make it look like a template. Text
outside of an article stays by its importance if the host has at least PAGES pages; on others only the article counts. If
nothing is left, importance is not used on that page.

Statistics are counts by (host, element, value) that every task adds up first; a host's tree is as large as its templates.
A host with fewer than PAGES pages has no tree: what few pages share by chance would look like a template. Null html gives an empty
text; pages without a host only know the rules that need no tree. Very long pages are read whole. Repeated rows are pages of their own.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, staged, table

GAMMA, LEAST, PAGES = 0.9, 0.4, 8
BROADCAST_ROWS = 50_000  # up to so many low elements go to all tasks; beyond, pages are joined with them
FLUSH = 200_000
ROOT = 0  # path of the element around a page; among the low elements it tells that the host was judged

# HTML's vocabulary, and the names that pages give to what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button input select textarea option iframe svg canvas audio video object embed dialog menu title xmp noembed noframes map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
NAMES = frozenset("nav navbar navigation menu menus submenu breadcrumb breadcrumbs footer footers sidebar sidebars aside widget widgets ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus respond reply replies popup modal overlay toolbar pagination pager masthead topbar".split())
HEADERS = frozenset("header head heading".split())
CLOSES = {"p": frozenset("p".split()), "li": frozenset(["li"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split()), "option": frozenset(["option"])}
STOPS = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset("tr table".split()), "th": frozenset("tr table".split())}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z]+")


class Branch:
    """What is in an element that is named like something else than the article."""

    __slots__ = ("outer", "kind", "article", "size")

    def __init__(self, outer, kind):
        self.outer, self.kind, self.article, self.size = outer, kind, False, 0


class Element:
    __slots__ = ("tag", "path", "parent", "depth", "dropped", "low", "article", "branch", "children", "texts")

    def __init__(self, tag, path, parent, depth, dropped, low, article, branch):
        self.tag, self.path, self.parent, self.depth = tag, path, parent, depth
        self.dropped, self.low, self.article, self.branch = dropped, low, article, branch
        self.children, self.texts = [], []


def mark(text: str) -> int:
    """63 bits of a digest."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little") >> 1


known_mark = lru_cache(1 << 14)(mark)  # for tags with their class, which pages repeat


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


NUMBERING = re.compile(r"(?<=[-_])[^-_]*[0-9][^-_]*|[0-9]{3,}")


def template_classes(given: str) -> list[str]:
    """An element's classes without what numbers pages, posts and builds: parts with digits behind a dash, and three digits or more."""
    return [NUMBERING.sub("#", name) for name in given.split()]


CLEAR, COMPOUND, NAMED, CHROME = range(4)


def is_chrome(tag: str, given: dict[str, str], in_article: bool) -> int:
    """Does an element say itself that it is not part of the article? By a class or id of several words, one of one word, or
    without doubt."""
    if tag in DROPPED:
        return CHROME
    if tag in ("html", "body", "article", "main"):
        return CLEAR
    if tag == "header" and not in_article:
        return CHROME
    if not given:
        return CLEAR
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower():
        return CHROME
    if given.get("role", "").lower() in ROLES:
        return CHROME
    telling = NAMES | HEADERS if not in_article and tag in ("div", "section") else NAMES
    kind = CLEAR
    for name in f"{given.get('class', '')} {given.get('id', '')}".lower().split():
        words = WORDS.findall(name)
        if not telling.isdisjoint(words):
            kind = max(kind, COMPOUND if len(words) > 1 else NAMED)
    return kind


def walk(page: str, on_text, on_close, on_block, low: frozenset[int] = frozenset()) -> tuple[bool, list[Branch]]:
    """Goes through a page once. on_text(element, raw text), on_close(element), on_block() between blocks. Returns whether
    there is an article element (or main) outside of what is dropped and of all branches, and the branches."""
    stack = [Element("", ROOT, ROOT, 0, False, False, False, None)]
    seen_article, branches = False, []
    opened = {"": 1}  # open elements by tag: an end tag of none is passed over

    def close(to: int) -> None:
        while len(stack) > to:
            element = stack.pop()
            opened[element.tag] -= 1
            on_close(element)

    at, end = 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        if found is None:
            on_text(stack[-1], page[at:])
            break
        if found.start() > at:
            on_text(stack[-1], page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            if tag not in INLINE:
                on_block()
            if opened.get(tag):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag == "br":
            on_text(stack[-1], "\n")
            continue
        raw = found[3] if found[2] else found[6]
        if tag not in INLINE:
            on_block()
            closing = CLOSES.get(tag, CLOSES["p"])
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closing:
                    close(k)
                    if tag not in ("tr", "dt", "dd"):
                        break
                elif stack[k].tag in STOPS.get(tag, ()) or (tag not in CLOSES and stack[k].tag not in INLINE):
                    break
        top = stack[-1]
        given = attributes(raw) if raw.strip() else {}
        kind = tag + "." + " ".join(own) if (own := template_classes(given.get("class", ""))) else tag
        path = ((top.path * 1_000_003) ^ known_mark(kind)) & 0x7FFFFFFFFFFFFFFF
        kind = CHROME if top.dropped else is_chrome(tag, given, top.article)
        dropped, branch = kind == CHROME, top.branch
        if kind in (COMPOUND, NAMED):
            branch = Branch(branch, kind)
            branches.append(branch)
        article = top.article or (not dropped and (tag in ("article", "main") or given.get("role", "").lower() == "main"))
        if article and not top.article:
            seen_article |= branch is None
            around = branch
            while around is not None:
                around.article, around = True, around.outer
        inner = Element(tag, path, top.path, top.depth + 1, dropped, (top.low or path in low) and top.article == article, article, branch)
        if not top.children or top.children[-1] != path:
            top.children.append(path)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = stop.end()
            on_close(inner)
        elif tag in VOID or raw.endswith("/") and tag not in ("p", "div", "a", "span"):
            on_close(inner)
        else:
            stack.append(inner)
            opened[tag] = opened.get(tag, 0) + 1
    on_block()
    close(0)
    return seen_article, branches


def main_text(page: str | None, low: frozenset[int] = frozenset()) -> str:
    """low: the elements of low importance of the host, and ROOT if its tree was judged."""
    if not page:
        return ""
    blocks: list[list[tuple[Element, str]]] = [[]]

    def on_text(element: Element, raw: str) -> None:
        if not element.dropped:
            blocks[-1].append((element, raw))

    def on_block() -> None:
        if blocks[-1]:
            blocks.append([])

    seen, branches = walk(page, on_text, lambda _: None, on_block, low)
    if not branches:
        return chosen(blocks, low, seen)
    total = 0
    for own in blocks:
        for e, raw in own:
            size = len(raw.strip())
            total += size
            if e.branch is not None:
                e.branch.size += size
    for branch in reversed(branches):
        if branch.outer is not None:
            branch.outer.size += branch.size
    for most in (COMPOUND, NAMED):
        some = [] if seen and most == COMPOUND else [x for x in branches if x.kind <= most]
        articles = any(x.article for x in some)
        stay: set[Branch | None] = {None}
        for x in some:  # outer ones come first
            if x.outer in stay and (x.article if articles else 2 * x.size > total):
                stay.add(x)
        if text := chosen([[x for x in own if x[0].branch in stay] for own in blocks], low, seen):
            return text
    return chosen(blocks, low, seen)


def chosen(blocks: list[list[tuple[Element, str]]], low: frozenset[int], seen: bool) -> str:
    """The text of what counts. seen: an article decides, even if it is shorter than what is outside of it."""

    def text_of(wanted) -> str:
        texts = (" ".join(html.unescape("".join(raw for e, raw in own if wanted(e))).split()) for own in blocks)
        return "\n\n".join(x for x in texts if x)

    article = text_of(lambda e: e.article)
    if article and ROOT not in low and (seen or 2 * len(article) > len(text_of(lambda e: True))):
        return article
    high = text_of(lambda e: not e.low)
    if article and not any(e.article and not e.low and raw.strip() for own in blocks for e, raw in own) and len(article) > len(high):
        return text_of(lambda e: e.article or not e.low)
    return high or text_of(lambda e: True)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
COUNTS = "host string, path long, parent long, depth int, kind int, value long, n long"
STYLE, TEXT, PRESENT = 0, 1, 2


def count_elements(pages: DataFrame) -> DataFrame:
    """COUNTS, added up in every task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in COUNTS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(*k, n) for k, n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in sliced(batches, "html"):
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                if not host or not page:
                    continue
                present = set()

                def on_text(element: Element, raw: str) -> None:
                    element.texts.append(raw)

                def on_close(element: Element) -> None:
                    key = host, element.path, element.parent, element.depth
                    present.add(key)
                    counts[(*key, STYLE, mark(repr(element.children)))] += 1
                    if text := " ".join("".join(element.texts).split()):
                        counts[(*key, TEXT, mark(text))] += 1

                walk(page, on_text, on_close, lambda: None)
                for key in present:
                    counts[(*key, PRESENT, 0)] += 1
                if len(counts) > FLUSH:
                    yield flush()
        if counts:
            yield flush()

    return pages.select("host", "html").mapInArrow(count, COUNTS)


def entropy_of_tree(rows: list[dict]) -> dict[int, float]:
    """For each element of a host's tree the largest composite importance of itself, its texts and all below it: an
    element is noise only if nothing in its branch is important."""
    most: dict[int, float] = {}
    inside: dict[int, list[tuple[float, float, float]]] = {}  # of an element: (importance, weight, most in the branch)
    for r in sorted(rows, key=lambda r: -r["depth"]):
        parts = inside.get(r["path"], [])
        if r["texts"]:
            log = math.log(r["texts"])
            text = (log - r["text_sum"] / r["texts"]) / log if log else 1.0
            parts = [*parts, (text, r["pages"], text)]
        log = math.log(r["seen"])
        style = (log - r["style_sum"] / r["seen"]) / log if log else 1.0
        weight = sum(w for _, w, _ in parts)
        damp = GAMMA ** r["styles"]
        value = (1 - damp) * style + damp * (sum(v * w for v, w, _ in parts) / weight if weight else 0.0)
        most[r["path"]] = max([value, *(m for *_, m in parts)])
        inside.setdefault(r["parent"], []).append((value, r["pages"], most[r["path"]]))
    return most


def low_elements(pages: DataFrame) -> DataFrame:
    """host, path: elements of low importance, and ROOT for each host with at least PAGES pages."""
    counts = count_elements(pages).groupBy("host", "path", "parent", "depth", "kind", "value").agg(F.sum("n").alias("n"))
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0))
    own = F.col("n") * F.log(F.col("n").cast("double"))
    nodes = counts.groupBy("host", "path", "parent", "depth").agg(
        of(STYLE, F.col("n")).alias("seen"), of(STYLE, own).cast("double").alias("style_sum"), F.count_if(F.col("kind") == STYLE).alias("styles"),
        of(TEXT, F.col("n")).alias("texts"), of(TEXT, own).cast("double").alias("text_sum"), of(PRESENT, F.col("n")).alias("pages"),
    )

    def judge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        importance = entropy_of_tree(rows)
        low = [r["path"] for r in rows if r["pages"] >= PAGES and (r["path"] == ROOT or importance[r["path"]] < LEAST)]
        return pa.table({"host": pa.array([rows[0]["host"]] * len(low), pa.string()), "path": pa.array(low, pa.int64())})

    return nodes.groupBy("host").applyInArrow(judge, "host string, path long")


TEXTS = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> page_id, url, text, n_chars."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1)).alias("host"))
    low = staged(low_elements(pages))
    small = low.count() <= BROADCAST_ROWS
    known = {}
    if small:
        for r in low.collect():
            known.setdefault(r["host"], set()).add(r["path"])
    else:
        pages = pages.join(low.groupBy("host").agg(F.collect_set("path").alias("paths")), "host", "left")
    shared = spark.sparkContext.broadcast({h: frozenset(p) for h, p in known.items()})  # at most BROADCAST_ROWS elements

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: frozenset[int] = frozenset()
        for batch in sliced(batches, "html"):
            lows = [shared.value.get(h, none) for h in batch.column("host").to_pylist()] if small else [frozenset(p or ()) for p in batch.column("paths").to_pylist()]
            texts = [main_text(page, own) for page, own in zip(batch.column("html").to_pylist(), lows)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html", "host", *([] if small else ["paths"])).mapInArrow(read, TEXTS)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
