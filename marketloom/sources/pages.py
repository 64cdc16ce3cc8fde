"""Articles from web pages: a tree of each page, rules that pick its parts, and a chain of readings that stops at the first sound one.

Pages are read in batches of Python tasks, one by one; what is judged about
their texts is column expressions (``operators.quality``). Null and broken pages give
empty parts.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from html.parser import HTMLParser
from operator import add
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Selectors of each part in the order they are tried, what is noise, date forms, and boilerplate that texts lose.
TITLE_SELECTORS = ['h1[class*="headline"]', 'h1[class*="title"]', 'h1[class*="article"]', ".article-title", ".headline", ".entry-title", '[property="og:title"]', '[name="twitter:title"]', "h1", "title"]
AUTHOR_SELECTORS = ['[rel="author"]', ".author", ".byline", ".article-author", ".writer", '[class*="author"]', '[property="article:author"]', '[name="author"]']
DATE_SELECTORS = ['[property="article:published_time"]', '[name="publish_date"]', '[name="publication_date"]', '[class*="publish"]', '[class*="date"]', "time[datetime]", "time[pubdate]"]
UPDATE_SELECTORS = ['[property="article:modified_time"]', '[name="last_modified"]', '[class*="updated"]', '[class*="modified"]']
SOURCE_SELECTORS = ['[property="og:site_name"]', '[name="application-name"]', '[name="site_name"]', ".site-name", ".publication-name", ".brand-name"]
CONTENT_SELECTORS = ["article", '[role="main"]', ".article-content", ".entry-content", ".post-content", ".main-content", ".story-body", ".article-body", ".content-body", '[class*="content"]', '[class*="article"]', '[class*="story"]', "main"]
NOISE_SELECTORS = ["nav", "header", "footer", "aside", ".navigation", ".sidebar", ".comments", ".social-share", ".advertisement", ".ad", ".related-articles", ".more-stories", ".newsletter-signup", ".subscription", ".tags", ".breadcrumb", ".pagination", "script", "style", "noscript"]
DATE_FORMS = ["%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y"]
BOILERPLATE = [r"share on facebook", r"share on twitter", r"subscribe to.*newsletter", r"follow us on", r"©\s*\d{4}.*", r"all rights reserved", r"terms of service", r"privacy policy"]
# Signs of a paywall, in texts, classes and scripts, one of them listed twice, signs of a fading text, terms of subscriptions, and the words below which these tell.
PAYWALL_SIGNS = [
    "subscribe to continue", "subscription required", "unlock this story", "become a member", "premium content", "subscriber only", "login to read", "create free account", "start your free trial", "this article is for subscribers", "upgrade to premium", "paywall",
    "paywall", "subscription-required", "premium-content", "subscriber-only", "login-wall", "subscription-wall", "content-gate", "article-gate", "meter-content", "piano-paywall", "tinypass", "subscriptions-section", "registration-required",
]
FADE_SIGNS, MEMBER_TERMS, TEASER_WORDS = ["blur", "fade-out", "content-fade", "paywall-blur", "subscription-blur"], ["subscribe", "premium", "member"], 100
# The fewest words of a content element and of a block, and the most authors.
CONTENT_WORDS, BLOCK_WORDS, MAX_AUTHORS = 50, 20, 5
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES_P = {"p", "div", "section", "article", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "main", "header", "footer", "aside", "nav", "form", "blockquote"}
#: A block's links may hold so much of its text where density decides.
LINK_SHARE = 0.3


class Node:
    """An element; ``parts`` are texts and elements in the order of the page."""

    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict) -> None:
        self.tag, self.attrs, self.parts = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in the order of the page."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [x for x in reversed(node.parts) if isinstance(x, Node)]

    def strings(self) -> Iterator[str]:
        todo: list = [self]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                yield part
            else:
                todo += reversed(part.parts)

    def text(self, between: str = " ") -> str:
        return between.join(t for s in self.strings() if (t := s.strip()))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [Node("", {})]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in CLOSES_P and self.open[-1].tag == "p":
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.open[-1].parts.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def tree_of(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.open[0]


@lru_cache(maxsize=256)
def _test(selector: str):
    """Whether an element meets a selector: a tag, a class, attributes that are there, equal or contain a value, or several of these."""
    tag = re.match(r"[a-z0-9]*", selector).group()
    classes, there = re.findall(r"\.([\w-]+)", re.sub(r"\[.*?\]", "", selector)), re.findall(r'\[(\w+)(?:(\*?=)"([^"]*)")?\]', selector)

    def meets(node: Node) -> bool:
        if tag and node.tag != tag or not set(classes) <= set(node.attrs.get("class", "").split()):
            return False
        return all(name in node.attrs and (not sign or (value in node.attrs[name] if sign == "*=" else node.attrs[name] == value)) for name, sign, value in there)

    return meets


def select(root: Node, selector: str) -> Iterator[Node]:
    return filter(_test(selector), root.walk())


def said(node: Node) -> str:
    """What an element says: its text, or the content of a meta element."""
    return node.text("") or node.attrs.get("content", "").strip()


def parse_date(text: str) -> dt.datetime | None:
    """A time in UTC, from the first of the forms that fits; without a zone it is UTC."""
    for form in DATE_FORMS:
        try:
            found = dt.datetime.strptime(text.strip(), form)
        except ValueError:
            continue
        return (found.astimezone(dt.timezone.utc) if found.tzinfo else found).replace(tzinfo=None)
    return None


def _date(node: Node) -> dt.datetime | None:
    return parse_date(node.attrs.get("datetime") or node.attrs.get("content") or node.text(""))


def dates_of(root: Node) -> tuple[dt.datetime | None, dt.datetime | None]:
    """(published, updated): each selector gives its first date; the first of all is the publication, later ones updates, and selectors of updates overrule them."""
    published = updated = None
    for selectors, only_updates in ((DATE_SELECTORS, False), (UPDATE_SELECTORS, True)):
        for selector in selectors:
            found = next(filter(None, map(_date, select(root, selector))), None)
            if found and published is None and not only_updates:
                published = found
            elif found:
                updated = found
    return published, updated


def authors_of(root: Node) -> list[str]:
    found: list[str] = []
    for selector in AUTHOR_SELECTORS:
        for node in select(root, selector):
            raw = said(node)
            if raw and raw not in found and len(name := re.sub(r"^(by\s+|author:\s*)", "", raw, flags=re.IGNORECASE)) < 100:
                found.append(name)
    return found[:MAX_AUTHORS]


def without_noise(root: Node) -> Node:
    """A copy of the tree without what the noise selectors meet."""
    tests = [_test(s) for s in NOISE_SELECTORS]

    def copy(node: Node) -> Node:
        out = Node(node.tag, node.attrs)
        todo = [(node, out)]
        while todo:
            old, new = todo.pop()
            for part in old.parts:
                if isinstance(part, str):
                    new.parts.append(part)
                elif not any(t(part) for t in tests):
                    child = Node(part.tag, part.attrs)
                    new.parts.append(child)
                    todo.append((part, child))
        return out

    return copy(root)


def clean(text: str) -> str:
    text = re.sub(r"\s+", " ", text)
    for pattern in BOILERPLATE:
        text = re.sub(pattern, "", text, flags=re.IGNORECASE)
    return text.strip()


def dense_block(root: Node) -> Node | None:
    """The block with most text of its own paragraphs, less what links say: each paragraph counts for its parent, and by half for the parent's parent."""
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    parents = {id(child): node for node in root.walk() for child in node.parts if isinstance(child, Node)}
    for p in root.walk():
        if p.tag not in ("p", "td", "pre", "blockquote"):
            continue
        size, linked = len(p.text()), sum(len(a.text()) for a in select(p, "a"))
        if size < 25 or linked > LINK_SHARE * size:
            continue
        up, weight = parents.get(id(p)), 1.0
        while up is not None and weight >= 0.5:
            nodes[id(up)], scores[id(up)] = up, scores.get(id(up), 0.0) + weight * (size - linked)
            up, weight = parents.get(id(up)), weight / 2
    best = max(scores, key=scores.get, default=None)
    return nodes.get(best)


def n_paragraphs(node: Node) -> int:
    return sum(1 for p in select(node, "p") if p.text())


def largest_block(root: Node) -> Node | None:
    """The p, div or section with most words, tags in that order, of those with twenty or more."""
    blocks = [n for tag in ("p", "div", "section") for n in select(root, tag)]
    sized = [(len(n.text().split()), -i) for i, n in enumerate(blocks)]
    best = max((s for s in sized if s[0] >= BLOCK_WORDS), default=None)
    return blocks[-best[1]] if best else None


def readings(root: Node) -> list[tuple[str, str, int]]:
    """``(method, text, paragraphs)`` of each way to read a page, those that find nothing left out."""
    bare, out = without_noise(root), []
    for selector in CONTENT_SELECTORS:
        node = next(select(bare, selector), None)
        if node and len(node.text().split()) >= CONTENT_WORDS:
            out.append((selector, clean(node.text()), n_paragraphs(node)))
            break
    for method, node in (("text_density", dense_block(bare)), ("largest_text_block", largest_block(bare)), ("whole_page", bare)):
        if node and (text := clean(node.text())):
            out.append((method, text, n_paragraphs(node)))
    return out


def read_page(html: str | None, url: str | None) -> tuple:
    """``title, authors, published, updated, source, readings`` of a page."""
    root = tree_of(html)
    title = next((t for s in TITLE_SELECTORS if (n := next(select(root, s), None)) and len(t := said(n)) > 5), "Untitled Article")
    named = (n.attrs.get("content") or n.text("") for s in SOURCE_SELECTORS if (n := next(select(root, s), None)))
    source = next(filter(None, named), urlparse(url or "").netloc.replace("www.", ""))
    return (title, authors_of(root), *dates_of(root), source, readings(root))


def paywall_status(html: str) -> Column:
    """``paywalled`` with two signs of a paywall or more, ``preview`` with one, with a fading text or with a short text that speaks of subscriptions, else ``free``."""
    page = F.lower(F.coalesce(html, F.lit("")))
    count = lambda signs: reduce(add, (F.contains(page, F.lit(s)).cast("int") for s in signs))
    n_words = F.size(F.filter(F.split(F.regexp_replace(page, "<[^>]*>", " "), r"\s+"), lambda w: w != ""))
    teaser = (n_words < TEASER_WORDS) & (count(MEMBER_TERMS) > 0)
    return F.when(count(PAYWALL_SIGNS) >= 2, "paywalled").when((count(PAYWALL_SIGNS) == 1) | (count(FADE_SIGNS) > 0) | teaser, "preview").otherwise("free")


_PARTS = "title string, authors array<string>, published timestamp_ntz, updated timestamp_ntz, source string, readings array<struct<method:string, text:string, paragraphs:int>>"


def read_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without the HTML, with what ``read_page`` finds in it."""
    names = [p.split()[0] for p in _PARTS.split(", ")[:5]] + ["readings"]

    @F.pandas_udf(_PARTS)
    def parts(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([read_page(h, u) for u, h in zip(urls, pages)], columns=names)
        found["readings"] = [[{"method": m, "text": t, "paragraphs": n} for m, t, n in x] for x in found["readings"]]
        return found.astype({"published": "datetime64[us]", "updated": "datetime64[us]"})

    others = [c for c in pages.columns if c != html and c not in names]
    return pages.withColumn("_parts", parts(url, html)).select(*others, "_parts.*")
