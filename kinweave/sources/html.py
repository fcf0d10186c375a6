"""HTML pages to listings and articles, on the standard library's parser, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import clean, distinct_names, first_filled, published_at, strip

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_NOISE = frozenset(("script", "style", "nav", "aside", "figure"))
_RAW = frozenset(("script", "style"))


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    parent: Node | None = None

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in skip:
                stack += reversed(node.children)
        return "".join(out)

    def inside(self, tags: frozenset[str]) -> bool:
        node = self.parent
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    @property
    def classes(self) -> frozenset[str]:
        return frozenset((self.attrs.get("class") or "").split())


class _Tree(HTMLParser):
    """A tree with implied ends of paragraphs; end tags that open nothing are passed over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P and self._open("p"):
            self._close("p")
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag:
            self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        if self._open(tag):
            self._close(tag)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def _open(self, tag: str) -> bool:
        node = self.at
        while node is not None and node.tag:
            if node.tag == tag:
                return True
            node = node.parent
        return False

    def _close(self, tag: str) -> None:
        while self.at.tag != tag:
            self.at = self.at.parent
        self.at = self.at.parent


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


Test = Callable[[Node], bool]


def tag(name: str, cls: str | None = None, attr: str | None = None) -> Test:
    return lambda n: n.tag == name and (cls is None or cls in n.classes) and (attr is None or attr in n.attrs)


@dataclass(frozen=True)
class Layout:
    """Where a site's pages hold what; the first of several that finds anything counts."""

    # The places of the supported site's pages.
    listing: Test = tag("a", "loop-card__title-link")
    titles: tuple[Test, ...] = (tag("h1", "article__title"), tag("h1", "wp-block-techcrunch-podcast-single-hero__title"), tag("h1", "wp-block-post-title"))
    authors: tuple[Test, ...] = (tag("a", "article__author-name"), tag("a", "wp-block-tc23-author-card-name__link"))
    times: tuple[Test, ...] = (tag("time", "article__date"), tag("time", attr="datetime"))
    date_classes: tuple[str, ...] = ("hero__meta", "byline", "post-meta", "post-date")
    body: Test = tag("div", "article-content")


def listing_links(html: str | None, layout: Layout) -> list[str]:
    """Links of title anchors; only where there are none, those in headings of the second and third order."""
    root = parse(html)
    links = [n.attrs.get("href", "") for n in root.walk() if layout.listing(n)]
    if not any(layout.listing(n) for n in root.walk()):
        heads = frozenset(("h2", "h3"))
        links = [n.attrs.get("href", "") for n in root.walk() if n.tag == "a" and n.inside(heads)]
    return [x for x in links if x]


def article_fields(html: str | None, layout: Layout) -> dict:
    """The texts that an article's columns are made of."""
    root = parse(html)
    every = list(root.walk())
    found = lambda tests: [[n.text() for n in every if t(n)] for t in tests]
    times = next((n for t in layout.times for n in every if t(n)), None)
    area = next((n for n in every if layout.body(n)), None) or next((n for n in every if n.tag == "main"), None) or root
    noise = _NOISE
    paragraphs = [n.text(noise).strip() for n in area.walk() if n.tag == "p" and not n.inside(noise)]
    names = next((x for x in found(layout.authors) if any(y.replace(" ", " ").strip() for y in x)), [])
    return {
        "titles": [x[0] if x else None for x in found(layout.titles)],
        "authors": names,
        "meta_time": next((n.attrs.get("content") for n in every if n.tag == "meta" and n.attrs.get("property") == "article:published_time"), None),
        "time_attr": times.attrs.get("datetime") if times else None,
        "time_text": times.text() if times else None,
        "date_text": " ".join(n.text() for n in every if any(c in n.attrs.get("class", "") for c in layout.date_classes)),
        "body": "\n".join(paragraphs),
    }


FIELDS = "url string, titles array<string>, authors array<string>, meta_time string, time_attr string, time_text string, date_text string, body string"


def parse_articles(pages: DataFrame, source: Column | str, layout: Layout | None = None) -> DataFrame:
    """Articles of pages (url, html): url, title, author, published_at, body_text, source; pages without a body give none."""
    layout = layout or Layout()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            got = pd.DataFrame([article_fields(h, layout) for h in rows["html"]], columns=[x.split()[0] for x in FIELDS.split(", ")][1:])
            got.insert(0, "url", rows["url"].values)
            yield got

    raw = pages.select("url", "html").where("html is not null").mapInPandas(run, FIELDS)
    titles = [clean(F.get("titles", F.lit(i))) for i in range(len(layout.titles))]
    author = F.nullif(F.array_join(distinct_names("authors"), ", "), F.lit(""))
    when = published_at(F.col("meta_time"), F.col("time_attr"), F.col("time_text"), F.col("date_text"))
    out = raw.select("url", first_filled(*titles).alias("title"), author.alias("author"), when.alias("published_at"), strip("body").alias("body_text"), (F.lit(source) if isinstance(source, str) else source).alias("source"))
    return out.where(F.col("body_text") != "")


def parse_listings(pages: DataFrame, root: str, layout: Layout | None = None) -> DataFrame:
    """url and urls (absolute, distinct, in order) of listing pages (url, html); a page that wasn't got has none."""
    layout = layout or Layout()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"url": rows["url"], "links": [listing_links(h, layout) for h in rows["html"]]})

    raw = pages.select("url", "html").mapInPandas(run, "url string, links array<string>")
    absolute = lambda x: F.when(x.startswith("http"), x).otherwise(F.concat(F.lit(root.rstrip("/")), F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))))
    return raw.select("url", F.array_distinct(F.transform("links", absolute)).alias("urls"))
