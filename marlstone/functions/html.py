"""Problem pages: text, layout and features of an HTML document, as one Arrow UDF.

Nesting is not regular, so the standard library's parser walks the page once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = "text string, has_image boolean, has_table boolean, has_math boolean, has_script boolean, n_pre int"
# Elements that end a line, and elements whose text is no content.
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "section", "article", "pre"}
HIDDEN = {"script", "style", "head", "template"}
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "col"}


class _Page(HTMLParser):
    def __init__(self, part: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.seen: dict[str, int] = {}
        self.hidden = self.pre = 0
        self.part, self.inside, self.open = part, 0, []

    def handle_starttag(self, tag, attrs):
        self.seen[tag] = self.seen.get(tag, 0) + 1
        if tag in HIDDEN:
            self.hidden += 1
        if tag == "pre":
            self.pre += 1
        if tag not in VOID:
            own = self.part is not None and self.part in (dict(attrs).get("class") or "").split()
            self.open.append((tag, own))
            self.inside += own
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "pre" and self.pre:
            self.pre -= 1
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, own = self.open.pop()
                self.inside -= own
                if t == tag:
                    break
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden and (self.part is None or self.inside):
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def layout(text: str) -> str:
    """Lines without blanks at the ends, one empty line at most between them."""
    lines = [x.strip() if not x.startswith("    ") else x.rstrip() for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def parsed(html: str | None, part: str | None = None) -> tuple:
    page = _Page(part)
    page.feed(html or "")
    page.close()
    has = lambda *tags: any(t in page.seen for t in tags)
    math = has("math", "var") or bool(re.search(r"\\\(|\$\$", html or ""))
    return layout("".join(page.out)), has("img", "svg"), has("table"), math, has("script"), page.seen.get("pre", 0)


def described(html: Column, part: str | None = None) -> Column:
    """Text and features of a page; with ``part`` only the text inside elements of that class."""

    @F.pandas_udf(PAGE)
    def of(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in pages:
            yield pd.DataFrame([parsed(x, part) for x in s], columns=[c.split()[0] for c in PAGE.split(", ")])

    return of(html)
