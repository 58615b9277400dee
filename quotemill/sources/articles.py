"""Article pages to rows: links, title, date text, paragraphs and an attached PDF."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where the news site keeps date, body and paragraphs, and the attachment's heading.
DATE_CLASSES = ("datenew", "date hidden-xs")
BODY_ID = "vst_detail"
PARAGRAPH_CLASS = "pBody"
ATTACHMENT_WORDS = "Tài liệu đính kèm:"

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style"}


@dataclass
class Layout:
    """Which elements of a page matter. Without a body id the whole page is the body."""

    date_classes: tuple[str, ...] = DATE_CLASSES
    body_id: str | None = BODY_ID
    paragraph_class: str | None = PARAGRAPH_CLASS
    attachment_words: str = ATTACHMENT_WORDS


class _Page(HTMLParser):
    """Collects the wanted texts in one walk over a page."""

    def __init__(self, layout: Layout):
        super().__init__(convert_charrefs=True)
        self.layout = layout
        self.open: list[tuple[str, dict]] = []
        self.links: list[str] = []
        self.title: list[str] = []
        self.date: list[str] | None = None
        self.date_open = False
        self.paragraphs: list[list[str]] = []
        self.in_paragraph = False
        self.table_text: list[str] = []
        self.table_link: str | None = None
        self.tables = 0

    def _inside(self, tag: str) -> bool:
        return any(t == tag for t, _ in self.open)

    def _in_body(self) -> bool:
        wanted = self.layout.body_id
        return wanted is None or any(a.get("id") == wanted for _, a in self.open)

    def handle_starttag(self, tag, attrs):
        found = {k: v or "" for k, v in attrs}
        if tag not in _VOID:
            self.open.append((tag, found))
        if tag == "a" and "href" in found:
            self.links.append(found["href"])
            if self.table_link is None and self.tables == 1 and self._in_body() and self._inside("table"):
                self.table_link = found["href"]
        elif tag == "table" and self._in_body():
            self.tables += 1
        elif tag == "span" and self.date is None and found.get("class") in self.layout.date_classes:
            self.date, self.date_open = [], True
        elif tag == "p":
            wanted = self.layout.paragraph_class
            self.in_paragraph = self._in_body() and (wanted is None or wanted in found.get("class", "").split())
            if self.in_paragraph:
                self.paragraphs.append([])

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        if tag == "p":
            self.in_paragraph = False
        elif tag == "span":
            self.date_open = False

    def handle_data(self, data):
        if any(t in _HIDDEN for t, _ in self.open):
            return
        text = data.strip()
        if not text:
            return
        if self._inside("title"):
            self.title.append(text)
        if self.date_open:
            self.date.append(text)
        if self.tables == 1 and self._inside("table") and self._in_body():
            self.table_text.append(text)
        if self.in_paragraph and self._inside("p"):
            self.paragraphs[-1].append(text)

    def row(self) -> tuple:
        attached = self.layout.attachment_words in " ".join(self.table_text) and self.table_link is not None
        body = " ".join(" ".join(p) for p in self.paragraphs if p)
        return (
            " ".join(self.title),
            self.links,
            "".join(self.date) if self.date is not None else None,
            attached,
            None if attached else body,
            self.table_link if attached else None,
        )


def extract_articles(pages: DataFrame, layout: Layout | None = None, html: str = "html") -> DataFrame:
    """Add title, links, date text, PDF flag, joined paragraphs and PDF link to each page.

    A page that can't be read to its end keeps what was read; ``problem`` says why.
    """
    layout = layout or Layout()
    schema = "title string, links array<string>, date string, is_pdf boolean, content string, pdf_link string, problem string"

    @F.pandas_udf(schema)
    def read_page(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                page, problem = _Page(layout), None
                try:
                    page.feed(text or "")
                    page.close()
                except (AssertionError, ValueError) as error:  # what the parser raises on broken markup
                    problem = str(error)
                rows.append((*page.row(), problem))
            yield pd.DataFrame(rows, columns=["title", "links", "date", "is_pdf", "content", "pdf_link", "problem"])

    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, read_page(html).alias("_a")).select(*keep, "_a.*")


def article_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row per link, in page order, with built-in functions only."""
    found = F.regexp_extract_all(html, F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "link"))
