"""The readable text of HTML pages.

Tags are found by Python's tolerant parser. The title is what stands in the
first title element before the head ends; the body is the first of article,
main or body, without style, nav, video, canvas and script, and block tags
become a blank. The parser works on Arrow batches in Python workers, whose
cost is the page itself; the fields stay strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tag lists that decide the result; fixed values.
DROPPED = frozenset("style nav video canvas script".split())
BLANK = frozenset(
    """
address article aside blockquote canvas dd div dl fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr li main nav noscript ol output p pre section table tfoot ul video
tr td th br
""".split()
)
BODIES = ("article", "main", "body")
PAGE = T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())])


class _Cleaner(HTMLParser):
    """One pass: text goes to the title and to every body element that is open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.in_title = self.head_over = False
        self.dropping: str | None = None
        self.found: dict[str, list[str]] = {}
        self.open: set[str] = set()

    def put(self, text: str) -> None:
        if self.dropping is None:
            for name in self.open:
                self.found[name].append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.in_title and tag in BLANK:
            self.title.append(" ")
        if tag == "title" and self.title is None and not self.head_over:
            self.title, self.in_title = [], True
        if self.dropping is not None:
            return
        if tag in DROPPED:
            self.dropping = tag
            return
        if tag in BODIES and tag not in self.found:
            self.found[tag] = []
            self.open.add(tag)
        if tag in BLANK:
            self.put(" ")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if self.dropping == tag:
            self.dropping = None

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        elif self.in_title and tag in BLANK:
            self.title.append(" ")
        if tag == "head":
            self.head_over, self.in_title = True, False
        if self.dropping is not None:
            if tag == self.dropping:
                self.dropping = None
            return
        self.open.discard(tag)
        if tag in BLANK:
            self.put(" ")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        self.put(data)


def clean(html: str) -> tuple[str, str]:
    """Title and body."""
    parser = _Cleaner()
    parser.feed(html)
    parser.close()
    body = next((parser.found[n] for n in BODIES if n in parser.found), [])
    return "".join(parser.title or []), "".join(body)


@F.pandas_udf(PAGE)
def _clean(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in pages:
        yield pd.DataFrame([(None, None) if t is None else clean(t) for t in s], columns=["title", "body"])


def cleaned(html: Column) -> Column:
    """A struct of title and body; both null of a null page."""
    return _clean(html)


def clean_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with title and body in place of the markup."""
    made = pages.withColumn("_page", cleaned(F.col(html))).drop(html, "title", "body")
    return made.select("*", "_page.title", "_page.body").drop("_page")
