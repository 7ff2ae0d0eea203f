"""Tables, grids and images of listing pages, for Arrow UDFs.

Spark has no HTML reader, so this alone is Python; the rows it gives are typed and matched
with Spark functions.

A page is scanned once, with the open elements on a stack of its own: elements are numbered
in the order in which they start, so those inside one are a range of numbers, and its text
a range of text pieces. Nothing recurses, so a page may nest or leave open as many tags as
it likes. Of elements of one name or class that stand in each other, NESTED are found; what
is deeper only counts as their text, so that no page takes more than linear time. A page
that the scanner gives up on (a broken declaration) ends there.
"""

from __future__ import annotations

import contextlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
_CLOSES = {"tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "li": {"li"}, "option": {"option"}, "tbody": {"td", "th", "tr", "thead", "tbody"}}
_BLANK = "\t\n\x0b\x0c\r \xa0\ufeff"
#: Elements of one name, or of one class, within each other that are found.
NESTED = 64
_HEADINGS = tuple(f"h{k}" for k in range(1, 7))


class Page(HTMLParser):
    """A scanned page. Element 0 stands for the whole page."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.up, self.link = [""], [{}], [-1], [None]
        self.ends, self.text_at, self.text_end = [0], [0], [0]
        self.pieces: list[str] = []
        self.open, self.open_tags, self.open_classes = [0], Counter(), Counter()
        self.by_tag: dict[str, list[int]] = defaultdict(list)
        self.by_class: dict[str, list[int]] = defaultdict(list)
        with contextlib.suppress(AssertionError, ValueError):
            self.feed(html or "")
            self.close()
        while self.open:
            self._end()

    def _end(self) -> None:
        """Ends the innermost open element."""
        n = self.open.pop()
        self.ends[n], self.text_end[n] = len(self.tags), len(self.pieces)
        self.open_tags[self.tags[n]] -= 1
        self.open_classes.subtract(self._classes(n))

    def _classes(self, n: int) -> set[str]:
        return set(self.attrs[n].get("class", "").split())

    def handle_starttag(self, tag, attrs):
        while self.tags[self.open[-1]] in _CLOSES.get(tag, ()):
            self._end()
        n, parent = len(self.tags), self.open[-1]
        own = {k: v or "" for k, v in attrs}
        self.tags.append(tag)
        self.attrs.append(own)
        self.up.append(parent)
        self.link.append(own["href"] if tag == "a" and "/p/" in own.get("href", "") else self.link[parent])
        self.ends.append(n + 1)
        self.text_at.append(len(self.pieces))
        self.text_end.append(len(self.pieces))
        classes = self._classes(n)
        if self.open_tags[tag] < NESTED:
            self.by_tag[tag].append(n)
        for c in classes:
            if self.open_classes[c] < NESTED:
                self.by_class[c].append(n)
        if tag not in _VOID:
            self.open.append(n)
            self.open_tags[tag] += 1
            self.open_classes.update(classes)

    def handle_endtag(self, tag):
        if self.open_tags[tag] > 0:
            while self.tags[self.open[-1]] != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        self.pieces.append(data)

    def has(self, n: int, name: str) -> bool:
        return name in self._classes(n)

    def within(self, n: int, found: list[int]) -> list[int]:
        """Those of ``found``, in order, that stand inside an element."""
        return found[bisect_right(found, n) : bisect_left(found, self.ends[n])]

    def all(self, tag: str, n: int = 0) -> list[int]:
        return self.within(n, self.by_tag.get(tag, []))

    def marked(self, name: str, n: int = 0) -> list[int]:
        """Elements of a class inside an element."""
        return self.within(n, self.by_class.get(name, []))

    def text(self, n: int, *without: list[int]) -> str:
        """The text of an element, but for that of the elements in ``without``."""
        at, out = self.text_at[n], []
        for skipped in sorted({k for found in without for k in self.within(n, found)}):
            out += self.pieces[at : max(at, self.text_at[skipped])]
            at = max(at, self.text_end[skipped])
        return "".join(out + self.pieces[at : self.text_end[n]])

    def following(self, n: int) -> Iterator[int]:
        """Later siblings."""
        at, last = self.ends[n], self.ends[self.up[n]] if n else 0
        while at < last:
            yield at
            at = self.ends[at]


def _after_heading(page: Page, pattern: str) -> int | None:
    """The first table among the later siblings of the first heading that matches."""
    headings = sorted(n for h in _HEADINGS for n in page.all(h))
    heading = next((n for n in headings if re.search(pattern, page.text(n), re.I)), None)
    return None if heading is None else next((n for n in page.following(heading) if page.tags[n] == "table"), None)


def _cells(page: Page, row: int) -> list[int]:
    return sorted(page.all("td", row) + page.all("th", row))


def current_table(page: Page) -> int | None:
    """The table of current bonuses: by heading, by class, or by a header cell."""
    named = _after_heading(page, r"current\s+and\s+upcoming")
    if named is not None:
        return named
    tables = page.all("table")
    by_header = lambda t: "Transfer Bonus Details" in "".join(page.text(c) for r in page.all("tr", t)[:1] for c in _cells(page, r))
    return next((t for t in tables if page.has(t, "tablepress")), None) or next((t for t in tables if by_header(t)), None)


def archive_table(page: Page) -> int | None:
    """The table of past bonuses, never the current one: by heading, else the longest other."""
    now = current_table(page)
    named = _after_heading(page, r"expired|past\s+transfer|previous\s+transfer")
    if named is not None and named != now:
        return named
    others = [t for t in page.all("table") if page.has(t, "tablepress") and t != now]
    return max(others, key=lambda t: len(page.all("tr", t)), default=None)


def _rows(page: Page, table: int | None) -> list[dict]:
    """Cells of each row as (all text, text outside paragraphs)."""
    if table is None:
        return []
    out, paragraphs = [], page.by_tag.get("p", [])  # a hidden sort key stands in a paragraph
    for r in page.all("tr", table):
        if cells := page.all("td", r):
            out.append({"text": [page.text(c).strip(_BLANK) for c in cells], "bare": [page.text(c, paragraphs).strip(_BLANK) for c in cells]})
    return out


def _grid(page: Page) -> list[dict]:
    """Rows of the bonus grid: from, to, bonus."""
    at = next((n for n, own in enumerate(page.attrs) if own.get("id") == "Current_Transfer_Bonuses"), -1)
    while at > 0 and page.tags[at] != "h2":
        at = page.up[at]
    found = next((n for n in page.following(at) if page.has(n, "transfer-times")), None) if at > 0 else None
    found = found or next(iter(page.marked("transfer-times")), None)
    aside = [page.by_class.get(c, []) for c in ("tt-arrow", "tt-from-region", "tt-bonus")]
    squeeze = lambda s: re.sub(r"\s+", " ", s).strip()
    out = []
    for r in page.marked("tt-row", found) if found is not None else ():
        if page.marked("tt-body", r):
            cell = lambda c, *skip: squeeze("".join(page.text(n, *skip) for n in page.marked(c, r)))  # noqa: B023, E731
            out.append({"from": cell("tt-from", *aside), "to": cell("tt-to", *aside), "bonus": cell("tt-bonus")})
    return out


def _images(page: Page) -> list[dict]:
    """Images with a description, and the nearest link to a product page around them."""
    return [{"alt": page.attrs[n]["alt"], "href": page.link[n]} for n in page.all("img") if "alt" in page.attrs[n]]


def _directories(page: Page) -> list[dict]:
    """Directory tables: header cells, and the cells of each row."""
    cells = lambda parts, tag: [[page.text(c).strip(_BLANK) for c in page.all(tag, r)] for t in parts for r in page.all("tr", t)]
    out = []
    for t in page.all("table"):
        if page.has(t, "tablepress"):
            head = cells(page.all("thead", t), "th")
            out.append({"head": [c for r in head for c in r], "rows": cells(page.all("tbody", t), "td")})
    return out


def _udf(of: Callable[[Page], list], kind: str) -> Callable[[str], Column]:
    """The extraction as a function of a column of pages."""

    def column(page: str) -> Column:
        @F.pandas_udf(kind)
        def run(pages: pd.Series) -> pd.Series:
            return pages.map(lambda html: of(Page(html)))

        return run(page)

    return column


_ROW = "array<struct<text:array<string>,bare:array<string>>>"
current_rows = _udf(lambda page: _rows(page, current_table(page)), _ROW)
archive_rows = _udf(lambda page: _rows(page, archive_table(page)), _ROW)
grid_rows = _udf(_grid, "array<struct<from:string,to:string,bonus:string>>")
images = _udf(_images, "array<struct<alt:string,href:string>>")
directory_tables = _udf(_directories, "array<struct<head:array<string>,rows:array<array<string>>>>")
