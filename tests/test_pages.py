"""Pages of any depth: what is read from them, and what a bad one does to its neighbours."""

import time

import pytest

from tidewindow.sources import listings
from tidewindow.sources.html import NESTED, Page

ROW = "<tr><td>Citi</td><td>{n}% transfer bonus from Citi to Avianca</td><td>7/1/26</td><td><p>1</p>7/18/26</td></tr>"
TABLE = f'<table class="tablepress">{ROW.format(n=30)}{ROW.format(n=40)}</table>'
DEEP = 100_000


def frame(spark, pages):
    return spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page bigint, url string, html string")


def test_elements_are_ranges():
    page = Page('<div class="a b">one<p>two<b class=a>three</b><p>four</div>five<td>x<td>y</i>z')
    (div,), (p, q), (b,) = page.all("div"), page.all("p"), page.all("b")
    assert page.text(div) == "onetwothreefour" and page.text(p) == "twothree" and page.text(q) == "four"
    assert page.text(div, page.by_tag["p"]) == "one" and page.text(div, page.marked("a"), page.by_tag["p"]) == "one"
    assert page.marked("a") == [div, b] and page.marked("a", div) == [b] and page.has(div, "b") and not page.has(b, "b")
    assert [page.text(t) for t in page.all("td")] == ["x", "yz"] and page.text(0) == "onetwothreefourfivexyz"
    assert list(page.following(p)) == [q] and list(page.following(0)) == [] and Page(None).text(0) == ""


@pytest.mark.parametrize(
    ("name", "before", "after"),
    [
        ("unclosed", "<b>" * DEEP, ""),
        ("unclosed with classes", '<i class="tt-row tt-body tablepress">x' * DEEP, ""),
        ("closed", "<div>" * DEEP, "</div>" * DEEP),
        ("ends of nothing", "<b>" * DEEP + "</i>" * DEEP, ""),
        ("in a heading", "<h3>" + "<b>" * DEEP + "Current and upcoming" + "</b>" * DEEP + "</h3>", ""),
        ("many headings", "<h3>x<h2>y" * (DEEP // 2), ""),
        ("links", '<a href="/p/a">' * DEEP, ""),
        ("cells", "</table>", "<table><tr><td>x" * DEEP),
        ("broken declaration behind", "", "<![broken[" + "<" * DEEP),
    ],
)
def test_deep_pages_are_read(name, before, after):
    began = time.perf_counter()
    page = Page(before + TABLE + after)
    from tidewindow.sources import html

    assert [r["text"][1][:2] for r in html._rows(page, html.current_table(page))] == ["30", "40"]
    for read in (html._grid, html._images, html._directories, lambda p: html._rows(p, html.archive_table(p))):
        read(page)
    assert time.perf_counter() - began < 20


def test_nested_tables_are_found_to_a_depth():
    page = Page("<table><tr><td>x" * 1000)
    assert len(page.all("table")) == len(page.all("td")) == NESTED and page.text(page.all("td")[0]) == "x" * 1000
    assert len(Page("<table></table>" * 1000).all("table")) == 1000


def test_a_deep_page_leaves_its_neighbours_alone(spark):
    """Through every parser of a listing, in one batch."""
    banner = '<a href="/p/x/e1"><img alt="Ao transferir, 100% de bônus, só até 26/07 a marca da Azul e o botão"></a>'
    grid = '<div class="transfer-times"><div class="tt-row"><div class="tt-body"><div class="tt-from">Citi</div><div class="tt-to">Avianca<span class="tt-bonus">30% until July 18, 2026</span></div></div></div></div>'
    good = TABLE + banner + grid
    deep = "<b>" * (DEEP // 5)
    pages = frame(spark, [deep + good, good, "<![x[", None, "<table><tr><td>" * 2000, good + deep])
    assert [r["pct"] for r in listings.table_bonuses(pages, "t").orderBy("ord").collect()] == [30, 40] * 3
    assert [r["endDateRaw"] for r in listings.banner_bonuses(pages, "b").orderBy("ord").collect()] == ["26/07"] * 3
    assert [r["endDateRaw"] for r in listings.grid_bonuses(pages, "g").orderBy("ord").collect()] == ["July 18, 2026"] * 3
