"""Listing pages (url, html, and ``page``, their order) to raw bonuses and raw windows.

Raw bonuses: ``ord, source, bankName, partnerName, pct, endDateRaw, sourceUrl``. Raw
windows: ``ord, source, bankName, partnerName, pct, startDateRaw, endDateRaw``. A source is
anything with ``id`` and ``parse(pages)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.functions.dates import deadline_day, stripped
from tidewindow.sources import html
from tidewindow.sources.objects import json_nodes

#: An ``ord`` has a page's place from PAGE_BITS on, an item's from ITEM_BITS on, and below that a part's: a million
#: pages of a million items of 1,024 parts, in 50 bits.
PAGE_BITS, ITEM_BITS = 30, 10

# How the listings word a bonus.
DETAILS = r"(?i)(\d+)%\s*transfer bonus\s+from\s+(.+?)\s+to\s+(.+)"
TARGETED = r"(?i)\[\s*targeted\s*\]"
GRID_PCT = r"(\d+(?:\.\d+)?)\s*%"
GRID_DATE = r"[A-Z][a-z]+\.?\s+\d{1,2},?\s+\d{4}"
BONUS = r"(?iu)(\d+(?:[.,]\d+)?)\s*%\s*de\s*b[oô]nus"
PRODUCT_LINK = r"(?i)/livelo-para-parceiros/([a-z0-9-]+)/"
UNTIL = r"(?iu)\bat[ée]\s+(?:as\s+\d{1,2}h\d{0,2}\s+d[oe]\s+dia\s+)?(\d{1,2}/\d{1,2})\b"
TO_WHOM = r"(?iu)\bpara\s+(?:o|a|os|as)\s+(.+?)\s*$"
BANNER_END = r"(?iu)s[óo]\s+at[ée]\s+(\d{1,2}/\d{1,2}(?:/\d{2,4})?)"
BANNER_BRAND = r"(?iu)a\s+marca\s+(?:d[aeo]s?\s+)?(.+?)\s+e\s+o\s+bot[ãa]o"
TRANSFER = r"(?iu)transferir|transfira|transfer[êe]ncia"


class Source(Protocol):
    id: str

    def parse(self, pages: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Listing:
    """A source: its id and its parser."""

    id: str
    parser: Callable[[DataFrame, str], DataFrame]

    def parse(self, pages: DataFrame) -> DataFrame:
        return self.parser(pages, self.id)


def _exploded(pages: DataFrame, items: Column) -> DataFrame:
    rows = pages.select("page", "url", items.alias("items"))
    rows = rows.select("page", "url", F.posexplode("items").alias("at", "x"))
    return rows.withColumn("ord", F.shiftleft(F.col("page").cast("bigint"), PAGE_BITS) + F.shiftleft(F.col("at").cast("bigint"), ITEM_BITS))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _first_of(rows: DataFrame, *key: str) -> DataFrame:
    """The first row of each key, per page."""
    order = Window.partitionBy("page", *key).orderBy("ord")
    return rows.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def _bonuses(rows: DataFrame, source: str) -> DataFrame:
    return rows.select("ord", F.lit(source).alias("source"), "bankName", "partnerName", "pct", "endDateRaw", F.col("url").alias("sourceUrl"))


def table_bonuses(pages: DataFrame, source: str) -> DataFrame:
    """Rows of the current-bonus table with a bank, a readable bonus and an end date."""
    rows = _exploded(pages, html.current_rows("html")).filter(F.size("x.text") >= 4)
    details = stripped(F.col("x.text")[1])
    rows = rows.withColumns({"bankName": F.col("x.text")[0], "partnerName": stripped(F.regexp_extract(details, DETAILS, 3)), "pct": F.regexp_extract(details, DETAILS, 1).try_cast("double"), "endDateRaw": F.col("x.bare")[3]})
    return _bonuses(rows.filter("pct is not null and bankName <> '' and endDateRaw <> ''"), source)


def table_archive(pages: DataFrame, source: str) -> DataFrame:
    """Rows of the archive table; targeted and other promotions are left out."""
    rows = _exploded(pages, html.archive_rows("html")).filter(F.size("x.bare") >= 4)
    details = F.col("x.bare")[1]
    rows = rows.filter(~details.rlike(TARGETED)).withColumn("pct", F.regexp_extract(details, DETAILS, 1).try_cast("double")).filter("pct is not null")
    return rows.select("ord", F.lit(source).alias("source"), F.col("x.bare")[0].alias("bankName"), stripped(F.regexp_extract(details, DETAILS, 3)).alias("partnerName"), "pct", F.col("x.bare")[2].alias("startDateRaw"), F.col("x.bare")[3].alias("endDateRaw"))


def grid_bonuses(pages: DataFrame, source: str) -> DataFrame:
    """Rows of the bonus grid; the end date is the first one behind the first percentage."""
    rows = _exploded(pages, html.grid_rows("html"))
    bonus = F.col("x.bonus")
    end = F.regexp_extract(F.regexp_extract(bonus, rf"(?s)^.*?{GRID_PCT}(.*)$", 2), GRID_DATE, 0)
    rows = rows.withColumns({"bankName": F.col("x.from"), "partnerName": F.col("x.to"), "pct": F.regexp_extract(bonus, GRID_PCT, 1).try_cast("double"), "endDateRaw": F.regexp_replace(end, r"\s+", " ")})
    return _bonuses(rows.filter("pct is not null and bankName <> '' and partnerName <> '' and endDateRaw <> ''"), source)


def next_data(page: Column) -> Column:
    """The JSON that a page carries in its data script; empty if it has none."""
    return F.regexp_extract(page, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)


def title_case(slug: Column) -> Column:
    return F.array_join(F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def offer_bonuses(pages: DataFrame, source: str, bank: str = "Livelo") -> DataFrame:
    """Offers in embedded JSON: nodes with ``status.variations``; undated offers stay, with an empty end date."""
    kind = "status struct<variations:array<struct<status:string,title:string,description:string,button:struct<redirectLink:string>>>>, countdown struct<endDate:string>"
    rows = _exploded(pages, json_nodes(next_data(F.col("html")), "status.variations"))
    rows = rows.withColumn("node", F.from_json("x", kind)).filter("node.status.variations is not null")
    rows = rows.select("page", "url", F.col("ord").alias("node_at"), F.col("node.countdown.endDate").alias("deadline"), F.posexplode("node.status.variations").alias("k", "v"))
    rows = rows.withColumn("ord", F.col("node_at") + F.col("k"))
    title, link = F.coalesce("v.title", F.lit("")), F.coalesce("v.button.redirectLink", F.lit(""))
    text = F.regexp_replace(F.concat(title, F.lit(" "), F.coalesce("v.description", F.lit(""))), r"<[^>]+>", " ")
    rows = rows.filter(F.col("v.status").isNull() | (F.col("v.status") == "") | F.col("v.status").rlike("(?i)vigente"))
    rows = rows.withColumns({"slug": F.nullif(F.regexp_extract(link, PRODUCT_LINK, 1), F.lit("")), "words": text, "title": title})
    rows = rows.filter(F.col("slug").isNotNull() | F.col("words").rlike("(?i)transfer"))
    partner = F.coalesce(title_case(F.col("slug")), F.trim(F.regexp_extract("title", TO_WHOM, 1)))
    due = deadline_day(F.coalesce("deadline", F.lit("")))
    rows = rows.withColumns({"bankName": F.lit(bank), "partnerName": partner, "pct": _number(F.regexp_extract("words", BONUS, 1)), "endDateRaw": F.when(due != "", due).otherwise(F.regexp_extract("words", UNTIL, 1))})
    return _bonuses(_first_of(rows.filter("pct is not null and partnerName <> ''"), "partnerName", "pct"), source)


def banner_bonuses(pages: DataFrame, source: str, bank: str = "Esfera") -> DataFrame:
    """Image descriptions that tell of a transfer bonus and its end date."""
    rows = _exploded(pages, html.images("html"))
    alt = F.col("x.alt")
    rows = rows.filter(alt.rlike(BONUS) & alt.rlike(TRANSFER))
    brand = F.trim(F.regexp_extract(alt, BANNER_BRAND, 1))
    slug = F.coalesce(F.replace(F.get(F.split("x.href", "/"), F.lit(2)), F.lit("-"), F.lit(" ")), F.lit(""))
    rows = rows.withColumns({"bankName": F.lit(bank), "partnerName": F.when(brand != "", brand).otherwise(slug), "pctRaw": F.regexp_extract(alt, BONUS, 1), "endDateRaw": F.regexp_extract(alt, BANNER_END, 1)})
    rows = rows.filter("partnerName <> '' and endDateRaw <> ''").withColumn("pct", _number(F.col("pctRaw")))
    return _bonuses(_first_of(rows, "partnerName", "pctRaw", "endDateRaw"), source)


BONUS_TABLE = Listing("table", table_bonuses)
BONUS_GRID = Listing("grid", grid_bonuses)
OFFERS = Listing("offers", offer_bonuses)
BANNERS = Listing("banners", banner_bonuses)
SOURCES: tuple[Source, ...] = (BONUS_TABLE, BONUS_GRID, OFFERS, BANNERS)
