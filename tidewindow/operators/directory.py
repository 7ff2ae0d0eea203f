"""The partner directory: scraping, canonical names, merging and upserts.

A directory is ``bank, bucket (air or hotel), name, ratio, ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.functions.names import PARTNER_ALIASES, alias_map, display_name, resolved
from tidewindow.sources import html
from tidewindow.sources.listings import next_data
from tidewindow.sources.objects import json_nodes

# Columns of the directory table, what is no travel, what is a hotel, and hotel names.
COLUMNS = ("AMEX", "CHASE", "CITI", "C1", "BILT", "WF", "ROVE")
NOT_TRAVEL = "(?i)shop your way|dotz|seedz"
HOTEL = "(?i)hyatt|accor|hilton|ihg|marriott|wyndham|choice|preferred hotels|leading hotels|radisson"
HOTEL_NAMES = {
    "accor": "ALL Accor Live Limitless", "hilton": "Hilton Honors", "ihg": "IHG One Rewards", "marriott": "Marriott Bonvoy", "hyatt": "World of Hyatt",
    "wyndham": "Wyndham Rewards", "choice": "Choice Privileges", "preferred hotels": "Preferred Hotels I Prefer", "leading hotels": "Leading Hotels Leaders Club",
}
UNKNOWN = "—"


def parse_ratio_cell(cell: Column) -> Column:
    """``1,000 to 800`` as ``1000:800``; a dash if it is no ratio."""
    p = r"(?i)([\d.,]+)\s*to\s*([\d.,]+)"
    return F.when(cell.rlike(p), F.concat_ws(":", *(F.replace(F.regexp_extract(cell, p, k), F.lit(","), F.lit("")) for k in (1, 2)))).otherwise(UNKNOWN)


def canonical(df: DataFrame, name: str) -> Column:
    """The name shown for a tracked partner, else the hotel's, else the trimmed name."""
    n = F.col(name)
    out = display_name(resolved(n, alias_map(df.sparkSession, PARTNER_ALIASES)))
    hotel = F.lit(None).cast("string")
    for mark, shown in reversed(HOTEL_NAMES.items()):
        hotel = F.when(n.rlike(f"(?i){mark}"), F.lit(shown)).otherwise(hotel)
    return F.coalesce(out, hotel, F.trim(n))


def bucket(name: Column) -> Column:
    return F.when(name.rlike(HOTEL), "hotel").otherwise("air")


def first_rows(rows: DataFrame) -> DataFrame:
    """The first row of each bank, bucket and name."""
    order = Window.partitionBy("bank", "bucket", "name").orderBy("ord")
    return rows.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def table_directory(pages: DataFrame) -> DataFrame:
    """Direct-transfer tables, one column a bank, unpivoted; an empty cell is no partnership."""
    tables = pages.select("page", F.posexplode(html.directory_tables("html")).alias("t", "x"))
    head = F.col("x.head")
    tables = tables.filter(F.get(head, F.lit(0)).rlike("(?i)Rewards Program") & F.get(head, F.lit(1)).rlike("(?i)Transfer Ratio") & ~F.exists(head, lambda h: h.rlike("(?i)Indirect")))
    rows = tables.select("page", "t", F.posexplode("x.rows").alias("r", "cells")).withColumn("program", F.get("cells", F.lit(0)))
    rows = rows.filter((F.col("program") != "") & ~F.col("program").rlike(NOT_TRAVEL))
    rows = rows.select((F.shiftleft(F.col("page").cast("bigint"), 40) + F.shiftleft(F.col("t").cast("bigint"), 24) + F.col("r")).alias("ord"), "program", *(F.get("cells", F.lit(k + 1)).alias(b) for k, b in enumerate(COLUMNS)))
    cells = rows.unpivot(["ord", "program"], list(COLUMNS), "bank", "cell").filter("cell <> ''")
    named = cells.withColumn("name", canonical(cells, "program"))
    return first_rows(named.select("bank", bucket(F.col("program")).alias("bucket"), "name", parse_ratio_cell(F.col("cell")).alias("ratio"), "ord"))


def _named(rows: DataFrame, bank: str) -> DataFrame:
    rows = rows.filter((F.col("raw") != "") & ~F.col("raw").rlike(NOT_TRAVEL))
    rows = rows.withColumn("name", canonical(rows, "raw"))
    return first_rows(rows.select(F.lit(bank).alias("bank"), bucket(F.col("raw")).alias("bucket"), "name", F.lit(UNKNOWN).alias("ratio"), F.col("ord").cast("bigint").alias("ord")))


def list_directory(pages: DataFrame, bank: str = "LIV") -> DataFrame:
    """Active partners of the first ``listPartners`` in a page's data, without ratios."""
    kind = "listPartners array<struct<nomeParceiro:string,status:string>>"
    first = F.get(json_nodes(next_data(F.col("html")), "listPartners"), F.lit(0))
    rows = pages.select(F.posexplode(F.from_json(first, kind)["listPartners"]).alias("ord", "p")).filter("coalesce(p.status, '') in ('', 'Ativo')")
    return _named(rows.select("ord", F.col("p.nomeParceiro").alias("raw")), bank)


def menu_directory(pages: DataFrame, bank: str = "ESF") -> DataFrame:
    """Links to product pages in the menus of national and international partners."""
    kind = "mainItemLabel struct<title:string>, groupMenuItemsLinks array<struct<menuLink:struct<title:string,href:string>>>"
    nodes = pages.select(F.posexplode(json_nodes(next_data(F.col("html")), "groupMenuItemsLinks")).alias("at", "n")).withColumn("n", F.from_json("n", kind))
    nodes = nodes.filter(F.col("n.mainItemLabel.title").rlike("(?i)Parceiros (Nacionais|Internacionais)"))
    links = nodes.select("at", F.posexplode("n.groupMenuItemsLinks").alias("k", "g")).filter(F.col("g.menuLink.href").startswith("/p/"))
    return _named(links.select((F.col("at") * 10_000 + F.col("k")).alias("ord"), F.col("g.menuLink.title").alias("raw")), bank)


def in_order(rows: DataFrame) -> DataFrame:
    """``ord`` anew: by name as people sort, within bank and bucket."""
    order = Window.partitionBy("bank", "bucket").orderBy(F.collate("name", "UNICODE"))
    return rows.withColumn("ord", F.row_number().over(order).cast("bigint"))


def merge_directory(curated: DataFrame, scraped: DataFrame) -> DataFrame:
    """A bank with scraped rows gets those, with ratios that they lack from curated rows of the same
    canonical name; other banks keep their rows; banks that aren't curated are left out."""
    known = curated.select("bank").distinct()
    fresh = scraped.join(known, "bank", "left_semi")
    old = first_rows(curated.withColumns({"name": canonical(curated, "name"), "ord": -F.col("ord")})).select("bank", "bucket", "name", F.nullif("ratio", F.lit(UNKNOWN)).alias("old"))
    fresh = fresh.join(old, ["bank", "bucket", "name"], "left").withColumn("ratio", F.coalesce(F.nullif("ratio", F.lit(UNKNOWN)), "old", F.lit(UNKNOWN)))
    kept = curated.join(fresh.select("bank").distinct(), "bank", "left_anti")
    columns = ["bank", "bucket", "name", "ratio", "ord"]
    return in_order(fresh).select(*columns).unionByName(kept.select(*columns))


def fold_names(rows: DataFrame) -> DataFrame:
    """Rows of one canonical name as one; the first ratio that isn't a dash holds."""
    named = rows.withColumn("name", canonical(rows, "name"))
    known = F.col("ratio") != UNKNOWN
    out = named.groupBy("bank", "bucket", "name").agg(F.coalesce(F.min_by("ratio", F.when(known, F.col("ord"))), F.lit(UNKNOWN)).alias("ratio"))
    return in_order(out).select("bank", "bucket", "name", "ratio", "ord")


def upsert_rates(directory: DataFrame, seen: DataFrame) -> DataFrame:
    """``seen`` (bank, name, ratio or null, ord) into the directory: a new ratio replaces, a new name is added, nothing goes.

    Of several rows of a name the last by ``ord`` counts. ``change`` tells what happened: updated, added or null.
    """
    s = seen.groupBy("bank", "name").agg(F.max_by("ratio", "ord").alias("new"))
    both = directory.join(s, ["bank", "name"], "full_outer")
    change = F.when(F.col("ord").isNull(), "added").when(F.col("new") != F.col("ratio"), "updated")
    out = both.select("bank", F.coalesce("bucket", bucket(F.col("name"))).alias("bucket"), "name", F.coalesce("new", "ratio", F.lit(UNKNOWN)).alias("ratio"), F.coalesce("ord", F.lit(1 << 40)).alias("ord"), change.alias("change"))
    return in_order(out)
