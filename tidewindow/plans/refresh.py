"""The weekly refresh of the partner directory, and the check of a document on disk."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewindow.operators.directory import NOT_TRAVEL, canonical, fold_names, upsert_rates
from tidewindow.operators.validate import FEED_KEYS, ROUTE_KEYS, ROUTE_NEEDED, feed_violations, key_violations, partner_violations
from tidewindow.plans.publish import ROUTE, directory_json, directory_table, partner_tables, read_json, write_json
from tidewindow.sources.rates import page_partner, page_ratios


def refresh_directory(directory: DataFrame, pages: DataFrame, now: date) -> DataFrame:
    """``directory`` on canonical names with the rates of partner pages (page, bank, name or null, html) upserted.

    ``page`` is a page's place in the order; of pages of one name the last one's rate holds.
    A page without a name is named by its title; one that has none is an unpublished shell
    and goes. Columns: bank, bucket, name, ratio, ord, change. Write it if any row changed:
    names that were folded alone are no reason to.
    """
    named = pages.withColumn("raw", F.coalesce("name", page_partner(F.col("html")))).filter(F.col("raw").isNotNull() & ~F.col("raw").rlike(NOT_TRAVEL))
    named = named.withColumn("name", canonical(named, "raw"))
    ratios = page_ratios(named.select(F.col("page").alias("k"), "bank", "html"), F.lit(now)).withColumnRenamed("k", "page")
    seen = named.select("page", "bank", "name").join(ratios, "page", "left").select("bank", "name", "ratio", F.col("page").alias("ord"))
    return upsert_rates(fold_names(directory), seen)


def write_refreshed(spark: SparkSession, path: str, pages: DataFrame, now: date, *, dry: bool = False) -> list[Row]:
    """Refreshes the directory in the partner document at ``path``; returns the changed rows (bank, name, ratio, change).

    Nothing is written if none changed, or with ``dry``. The document is one of a few rows a
    bank and partner, as all that is published.
    """
    doc = read_json(path)
    refreshed = refresh_directory(directory_table(spark, doc), pages, now).cache()
    try:
        rows = refreshed.filter("change is not null").select("bank", "name", "ratio", "change").orderBy("bank", "name").collect()
        if rows and not dry:
            write_json(doc | {"directory": directory_json(refreshed)}, path)
    finally:
        refreshed.unpersist()
    return rows


def changed(refreshed: DataFrame) -> bool:
    return not refreshed.filter("change is not null").isEmpty()


def document_violations(spark: SparkSession, text: str, schema: str = "feed") -> DataFrame:
    """``subject, rule`` of a feed or partner document; a text that is no JSON object breaks one rule."""
    try:
        doc = json.loads(text)
    except ValueError:
        doc = None
    if not isinstance(doc, dict):
        return spark.createDataFrame([(schema, "not a JSON object")], "subject string, rule string")
    if schema == "partners":
        return partner_violations(partner_tables(spark, doc))
    lines = spark.createDataFrame([(f"routes[{k}]", json.dumps(r)) for k, r in enumerate(doc.get("routes", []))], "subject string, json string")
    top = key_violations(spark.createDataFrame([("feed", text)], "subject string, json string"), FEED_KEYS, FEED_KEYS)
    routes = lines.select(F.from_json("json", ROUTE).alias("r")).select("r.*")
    return top.unionByName(key_violations(lines, ROUTE_NEEDED, ROUTE_KEYS)).unionByName(feed_violations(routes))
