"""The partner directory as a table of versions (:mod:`tidewindow.plans.versions`), its rows in buckets by bank.

A scrape or a refresh reads and writes the buckets of the banks that it has rows of; the
files of all others stay as they are. Numbering is within a bank, so no step needs more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewindow.operators.directory import merge_directory, upsert_rates
from tidewindow.plans.versions import VersionedTable

DIRECTORY = "bank string, bucket string, name string, ratio string, ord bigint"


def directory_versions(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, DIRECTORY, "bank")


def merge_scraped(scraped: DataFrame, path: str) -> list[int]:
    """Scraped rows into the directory at ``path``, as :func:`~tidewindow.operators.directory.merge_directory` merges them; the buckets that changed."""
    return directory_versions(scraped.sparkSession, path).merge(scraped.select("bank"), lambda held: merge_directory(held, scraped))


def upsert_seen(seen: DataFrame, path: str) -> list[int]:
    """Rates that were seen (bank, name, ratio or null, ord) into the directory at ``path``; the buckets that changed."""
    return directory_versions(seen.sparkSession, path).merge(seen.select("bank"), lambda held: upsert_rates(held, seen))
