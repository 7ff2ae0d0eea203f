"""The ledger as a table of versions (:mod:`tidewindow.plans.versions`), its entries in buckets by route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewindow.operators.ledger import ENTRY
from tidewindow.plans.versions import VersionedTable, changed_keys


def ledger_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, ENTRY, "id")


def read_entries(spark: SparkSession, path: str) -> tuple[bool, DataFrame]:
    """(usable, entries). Without a manifest: usable and empty; with one that can't be read: not to be used or replaced."""
    return ledger_table(spark, path).read()


def changed_entries(new: DataFrame, old: DataFrame) -> DataFrame:
    """``id`` of every route of which only one of two ledgers has an entry, or has it with other values."""
    return changed_keys(new, old, "id")


def write_entries(entries: DataFrame, path: str) -> list[int]:
    """Makes ``entries`` the ledger at ``path``; the buckets that were written anew, none if nothing changed."""
    return ledger_table(entries.sparkSession, path).write(entries)
