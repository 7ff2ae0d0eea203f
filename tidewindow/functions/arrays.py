"""Helpers that keep plans small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def made_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with new columns that the optimizer computes once, however often later ones use them.

    Projections on top of each other are merged, and with them every use of a column gets
    a copy of its expression; a generator of one row in between stops that.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
