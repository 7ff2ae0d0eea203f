"""Labelled rows for the classifiers: a bounded sample, and the fold that is never learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: folds of the hold-out rule; fold 0 is held out.
FOLDS = 5


def fold(key: str | Column) -> Column:
    return F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("")).cast("binary")) % FOLDS


def held_out(key: str | Column) -> Column:
    return fold(key) == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, *, text: str = "text", key: str = "doc_id", most: int) -> DataFrame:
    """``id, t, y`` of at most ``most`` labelled rows outside the held-out fold, the first by a hash of the id.
    Of labels repeated for an id the highest counts; above 0 is 1.

    At most ``most`` ids and labels are broadcast; the documents are not shuffled.
    """
    chosen = labels.filter(~held_out(key) & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg((F.max(label) > 0).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(most)
    return docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen), "id")
