"""Guards of a run, as rows: what each source gave, and whether a run may publish."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The share of sources that may fail, and the drop in routes that stops a run.
MOST_FAILED, CLIFF, CLIFF_FROM = 0.5, 0.5, 4


def source_report(rows: DataFrame, sources: Iterable[str]) -> DataFrame:
    """``source, entries, failed`` of every one of ``sources``, those without a row too: a source that gave nothing failed."""
    named = rows.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    counts = rows.groupBy("source").agg(F.count("*").alias("entries"))
    return named.join(counts, "source", "left").select("source", F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries"), F.col("entries").isNull().alias("failed"))


def verdict(report: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """One row ``sources, failed, had, routes, too_many_failed, fell, ok``: the run's sources, and its routes beside those published before.

    Stops a run of which more than MOST_FAILED of the sources failed, or whose routes fell
    below CLIFF of what was there, from CLIFF_FROM routes on.
    """
    counted = report.agg(F.count("*").alias("sources"), F.coalesce(F.sum(F.col("failed").cast("bigint")), F.lit(0)).alias("failed"))
    row = counted.join(F.broadcast(before.agg(F.count("*").alias("had")))).join(F.broadcast(now.agg(F.count("*").alias("routes"))))  # one row each
    row = row.withColumn("too_many_failed", F.col("failed") > MOST_FAILED * F.col("sources")).withColumn("fell", (F.col("had") >= CLIFF_FROM) & (F.col("routes") < CLIFF * F.col("had")))
    return row.withColumn("ok", ~F.col("too_many_failed") & ~F.col("fell"))
