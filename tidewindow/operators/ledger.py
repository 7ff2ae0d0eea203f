"""The ledger of observed windows: a day's sightings folded into entries.

An active route continues its first entry that was seen at most GAP days ago and whose end
date has not passed; else it opens an entry. An entry keeps its highest pct, takes the end
date published last (which may shorten it), and never changes its ``pred`` stamp.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.functions.dates import month_index
from tidewindow.operators.windows import uncovered

#: Fixed value: days after which a route that comes back is a new window.
GAP = 7
PRED = "struct<p2:double,w1:double,absent:boolean,asOf:date>"
ENTRY = f"ord bigint, id string, bank string, code string, pct double, firstSeen date, lastSeen date, endDate date, pred {PRED}"


def effective_end(end: Column, first: Column, last: Column) -> Column:
    """The published end if it isn't before the first day, else the last day seen."""
    return F.when(end >= first, end).otherwise(last)


def stamps(previous: DataFrame | None, as_of: date | None, today: date) -> DataFrame | None:
    """``id, pred`` of the previous feed's routes: what it said of this month's and next month's chance."""
    if previous is None or as_of is None:
        return None
    pred = F.struct(F.col("p2")[today.month - 1].cast("double").alias("p2"), F.col("wait")[0].cast("double").alias("w1"), F.lit(None).cast("boolean").alias("absent"), F.lit(as_of).alias("asOf"))
    return previous.select("id", pred.alias("pred"))


def update_ledger(ledger: DataFrame, active: DataFrame, today: date, *, previous: DataFrame | None = None, as_of: date | None = None) -> DataFrame:
    """One day's step. ``active``: ``id, bank, code, pct, endDate, pos``, a row a route. Pure: returns the new ledger.

    ``pred`` of new entries is null without a previous feed, and says ``absent`` for routes that it lacks.
    """
    day = F.lit(today)
    can = (F.datediff(day, "lastSeen") <= GAP) & ~F.coalesce(F.col("endDate") < day, F.lit(False))
    hits = ledger.filter(can).join(active.select("id"), "id", "left_semi").groupBy("id").agg(F.min("ord").alias("ord"))
    seen = hits.join(active.select("id", F.col("pct").alias("new_pct"), F.col("endDate").alias("new_end")), "id")
    kept = ledger.join(seen, ["id", "ord"], "left")
    hit = F.col("new_pct").isNotNull()
    kept = kept.select(
        "ord", "id", "bank", "code", F.greatest("pct", "new_pct").alias("pct"), "firstSeen", F.when(hit, F.greatest("lastSeen", day)).otherwise(F.col("lastSeen")).alias("lastSeen"),
        F.coalesce("new_end", "endDate").alias("endDate"), "pred",
    )
    fresh = active.join(hits.select("id"), "id", "left_anti")
    kind = "struct<p2:double,w1:double,absent:boolean,asOf:date>"
    said = stamps(previous, as_of, today)
    if said is None:
        fresh = fresh.withColumn("pred", F.lit(None).cast(kind))
    else:
        absent = F.struct(F.lit(None).cast("double").alias("p2"), F.lit(None).cast("double").alias("w1"), F.lit(True).alias("absent"), F.lit(as_of).alias("asOf"))
        fresh = fresh.join(said, "id", "left").withColumn("pred", F.coalesce("pred", absent))
    last = ledger.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))  # one row
    fresh = fresh.join(F.broadcast(last)).select((F.col("last") + 1 + F.col("pos")).alias("ord"), "id", "bank", "code", "pct", day.alias("firstSeen"), day.alias("lastSeen"), "endDate", "pred")
    return kept.unionByName(fresh)


def without_repeats(ledger: DataFrame) -> DataFrame:
    """One entry for each route, first day and end date, the earliest, so that the first ``pred`` survives."""
    order = Window.partitionBy("id", "firstSeen", "endDate").orderBy("ord")
    return ledger.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def replay(sightings: DataFrame, *, gap: int = GAP) -> DataFrame:
    """The ledger after many days of sightings (id, day, pct, endDate): ``id, firstSeen, lastSeen, pct, endDate``.

    Sightings are reduced to one a route and day first. Days ascend, so only a route's last
    entry can go on, and window functions tell where one ends: first by a gap of more than
    ``gap`` days, which makes runs, then by the end date published last in its run. Such a
    date ends one entry, on the first day after it; an entry opened since has none before
    it publishes its own.
    """
    daily = sightings.groupBy("id", "day").agg(F.max("pct").alias("pct"), F.max_by("endDate", F.struct("pct", "endDate")).alias("endDate"))
    order = Window.partitionBy("id").orderBy("day")
    runs = daily.withColumn("run", F.sum(F.when(F.datediff("day", F.lag("day").over(order)) <= gap, 0).otherwise(1)).over(order))
    inside = Window.partitionBy("id", "run").orderBy("day")
    published = F.last("endDate", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumns({"published": published, "day_before": F.lag("day").over(inside), "end_before": F.lag("endDate").over(inside)})
    passed = (F.col("published") < F.col("day")) & (F.col("end_before").isNotNull() | (F.col("day_before") <= F.col("published")))
    entries = runs.withColumn("entry", F.sum(F.when(passed, 1).otherwise(0)).over(inside)).groupBy("id", "run", "entry")
    last_end = F.max_by("endDate", F.when(F.col("endDate").isNotNull(), F.col("day")))
    return entries.agg(F.min("day").alias("firstSeen"), F.max("day").alias("lastSeen"), F.max("pct").alias("pct"), last_end.alias("endDate")).drop("run", "entry")


def runs_of_days(sightings: DataFrame, *, gap: int = GAP) -> DataFrame:
    """:func:`replay` for sightings without end dates: ``id, firstSeen, lastSeen, pct``."""
    daily = sightings.groupBy("id", "day").agg(F.max("pct").alias("pct"))
    order = Window.partitionBy("id").orderBy("day")
    opens = F.when(F.datediff("day", F.lag("day").over(order)) <= gap, 0).otherwise(1)
    runs = daily.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    return runs.groupBy("id", "run").agg(F.min("day").alias("firstSeen"), F.max("day").alias("lastSeen"), F.max("pct").alias("pct")).drop("run")


def ledger_windows(ledger: DataFrame, archive: DataFrame) -> DataFrame:
    """Entries as windows (id, bank, code, start, end, pct, ord), without those that ``archive`` covers on a day."""
    rows = ledger.select("id", "bank", "code", F.col("firstSeen").alias("start"), effective_end(F.col("endDate"), F.col("firstSeen"), F.col("lastSeen")).alias("end"), "pct", "ord")
    rows = uncovered(rows, archive)
    return rows.withColumns({"s": month_index(F.col("start")), "e": month_index(F.col("end"))})
