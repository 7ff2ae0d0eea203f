"""Walk-forward evaluation of forecasts: rows, scores, calibration and a clustered bootstrap.

All cutoffs run in one plan, keyed by (now, id). The bootstrap resamples clusters from
their sufficient statistics, never from rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.functions.dates import month_index
from tidewindow.functions.numbers import uniform_draw
from tidewindow.functions.shared import numbered, written
from tidewindow.operators.forecast import finished, masses


def month_starts(first: date, last: date) -> list[date]:
    """The first day of every month from ``first`` to ``last``."""
    return [date(m // 12, m % 12 + 1, 1) for m in range(first.year * 12 + first.month - 1, last.year * 12 + last.month)]


def climatology(windows: DataFrame, cutoffs: list[date]) -> DataFrame:
    """``now, id, clim``: of windows that had ended, the share of a route's observed two-month stretches with one, unweighted; one half if there are none."""
    return masses(windows, cutoffs, only_ended=True).select("now", "id", _climate().alias("clim"))


def _climate() -> Column:
    return F.when(F.col("plain.n") > 0, F.col("plain.k") / F.col("plain.n")).otherwise(0.5)


def eval_rows(windows: DataFrame, cutoffs: list[date]) -> DataFrame:
    """``id, cut, year, nTrain, ship, clim, y``: what would have been shown at each cutoff, and what came.

    Trains on windows that had ended; leaves out routes without ``next`` and those live at
    the cutoff; the outcome is a window, of all, in one of the two months after.
    """
    shown = finished(masses(windows, cutoffs, only_ended=True), keep=("plain",)).filter("next is not null").withColumns({"cut": month_index(F.col("now")), "clim": _climate()})
    # a window is live at, or follows, the cutoffs of a few months: it says so itself, without a range join
    touched = windows.select("id", F.explode(F.sequence(F.col("s") - 2, F.col("e"))).alias("cut"), "s", "e")
    seen = touched.groupBy("id", "cut").agg(
        F.max((F.col("s") <= F.col("cut")) & (F.col("e") >= F.col("cut"))).alias("live"),
        F.max((F.col("s") <= F.col("cut") + 2) & (F.col("e") >= F.col("cut") + 1)).alias("came"),
    )
    rows = shown.join(seen, ["id", "cut"], "left").filter("not coalesce(live, false)")
    ship = F.element_at("p2", (F.pmod(F.col("cut") + 1, F.lit(12)) + 1).cast("int"))
    return rows.select("id", "cut", F.floor(F.col("cut") / 12).cast("int").alias("year"), F.col("n").cast("int").alias("nTrain"), ship.alias("ship"), "clim", F.coalesce("came", F.lit(False)).cast("int").alias("y"))


def squared(p: str) -> Column:
    return F.pow(F.col(p) - F.col("y"), 2)


def brier(p: str) -> Column:
    return F.avg(squared(p))


def log_loss(p: str) -> Column:
    q = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col(p)))
    return F.avg(-F.when(F.col("y") == 1, F.log(q)).otherwise(F.log(1 - q)))


def scores(rows: DataFrame, by: list[str] | None = None, *, key: str = "ship", ref: str = "clim") -> DataFrame:
    """Rows, Brier and log scores of both forecasts, and the skill in per cent, in all or by groups."""
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), brier(key).alias("brier"), brier(ref).alias("brier_ref"), log_loss(key).alias("log_loss"), log_loss(ref).alias("log_loss_ref"))
    return out.withColumn("skill_pct", F.when(F.col("brier_ref") != 0, (1 - F.try_divide("brier", "brier_ref")) * 100))


def by_thickness(rows: DataFrame) -> DataFrame:
    """Scores of routes with fewer than four training windows, and of the others."""
    return scores(rows.withColumn("thin", F.col("nTrain") < 4), ["thin"])


def worst_misses(rows: DataFrame, *, over: float = 0.6, most: int = 8, key: str = "ship") -> DataFrame:
    """The largest errors above ``over``, ``most`` of them: a report."""
    miss = F.abs(F.col(key) - F.col("y"))
    return rows.withColumn("miss", miss).filter(F.col("miss") > over).orderBy(F.desc("miss"), "id", "cut").limit(most)


def calibration(rows: DataFrame, key: str = "ship") -> DataFrame:
    """``bin, n, meanP, observed`` for tenths with rows; the last tenth holds 1 too. Bounds are b / 10 as doubles."""
    bins = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(b / 10).alias("lo"), F.lit((b + 1) / 10).alias("hi")) for b in range(10)))
    p = F.col(key)
    mine = F.filter(bins, lambda x: (p >= x["lo"]) & ((p < x["hi"]) | ((x["b"] == 9) & (p <= 1))))
    out = rows.withColumn("b", F.get(mine, F.lit(0))["b"]).filter("b is not null").groupBy("b").agg(F.count("*").alias("n"), F.avg(p).alias("meanP"), F.avg(F.col("y").cast("double")).alias("observed"))
    name = F.concat((F.col("b") * 10).cast("string"), F.lit("-"), ((F.col("b") + 1) * 10).cast("string"), F.lit("%"))
    return out.select("b", name.alias("bin"), "n", "meanP", "observed")


def effective_events(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """``positiveRows, distinctWindows, rowsPerWindow``: the real windows behind rows with y = 1; a row counts for the first window, in their order, that meets it."""
    ones = rows.filter("y = 1").select("id", "cut")
    spread = windows.select("id", "s", "ord", F.explode(F.sequence(F.col("s") - 2, F.col("e") - 1)).alias("cut"))
    first = ones.join(spread, ["id", "cut"]).groupBy("id", "cut").agg(F.min_by("s", "ord").alias("s"))
    counted = first.agg(F.count("*").alias("rows"), F.count_distinct("id", "s").alias("distinctWindows"))
    per = F.when(F.col("distinctWindows") > 0, F.try_divide("rows", "distinctWindows")).otherwise(0.0)
    return ones.agg(F.count("*").alias("positiveRows")).join(F.broadcast(counted)).select("positiveRows", "distinctWindows", per.alias("rowsPerWindow"))


def clusters(rows: DataFrame, by: str, *, key: str = "ship", ref: str = "clim") -> DataFrame:
    """``g, e_key, e_ref, n``: sums for each cluster, numbered from 0 in order of its first row (cut, id).

    The sums are written before they are numbered, as range partitioning reads its input twice.
    """
    sums = rows.groupBy(by).agg(F.sum(squared(key)).alias("e_key"), F.sum(squared(ref)).alias("e_ref"), F.count("*").alias("n"), F.min(F.struct("cut", "id")).alias("at"))
    return numbered(written(sums, "clusters"), "at", "g").select("g", "e_key", "e_ref", "n")


def bootstrap_delta(rows: DataFrame, *, by: str = "cut", key: str = "ship", ref: str = "clim", reps: int = 2000, seed: int = 42) -> DataFrame:
    """One row ``delta, lo, hi, pNeg, clusters``: the gain in Brier score over ``ref`` and its 95 % interval when whole clusters are drawn.

    Draw i of the generator is a function of i, so all draws are columns of one range; each
    is joined to its cluster's sums, and replicates are sums of those. Without rows there are
    no clusters and no draws: ``pNeg`` is not a number, ``delta``, ``lo`` and ``hi`` are null.
    """
    spark = rows.sparkSession
    g = clusters(rows, by, key=key, ref=ref)
    size = g.agg(F.count("*").alias("G"), (F.sum("e_ref") / F.sum("n") - F.sum("e_key") / F.sum("n")).alias("delta"))
    slots = spark.range(reps).withColumnRenamed("id", "rep").join(F.broadcast(size)).filter("G > 0").select("rep", "G", F.explode(F.sequence(F.lit(0), F.col("G") - 1)).alias("j"))
    drawn = slots.select("rep", F.floor(uniform_draw(seed, F.col("rep") * F.col("G") + F.col("j") + 1) * F.col("G")).cast("int").alias("g"))
    draws = drawn.join(g, "g").groupBy("rep").agg((F.sum("e_ref") / F.sum("n") - F.sum("e_key") / F.sum("n")).alias("d"))
    low, high = int(reps * 0.025), int(reps * 0.975)
    below = F.when(F.count("*") > 0, F.sum((F.col("d") <= 0).cast("int")) / F.count("*")).otherwise(float("nan"))
    ordered = draws.agg(F.sort_array(F.collect_list("d")).alias("d"), below.alias("pNeg"))  # as long as `reps`
    return ordered.join(F.broadcast(size)).select("delta", F.get("d", F.lit(low)).alias("lo"), F.get("d", F.lit(high)).alias("hi"), "pNeg", F.col("G").cast("int").alias("clusters"))


def route_sizes(windows: DataFrame) -> DataFrame:
    """``lo, mid, hi``: windows a route, least, upper median and most."""
    sizes = windows.groupBy("id").agg(F.count("*").alias("n"))
    rank = sizes.groupBy("n").agg(F.count("*").alias("c"))  # one row a size
    total = F.sum("c").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = F.sum("c").over(Window.orderBy("n"))
    ranked = rank.select("n", upto.alias("upto"), total.alias("total"))
    return ranked.agg(F.min("n").alias("lo"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n"))).alias("mid"), F.max("n").alias("hi"))
