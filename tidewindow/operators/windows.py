"""Windows: from raw rows to typed intervals, and joins of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.functions.dates import month_index, parse_mdy
from tidewindow.functions.names import BANK_ALIASES, PARTNER_ALIASES, alias_map, resolved, route_id


def resolve_windows(raw: DataFrame, *, check_pct: bool = True) -> DataFrame:
    """Raw windows (bankName, partnerName, pct, startDateRaw, endDateRaw, ord) as ``id, bank, code, start, end, pct, s, e, ord``.

    Rows whose bank or partner is not known, whose dates don't parse or end before they
    start go without a trace; so do, unless ``check_pct`` is off, those without a positive pct.
    """
    spark = raw.sparkSession
    rows = raw.select(
        resolved(F.col("bankName"), alias_map(spark, BANK_ALIASES)).alias("bank"),
        resolved(F.col("partnerName"), alias_map(spark, PARTNER_ALIASES)).alias("code"),
        parse_mdy(F.col("startDateRaw")).alias("start"), parse_mdy(F.col("endDateRaw")).alias("end"), "pct", "ord",
    )
    rows = rows.filter("bank is not null and code is not null and start is not null and end is not null and end >= start")
    if check_pct:
        rows = rows.filter((F.col("pct") > 0) & ~F.isnan("pct") & (F.col("pct") < float("inf")))
    return rows.select(route_id(F.col("bank"), F.col("code")).alias("id"), "*", month_index(F.col("start")).alias("s"), month_index(F.col("end")).alias("e"))


def in_months(windows: DataFrame) -> DataFrame:
    """``windows`` with a row for each month ``m`` that a window touches, so that windows which share a day share a month."""
    return windows.withColumn("m", F.explode(F.sequence(month_index(F.col("start")), month_index(F.col("end")))))


def overlap_pairs(windows: DataFrame) -> DataFrame:
    """Pairs of windows of one route that share a day: ``id, a_start, a_end, b_start, b_end``, the earlier start first, of equal starts the lesser ``ord``.

    The later window of a pair is looked up in the month in which it starts, among windows
    that touch that month: a route with ever more windows is spread over its months, and
    each pair is met once.
    """
    columns = lambda p: [F.col(c).alias(f"{p}_{c}") for c in ("start", "end", "ord")]
    touched = in_months(windows.select("id", "start", "end", "ord")).select("id", "m", *columns("a"))
    starting = windows.select("id", month_index(F.col("start")).alias("m"), *columns("b"))
    earlier = (F.col("a_start") < F.col("b_start")) | ((F.col("a_start") == F.col("b_start")) & (F.col("a_ord") < F.col("b_ord")))
    pairs = touched.join(starting, ["id", "m"]).filter(earlier & (F.col("a_end") >= F.col("b_start")))
    return pairs.select("id", "a_start", "a_end", "b_start", "b_end")


def day_bits(m: Column, start: Column, end: Column) -> Column:
    """The days of month ``m`` from ``start`` to ``end``, as bits 1 to 31."""
    first = F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1))
    bit = lambda day: F.call_function("shiftleft", F.lit(1).cast("bigint"), day)
    return bit(F.dayofmonth(F.least(end, F.last_day(first))) + 1) - bit(F.dayofmonth(F.greatest(start, first)))


def uncovered(windows: DataFrame, archive: DataFrame) -> DataFrame:
    """``windows`` that share no day with a window of ``archive`` on the same route.

    The archive is summed up to the covered days of each route and month, as bits, so that
    a hot route has a row a month however many windows it has; of the windows, those whose
    days in some month meet them go.
    """
    bits = day_bits(F.col("m"), F.col("start"), F.col("end"))
    covered = in_months(archive.select("id", "start", "end")).groupBy("id", "m").agg(F.bit_or(bits).alias("days"))
    spans = windows.select("id", "start", "end").distinct()
    met = in_months(spans).join(covered, ["id", "m"]).filter(bits.bitwiseAND(F.col("days")) != 0).select("id", "start", "end").distinct()
    return windows.join(met, ["id", "start", "end"], "left_anti").select(*windows.columns)
