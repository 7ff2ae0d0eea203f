"""Routes to publish: live bonuses joined with history, and forecasts of the others."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewindow.functions.dates import parse_end_date
from tidewindow.functions.names import BANK_ALIASES, PARTNER_ALIASES, alias_map, display_name, resolved, route_id

#: Forecasts that are published at most, and what stands for an unknown time.
MOST_FORECASTS, UNKNOWN = 60, "—"


def resolve_bonuses(raw: DataFrame) -> DataFrame:
    """Raw bonuses (ord, bankName, partnerName, pct, endDateRaw, sourceUrl) with ``bank``, ``code``, ``id`` where known."""
    spark = raw.sparkSession
    rows = raw.withColumns({"bank": resolved(F.col("bankName"), alias_map(spark, BANK_ALIASES)), "code": resolved(F.col("partnerName"), alias_map(spark, PARTNER_ALIASES))})
    return rows.withColumn("id", F.when(F.col("bank").isNotNull() & F.col("code").isNotNull(), route_id(F.col("bank"), F.col("code"))))


def unmapped(resolved_rows: DataFrame) -> DataFrame:
    """The rows that have no route, with the reason; the bank is looked at first."""
    reason = F.when(F.col("bank").isNull(), F.concat(F.lit('unknown bank "'), F.coalesce("bankName", F.lit("")), F.lit('"')))
    reason = reason.otherwise(F.concat(F.lit('unknown partner "'), F.coalesce("partnerName", F.lit("")), F.lit('"')))
    return resolved_rows.filter("id is null").select("ord", "bankName", "partnerName", "pct", "endDateRaw", "sourceUrl", reason.alias("reason"))


def best_bonuses(resolved_rows: DataFrame, now: date, *, day_first: Column | None = None) -> DataFrame:
    """One row a route: the highest pct, the first of equals; ``seen`` is the route's first row, ``urls`` those of all its rows in order."""
    rows = resolved_rows.filter("id is not null").withColumn("endDate", parse_end_date(F.col("endDateRaw"), F.lit(now), day_first=day_first))
    urls = rows.groupBy("id", "sourceUrl").agg(F.min("ord").alias("at")).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "sourceUrl"))), lambda x: x["sourceUrl"]).alias("urls"))
    best = rows.groupBy("id", "bank", "code").agg(F.max_by(F.struct("pct", "endDate"), F.struct("pct", -F.col("ord"))).alias("b"), F.min("ord").alias("seen"))
    return best.join(urls, "id").select("id", "bank", "code", "b.pct", "b.endDate", "seen", "urls")


def with_names(rows: DataFrame, times: DataFrame | None) -> DataFrame:
    """``rows`` (bank, code) with the name shown for the code and the time a transfer takes."""
    rows = rows.withColumn("airline", display_name(F.col("code")))
    if times is None:
        return rows.withColumn("time", F.lit(UNKNOWN))
    return rows.join(times.select("bank", "code", "time"), ["bank", "code"], "left").withColumn("time", F.coalesce("time", F.lit(UNKNOWN)))


FIELDS = ("id", "bank", "airline", "code", "time", "typical", "mp", "p2", "wait", "active", "ended", "next", "hist")


def live_routes(best: DataFrame, history: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Live routes in order of first appearance (``pos``). Without history the arrays are zeros, without an end date a route isn't active."""
    zeros = F.array_repeat(F.lit(0.0), 12)
    none = F.array().cast("array<struct<w:string,pct:double,len:string>>")
    h = history.select("id", "typical", "mp", "p2", "wait", "ended", "hist")
    rows = with_names(best.join(h, "id", "left"), times)
    active = F.when(F.col("endDate").isNotNull(), F.struct("pct", "endDate"))
    return rows.select(
        "id", "bank", "airline", "code", "time", F.coalesce("typical", F.lit(UNKNOWN)).alias("typical"), F.coalesce("mp", zeros).alias("mp"), F.coalesce("p2", zeros).alias("p2"), "wait",
        active.alias("active"), F.when(F.col("endDate").isNull(), F.col("ended")).alias("ended"), F.lit(None).cast("struct<label:string,prob:int>").alias("next"), F.coalesce("hist", none).alias("hist"),
        F.struct(F.lit(0).alias("part"), F.col("seen").cast("bigint").alias("at")).alias("pos"),
    )


def forecast_routes(history: DataFrame, live: DataFrame, times: DataFrame | None = None, *, most: int = MOST_FORECASTS) -> DataFrame:
    """Routes that aren't live: those with ``next``, recently ended ones first, then by probability, ``most`` of them; then those that only ended.

    ``history`` has ``ord``, the order in which its routes came. The top rows are taken with a limit, so no more than ``most`` rows a task meet.
    """
    rest = with_names(history.join(live.select("id"), "id", "left_anti"), times).withColumn("active", F.lit(None).cast("struct<pct:double,endDate:date>"))
    rank = [F.col("ended").isNotNull().desc(), F.col("next.prob").desc(), F.col("ord")]
    top = rest.filter("next is not null").orderBy(*rank).limit(most)
    top = top.withColumn("pos", F.struct(F.lit(1).alias("part"), F.row_number().over(Window.orderBy(*rank)).cast("bigint").alias("at")))  # of at most `most` rows
    ended = rest.filter("next is null and ended is not null").withColumn("pos", F.struct(F.lit(2).alias("part"), F.col("ord").cast("bigint").alias("at")))
    return top.select(*FIELDS, "pos").unionByName(ended.select(*FIELDS, "pos"))


def all_routes(raw: DataFrame, history: DataFrame, now: date, times: DataFrame | None = None, *, most: int = MOST_FORECASTS, day_first: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(routes with ``pos``, unmapped rows) of raw bonuses and :func:`derive_history` rows that also have ``hist`` and ``ord``."""
    rows = resolve_bonuses(raw)
    live = live_routes(best_bonuses(rows, now, day_first=day_first), history, times)
    return live.unionByName(forecast_routes(history, live, times, most=most)), unmapped(rows)


def stale_fill(candidate: DataFrame, previous: DataFrame) -> DataFrame:
    """``candidate`` and, behind it, the previous routes whose id it lacks."""
    old = previous.join(candidate.select("id"), "id", "left_anti")
    if "pos" in candidate.columns:
        old = old.withColumn("pos", F.struct(F.lit(3).alias("part"), F.coalesce(old["pos"]["at"], F.lit(0)).cast("bigint").alias("at")) if "pos" in old.columns else F.struct(F.lit(3).alias("part"), F.lit(0).cast("bigint").alias("at")))
    return candidate.unionByName(old, allowMissingColumns=True)
