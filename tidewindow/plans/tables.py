"""Windows, sightings and dates made from the supplied tables, for the queries.

An urgent order of over 400,000 is a window of its customer's route: the market segment
stands for the bank, the nation for the partner.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.functions.dates import month_index
from tidewindow.functions.names import route_id

NOW, FEED_DAY = date(2001, 8, 2), date(2001, 8, 1)
CUTOFFS = (date(1999, 1, 1), date(2001, 6, 1))
LARGE, DAYS = 400_000, 35


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_windows(spark: SparkSession, sf_dir: str, priority: str = "1-URGENT") -> DataFrame:
    """``id, bank, code, start, end, pct, s, e, ord``."""
    orders = table(spark, sf_dir, "orders").filter((F.col("o_orderpriority") == priority) & (F.col("o_totalprice") > LARGE))
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    start = F.to_date("o_orderdate")
    rows = rows.select(
        route_id(F.col("c_mktsegment"), F.col("n_name")).alias("id"), F.col("c_mktsegment").alias("bank"), F.col("n_name").alias("code"), start.alias("start"),
        F.date_add(start, (F.col("o_orderkey") % DAYS).cast("int")).alias("end"), (10 + 5 * (F.col("o_orderkey") % 10)).cast("double").alias("pct"), F.col("o_orderkey").alias("ord"),
    )
    return rows.withColumns({"s": month_index(F.col("start")), "e": month_index(F.col("end"))})
