"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as the session names it. Where it names none, a local session has one of its own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.gettempdir()}/checkpoints-{spark.sparkContext.applicationId}"
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with its place from 0 in the order of ``by`` as ``name``.

    Rows are range-partitioned and numbered in their partition; a partition's first number
    is the sum of the sizes before it, from one row a partition.
    """
    inside = Window.partitionBy("__part").orderBy(by)
    parts = df.repartitionByRange(by).withColumn("__part", F.spark_partition_id())
    placed = written(parts.withColumn("__at", F.row_number().over(inside) - 1), "numbered")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("__part", before.alias("__first"))
    return placed.join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + F.col("__at")).drop("__part", "__first", "__at")
