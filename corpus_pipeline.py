"""A training-data pipeline over ``documents``: five stages of the operators in tidewindow.llm.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, the last
one their encoding. Between stages documents are written as Parquet and read again.

Stages decide on rows, not on ids: a row's key is its position in the files of its stage's
input, so rows without an id and rows that share one are kept or dropped each by itself. What
a stage drops is a list of positions for each file; the documents themselves are neither
copied nor shuffled to leave them out.

Null and empty texts are equal to each other, have no near copies, no tokens to weigh, and
encode to no ids; of ties (equal ids in a group) the earlier row stays; tables without rows
go through all stages; columns of any name go through unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewindow.llm.bpe_automaton import bpe_round_trip
from tidewindow.llm.common import shared_dir, table, tokenizer_json, written
from tidewindow.llm.exact_dedup import exact_dedup
from tidewindow.llm.mixing import mix_sources
from tidewindow.llm.near_dup import near_duplicates
from tidewindow.llm.positions import Placed
from tidewindow.llm.toxicity import fit_toxicity, without_toxic

#: A row's key while a stage decides, and the key that operators see.
ROW, NODE = "__row", "__node"


def _all_but_first(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """ROW of all rows in a group (ROW, group) that has a row of a smaller id, or of the same id and a smaller key; null ids come last."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    members = rows.select("doc_id", ROW).join(groups, ROW)
    first = members.groupBy("group").agg(F.min(order).alias("first"))
    return members.join(first, "group").filter(F.col(ROW) != F.col(f"first.{ROW}")).select(ROW)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half; rows without an id stay."""
    return without_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that of the smallest id; a row without an id only where no other row has the text."""
    docs = Placed(docs, ROW)
    found = exact_dedup(docs.rows, key=ROW).filter("group_size > 1")
    return docs.without(_all_but_first(docs.rows, found.select(ROW, F.col("keep_id").alias("group"))))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row, that of the smallest id; rows without an id stay."""
    docs = Placed(docs, ROW)
    nodes = docs.rows.withColumn(NODE, F.when(F.col("doc_id").isNotNull(), F.col(ROW)))
    found = written(near_duplicates(nodes, key=NODE).filter(F.col(NODE).isNotNull()).select(F.col(NODE).alias(ROW), F.col("component_id").alias("group")), "components")
    several = found.filter(F.col(ROW) != F.col("group")).select("group").distinct()
    return docs.without(_all_but_first(docs.rows, found.join(several, "group", "left_semi")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the flattened weights of sources, languages and topics, without repeats: 80 % of tokens or what the weights allow."""
    docs = Placed(docs, ROW)
    mixed = mix_sources(docs.rows, budget=0.8, key=ROW, drawn_by="doc_id", tokenizer=tokenizer_json("byte_bpe_50k.json"))
    return docs.without(mixed.filter("not coalesce(taken, false)").select(ROW))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens, and digests of ids and decoded text, of each document."""
    return bpe_round_trip(docs, tokenizer_json("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_duplicates),
    ("MinHash near-dedup", near_duplicates_stage),
    ("mixing", mixing),
    ("BPE encoding and decoding", encoding),
]

#: The classifier, the raked weights and the tokenizer can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
