"""A corpus pipeline: documents to packed training sequences, in five stages.

Each stage reads what the one before it wrote; all but the last return the
columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from originlake.llm import convnet, jaccard, pack, pii, suffix_dedup
from originlake.llm.text import cut, drop, settled


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the quality classifier, trained on ``labels``, does not reject."""
    weights = convnet.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return convnet.keep(docs, weights)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near duplicates one row with the smallest id; texts without words all stay.

    Rows are told apart by a number of their own, so those that share an id, or have none, are judged by their texts.
    """
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = cut(jaccard.near_duplicates(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id"))
    first = F.min(F.struct("doc_id", "_row"))["_row"].alias("_first")
    several = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    copies = cut(groups.join(several, "component_id").join(rows.select("_row", "doc_id"), "_row"))
    extra = copies.join(copies.groupBy("component_id").agg(first), "component_id").where("_row <> _first").select("_row")
    return rows.join(extra, "_row", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings of 100 that stand earlier; documents of which nothing is left go, those empty before stay."""
    kept = suffix_dedup.dedup(docs.withColumn("_empty", F.coalesce(F.length("text"), F.lit(0)) == 0))
    return kept.where("_empty or length(text) > 0").drop("_empty")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by marks."""
    return pii.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and their places in sequences."""
    return pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: Training, sketches and tokenizers are beyond SQL; tests compare the stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each but the last written and read again; what a stage read and wrote besides is removed after it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = settled(functools.partial(stage, spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
