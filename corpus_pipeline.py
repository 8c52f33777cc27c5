"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read again as the
next stage's documents.  All but the last return the columns of ``documents``; where a stage changes texts it
brings ``n_chars`` up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft.llm import decontaminate, line_dedup, minhash_dedup, packing, quality
from kinweft.llm.queries import PACK_END, PACK_SIZE, PACK_TOKENIZER
from kinweft.llm.shared import durable


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, less their failing lines."""
    return _counted(quality.clean(docs))


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that ten or more of them share.  A document may become empty; it stays."""
    return _counted(line_dedup.drop_common_lines(docs).drop("n_lines", "n_dropped"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return minhash_dedup.keep_first(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in packed sequences."""
    return packing.packed_documents(docs, PACK_TOKENIZER, PACK_END, PACK_SIZE)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", common_lines),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_items),
    ("packing", sequences),
]

#: SQL cannot express tokenization; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
