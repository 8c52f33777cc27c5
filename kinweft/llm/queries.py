"""One query for each training-data operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweft.llm import decontaminate, divergence, hard_negatives, html_wrapper, kneser_ney, line_dedup, minhash_dedup, packing, paragraph_dedup, quality, secret_scan, sql, token_counts, url_rules

PACK_TOKENIZER, PACK_END, PACK_SIZE = "byte_bpe_50k.json", 2, 1024
COUNT_TOKENIZER, COUNT_LIMIT = "word_bpe_49k.json", 2048
URL_RULES = (url_rules.Rule("net/", "block"), url_rules.Rule("example.net/en/", "allow"), url_rules.Rule("example.com/de/", "block"), url_rules.Rule("org/fr/", "allow"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_key")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = secret_scan.scan_versions(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind_order"] < len(secret_scan.BASE_RULES))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == r.kind)).cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE_RULES]  # noqa: B023
    return made.select("doc_id", *counts, F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeats(_table(spark, sf_dir, "documents")).drop("text_key")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_text(_table(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return kneser_ney.scores(docs, kneser_ney.train(docs, ~kneser_ney.held_out()))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), PACK_TOKENIZER, PACK_END, PACK_SIZE)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), COUNT_TOKENIZER, COUNT_LIMIT)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.drop_common_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": sql.NEAR_DUPLICATES, "op2_secret_scans": sql.SECRETS, "op5_benchmark_decontamination": sql.CONTAINED, "op6_quality_rules": quality.SQL, "op10_line_dedup": sql.LINES, "op11_source_divergence": divergence.sql(), "op12_hard_negatives": hard_negatives.sql(), "op13_url_filters": url_rules.sql(URL_RULES)}
