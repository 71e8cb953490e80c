"""From raw documents to token ids: rated, deduplicated, free of benchmark passages and secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofline.llm import decontaminate, quality, secrets, sentencepiece_codec, simhash
from proofline.llm.common import cut_table, table


def rated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rating is likelier than not to be above the lowest; all columns as they were."""
    return quality.select(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id (null last); of its repeated rows one."""
    return simhash.distinct(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage of weight; all columns as they were."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret replaced by a mark."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document."""
    return sentencepiece_codec.encode(docs).select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", rated), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("secrets", redacted), ("sentencepiece", tokens)]
#: No stage can be left out, and SQL expresses neither the fitted model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
