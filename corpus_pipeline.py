"""A corpus from raw documents to packed sequences: each stage is one operator over all that its predecessor kept.

Toxicity drops what the classifier scores 0.5 or more; near-dedup keeps one document of each group of texts whose
five-word shingles are 0.8 alike or more; decontamination drops documents that hold a benchmark phrase; personal
data is replaced by its kind in brackets; packing cuts what is left into power-of-two sequences. Labels and
benchmark items are read from the tables beside ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryflow.llm import decontam, neardup, packing, pii, toxicity
from quarryflow.llm.common import materialize, table


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.op5_packing(docs)


STAGES = [("toxicity", civil), ("simhash_near_dedup", distinct), ("decontamination", unseen), ("pii", private), ("packing", packed)]

#: Trained scores, near-duplicate classes and a tokenizer are not for SQL; tests hold each stage to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
