"""A corpus pipeline of five stages over `documents`; part of the language-model operators.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes it as Parquet below the shared folder and
reads it again as the next stage's docs. All but the last return the columns of documents, texts whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm import packing, quality_classifier, quality_rules, secret_scan, simhash_dedup
from spandrel.llm.common import staged
from spandrel.sources.tables import importable, table


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    return quality_rules.keep_documents(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low posterior quality, and toxic ones, go."""
    importable(spark)
    return quality_classifier.keep_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    importable(spark)
    return simhash_dedup.keep_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark; no document goes."""
    importable(spark)
    forest = secret_scan.train(secret_scan.labelled(spark), public_tokenizers.path("piece_bpe_32k.model"))
    clean = docs.withColumn("text", secret_scan.redacted(F.col("text"), F.col("source"), forest))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    importable(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL: a fitted classifier, fingerprints, a forest and a tokenizer have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage-{k}")
    return docs
