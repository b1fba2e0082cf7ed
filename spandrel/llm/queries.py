"""Queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spandrel.llm import bit_sliced_topk, chat_format, language_mixture, license_scan, packing, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, simhash_dedup, spelling_variants, vector_codes, warc
from spandrel.sources.tables import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_findings(table(spark, sf_dir, "documents"), partial=True)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.format_conversations(rows))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secret_scan.train(secret_scan.labelled(spark), public_tokenizers.path("piece_bpe_32k.model"))
    return secret_scan.secret_findings(table(spark, sf_dir, "documents"), forest)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op13_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.languages(table(spark, sf_dir, "documents"))


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the default policy rejects, and rejects alone, from the ledger of op3."""
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents")))


def packing_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing under capacities that bind beside the tokens: six documents, and the attention cost of one and a half
    pieces of half a sequence."""
    capacity = packing.Capacity(2048, 6, 1.5 * 1024**2, weights=(1.0, 0.5, 0.5), rule="dot", piece=1024)
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_chat_format": op5_chat_format,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_exact_topk": op10_exact_topk,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_codes": op12_vector_codes,
    "op13_language_mixture": op13_language_mixture,
    "rules_ablation": rules_ablation,
    "packing_capacities": packing_capacities,
}
ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op10_exact_topk": bit_sliced_topk.ORACLE,
    "op11_spelling_variants": spelling_variants.ORACLE,
    "op12_vector_codes": vector_codes.oracle(),
    "rules_ablation": quality_rules.ABLATION_ORACLE,
}
