"""Query name -> Spark callable, and query name -> the same question as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spandrel.plans import benchmark_queries, document_queries, extraction_queries, receipt_queries

FLAGSHIP = "r1_topk_bigram"
PARTS = (receipt_queries, extraction_queries, document_queries, benchmark_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in PARTS for k, v in p.ORACLES.items()}
