"""Names every runnable query of the engine and its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import contract_queries, report_queries, retrieval_queries, rule_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (retrieval_queries, rule_queries, report_queries, contract_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: lexical and dense rankings of all records, fused by reciprocal ranks."""
    return retrieval_queries.hybrid_rrf_topk(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
