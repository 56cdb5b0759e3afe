"""Named queries over a folder of tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import claim_queries, governance_queries, proof_queries, report_queries, request_queries, scoring_queries, shape_queries, source_queries, structure_queries, text_queries, view_queries

MODULES = (text_queries, scoring_queries, source_queries, claim_queries, report_queries, governance_queries, structure_queries, view_queries, proof_queries, shape_queries, request_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
