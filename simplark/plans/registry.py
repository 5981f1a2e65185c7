"""All queries over the reference tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from simplark.plans import core_queries, model_queries, relation_queries

FAMILIES = (core_queries, relation_queries, model_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for f in FAMILIES for name, q in f.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for f in FAMILIES for name, sql in f.ORACLE_SQL.items()}
