"""Queries over the fixture tables by name, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import relational, versioned

QUERIES = relational.QUERIES | versioned.QUERIES
ORACLE_SQL = relational.ORACLE_SQL | versioned.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["merged_fresh"](spark, sf_dir)
