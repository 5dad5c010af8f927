"""Registered queries of the escalation-index operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tocsin.queries import board, landed, scores, texts, views  # noqa: F401
from tocsin.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["composite_index_history"](spark, sf_dir)
