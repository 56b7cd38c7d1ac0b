"""Registered queries of the analytics layers over the test tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulon.catalog import answers, changes, coding, evidence, judgements, records, recoding, tables, text, views

MODULES = (tables, coding, evidence, text, views, changes, recoding, judgements, records, answers)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-way analysis of variance of order prices by priority."""
    return QUERIES["anova_orders"](spark, sf_dir)
